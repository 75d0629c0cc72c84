"""Edge cases of the batch operators, on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

import postlark as pl


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def texts(spark, *values):
    return spark.createDataFrame([(value,) for value in values], "Text string")


def languages(spark, *values):
    return spark.createDataFrame([(value,) for value in values], "Language string")


# --- languages ---


def test_language_counts_skip_null_and_label_undetermined(spark):
    posts = languages(spark, "en", "en", None, None, "und", "zz")
    assert sorted(rows(pl.language_counts(posts))) == [("Undetermined", 1), ("en", 2), ("zz", 1)]


def test_null_and_undetermined_groups_stay_apart(spark):
    only_null = languages(spark, None, None)
    assert rows(pl.language_counts(only_null)) == []


def test_column_names_are_case_insensitive(spark):
    posts = languages(spark, "en")
    assert rows(pl.language_counts(posts, "LANGUAGE")) == [("en", 1)]


def test_names_fall_back_to_the_code_and_match_exactly(spark):
    counts = spark.createDataFrame(
        [("en", 2), ("zz", 1), ("EN", 4)], "language string, tweet_count long"
    )
    names = spark.createDataFrame([("en", "English"), ("fr", "French")], "code string, name string")
    named = pl.name_languages(counts, names)
    assert named.columns == ["language", "tweet_count"]
    assert sorted(rows(named)) == [("EN", 4), ("English", 2), ("zz", 1)]


def test_codes_listed_twice_do_not_multiply_counts(spark):
    counts = spark.createDataFrame([("en", 2)], "language string, tweet_count long")
    names = spark.createDataFrame(
        [("en", "English"), ("en", "Anglais"), (None, "nothing")], "code string, name string"
    )
    assert rows(pl.name_languages(counts, names)) == [("Anglais", 2)]


def test_codes_with_the_same_name_stay_apart(spark):
    counts = spark.createDataFrame([("nd", 2), ("nr", 3)], "language string, tweet_count long")
    names = spark.createDataFrame([("nd", "N"), ("nr", "N")], "code string, name string")
    assert sorted(rows(pl.name_languages(counts, names))) == [("N", 2), ("N", 3)]


def test_shares_sum_to_one(spark):
    posts = languages(spark, *["en"] * 5, *["fr"] * 3, "de", None)
    names = spark.createDataFrame([("fr", "French")], "code string, name string")
    result = {r.language: (r.tweet_count, r.share) for r in pl.language_distribution(posts, names).collect()}
    assert result == {"en": (5, 5 / 9), "French": (3, 3 / 9), "de": (1, 1 / 9)}


def test_lookup_file_with_quoted_names(spark, tmp_path):
    (tmp_path / "names.csv").write_text('alpha,Name\nen,English\nxx,"Foo, North; North Foo"\n')
    names = pl.read_language_names(spark, str(tmp_path / "names.csv"))
    assert rows(names.orderBy("code")) == [("en", "English"), ("xx", "Foo, North; North Foo")]


# --- words ---


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Español", ["espaol"]),
        ("https://t.co/abc #Tag", ["httpstcoabc"]),
        ("it's! abc. abcd", ["abcd"]),
        ("  leading\tand\u000btrailing \n", ["leading", "trailing"]),
        ("Same SAME same", ["same", "same", "same"]),
        ("snake_case 2024", ["snake_case", "2024"]),
        ("a non breaking blank", ["anonbreaking", "blank"]),
        ("日本語 text", ["text"]),
        ("... !!! ---", []),
        ("", []),
        (None, []),
    ],
)
def test_words(spark, text, expected):
    assert [row.word for row in pl.words(texts(spark, text)).collect()] == expected


def test_word_counts_and_ties(spark):
    posts = texts(spark, "beta alpha gamma", "alpha beta delta", "alpha", None)
    counts = pl.word_counts(posts)
    assert sorted(rows(counts)) == [("alpha", 3), ("beta", 2), ("delta", 1), ("gamma", 1)]
    assert rows(pl.top_words(counts, 3)) == [("alpha", 3), ("beta", 2), ("delta", 1)]


def test_top_list_needs_k_words(spark):
    posts = texts(spark, "alpha beta gamma delta")
    assert rows(pl.most_frequent_words(posts, 5)) == []
    assert len(rows(pl.most_frequent_words(posts, 4))) == 4
    assert len(rows(pl.most_frequent_words(posts, 5, full_only=False))) == 4


def test_retweets_count(spark):
    posts = spark.createDataFrame([("alpha", True), ("alpha", False)], "Text string, isRetweet boolean")
    assert rows(pl.word_counts(posts)) == [("alpha", 2)]


# --- keywords ---


def test_parse_keywords():
    assert pl.parse_keywords("that with, dans ,,") == [["that", "with"], ["dans"]]
    assert pl.parse_keywords(["#Café au-lait", "x,x", "!?"]) == [["Café", "aulait"], ["x"]]


@pytest.mark.parametrize("blank", [None, "", "  ", ",,", "!!, ?", []])
def test_blank_keywords_are_refused(spark, blank):
    with pytest.raises(ValueError):
        pl.keyword_filter(texts(spark, "x"), blank)


@pytest.mark.parametrize(
    "text, matches",
    [
        ("That is WITH me", True),
        ("only that", False),
        ("with\nthat", True),
        ("dans", True),
        ("(Dans!)", True),
        ("da-ns", True),
        ("danse", False),
        ("la danse dans", True),
        ("", False),
        (None, False),
    ],
)
def test_keyword_filter(spark, text, matches):
    kept = pl.keyword_filter(texts(spark, text), "that with, dans ,,")
    assert len(kept.collect()) == int(matches)


def test_keywords_of_other_scripts_and_accents(spark):
    posts = texts(spark, "ÉCOLE fermée", "ecole", "новости ДНЯ", "ΟΔΟΣ", "日本 語")
    keywords = "école, дня, οδος, 日本"
    assert [r.Text for r in pl.keyword_filter(posts, keywords).collect()] == [
        "ÉCOLE fermée",
        "новости ДНЯ",
        "ΟΔΟΣ",
        "日本 語",
    ]


def test_many_keywords(spark):
    posts = texts(spark, "word7 other", "word1 word2", "first7 second7", "first7 second8", "nothing")
    keywords = [f"word{i}" for i in range(3, 300)] + [f"first{i} second{i}" for i in range(300)]
    assert [r.Text for r in pl.keyword_filter(posts, keywords).collect()] == [
        "word7 other",
        "first7 second7",
    ]


# --- records ---


def nested(spark, **changes):
    post = {
        "user": {"name": "Ann", "id": 7},
        "created_at": datetime.datetime(2024, 1, 31, 23, 59, 8),
        "display_text_range": [0, 11],
        "favorite_count": 3,
        "lang": "en",
        "place": {"country": "FR", "coordinates": [[{"lat": 1.5, "lon": 2.0}]]},
        "retweet_count": 4,
        "text": "hello there",
        "retweeted_status": {"id": 9},
    }
    return spark.createDataFrame([{**post, **changes}], pl.NESTED_POST)


def test_flatten(spark):
    flat = pl.flatten_posts(nested(spark))
    assert flat.schema.names == pl.POST.names
    assert [c.dataType for c in flat.schema] == [c.dataType for c in pl.POST]
    assert rows(flat) == [
        (
            "Ann",
            7,
            "Wed Jan 31 23:59:08 UTC 2024",
            0,
            11,
            3,
            "en",
            "FR",
            '[[{"lat":1.5,"lon":2.0}]]',
            4,
            "hello there",
            True,
        )
    ]


@pytest.mark.parametrize(
    "place, expected",
    [
        (None, ("", "")),
        ({"country": "FR", "coordinates": None}, ("", "")),
        ({"country": None, "coordinates": [[{"lat": 1.0, "lon": 2.0}]]}, ("", '[[{"lat":1.0,"lon":2.0}]]')),
    ],
)
def test_place_and_coordinates_go_together(spark, place, expected):
    flat = pl.flatten_posts(nested(spark, place=place))
    assert rows(flat.select("Place", "Coordinates")) == [expected]


def test_flatten_missing_parts(spark):
    flat = pl.flatten_posts(
        nested(spark, user=None, display_text_range=[], retweeted_status=None, created_at=None)
    )
    row = flat.collect()[0]
    assert (row.UserName, row.UserID, row.created_at) == (None, None, None)
    assert (row.TextRangeStart, row.TextRangeEnd, row.isRetweet) == (None, None, False)


def test_created_at_reads_back(spark):
    frame = spark.createDataFrame([("Wed Jan 31 23:59:08 UTC 2024",), ("yesterday",), (None,)], "t string")
    parsed = frame.select(pl.parse_created_at(F.col("t")))
    assert rows(parsed) == [(datetime.datetime(2024, 1, 31, 23, 59, 8),), (None,), (None,)]


def test_feed_prints_missing_parts(spark):
    posts = spark.createDataFrame([("Ann", "hi"), (None, "hi"), ("Ann", None)], "UserName string, Text string")
    assert rows(pl.feed(posts)) == [("Ann:hi",), ("null:hi",), ("Ann:null",)]


def test_chart_series(spark):
    counts = spark.createDataFrame([("en", 2)], "language string, tweet_count long")
    series = pl.chart_series(counts, "language", "tweet_count")
    assert series.dtypes == [("name", "string"), ("value", "double")]
    assert rows(series) == [("en", 2.0)]


def test_intake_from_json_files_and_messages(spark, tmp_path):
    path = str(tmp_path / "posts")
    nested(spark).union(nested(spark, text="nothing here")).write.json(path)
    posts = pl.read_posts(spark, path)
    assert rows(pl.intake(posts, "THERE").select("Text")) == [("hello there",)]
    messages = spark.read.text(path).select(F.col("value").cast("binary").alias("value"))
    decoded = pl.flatten_posts(pl.decode_posts(messages))
    assert sorted(rows(decoded)) == sorted(rows(pl.flatten_posts(posts)))
    assert len(rows(decoded)) == 2


def test_registering_twice_replaces_the_view(spark):
    pl.register_posts(languages(spark, "en"), "some_posts")
    pl.register_posts(languages(spark, "fr"), "some_posts")
    assert rows(spark.sql("select language from some_posts")) == [("fr",)]


@pytest.mark.parametrize("text", ["Xyz Jul 04 10:00:00 UTC 2020", "    Jul 04 10:00:00 UTC 2020", "Sat", "", None])
def test_created_at_needs_a_weekday(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(pl.parse_created_at(F.col("t"))).head()[0] is None


def test_unreadable_payloads_are_set_aside(spark):
    payloads = [('{"text": "a"}',), ('{"text": ',), ("no json",), (None,), ('{"text": null}',)]
    messages = spark.createDataFrame(payloads, "value string")
    assert sorted(str(r.text) for r in pl.decode_posts(messages).collect()) == ["None", "a"]
    rejected = [r.payload for r in pl.rejected_payloads(messages).collect()]
    assert sorted(map(str, rejected)) == ["None", "no json", '{"text": ']
