"""The text operators against plain Python on random and skewed posts."""

import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import postlark as pl

WHITE = "[ \t\n\x0b\f\r]+"

pieces = st.sampled_from(
    ["that", "WITH", "dans", "it's", "ça", "É", "_x_", "日本語", " ", "á", "٣", "-", "!", "#",
     " ", "\n", "\t", "\x0b", "\r\n", "words", "0123", "İ", "ß"]
)
post_texts = st.lists(
    st.one_of(st.none(), st.lists(pieces, max_size=12).map("".join)), min_size=1, max_size=40
)


def expected_words(text):
    stripped = (re.sub(r"[^A-Za-z0-9_]", "", token) for token in re.split(WHITE, text or ""))
    return [word.lower() for word in stripped if len(word) > 3]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, Text string")


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(post_texts)
def test_word_counts_equal_python(spark, texts):
    expected = Counter(word for text in texts for word in expected_words(text))
    assert dict(map(tuple, pl.word_counts(frame(spark, texts)).collect())) == expected


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(post_texts)
def test_keyword_filter_equals_python(spark, texts):
    import unicodedata

    def tokens(text):
        for token in re.split(WHITE, text or ""):
            yield "".join(
                c for c in token if c == "_" or unicodedata.category(c)[0] in "LMN"
            ).lower()

    expected = []
    for number, text in enumerate(texts):
        found = set(tokens(text))
        if {"that", "with"} <= found or "dans" in found or "日本語" in found:
            expected.append(number)
    kept = pl.keyword_filter(frame(spark, texts), "that with, Dans, 日本語!")
    assert sorted(row.id for row in kept.collect()) == expected


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all words is one word, a third of all posts one language."""
    pick = random.Random(3)
    texts, languages = [], []
    for number in range(3_000):
        words = [f"w{pick.randrange(10_000):05d}" for _ in range(8)] + ["same"] * 4
        texts.append(" ".join(words))
        languages.append("en" if number % 3 == 0 else f"x{pick.randrange(500)}")
    posts = spark.createDataFrame(list(zip(languages, texts)), "Language string, Text string")
    return posts.repartition(8), languages, texts


def test_skewed_words(spark, skewed):
    posts, _, texts = skewed
    expected = Counter(word for text in texts for word in expected_words(text))
    assert dict(map(tuple, pl.word_counts(posts).collect())) == expected
    best = sorted(expected.items(), key=lambda item: (-item[1], item[0]))[:20]
    assert [tuple(r) for r in pl.most_frequent_words(posts, 20).collect()] == best
    assert best[0] == ("same", 12_000)


def test_skewed_languages(spark, skewed):
    posts, languages, _ = skewed
    expected = Counter(languages)
    names = spark.range(500).select(
        F.concat(F.lit("x"), "id").alias("code"), F.concat(F.lit("name "), "id").alias("name")
    )
    result = pl.language_distribution(posts, names).collect()
    assert {(r.language, r.tweet_count) for r in result} == {
        (code.replace("x", "name "), count) for code, count in expected.items()
    }
    assert abs(sum(r.share for r in result) - 1) < 1e-9


def test_totals_add_up_over_parts(spark, skewed):
    posts, _, _ = skewed
    part = F.length("Text") % 2 == 0
    whole = pl.word_counts(posts)
    parts = pl.word_counts(posts.where(part)).unionByName(pl.word_counts(posts.where(~part)))
    added = parts.groupBy("word").agg(F.sum("word_count").alias("word_count"))
    assert whole.exceptAll(added).isEmpty() and added.exceptAll(whole).isEmpty()
    top = pl.most_frequent_words(posts, 7)
    assert top.exceptAll(whole).isEmpty() and top.count() == 7
