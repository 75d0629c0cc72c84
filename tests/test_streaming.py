"""Streams give what the batch operators give, also when batches are replayed."""

import random
import threading
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import postlark as pl
from postlark.schemas import LANGUAGE_COUNTS, LANGUAGE_DISTRIBUTION, WORD_COUNTS
from postlark.streaming import reports
from postlark.streaming.runs import new_run, shared_root
from postlark.streaming.sinks import replace_all, upsert, upsert_top_words

ONCE = {"availableNow": True}
DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def rows(frame):
    return sorted(tuple(row) for row in frame.collect())


@pytest.fixture(scope="module")
def posts(spark):
    documents = spark.read.parquet(DOCUMENTS)
    language = F.when(F.col("source") == "src0", None).otherwise(F.col("lang"))
    filled = {
        "UserName": F.col("source"),
        "UserID": F.col("doc_id"),
        "Language": language,
        "Text": F.col("text"),
    }
    return documents.select(
        *[filled.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in pl.POST]
    )


@pytest.fixture(scope="module")
def source(posts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("source") / "posts")
    posts.repartition(4).write.parquet(path)
    return path


def stream(spark, source):
    return pl.read_posts(spark, source, "parquet", pl.POST, stream=True, maxFilesPerTrigger=1)


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("en", "English"), ("fr", "French")], "code string, name string")


def finish(spark, query):
    assert query.awaitTermination(120)
    assert len([p for p in query.recentProgress if p.numInputRows > 0]) == 4


def run(spark, schema, start):
    path = new_run(spark, "test")
    table = pl.SnapshotTable(spark, f"{path}/result", schema)
    finish(spark, start(table, f"{path}/checkpoint"))
    return table


def test_language_counts(spark, source, posts):
    table = run(
        spark,
        LANGUAGE_COUNTS,
        lambda t, c: reports.run_language_counts(stream(spark, source), t, c, trigger=ONCE),
    )
    assert rows(table.read()) == rows(pl.language_counts(posts))


def test_language_names(spark, source, posts, names):
    table = run(
        spark,
        LANGUAGE_COUNTS,
        lambda t, c: reports.run_language_names(stream(spark, source), names, t, c, trigger=ONCE),
    )
    assert rows(table.read()) == rows(pl.name_languages(pl.language_counts(posts), names))


def test_language_distribution(spark, source, posts, names):
    table = run(
        spark,
        LANGUAGE_DISTRIBUTION,
        lambda t, c: reports.run_language_distribution(
            stream(spark, source), names, t, c, trigger=ONCE
        ),
    )
    assert rows(table.read()) == rows(pl.language_distribution(posts, names))


def test_language_upserts(spark, source, posts):
    table = run(
        spark,
        LANGUAGE_COUNTS,
        lambda t, c: reports.run_language_upserts(stream(spark, source), t, c, trigger=ONCE),
    )
    assert rows(table.read()) == rows(pl.language_counts(posts))
    assert table.committed() == [0, 1, 2, 3]


def word_table(spark, path, **options):
    return pl.ChangeTable(spark, path, WORD_COUNTS, key="word", total="word_count", **options)


@pytest.mark.parametrize("compact_every", [2, 50])
def test_word_counts(spark, source, posts, compact_every):
    path = new_run(spark, "test")
    table = word_table(spark, f"{path}/result", compact_every=compact_every)
    query = reports.run_word_counts(stream(spark, source), table, f"{path}/checkpoint", trigger=ONCE)
    finish(spark, query)
    assert rows(table.read()) == rows(pl.word_counts(posts))
    assert table.committed("whole_id") == ([1, 3] if compact_every == 2 else [])


def totals(spark, **values):
    return spark.createDataFrame(list(values.items()), WORD_COUNTS)


def test_changes_merge_replay_and_compact(spark, tmp_path):
    table = word_table(spark, str(tmp_path), keep_seconds=0, compact_every=2)
    table.write(totals(spark, **{f"w{i}": 1 for i in range(2000)}), 0)
    for batch_id in range(1, 7):
        for _ in range(1 + batch_id % 2):  # a replay
            table.write(totals(spark, w1=batch_id + 1), batch_id)
        got = dict(rows(table.read()))
        assert len(got) == 2000 and got["w1"] == batch_id + 1 and got["w2"] == 1
    sizes = {
        n: sum(f.stat().st_size for f in tmp_path.glob(f"run=*/batch_id={n}/*.parquet")) for n in (5, 6)
    }
    assert 0 < max(sizes.values()) < 10_000  # a batch writes what it changed
    assert table.committed("whole_id") == [3, 5]
    assert table.committed() == [4, 5, 6]


@pytest.mark.parametrize("start", [reports.run_top_words, reports.run_top_words_complete])
def test_top_words(spark, source, posts, start):
    table = run(
        spark, WORD_COUNTS, lambda t, c: start(stream(spark, source), t, c, k=50, trigger=ONCE)
    )
    assert rows(table.read()) == rows(pl.most_frequent_words(posts, 50))


def test_feed(spark, source, posts, tmp_path):
    query = reports.run_feed(
        stream(spark, source), f"{tmp_path}/feed", f"{tmp_path}/checkpoint", trigger=ONCE
    )
    finish(spark, query)
    assert rows(spark.read.parquet(f"{tmp_path}/feed")) == rows(pl.feed(posts))


def test_same_checkpoint_continues_and_a_new_one_starts_over(spark, posts, tmp_path):
    path = str(tmp_path / "posts")
    table = pl.SnapshotTable(spark, f"{tmp_path}/result", LANGUAGE_COUNTS)

    def count(table, checkpoint):
        source = pl.read_posts(spark, path, "parquet", pl.POST, stream=True)
        query = reports.run_language_counts(source, table, checkpoint, trigger=ONCE)
        assert query.awaitTermination(120)
        return rows(table.read())

    posts.write.parquet(path)
    once = rows(pl.language_counts(posts))
    assert count(table, f"{tmp_path}/first") == once
    posts.write.mode("append").parquet(path)
    twice = [(language, 2 * n) for language, n in once]
    assert count(table, f"{tmp_path}/first") == twice
    fresh = pl.SnapshotTable(spark, f"{tmp_path}/fresh", LANGUAGE_COUNTS)
    assert count(fresh, f"{tmp_path}/second") == twice
    assert count(fresh, f"{tmp_path}/second") == twice


# --- sinks, called directly ---


def counts(spark, **values):
    return spark.createDataFrame(list(values.items()), "language string, tweet_count long")


def test_upsert_merges_and_replays(spark, tmp_path):
    table = pl.SnapshotTable(spark, str(tmp_path), LANGUAGE_COUNTS)
    store = upsert(table, "language")
    store(counts(spark, en=1, fr=2), 0)
    store(counts(spark, en=5, de=1), 1)
    expected = [("de", 1), ("en", 5), ("fr", 2)]
    assert rows(table.read()) == expected
    store(counts(spark, en=5, de=1), 1)
    assert rows(table.read()) == expected
    store(counts(spark, fr=3), 2)
    assert rows(table.read()) == [("de", 1), ("en", 5), ("fr", 3)]


def test_upsert_replaces_a_null_key(spark, tmp_path):
    table = pl.SnapshotTable(spark, str(tmp_path), LANGUAGE_COUNTS)
    store = upsert(table, "language")
    for batch_id, count in enumerate([1, 2]):
        store(spark.createDataFrame([(None, count)], LANGUAGE_COUNTS), batch_id)
    assert rows(table.read()) == [(None, 2)]


def test_replace_all_replays(spark, tmp_path):
    table = pl.SnapshotTable(spark, str(tmp_path), LANGUAGE_COUNTS)
    store = replace_all(table)
    store(counts(spark, en=1), 0)
    store(counts(spark, en=2, fr=1), 1)
    store(counts(spark, en=2, fr=1), 1)
    assert rows(table.read()) == [("en", 2), ("fr", 1)]
    assert table.committed() == [0, 1]


def test_top_words_from_changes_equal_top_words_from_all(spark, tmp_path):
    pick = random.Random(7)
    table = pl.SnapshotTable(spark, str(tmp_path), WORD_COUNTS)
    store = upsert_top_words(table, 4)
    totals = {}
    for batch_id in range(8):
        changed = {f"w{pick.randrange(12)}" for _ in range(5)}
        for word in changed:
            totals[word] = totals.get(word, 0) + pick.randrange(1, 4)
        batch = spark.createDataFrame([(w, totals[w]) for w in changed], WORD_COUNTS)
        for _ in range(1 + batch_id % 2):
            store(batch, batch_id)
        best = sorted(totals.items(), key=lambda item: (-item[1], item[0]))[:4]
        assert rows(table.read()) == sorted(best)


def test_snapshots_are_pruned_and_unfinished_ones_ignored(spark, tmp_path):
    table = pl.SnapshotTable(spark, str(tmp_path), LANGUAGE_COUNTS, keep=2, keep_seconds=0)
    assert rows(table.read()) == []
    for batch_id in range(4):
        table.write(counts(spark, en=batch_id), batch_id)
    assert table.committed() == [2, 3]
    (tmp_path / table.run / "batch_id=9").mkdir()
    assert table.committed() == [2, 3]
    assert rows(table.read()) == [("en", 3)]
    assert rows(table.latest(before=3)) == [("en", 2)]


def test_a_reader_outlasts_quick_batches(spark, tmp_path):
    table = pl.SnapshotTable(spark, str(tmp_path), LANGUAGE_COUNTS, keep=2)
    table.write(counts(spark, en=0), 0)
    opened = table.read()
    for batch_id in range(1, 31):
        table.write(counts(spark, en=batch_id), batch_id)
    assert rows(opened) == [("en", 0)]
    assert rows(table.read()) == [("en", 30)]


def test_snapshots_need_no_marker_of_the_file_system(spark, tmp_path):
    key = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set(key, "false")
    try:
        table = pl.SnapshotTable(spark, str(tmp_path), LANGUAGE_COUNTS)
        table.write(counts(spark, en=1), 0)
        assert rows(table.read()) == [("en", 1)]
    finally:
        hadoop.unset(key)


@pytest.mark.parametrize("old_batches", [3, 25])
def test_a_new_checkpoint_on_a_used_table_starts_a_run_of_its_own(spark, tmp_path, old_batches):
    def table():
        return pl.SnapshotTable(spark, f"{tmp_path}/result", LANGUAGE_COUNTS, keep=2, keep_seconds=0)

    old = table()
    old.bind(f"{tmp_path}/first")
    for batch_id in range(old_batches):
        old.write(counts(spark, en=batch_id), batch_id)
    new = table()
    new.bind(f"{tmp_path}/second")
    assert rows(table().read()) == []
    store = upsert(new, "language")
    store(counts(spark, fr=1), 0)
    store(counts(spark, de=1), 1)
    assert rows(new.read()) == rows(table().read()) == [("de", 1), ("fr", 1)]
    again = table()
    again.bind(f"{tmp_path}/first")
    assert rows(again.read()) == [("en", old_batches - 1)]
    assert again.run == old.run != new.run
    again.remove()
    assert not (tmp_path / "result").exists()


def test_empty_snapshot_replaces_a_full_one(spark, tmp_path):
    table = pl.SnapshotTable(spark, str(tmp_path), LANGUAGE_COUNTS)
    table.write(counts(spark, en=1), 0)
    table.write(counts(spark, en=1).where("false"), 1)
    assert rows(table.read()) == []


def test_snapshot_files(spark, tmp_path):
    many = spark.range(0, 40, 1, 16).select(
        F.col("id").cast("string").alias("language"), F.lit(1).cast("long").alias("tweet_count")
    )
    for files, rows_per_file, expected in ((None, 100, 16), (1, 100, 1), (1, 10, 4)):
        path = tmp_path / f"{files}-{rows_per_file}"
        table = pl.SnapshotTable(
            spark, str(path), LANGUAGE_COUNTS, files=files, rows_per_file=rows_per_file
        )
        replace_all(table)(many, 0)
        assert table.read().count() == 40
        assert len(list(path.glob("run=*/batch_id=0/*.parquet"))) == expected


# --- runs and sessions ---


def test_shared_root_is_required_on_a_cluster():
    def session(master, root):
        conf = SimpleNamespace(get=lambda key, default: root or default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_root(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        shared_root(session("yarn", None))


@pytest.mark.parametrize("readers", ["one", "each"])
@pytest.mark.parametrize("landing_format", ["parquet", "csv"])
def test_session_once(spark, source, posts, names, landing_format, readers):
    keywords = "that with, dans"
    session = pl.PostSession(
        spark, stream(spark, source), keywords, names, landing_format=landing_format, readers=readers
    )
    session.start(once=True)
    session.await_termination()
    session.stop()
    matching = pl.keyword_filter(posts, keywords)
    assert rows(session.languages()) == rows(pl.language_distribution(matching, names))
    assert rows(session.top_words()) == rows(pl.most_frequent_words(matching))
    assert feed(session) == rows(pl.feed(matching))
    assert rows(session.landed()) == rows(matching.withColumn("Text", F.nullif("Text", F.lit(""))))


def feed(session):
    lines = session.feed()
    assert lines.where("arrived IS NULL OR UserID IS NULL").isEmpty()
    return rows(lines.select("line"))


def test_session_runs_signals_stops_and_starts_over(spark, posts, tmp_path):
    path = str(tmp_path / "incoming")
    posts.limit(0).write.parquet(path)
    incoming = pl.read_posts(spark, path, "parquet", pl.POST, stream=True)
    changed, signals = threading.Event(), []

    def on_change(report):
        signals.append(report)
        if {"intake", "languages", "words", "feed"} <= set(signals):
            changed.set()

    session = pl.PostSession(spark, incoming, "that", on_change=on_change, readers="each")
    queries = session.start()
    assert set(queries) == {"intake", "languages", "words", "feed"}
    assert all(query.isActive for query in queries.values())
    with pytest.raises(RuntimeError):
        session.start()
    posts.write.mode("append").parquet(path)
    assert changed.wait(90)
    session.stop(drain=True)
    assert not any(query.isActive for query in queries.values())
    matching = pl.keyword_filter(posts, "that")
    assert feed(session) == rows(pl.feed(matching))
    assert rows(session.top_words()) == rows(pl.most_frequent_words(matching))

    first = session.run_dir
    session.start(once=True)
    session.await_termination()
    session.stop()
    assert session.run_dir != first
    assert feed(session) == rows(pl.feed(matching))


def test_both_landing_formats_agree_on_empty_languages(spark, tmp_path):
    values = [(1, "en"), (2, ""), (3, None), (4, "und")]
    frame = spark.createDataFrame(values, "UserID long, Language string")
    columns = [
        F.lit("tea time").alias(c.name) if c.name == "Text"
        else F.col(c.name) if c.name in frame.columns else F.lit(None).cast(c.dataType).alias(c.name)
        for c in pl.POST
    ]
    frame.select(columns).write.parquet(f"{tmp_path}/posts")
    got = []
    for landing_format in ("parquet", "csv"):
        session = pl.PostSession(
            spark, stream(spark, f"{tmp_path}/posts"), "tea", landing_format=landing_format, readers="each"
        )
        session.start(once=True)
        session.await_termination()
        session.stop()
        got.append((rows(session.languages()), feed(session)))
    assert got[0] == got[1]
    assert got[0][0] == [("Undetermined", 1, 0.5), ("en", 1, 0.5)]


@pytest.mark.parametrize("report", ["intake", "languages", "words", "feed"])
def test_a_failed_query_is_raised(spark, posts, tmp_path, report, monkeypatch):
    """The query breaks while writing; waiting, stopping and reading all say so."""
    from postlark.streaming import session as S

    path = str(tmp_path / "posts")
    posts.write.parquet(path)
    broken = F.udf(lambda text: 1 // 0, "string")
    if report == "intake":
        original = S.stream_landing
        monkeypatch.setattr(
            S, "stream_landing", lambda p, *a, **k: original(p.withColumn("Place", broken("Text")), *a, **k)
        )
    elif report == "feed":
        original = S.reports.run_feed_table
        monkeypatch.setattr(
            S.reports, "run_feed_table", lambda p, *a, **k: original(p.withColumn("Text", broken("Text")), *a, **k)
        )
    else:
        name = {"languages": "run_language_distribution", "words": "run_top_words"}[report]
        original = getattr(S.reports, name)
        column = {"languages": "Language", "words": "Text"}[report]
        monkeypatch.setattr(
            S.reports, name, lambda p, *a, **k: original(p.withColumn(column, broken("Text")), *a, **k)
        )
    incoming = pl.read_posts(spark, path, "parquet", pl.POST, stream=True)
    session = pl.PostSession(spark, incoming, "that", state_partitions=2, readers="each")
    session.start()
    with pytest.raises(Exception, match="division|ZeroDivision"):
        session.await_termination()
    assert not any(query.isActive for query in session.queries.values())
    for call in (session.languages, session.top_words, session.feed, lambda: session.stop(drain=True)):
        with pytest.raises(Exception, match="division|ZeroDivision"):
            call()


def test_landed_files_are_bounded_and_a_removed_run_leaves_nothing(spark, source, tmp_path):
    spark_files = lambda run: list(Path(run.removeprefix("file:")).glob("landing/*.parquet"))
    session = pl.PostSession(
        spark, stream(spark, source), "that with, dans", files_per_batch=1, readers="each"
    )
    session.start(once=True)
    session.await_termination()
    run_dir = session.run_dir
    with_rows = [p for p in session.queries["intake"].recentProgress if p.numInputRows > 0]
    assert len(spark_files(run_dir)) <= len(with_rows) == 4
    session.stop()
    session.remove()
    assert not Path(run_dir.removeprefix("file:")).exists()


@pytest.mark.parametrize("readers", ["one", "each"])
def test_session_without_matches_is_empty(spark, source, readers):
    session = pl.PostSession(spark, stream(spark, source), "nosuchword", readers=readers)
    session.start(once=True)
    session.await_termination()
    session.stop()
    assert rows(session.languages()) == rows(session.top_words()) == rows(session.feed()) == []


@pytest.mark.parametrize("keywords", ["  ", None, ",!"])
def test_session_refuses_blank_keywords(spark, source, keywords):
    with pytest.raises(ValueError):
        pl.PostSession(spark, stream(spark, source), keywords)
