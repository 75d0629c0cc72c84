"""Result tables: runs, replays, bounded files and the log that says what counts."""

import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import postlark as pl
from postlark.schemas import FEED, LANGUAGE_COUNTS, WORD_COUNTS
from postlark.streaming.commits import CommitLog
from postlark.streaming.files import Directory


def rows(frame):
    return sorted(tuple(row) for row in frame.collect())


def counts(spark, **values):
    return spark.createDataFrame(list(values.items()), "language string, tweet_count long")


# --- the commit log ---


def test_an_early_reader_sees_every_later_batch(spark, tmp_path):
    def table():
        return pl.SnapshotTable(spark, str(tmp_path), LANGUAGE_COUNTS)

    early = table()
    assert rows(early.read()) == [] and early.run is None and early.committed() == []
    writer = table()
    for batch_id in range(3):
        writer.write(counts(spark, en=batch_id), batch_id)
        assert rows(early.read()) == rows(table().read()) == [("en", batch_id)]
    # A later run is followed too.
    other = table()
    other.bind(f"{tmp_path}/checkpoint")
    assert rows(early.read()) == []
    other.write(counts(spark, fr=1), 0)
    assert rows(early.read()) == [("fr", 1)] and rows(writer.read()) == [("en", 2)]


def test_writers_that_start_together_get_runs_of_their_own(spark, tmp_path):
    log, claimed, start = CommitLog(spark, str(tmp_path)), [], threading.Barrier(12)

    def claim(writer):
        start.wait()
        claimed.append(log.claim(writer))

    threads = [threading.Thread(target=claim, args=(f"{i:032x}",)) for i in range(12)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(set(claimed)) == 12 and sorted(claimed) == log.runs()
    assert [int(run[4:10]) for run in log.runs()] == list(range(12))
    assert log.newest() == log.runs()[-1]
    assert log.claim(f"{3:032x}") in claimed and len(log.runs()) == 12


def test_a_checkpoint_that_starts_twice_at_once_has_one_run(spark, tmp_path):
    found = []

    def bind():
        table = pl.SnapshotTable(spark, f"{tmp_path}/result", LANGUAGE_COUNTS)
        table.bind(f"{tmp_path}/checkpoint")
        found.append(table.run)

    threads = [threading.Thread(target=bind) for _ in range(6)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(found) == 6 and len(set(found)) == 1


@pytest.mark.parametrize("way", ["put_if_absent", "_rename"])
def test_put_if_absent(spark, tmp_path, way):
    """By a link on a local disk; by renaming, as on HDFS."""
    directory = Directory(spark, f"{tmp_path}/log")
    directory.create()
    put = getattr(directory, way)
    assert put("a", "first") and not put("a", "second") and put("b", "other")
    assert directory.text("a") == "first" and directory.text("b") == "other"
    assert [name for name in directory.names() if not name.startswith(".")] == ["a", "b"] or sorted(
        name for name in directory.names() if not name.startswith(".")
    ) == ["a", "b"]


def test_ages_are_those_of_the_markers(spark, tmp_path):
    """Folders have no times on object stores; here theirs are made to mislead."""
    import os

    table = pl.SnapshotTable(spark, str(tmp_path), LANGUAGE_COUNTS, keep=2, keep_seconds=100)
    for batch_id in range(4):
        table.write(counts(spark, en=batch_id), batch_id)
        os.utime(tmp_path / table.run / f"batch_id={batch_id}", (0, 0))
    assert table.committed() == [0, 1, 2, 3]
    for batch_id in range(3):
        marker = tmp_path / table.run / "_commits" / f"batch_id={batch_id}"
        os.utime(marker, (marker.stat().st_mtime - 200,) * 2)
    table.write(counts(spark, en=4), 4)
    assert table.committed() == [3, 4]
    assert rows(table.read()) == [("en", 4)]
    assert not (tmp_path / table.run / "batch_id=0").exists()


def test_data_without_a_marker_does_not_count(spark, tmp_path):
    table = pl.SumTable(spark, str(tmp_path), LANGUAGE_COUNTS, key="language", total="tweet_count")
    table.write(counts(spark, en=1), 0)
    counts(spark, en=5).write.parquet(f"{tmp_path}/{table.run}/batch_id=1")
    assert rows(table.read()) == [("en", 1)]
    table.write(counts(spark, en=7), 1)
    assert rows(table.read()) == [("en", 8)]


# --- sums ---


def test_sums_add_up_once_per_batch(spark, tmp_path):
    pick = random.Random(4)
    table = pl.SumTable(
        spark, str(tmp_path), WORD_COUNTS, key="word", total="word_count", keep_seconds=0, compact_every=3
    )
    totals = {}
    for batch_id in range(10):
        batch = {f"w{pick.randrange(6)}": pick.randrange(1, 9) for _ in range(4)}
        for word, n in batch.items():
            totals[word] = totals.get(word, 0) + n
        for _ in range(1 + batch_id % 2):  # a replay
            table.write(spark.createDataFrame(list(batch.items()), WORD_COUNTS), batch_id)
        assert dict(rows(table.read())) == totals
    assert table.committed("whole_id") == [5, 8]
    assert table.committed() == [6, 7, 8, 9]


# --- appended rows ---


def feed_table(spark, path, **options):
    return pl.AppendTable(spark, str(path), FEED, **options)


def line(spark, n):
    return spark.range(n, n + 1).select(
        F.col("id").alias("UserID"), F.lit("now").alias("created_at"),
        F.concat(F.lit("line "), F.col("id")).alias("line"), F.current_timestamp().alias("arrived"),
    )


def data_files(path):
    return [f for f in Path(path).glob("run=*/segment=*/*") if f.suffix in (".parquet", ".csv")]


def test_a_thousand_one_row_batches_stay_bounded(spark, tmp_path):
    """Each row once, also after replays; 1,000 batches are at most 15 segments of each of
    three sizes, and as many markers."""
    table = feed_table(spark, tmp_path, keep_seconds=0, files=1)
    for batch_id in range(1000):
        for _ in range(2 if batch_id % 97 == 0 or batch_id % 256 == 255 else 1):
            table.write(line(spark, batch_id), batch_id)
    assert rows(table.read().select("UserID")) == [(n,) for n in range(1000)]
    assert table.committed() == list(range(1000))
    markers = list((tmp_path / table.run / "_commits").glob("segment=*"))
    assert len(markers) <= 45 and len(data_files(tmp_path)) == len(markers)
    # 1000 = 3 * 256 + 14 * 16 + 8
    assert len(markers) == 3 + 14 + 8


def test_merged_segments_stay_for_their_readers(spark, tmp_path):
    table = feed_table(spark, tmp_path, fan=2, files=1)
    opened = None
    for batch_id in range(8):
        table.write(line(spark, batch_id), batch_id)
        opened = opened or table.read()
    assert rows(opened.select("UserID")) == [(0,)]
    assert rows(table.read().select("UserID")) == [(n,) for n in range(8)]
    assert len(data_files(tmp_path)) == 8 + 4 + 2 + 1


def test_a_crash_between_merge_and_removal_and_large_segments(spark, tmp_path):
    table = feed_table(spark, tmp_path, fan=2, keep_seconds=0)
    for batch_id in range(4):
        table.write(line(spark, batch_id), batch_id)
    # A part that was merged is left behind, marker and all.
    table._store(line(spark, 3), table._name(0, 3, 3), 1)
    assert rows(feed_table(spark, tmp_path).read().select("UserID")) == [(n,) for n in range(4)]
    table.write(line(spark, 4), 4)
    assert rows(table.read().select("UserID")) == [(n,) for n in range(5)]
    large = feed_table(spark, tmp_path / "large", fan=2, keep_seconds=0, segment_bytes=1)
    for batch_id in range(4):
        large.write(line(spark, batch_id), batch_id)
    assert rows(large.read().select("UserID")) == [(n,) for n in range(4)]
    assert sorted(large._segments()) == [(0, n, n) for n in range(4)]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_landing_table_gives_back_every_text(spark, tmp_path, format):
    texts = ['he said "hi", then', "two\nlines", " outer ", "\r", "", None, "Español"]
    posts = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "UserID long, Text string")
    posts = posts.select(
        *[F.col(c.name) if c.name in posts.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in pl.POST]
    )
    posts.repartition(5).write.parquet(f"{tmp_path}/source")
    table = pl.landing_table(spark, f"{tmp_path}/landing", format, fan=2, keep_seconds=0)
    incoming = pl.read_posts(spark, f"{tmp_path}/source", "parquet", pl.POST, stream=True, maxFilesPerTrigger=1)
    query = pl.land_batches(incoming, table, f"{tmp_path}/checkpoint", {"availableNow": True})
    assert query.awaitTermination(120)
    expected = [(i, t or None) for i, t in enumerate(texts * 3)]
    got = sorted(((r.UserID, r.Text) for r in table.read().collect()), key=lambda r: r[0])
    assert got == expected
    assert len(table._segments()) < 5
