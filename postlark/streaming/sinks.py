"""``foreachBatch`` functions that keep a result table up to date."""

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.operators.words import top_words
from postlark.streaming.snapshots import SnapshotTable

BatchFunction = Callable[[DataFrame, int], None]


@contextmanager
def _held(batch: DataFrame) -> Iterator[None]:
    """Keep a batch that is read more than once."""
    batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        batch.unpersist()


def replace_all(
    table: SnapshotTable, transform: Callable[[DataFrame], DataFrame] | None = None
) -> BatchFunction:
    """Each batch is the whole result (complete mode): it becomes the snapshot.

    ``transform`` gets a static frame, so it may do what a streaming plan may not.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        if transform is None:
            table.write(batch, batch_id)
            return
        with _held(batch):
            table.write(transform(batch), batch_id)

    return store


def add_changes(table: SnapshotTable) -> BatchFunction:
    """Each batch holds what changed or came in and is written as it is."""

    def store(batch: DataFrame, batch_id: int) -> None:
        table.write(batch, batch_id)

    return store


def discard(batch: DataFrame, batch_id: int) -> None:
    """Run the batch for its state and keep nothing else."""
    batch.write.format("noop").mode("overwrite").save()


def fan_out(outputs: Sequence[tuple[SnapshotTable, Callable[[DataFrame], DataFrame]]]) -> BatchFunction:
    """Several tables from one batch, which is read once and held meanwhile.

    Each table counts a batch once, so a batch that failed half-way is simply done again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        with _held(batch):
            for table, make in outputs:
                table.write(make(batch), batch_id)

    return store


def upsert(table: SnapshotTable, key: str) -> BatchFunction:
    """Each batch holds the rows that changed (update mode): replace them by key.

    Every batch copies the table, so this is for results much smaller than the
    stream, such as a count per language.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        before = table.latest(batch_id, batch.sparkSession)
        if before is None:
            table.write(batch, batch_id)
            return
        with _held(batch):
            same = before[key].eqNullSafe(batch[key])
            table.write(before.join(batch, same, "left_anti").unionByName(batch), batch_id)

    return store


def upsert_top_words(table: SnapshotTable, k: int) -> BatchFunction:
    """Keep the k most frequent words from the counts that changed (update mode).

    Running totals never fall. So a word that did not change and was not among
    the first k still is not: the new list comes from the old one and the changed
    words, and the rest of the state need not be read. Where the old list holds a
    stale total of a changed word, either its new total is among the first k of
    the batch and wins by ``max``, or k others already beat it.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        before = table.latest(batch_id, batch.sparkSession)
        best = top_words(batch, k)
        if before is not None:
            candidates = best.unionByName(before)
            totals = candidates.groupBy("word").agg(F.max("word_count").alias("word_count"))
            best = top_words(totals, k)
        table.write(best, batch_id)

    return store
