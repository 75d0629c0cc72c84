"""The reports as running queries.

Every function takes the stream, where to keep results, a checkpoint path and
the arguments of ``_start``, and returns the started query. The checkpoint holds
the progress: the same one continues the totals, a new one starts from zero.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from pyspark.sql.types import StringType, StructField, StructType

from postlark.operators.feed import feed_lines
from postlark.operators.languages import language_counts, name_languages, with_share
from postlark.operators.words import top_words, word_counts
from postlark.schemas import REJECTED
from postlark.sources.landing import empty_as_null
from postlark.sources.lookup import Lookup
from postlark.streaming.runs import ROCKSDB_STATE, settings
from postlark.streaming.sinks import (
    BatchFunction,
    add_changes,
    discard,
    fan_out,
    replace_all,
    upsert,
    upsert_top_words,
)
from postlark.streaming.snapshots import AppendTable, ChangeTable, SnapshotTable

# How often the running reports are refreshed.
LANGUAGE_TRIGGER = {"processingTime": "200 milliseconds"}
WORD_TRIGGER = {"processingTime": "300 milliseconds"}

REJECTED_ROWS = StructType([StructField("line", StringType())])


def _writer(result: DataFrame, checkpoint: str, trigger: dict, name: str | None) -> DataStreamWriter:
    writer = result.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
    return writer.queryName(name) if name else writer


def _start(
    result: DataFrame,
    mode: str,
    table: SnapshotTable | None,
    store: BatchFunction,
    checkpoint: str,
    trigger: dict,
    name: str | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Start a query with state.

    ``trigger`` is such as ``{"processingTime": "1 second"}`` or
    ``{"availableNow": True}``; ``name`` is shown in Spark's UI and progress
    events. ``partitions`` splits the state, by default as the session's shuffle
    partitions say; the first start of a checkpoint fixes it.
    """
    spark = result.sparkSession
    split = {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}
    if table is not None:
        table.bind(checkpoint)
    with settings(spark, ROCKSDB_STATE | split):
        return (
            _writer(result, checkpoint, trigger, name)
            .outputMode(mode)
            .foreachBatch(store)
            .start()
        )


def run_complete(
    result: DataFrame, table: SnapshotTable, checkpoint: str, trigger: dict, **start
) -> StreamingQuery:
    """Keep the whole result of any aggregation over a stream, such as one in SQL."""
    return _start(result, "complete", table, replace_all(table), checkpoint, trigger, **start)


def run_language_counts(
    posts: DataFrame,
    table: SnapshotTable,
    checkpoint: str,
    language: str = "Language",
    trigger: dict = LANGUAGE_TRIGGER,
    **start,
) -> StreamingQuery:
    """Replace the snapshot by the counts of all languages seen so far."""
    return run_complete(language_counts(posts, language), table, checkpoint, trigger, **start)


def run_language_names(
    posts: DataFrame,
    names: DataFrame,
    table: SnapshotTable,
    checkpoint: str,
    language: str = "Language",
    trigger: dict = LANGUAGE_TRIGGER,
    **start,
) -> StreamingQuery:
    """Counts with language names; the lookup join is part of the streaming plan."""
    named = name_languages(language_counts(posts, language), names)
    return run_complete(named, table, checkpoint, trigger, **start)


def run_language_distribution(
    posts: DataFrame,
    names: DataFrame | Lookup | None,
    table: SnapshotTable,
    checkpoint: str,
    language: str = "Language",
    trigger: dict = LANGUAGE_TRIGGER,
    **start,
) -> StreamingQuery:
    """Counts with names and shares, which are worked out on each complete result.

    With a ``Lookup`` every batch has the names that its file holds by then.
    """

    def report(counts: DataFrame) -> DataFrame:
        shares = with_share(counts)
        known = names.current(counts.sparkSession) if isinstance(names, Lookup) else names
        return shares if known is None else name_languages(shares, known)

    counts = language_counts(posts, language)
    return run_report(counts, report, table, checkpoint, trigger, **start)


def run_report(
    result: DataFrame,
    report: Callable[[DataFrame], DataFrame],
    table: SnapshotTable,
    checkpoint: str,
    trigger: dict,
    **start,
) -> StreamingQuery:
    """Keep what ``report`` makes of each complete result, which it gets as a static frame."""
    return _start(result, "complete", table, replace_all(table, report), checkpoint, trigger, **start)


def run_language_upserts(
    posts: DataFrame,
    table: SnapshotTable,
    checkpoint: str,
    language: str = "Language",
    trigger: dict = LANGUAGE_TRIGGER,
    **start,
) -> StreamingQuery:
    """The same counts, merging only the languages a batch changed."""
    counts = language_counts(posts, language)
    return _start(counts, "update", table, upsert(table, "language"), checkpoint, trigger, **start)


def run_word_counts(
    posts: DataFrame,
    table: ChangeTable,
    checkpoint: str,
    text: str = "Text",
    trigger: dict = WORD_TRIGGER,
    **start,
) -> StreamingQuery:
    """Totals of all words: every batch writes the words it changed."""
    counts = word_counts(posts, text)
    return _start(counts, "update", table, add_changes(table), checkpoint, trigger, **start)


def run_word_state(
    posts: DataFrame, checkpoint: str, text: str = "Text", trigger: dict = WORD_TRIGGER, **start
) -> StreamingQuery:
    """Totals of all words, kept as state alone; ``state_totals`` reads them from there."""
    return _start(word_counts(posts, text), "update", None, discard, checkpoint, trigger, **start)


def run_top_words_complete(
    posts: DataFrame,
    table: SnapshotTable,
    checkpoint: str,
    k: int = 5,
    text: str = "Text",
    trigger: dict = WORD_TRIGGER,
    **start,
) -> StreamingQuery:
    """Sort and limit in the streaming plan; reads the whole state at every trigger."""
    top = top_words(word_counts(posts, text), k)
    return run_complete(top, table, checkpoint, trigger, **start)


def run_top_words(
    posts: DataFrame,
    table: SnapshotTable,
    checkpoint: str,
    k: int = 5,
    text: str = "Text",
    trigger: dict = WORD_TRIGGER,
    **start,
) -> StreamingQuery:
    """The same list from the words a batch changed; work grows with the batch."""
    counts = word_counts(posts, text)
    return _start(counts, "update", table, upsert_top_words(table, k), checkpoint, trigger, **start)


def run_feed(
    posts: DataFrame,
    path: str,
    checkpoint: str,
    user: str = "UserName",
    text: str = "Text",
    keys: tuple[str, ...] = (),
    trigger: dict = WORD_TRIGGER,
    name: str | None = None,
    arrival: str | None = None,
) -> StreamingQuery:
    """Append a line per post to a Parquet directory, exactly once.

    ``arrival`` names a column for the time of the batch that brought the line.
    """
    lines = feed_lines(posts, user, text, keys)
    if arrival:
        lines = lines.withColumn(arrival, F.current_timestamp())
    return (
        _writer(lines, checkpoint, trigger, name)
        .outputMode("append")
        .format("parquet")
        .start(path)
    )


def run_feed_table(
    posts: DataFrame,
    table: AppendTable,
    checkpoint: str,
    user: str = "UserName",
    text: str = "Text",
    keys: tuple[str, ...] = ("UserID", "created_at"),
    trigger: dict = WORD_TRIGGER,
    name: str | None = None,
) -> StreamingQuery:
    """Append a line per post to a table whose files and manifest stay bounded."""
    table.bind(checkpoint)
    lines = feed_lines(posts, user, text, keys).withColumn("arrived", F.current_timestamp())
    writer = _writer(lines, checkpoint, trigger, name).outputMode("append")
    return writer.foreachBatch(add_changes(table)).start()


def run_session(
    posts: DataFrame,
    tables: dict[str, SnapshotTable],
    checkpoint: str,
    trigger: dict = LANGUAGE_TRIGGER,
    name: str | None = None,
) -> StreamingQuery:
    """All reports of a session from one read of its posts.

    Counts need no state in the stream: a batch stores what it adds, by its number.
    """

    def readable(batch: DataFrame) -> DataFrame:
        if REJECTED not in batch.columns:
            return batch
        return batch.where(F.col(REJECTED).isNull()).drop(REJECTED)

    def feed(batch: DataFrame) -> DataFrame:
        lines = feed_lines(readable(batch), keys=("UserID", "created_at"))
        return lines.withColumn("arrived", F.current_timestamp())

    makers = {
        "landing": readable,
        "feed": feed,
        "languages": lambda batch: language_counts(readable(batch)),
        "words": lambda batch: word_counts(readable(batch)),
    }
    if REJECTED in posts.columns:
        makers["rejected"] = lambda batch: batch.where(F.col(REJECTED).isNotNull()).select(
            F.col(REJECTED).alias("line")
        )
    for table in tables.values():
        table.bind(checkpoint)
    outputs = [(tables[report], make) for report, make in makers.items()]
    writer = _writer(empty_as_null(posts), checkpoint, trigger, name).outputMode("append")
    return writer.foreachBatch(fan_out(outputs)).start()


def state_totals(spark: SparkSession, checkpoint: str, key: str, total: str) -> DataFrame:
    """The running totals of a query, read from its state with Spark's state data source.

    Nothing but the state is needed, so a query that exists for its totals need not write
    them anywhere. The totals are those of the last batch that the checkpoint has finished;
    a running query may go on meanwhile. The state must be that of one counting
    aggregation by one key.
    """
    state = spark.read.format("statestore").load(checkpoint)
    (own_key,), (own_total,) = state.schema["key"].dataType.names, state.schema["value"].dataType.names
    return state.select(
        F.col("key").getField(own_key).alias(key), F.col("value").getField(own_total).alias(total)
    )
