"""The CSV landing directory: headerless files of ``schemas.POST`` records.

Text may hold line breaks, quotes, commas and outer blanks; the options below
bring all of them back unchanged. An empty field, quoted or not, is read as NULL. A file with multi-line records cannot be split between tasks,
so the writers limit the records per file; Parquet or JSON suit large volumes
better.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructType

from postlark.schemas import POST
from postlark.streaming.snapshots import AppendTable

RECORDS_PER_FILE = 100_000

# Quoting every field protects outer blanks and lone carriage returns. Fixing the
# line separator keeps Spark from guessing it from the first text with a line
# break; in files with CRLF lines, the rest is blank space after the last field.
_FORMAT = {"sep": ",", "escape": '"', "lineSep": "\n", "ignoreLeadingWhiteSpace": "false"}
_WRITE = {**_FORMAT, "quoteAll": "true", "ignoreTrailingWhiteSpace": "false"}
_READ = {**_FORMAT, "multiLine": "true", "ignoreTrailingWhiteSpace": "true"}


def empty_as_null(posts: DataFrame) -> DataFrame:
    """An empty text is no value, whatever format posts are landed in."""
    return posts.select(
        [
            F.nullif(field.name, F.lit("")).alias(field.name)
            if isinstance(field.dataType, StringType)
            else F.col(field.name)
            for field in posts.schema
        ]
    )


def write_landing(
    posts: DataFrame, path: str, mode: str = "append", records_per_file: int = RECORDS_PER_FILE
) -> None:
    """Add a batch of posts to a landing directory."""
    (
        empty_as_null(posts)
        .write.mode(mode)
        .options(**_WRITE)
        .option("maxRecordsPerFile", records_per_file)
        .csv(path)
    )


def stream_landing(
    posts: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict,
    name: str | None = None,
    format: str = "csv",
    records_per_file: int = RECORDS_PER_FILE,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Keep writing a stream of posts to a landing directory, exactly once.

    Files appear complete or not at all, and the directory's commit log keeps a
    reader of the directory from seeing the files of a failed attempt. ``format``
    may also be ``parquet``, to be read with its own reader. ``files_per_batch`` limits
    the files of a batch, for sources that deliver few posts at a time; the directory's
    log grows with the number of files.
    """
    posts = empty_as_null(posts)
    if files_per_batch is not None:
        posts = posts.coalesce(files_per_batch)
    writer = (
        posts.writeStream.format(format)
        .options(**(_WRITE if format == "csv" else {}))
        .option("maxRecordsPerFile", records_per_file)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
    )
    return (writer.queryName(name) if name else writer).start(path)


def landing_table(
    spark: SparkSession, path: str, format: str = "parquet", schema: StructType = POST, **options
) -> AppendTable:
    """A landing directory whose files and manifest stay bounded; see ``AppendTable``.

    Write the batches of a stream to it with ``add_changes`` or ``land_batches``.
    """
    csv = {"write_options": _WRITE, "read_options": _READ, "rows_per_file": RECORDS_PER_FILE}
    return AppendTable(spark, path, schema, format=format, **(csv if format == "csv" else {}), **options)


def land_batches(
    posts: DataFrame, table: AppendTable, checkpoint: str, trigger: dict, name: str | None = None
) -> StreamingQuery:
    """Keep adding a stream of posts to a landing table, each post once."""
    table.bind(checkpoint)
    writer = empty_as_null(posts).writeStream.option("checkpointLocation", checkpoint).trigger(**trigger)
    return (writer.queryName(name) if name else writer).foreachBatch(table.write).start()


def read_landing(
    spark: SparkSession,
    path: str,
    schema: StructType = POST,
    stream: bool = False,
    **options,
) -> DataFrame:
    """Read a landing directory or glob as a table, or as a stream of its new files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).options(**{**_READ, **options}).csv(path)
