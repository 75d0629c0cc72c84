"""Read posts from files or a message payload, and name them for SQL."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postlark.schemas import NESTED_POST, REJECTED


def scan_posts(
    spark: SparkSession,
    path: str,
    format: str = "json",
    schema: StructType | str = NESTED_POST,
    stream: bool = False,
    **options,
) -> DataFrame:
    """One scan of JSON lines or CSV files: the columns of posts, and ``_rejected``.

    A line that is no record, or whose values do not have the types of the schema, is in
    ``_rejected`` as it stands; ``readable_posts`` and ``rejected_lines`` split the scan.
    Every line is always read whole, so that what is rejected does not depend on the
    columns a report selects. Blank lines are no rows; columns that folders name stay.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.readStream if stream else spark.read
    if format == "json" and str(options.get("multiLine", "false")).lower() != "true":
        # The text source knows few options; the others are those of the records.
        source = {"lineSep", "maxFilesPerTrigger", "maxBytesPerTrigger", "maxFileAge", "latestFirst",
                  "pathGlobFilter", "recursiveFileLookup", "modifiedAfter", "modifiedBefore",
                  "fileNameOnly", "cleanSource", "sourceArchiveDir", "wholetext"}
        of_source = {name: value for name, value in options.items() if name in source}
        # What is read here is kept or set apart line by line, so a mode means nothing.
        of_record = {name: value for name, value in options.items() if name not in source and name != "mode"}
        lines = reader.options(**of_source).text(path).where(F.trim("value") != "")
        folders = [name for name in lines.columns if name not in ("value", *schema.names)]
        decoded = _decoded(lines, "value", schema, of_record, folders)
        bad = _unread(decoded)
        posts = [F.when(~bad, F.col(f"post.{field.name}")).alias(field.name) for field in schema.fields]
        return decoded.select(*posts, *folders, F.when(bad, F.col("payload")).alias(REJECTED))
    wanted = StructType([*schema.fields, StructField(REJECTED, StringType())])
    rows = (
        reader.format(format)
        .schema(wanted)
        .options(**{"mode": "PERMISSIVE", **options, "columnNameOfCorruptRecord": REJECTED})
        .load(path)
    )
    # Always true, but it names every column: these readers look at no others.
    every = F.length(F.concat_ws("", *[F.col(name).cast("string") for name in schema.names])) >= 0
    return rows.withColumn(REJECTED, F.when(every, F.col(REJECTED)))


def readable_posts(scan: DataFrame) -> DataFrame:
    """The posts of a ``scan_posts``."""
    return scan.where(F.col(REJECTED).isNull()).drop(REJECTED)


def rejected_lines(scan: DataFrame) -> DataFrame:
    """``line``: what a ``scan_posts`` could not read, as it stands in its file."""
    return scan.where(F.col(REJECTED).isNotNull()).select(F.col(REJECTED).alias("line"))


def read_posts(
    spark: SparkSession,
    path: str,
    format: str = "json",
    schema: StructType | str = NESTED_POST,
    stream: bool = False,
    **options,
) -> DataFrame:
    """Read a directory of posts as a table, or as a stream of its new files.

    The schema is always given, never inferred: inference would read all the
    data once more, and a stream needs it up front anyway. Lines of JSON and CSV files
    that cannot be read make no post; ``scan_posts`` gives both in one scan.
    """
    if format in ("json", "csv"):
        return readable_posts(scan_posts(spark, path, format, schema, stream, **options))
    reader = spark.readStream if stream else spark.read
    return reader.format(format).schema(schema).options(**options).load(path)


def _decoded(
    messages: DataFrame, payload: str, schema: StructType, options: dict | None = None, others: Sequence[str] = ()
) -> DataFrame:
    text = F.col(payload).cast("string")
    wanted = StructType([*schema.fields, StructField(REJECTED, StringType())])
    post = F.from_json(text, wanted, {**(options or {}), "columnNameOfCorruptRecord": REJECTED})
    return messages.select(text.alias("payload"), post.alias("post"), *others)


def _unread(decoded: DataFrame) -> Column:
    return F.col("post").isNull() | F.col(f"post.{REJECTED}").isNotNull()


def decode_posts(
    messages: DataFrame, payload: str = "value", schema: StructType = NESTED_POST
) -> DataFrame:
    """Posts from a column of JSON text or bytes, as a message queue delivers them.

    Payloads that cannot be read make no post; ``rejected_payloads`` has them.
    """
    decoded = _decoded(messages, payload, schema)
    return decoded.where(~_unread(decoded)).select([F.col(f"post.{field.name}") for field in schema.fields])


def rejected_payloads(
    messages: DataFrame, payload: str = "value", schema: StructType = NESTED_POST
) -> DataFrame:
    """The payloads, as text, that ``decode_posts`` leaves out."""
    decoded = _decoded(messages, payload, schema)
    return decoded.where(_unread(decoded)).select("payload")


def register_posts(posts: DataFrame, view: str = "posts") -> DataFrame:
    """Make posts queryable with ``spark.sql``; registering again replaces the view."""
    posts.createOrReplaceTempView(view)
    return posts
