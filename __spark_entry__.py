"""

The queries run the library on the given tables. ``documents`` stands for posts
(``text``, ``lang``), ``conversations`` for the feed (``role``, ``text``), and the
JSON payload of ``events`` for nested posts.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import postlark as pl
from postlark.schemas import LANGUAGE_COUNTS, LANGUAGE_DISTRIBUTION, WORD_COUNTS
from postlark.streaming import reports
from postlark.streaming.runs import new_run

KEYWORDS = "that with, dans ,,"
SIGNAL_KEYWORDS = "signup, k error, click"

# A thousand phrases of two terms; few of them occur.
MANY_KEYWORDS = [
    f"{first} {second}"
    for first in ("that", "with", "dans", "this", "from", "nicht", "para", "tion", "avec", "und")
    for second in ("les", "est", "sur", "der", "die", "que", "los", "del", "and", "for")
    + tuple(f"absent{n}" for n in range(90))
]

# A sample lookup. It leaves out "es", which keeps its code.
NAMES_SQL = "VALUES ('de', 'German'), ('en', 'English'), ('fr', 'French')"

ONCE = {"availableNow": True}

# A stream over a large table is worked off in steps, so that a lost driver
# costs one step and not the whole run.
FILES_PER_TRIGGER = 10_000

# A table that is split has so many batches, in files whose row groups are of about this size:
# a row group is read by one task.
BATCHES = 5
ROW_GROUP_BYTES = 8 << 20

# How many parts the state of a running report gets here.
STATE_PARTITIONS = 8


# --- inputs -------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A file stream takes a directory or a glob, not one file: hence the braces.
    return pl.read_posts(
        spark,
        f"{sf_dir}/{{{name}}}.parquet",
        "parquet",
        table(spark, sf_dir, name).schema,
        stream=True,
        maxFilesPerTrigger=FILES_PER_TRIGGER,
    )


def split_stream(spark: SparkSession, sf_dir: str, name: str, run: str) -> DataFrame:
    """A table as a stream of several batches, as the tables here are one file each.

    A batch has as many files as a fifth of the table takes tasks to read, and their row
    groups are small, so Spark can share a batch between all cores.
    """
    source = table(spark, sf_dir, name)
    files = -(-source.rdd.getNumPartitions() // BATCHES)
    rows = source.repartition(BATCHES * files).write.option("parquet.block.size", ROW_GROUP_BYTES)
    rows.parquet(f"{run}/source")
    return pl.read_posts(
        spark, f"{run}/source", "parquet", source.schema, stream=True, maxFilesPerTrigger=files
    )


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("text")


def language_names(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {NAMES_SQL} AS names(code, name)")


def partly_unknown_languages(documents: DataFrame) -> DataFrame:
    """Documents of which some have no language and some are marked ``und``."""
    return documents.select(
        F.when(F.col("source") == "src0", None)
        .when(F.col("source") == "src1", "und")
        .otherwise(F.col("lang"))
        .alias("lang")
    )


def sql_language_counts(spark: SparkSession, posts: DataFrame) -> DataFrame:
    """The language counts as a user writes them in SQL, on a table or a stream."""
    view = f"posts_{uuid.uuid4().hex}"
    pl.register_posts(posts, view)
    return spark.sql(
        f"""
        WITH known AS (SELECT lang FROM {view} WHERE lang IS NOT NULL),
             counted AS (SELECT lang, count(*) AS tweet_count FROM known GROUP BY lang)
        SELECT if(lang = 'und', 'Undetermined', lang) AS language, tweet_count FROM counted
        """
    )


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested posts; some lack a place, some only its coordinates."""
    k = F.from_json("props", "k int")["k"]
    kind = F.col("event_type")
    point = F.struct(F.col("value").alias("lat"), k.cast("double").alias("lon"))
    place = F.struct(
        F.upper(kind).alias("country"),
        F.when(F.col("value") > 10, F.array(F.array(point))).alias("coordinates"),
    )
    return table(spark, sf_dir, "events").select(
        F.struct(kind.alias("name"), F.col("user_id").alias("id")).alias("user"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.array(F.lit(0), k).alias("display_text_range"),
        k.alias("favorite_count"),
        F.substring(kind, 1, 2).alias("lang"),
        F.when(kind != "view", place).alias("place"),
        F.length("props").alias("retweet_count"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("text"),
        F.when(kind == "click", F.struct(F.col("event_id").alias("id"))).alias(
            "retweeted_status"
        ),
    )


def documents_as_posts(documents: DataFrame) -> DataFrame:
    """Documents in the flat record's columns."""
    given = {"UserName": "source", "UserID": "doc_id", "Language": "lang", "Text": "text"}
    return documents.select(
        *[
            (F.col(given[c.name]) if c.name in given else F.lit(None).cast(c.dataType)).alias(
                c.name
            )
            for c in pl.POST
        ]
    )


def posts_as_documents(posts: DataFrame) -> DataFrame:
    return posts.select(
        F.col("UserID").alias("doc_id"),
        F.col("Language").alias("lang"),
        F.col("Text").alias("text"),
    )


# --- batch queries --------------------------------------------------------------


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.language_counts(table(spark, sf_dir, "documents"), "lang")


def language_counts_undetermined(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = partly_unknown_languages(table(spark, sf_dir, "documents"))
    return pl.language_counts(posts, "lang")


def language_counts_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = partly_unknown_languages(table(spark, sf_dir, "documents"))
    return sql_language_counts(spark, posts)


def language_names_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.name_languages(language_counts(spark, sf_dir), language_names(spark))


def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.language_distribution(
        table(spark, sf_dir, "documents"), language_names(spark), "lang"
    )


def language_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.chart_series(language_names_joined(spark, sf_dir), "language", "tweet_count")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.word_counts(document_text(spark, sf_dir), "text")


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.most_frequent_words(
        document_text(spark, sf_dir), k=5, text="text", full_only=False
    )


def top_words_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.most_frequent_words(table(spark, sf_dir, "events"), k=5, text="event_type")


def top_words_underfull(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    return pl.most_frequent_words(events, k=5, text="event_type")


def top_words_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.chart_series(top_words_guarded(spark, sf_dir), "word", "word_count")


def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pl.keyword_filter(documents, KEYWORDS, "text").select("doc_id")


def session_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.session_top_words(
        document_text(spark, sf_dir), KEYWORDS, k=5, text="text"
    )


def project_text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("language")
    )


def without_zone(posts: DataFrame) -> DataFrame:
    """The zone's name depends on the session, so it is left out of the comparison."""
    printed = F.col("created_at")
    short = F.concat(F.substring(printed, 1, 20), F.substring(printed, -4, 4))
    return posts.withColumn("created_at", short)


def flatten_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_zone(pl.flatten_posts(nested_events(spark, sf_dir)))


def created_at_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    printed = pl.created_at_text(F.col("ts").cast("timestamp"))
    return events.select(
        "event_id", pl.parse_created_at(printed).cast("timestamp_ntz").alias("created_at")
    )


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_zone(pl.intake(nested_events(spark, sf_dir), "signup, k error"))


def decode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = nested_events(spark, sf_dir)
    messages = nested.select(
        F.to_json(F.struct(*nested.columns)).cast("binary").alias("value")
    )
    return without_zone(pl.flatten_posts(pl.decode_posts(messages)))


def rejected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of which those of one event type have lost their last character."""
    cut = F.expr("CASE WHEN event_type = 'error' THEN left(props, length(props) - 1) ELSE props END")
    return pl.rejected_payloads(table(spark, sf_dir, "events").select(cut.alias("value")))


def language_names_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with names from a lookup file, whose names hold quotes and commas."""
    path = f"{new_run(spark, 'lookup')}/names"
    codes = table(spark, sf_dir, "documents").select(F.col("lang").alias("code")).distinct()
    named = codes.where(F.col("code") != "es").withColumn(
        "name", F.concat(F.lit('the "'), F.upper("code"), F.lit('", so called'))
    )
    named.write.options(header=True, quoteAll=True, escape='"').csv(path)
    return pl.name_languages(language_counts(spark, sf_dir), pl.read_language_names(spark, path))


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.feed_lines(
        table(spark, sf_dir, "conversations"), "role", "text", keys=("conv_id", "turn")
    )


def csv_landing_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = new_run(spark, "landing")
    pl.write_landing(documents_as_posts(table(spark, sf_dir, "documents")), landing)
    return posts_as_documents(pl.read_landing(spark, landing))


# --- streaming queries: run over the whole table, then read the result ------------


def _run(spark, sf_dir, name, schema, start, split=False, kind=pl.SnapshotTable, **options):
    run = new_run(spark, name)
    result = kind(spark, f"{run}/result", schema, **options)
    posts = split_stream(spark, sf_dir, "documents", run) if split else table_stream(spark, sf_dir, "documents")
    start(posts, result, f"{run}/checkpoint").awaitTermination()
    return result.read()


# What every report with state is started with.
START = {"trigger": ONCE, "partitions": STATE_PARTITIONS}


def stream_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(posts, result, checkpoint):
        return reports.run_language_counts(posts, result, checkpoint, "lang", **START)

    return _run(spark, sf_dir, "language-counts", LANGUAGE_COUNTS, start, split=True)


def stream_language_counts_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(documents, result, checkpoint):
        counts = sql_language_counts(spark, partly_unknown_languages(documents))
        return reports.run_complete(counts, result, checkpoint, **START)

    return _run(spark, sf_dir, "language-counts-sql", LANGUAGE_COUNTS, start)


def stream_language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(posts, result, checkpoint):
        names = language_names(spark)
        return reports.run_language_names(posts, names, result, checkpoint, "lang", **START)

    return _run(spark, sf_dir, "language-names", LANGUAGE_COUNTS, start)


def stream_language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(posts, result, checkpoint):
        names = language_names(spark)
        return reports.run_language_distribution(
            posts, names, result, checkpoint, "lang", **START
        )

    return _run(spark, sf_dir, "language-distribution", LANGUAGE_DISTRIBUTION, start)


def upsert_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(posts, result, checkpoint):
        return reports.run_language_upserts(posts, result, checkpoint, "lang", **START)

    return _run(spark, sf_dir, "language-upserts", LANGUAGE_COUNTS, start, split=True, files=1)


def stream_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(posts, result, checkpoint):
        return reports.run_word_counts(posts, result, checkpoint, "text", **START)

    return _run(
        spark, sf_dir, "word-counts", WORD_COUNTS, start, split=True, kind=pl.ChangeTable,
        key="word", total="word_count", compact_every=2,
    )


def stream_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(posts, result, checkpoint):
        return reports.run_top_words_complete(posts, result, checkpoint, 5, "text", **START)

    return _run(spark, sf_dir, "top-words-complete", WORD_COUNTS, start)


def stream_top_words_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    def start(posts, result, checkpoint):
        return reports.run_top_words(posts, result, checkpoint, 5, "text", **START)

    return _run(spark, sf_dir, "top-words", WORD_COUNTS, start, split=True, files=1)


def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = new_run(spark, "feed")
    query = reports.run_feed(
        table_stream(spark, sf_dir, "conversations"),
        f"{run}/result",
        f"{run}/checkpoint",
        "role",
        "text",
        ("conv_id", "turn"),
        ONCE,
    )
    query.awaitTermination()
    return spark.read.schema("conv_id long, turn long, line string").parquet(f"{run}/result")


def word_counts_from_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of several batches, read from the query's state; it writes no result."""
    run = new_run(spark, "word-state")
    posts = split_stream(spark, sf_dir, "documents", run)
    reports.run_word_state(posts, f"{run}/checkpoint", "text", **START).awaitTermination()
    return pl.state_totals(spark, f"{run}/checkpoint", "word", "word_count")


def landing_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing table of CSV segments, merged while batches come in."""
    run = new_run(spark, "landing-table")
    posts = documents_as_posts(split_stream(spark, sf_dir, "documents", run))
    table = pl.landing_table(spark, f"{run}/landing", "csv", fan=2)
    pl.land_batches(posts, table, f"{run}/checkpoint", ONCE).awaitTermination()
    return posts_as_documents(table.read())


def stream_language_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts named from a lookup file that is written anew between two batches."""
    run = new_run(spark, "lookup-stream")
    first = spark.sql("SELECT code, upper(name) AS name FROM (" + NAMES_SQL + ") AS names(code, name)")
    first.write.options(header=True, quoteAll=True, escape='"').csv(f"{run}/names")
    names = pl.Lookup(spark, f"{run}/names", f"{run}/prepared")
    result = pl.SnapshotTable(spark, f"{run}/result", LANGUAGE_DISTRIBUTION)
    posts = split_stream(spark, sf_dir, "documents", run)
    seen = []

    def report(counts: DataFrame) -> DataFrame:
        seen.append(None)
        if len(seen) == 3:
            again = language_names(spark).write.mode("overwrite")
            again.options(header=True, quoteAll=True, escape='"').csv(f"{run}/names")
        return pl.name_languages(pl.with_share(counts), names.current(counts.sparkSession))

    counts = pl.language_counts(posts, "lang")
    reports.run_report(counts, report, result, f"{run}/checkpoint", **START).awaitTermination()
    return result.read()


def broken_lines(spark: SparkSession, sf_dir: str, run: str) -> str:
    """Events as JSON lines of which those of one type have lost their last character."""
    nested = nested_events(spark, sf_dir)
    line = F.to_json(F.struct(*nested.columns))
    cut = F.when(F.col("user.name") == "error", F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    nested.withColumn("line", line).select(cut.alias("value")).repartition(3).write.text(f"{run}/json")
    return f"{run}/json"


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cannot be read of JSON lines (a stream) and of CSV files (a table).

    The broken JSON lines are shown by their user id and length; the CSV files have texts
    where numbers belong.
    """
    run = new_run(spark, "rejected")
    scan = pl.scan_posts(spark, broken_lines(spark, sf_dir, run), stream=True, maxFilesPerTrigger=1)
    lines = pl.rejected_lines(scan)
    (
        lines.writeStream.format("parquet")
        .option("checkpointLocation", f"{run}/checkpoint")
        .trigger(**ONCE)
        .start(f"{run}/lines")
        .awaitTermination()
    )
    kept = spark.read.schema("line string").parquet(f"{run}/lines")
    users = F.regexp_extract("line", r'"id":(\d+)', 1)
    from_json = kept.select(
        F.lit("json").alias("kind"),
        F.concat(users, F.lit(" "), F.regexp_extract("line", r'"text":"(\w+)', 1),
                 F.lit(" "), F.endswith("line", F.lit("}")).cast("string")).alias("line"),
    )
    events = table(spark, sf_dir, "events")
    amount = F.when(F.col("event_type") == "view", F.lit("many")).otherwise(F.col("user_id").cast("string"))
    events.select("event_id", amount.alias("amount"), "event_type").write.csv(f"{run}/csv")
    scan = pl.scan_posts(spark, f"{run}/csv", "csv", "event_id long, amount long, event_type string")
    from_csv = pl.rejected_lines(scan).select(F.lit("csv").alias("kind"), "line")
    return from_json.unionByName(from_csv)


def readable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts of the same broken files, flattened: a line that is cut makes no post."""
    path = broken_lines(spark, sf_dir, new_run(spark, "readable"))
    return without_zone(pl.flatten_posts(pl.read_posts(spark, path)))


def keyword_filter_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand phrases, of which the index tries those whose rarest term a text has."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pl.keyword_filter(documents, MANY_KEYWORDS, "text").select("doc_id")


def stream_landing_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = new_run(spark, "stream-landing")
    posts = documents_as_posts(table_stream(spark, sf_dir, "documents"))
    pl.stream_landing(
        posts, f"{run}/landing", f"{run}/checkpoints/write", ONCE
    ).awaitTermination()
    landed = pl.read_landing(spark, f"{run}/landing", stream=True)
    (
        posts_as_documents(landed)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{run}/checkpoints/read")
        .trigger(**ONCE)
        .start(f"{run}/result")
        .awaitTermination()
    )
    return spark.read.schema("doc_id long, lang string, text string").parquet(f"{run}/result")


def stream_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested posts as a stream of JSON files, flattened."""
    run = new_run(spark, "json")
    nested_events(spark, sf_dir).repartition(3).write.json(f"{run}/source")
    posts = pl.read_posts(spark, f"{run}/source", stream=True, maxFilesPerTrigger=1)
    flat = without_zone(pl.flatten_posts(posts))
    (
        flat.writeStream.format("parquet")
        .option("checkpointLocation", f"{run}/checkpoint")
        .trigger(**ONCE)
        .start(f"{run}/result")
        .awaitTermination()
    )
    return spark.read.schema(flat.schema).parquet(f"{run}/result")


def _session(spark: SparkSession, sf_dir: str, posts: DataFrame | None = None, **options):
    if posts is None:
        posts = table_stream(spark, sf_dir, "documents")
    names = language_names(spark)
    session = pl.PostSession(
        spark, documents_as_posts(posts), KEYWORDS, names, state_partitions=STATE_PARTITIONS, **options
    )
    session.start(once=True)
    session.await_termination()
    session.stop()
    return session


def post_session_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that the change signal of a session brings, added up.

    The source is a stream of JSON lines some of which are broken.
    """
    run = new_run(spark, "signal")
    scan = pl.scan_posts(spark, broken_lines(spark, sf_dir, run), stream=True, maxFilesPerTrigger=1)
    totals: dict[str, int] = {}

    def on_change(report: str, numbers) -> None:
        for name, n in numbers.items():
            totals[name] = totals.get(name, 0) + n

    session = pl.PostSession(
        spark, pl.flatten_posts(scan), SIGNAL_KEYWORDS, on_change=on_change, state_partitions=STATE_PARTITIONS
    )
    session.start(once=True)
    session.await_termination()
    session.stop()
    kept = {
        "taken": totals["taken"], "rejected": totals["rejected"], "matched": totals["matched"],
        "landed": session.landed().count(), "kept apart": session.rejected().count(),
    }
    return spark.createDataFrame(list(kept.items()), "metric string, n long")


def post_session_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).landed().select(F.col("UserID").alias("doc_id"), F.col("Text").alias("text"))


def post_session_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).top_words()


def post_session_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).languages()


def post_session_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).feed().select(F.col("UserID").alias("doc_id"), "line")


def partly_empty_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table_stream(spark, sf_dir, "documents")
    empty = F.when(F.col("source") == "src0", "").when(F.col("source") == "src1", "und")
    return documents.withColumn("lang", empty.otherwise(F.col("lang")))


def post_session_languages_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir, partly_empty_languages(spark, sf_dir)).languages()


def post_session_languages_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = partly_empty_languages(spark, sf_dir)
    return _session(spark, sf_dir, posts, landing_format="csv", readers="each").languages()


def post_session_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session with its usual triggers, stopped when it has seen the table."""
    posts = documents_as_posts(table_stream(spark, sf_dir, "documents"))
    session = pl.PostSession(
        spark, posts, KEYWORDS, language_names(spark), state_partitions=STATE_PARTITIONS, readers="each"
    )
    session.start()
    session.queries["intake"].processAllAvailable()
    session.stop(drain=True)
    return session.top_words()


# --- SQL equivalents ------------------------------------------------------------------

UNKNOWN_LANGUAGES = """(
    SELECT CASE WHEN source = 'src0' THEN NULL WHEN source = 'src1' THEN 'und'
                ELSE lang END AS lang FROM documents)"""

TOKENS = r"""list_transform(regexp_split_to_array(text, '\s+'),
    lambda x: lower(regexp_replace(x, '[^\p{L}\p{M}\p{N}_]', '', 'g')))"""

# Phrases with an absent term never match; a hundred pairs of terms are left.
MANY_SQL = f"""
    SELECT DISTINCT doc_id
    FROM (SELECT doc_id, {TOKENS} AS tokens FROM documents),
         (VALUES ('that'), ('with'), ('dans'), ('this'), ('from'), ('nicht'), ('para'), ('tion'),
                 ('avec'), ('und')) AS one(a),
         (VALUES ('les'), ('est'), ('sur'), ('der'), ('die'), ('que'), ('los'), ('del'), ('and'),
                 ('for')) AS two(b)
    WHERE list_contains(tokens, a) AND list_contains(tokens, b)"""

UNKNOWN_MATCHING = f"""(
    SELECT * FROM (
        SELECT CASE WHEN source = 'src0' THEN NULL WHEN source = 'src1' THEN 'und'
                    ELSE lang END AS lang, {TOKENS} AS tokens FROM documents)
    WHERE list_has_all(tokens, ['that', 'with']) OR list_has_all(tokens, ['dans']))"""

MATCHING = f"""(
    SELECT * FROM (SELECT *, {TOKENS} AS tokens FROM documents)
    WHERE list_has_all(tokens, ['that', 'with']) OR list_has_all(tokens, ['dans']))"""

NESTED = """(
    SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
           event_type <> 'view' AND value > 10 AS located
    FROM events)"""

COORDINATES = """CASE WHEN located THEN '[[{"lat":' || CAST(value AS VARCHAR) || ',"lon":'
        || CAST(CAST(k AS DOUBLE) AS VARCHAR) || '}]]' ELSE '' END"""


def counts_sql(source: str) -> str:
    return f"""
        SELECT replace(code, 'und', 'Undetermined') AS language,
               (SELECT count(*) FROM {source} AS posts WHERE posts.lang = codes.code) AS tweet_count
        FROM (SELECT DISTINCT lang AS code FROM {source} AS every) AS codes
        WHERE code IS NOT NULL"""


def names_sql(source: str) -> str:
    return f"""
        SELECT coalesce(name, language) AS language, tweet_count,
               tweet_count / sum(tweet_count) OVER () AS share
        FROM ({counts_sql(source)}) AS counts
        LEFT JOIN ({NAMES_SQL}) AS names(code, name) ON language = code"""


def words_sql(source: str, column: str) -> str:
    return rf"""
        SELECT word, count(*) AS word_count FROM (
            SELECT lower(regexp_replace(token, '[^\w]', '', 'g')) AS word
            FROM (SELECT unnest(regexp_split_to_array({column}, '\s+')) AS token
                  FROM {source}))
        WHERE length(word) > 3 GROUP BY word"""


def top_sql(source: str, column: str) -> str:
    return f"{words_sql(source, column)} ORDER BY word_count DESC, word LIMIT 5"


def guarded_sql(source: str, column: str) -> str:
    return f"""
        WITH top AS ({top_sql(source, column)})
        SELECT * FROM top WHERE (SELECT count(*) FROM top) >= 5"""


# --- contract -------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """The most frequent words among the documents that match a list of keywords."""
    return session_top_words(spark, "/root/testdata/sf0.001")


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators, where they are installed."""
    try:
        import corpus_pipeline
        from postlark.llm.oracles import oracle_sql as more_sql
        from postlark.llm.queries import queries as more_queries
    except ImportError as error:
        # Also where a package or file they need is missing: the other queries need none.
        warnings.warn(f"the training-data queries are left out: {error}", stacklevel=2)
        return {}, {}
    sql = more_sql()
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return more_queries() | {"pipeline": corpus_pipeline.run}, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries() | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return core_oracle_sql() | _training_data()[1]


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "language_counts": language_counts,
        "language_counts_undetermined": language_counts_undetermined,
        "language_counts_sql": language_counts_sql,
        "language_names": language_names_joined,
        "language_distribution": language_distribution,
        "language_chart": language_chart,
        "word_counts": word_counts,
        "top_words": top_words,
        "top_words_guarded": top_words_guarded,
        "top_words_underfull": top_words_underfull,
        "top_words_chart": top_words_chart,
        "keyword_filter": keyword_filter,
        "session_top_words": session_top_words,
        "project_text_language": project_text_language,
        "flatten_record": flatten_record,
        "created_at_parsed": created_at_parsed,
        "intake": intake,
        "decode_messages": decode_messages,
        "feed_lines": feed_lines,
        "csv_landing_roundtrip": csv_landing_roundtrip,
        "stream_language_counts": stream_language_counts,
        "stream_language_counts_sql": stream_language_counts_sql,
        "stream_language_names": stream_language_names,
        "stream_language_distribution": stream_language_distribution,
        "upsert_language_counts": upsert_language_counts,
        "stream_word_counts": stream_word_counts,
        "stream_top_words": stream_top_words,
        "stream_top_words_update": stream_top_words_update,
        "stream_feed": stream_feed,
        "stream_landing_roundtrip": stream_landing_roundtrip,
        "post_session_words": post_session_words,
        "post_session_languages": post_session_languages,
        "post_session_feed": post_session_feed,
        "post_session_languages_empty": post_session_languages_empty,
        "post_session_languages_csv": post_session_languages_csv,
        "post_session_live": post_session_live,
        "stream_json_files": stream_json_files,
        "rejected_payloads": rejected_payloads,
        "language_names_file": language_names_file,
        "word_counts_from_state": word_counts_from_state,
        "landing_table_roundtrip": landing_table_roundtrip,
        "stream_language_lookup": stream_language_lookup,
        "rejected_lines": rejected_lines,
        "readable_lines": readable_lines,
        "keyword_filter_indexed": keyword_filter_indexed,
        "post_session_signal": post_session_signal,
        "post_session_landed": post_session_landed,
    }


def core_oracle_sql() -> dict[str, str]:
    counts = counts_sql("documents")
    unknown = counts_sql(UNKNOWN_LANGUAGES)
    distribution = names_sql("documents")
    named = f"SELECT language, tweet_count FROM ({distribution})"
    words = words_sql("documents", "text")
    top = top_sql("documents", "text")
    top_events = guarded_sql("events", "event_type")
    session_top = guarded_sql(MATCHING, "text")
    flat = f"""
        SELECT event_type AS "UserName", user_id AS "UserID",
               strftime(ts, '%a %b %d %H:%M:%S %Y') AS created_at,
               CAST(0 AS INTEGER) AS "TextRangeStart", k AS "TextRangeEnd",
               k AS "FavoriteCount", substr(event_type, 1, 2) AS "Language",
               CASE WHEN located THEN upper(event_type) ELSE '' END AS "Place",
               {COORDINATES} AS "Coordinates",
               CAST(length(props) AS INTEGER) AS "RetweetCount",
               event_type || ' ' || props AS "Text",
               event_type = 'click' AS "isRetweet"
        FROM {NESTED}"""
    empty = names_sql(UNKNOWN_MATCHING)
    feed = "SELECT conv_id, turn, role || ':' || text AS line FROM conversations"
    documents = "SELECT doc_id, lang, text FROM documents"
    return {
        "language_counts": counts,
        "language_counts_undetermined": unknown,
        "language_counts_sql": unknown,
        "language_names": named,
        "language_distribution": distribution,
        "language_chart": f"""
            SELECT language AS name, CAST(tweet_count AS DOUBLE) AS value FROM ({named})""",
        "word_counts": words,
        "top_words": top,
        "top_words_guarded": top_events,
        "top_words_underfull": guarded_sql(
            "(SELECT * FROM events WHERE event_type <> 'error')", "event_type"
        ),
        "top_words_chart": f"""
            SELECT word AS name, CAST(word_count AS DOUBLE) AS value FROM ({top_events})""",
        "keyword_filter": f"SELECT doc_id FROM {MATCHING}",
        "session_top_words": session_top,
        "project_text_language": "SELECT doc_id, text, lang AS language FROM documents",
        "flatten_record": flat,
        "created_at_parsed": """
            SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at
            FROM events""",
        "intake": f"{flat} WHERE event_type IN ('signup', 'error')",
        "decode_messages": flat,
        "feed_lines": feed,
        "csv_landing_roundtrip": documents,
        "stream_language_counts": counts,
        "stream_language_counts_sql": unknown,
        "stream_language_names": named,
        "stream_language_distribution": distribution,
        "upsert_language_counts": counts,
        "stream_word_counts": words,
        "stream_top_words": top,
        "stream_top_words_update": top,
        "stream_feed": feed,
        "stream_landing_roundtrip": documents,
        "post_session_words": session_top,
        "post_session_languages": names_sql(MATCHING),
        "post_session_feed": f"SELECT doc_id, source || ':' || text AS line FROM {MATCHING}",
        "post_session_languages_empty": empty,
        "post_session_languages_csv": empty,
        "post_session_live": session_top,
        "stream_json_files": flat,
        "rejected_payloads": """
            SELECT left(props, length(props) - 1) AS payload FROM events
            WHERE event_type = 'error'""",
        "language_names_file": f"""
            SELECT CASE WHEN language = 'es' THEN 'es'
                        ELSE 'the "' || upper(language) || '", so called' END AS language,
                   tweet_count FROM ({counts})""",
        "word_counts_from_state": words,
        "landing_table_roundtrip": documents,
        "stream_language_lookup": distribution,
        "rejected_lines": """
            SELECT 'json' AS kind, user_id || ' ' || event_type || ' false' AS line
            FROM events WHERE event_type = 'error'
            UNION ALL SELECT 'csv', event_id || ',many,view' FROM events WHERE event_type = 'view'""",
        "readable_lines": f"{flat} WHERE event_type <> 'error'",
        "keyword_filter_indexed": MANY_SQL,
        "post_session_signal": """
            SELECT metric, n FROM (
                SELECT count(*) FILTER (event_type <> 'error') AS taken,
                       count(*) FILTER (event_type = 'error') AS rejected,
                       count(*) FILTER (event_type IN ('signup', 'click')) AS matched,
                       matched AS landed, rejected AS "kept apart"
                FROM events) UNPIVOT (n FOR metric IN (taken, rejected, matched, landed, "kept apart"))""",
        "post_session_landed": f"SELECT doc_id, text FROM {MATCHING}",
    }
