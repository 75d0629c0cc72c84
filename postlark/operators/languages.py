"""Posts per language, readable language names, and each language's share."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "Undetermined"


def language_counts(posts: DataFrame, language: str = "Language") -> DataFrame:
    """Count posts per language.

    Posts without a language are left out first, so the filter reaches the scan and a
    stream keeps no state for them. Posts marked ``und`` count as undetermined.
    """
    known = posts.select(F.col(language).alias("code")).where(F.col("code").isNotNull())
    name = F.when(F.col("code") == "und", UNDETERMINED).otherwise(F.col("code"))
    counts = known.groupBy("code").agg(F.count("*").alias("tweet_count"))
    return counts.select(name.alias("language"), "tweet_count")


def single_names(names: DataFrame) -> DataFrame:
    """One row per code. A code listed twice would double its count; the smallest name is
    taken."""
    return names.where(F.col("code").isNotNull()).groupBy("code").agg(F.min("name").alias("name"))


def name_languages(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Replace codes by names from ``names(code, name)``; unknown codes stay.

    The caller supplies ``names``, so its size is not known here and the join
    carries no broadcast hint: Spark broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins by shuffle.
    """
    single = single_names(names).withColumnRenamed("code", "_code")
    others = [column for column in counts.columns if column != "language"]
    return counts.join(single, counts["language"] == single["_code"], "left").select(
        F.coalesce(single["name"], counts["language"]).alias("language"),
        *[counts[column] for column in others],
    )


def with_share(counts: DataFrame, count: str = "tweet_count") -> DataFrame:
    """Add each row's fraction of the total.

    The total is a scalar subquery, not a window without partitions, so the rows
    are never gathered in one task. Its plan has the same exchange as ``counts``
    and Spark runs that once. Static frames only; on a stream, call it on the
    batch inside ``foreachBatch``.
    """
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn("share", F.col(count) / total)
