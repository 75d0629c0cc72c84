"""Word frequencies and the most frequent words."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlark.functions.text import word_array

SHORTEST_WORD = 4


def words(posts: DataFrame, text: str = "Text") -> DataFrame:
    """One row per word of at least four characters, lower-cased.

    The length is taken after punctuation is gone; NULL text gives no rows.
    """
    return (
        posts.select(F.explode(word_array(F.col(text))).alias("word"))
        .where(F.length("word") >= SHORTEST_WORD)
        .select(F.lower("word").alias("word"))
    )


def word_counts(posts: DataFrame, text: str = "Text") -> DataFrame:
    """Total number of occurrences per word, retweets included.

    Each task sums its own rows before the shuffle, so a word that makes up a
    third of the input still travels as one row per task.
    """
    return words(posts, text).groupBy("word").agg(F.count("*").alias("word_count"))


def top_words(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent words; equal counts are ordered alphabetically."""
    return counts.orderBy(F.desc("word_count"), F.asc("word")).limit(k)


def require_full(top: DataFrame, k: int = 5) -> DataFrame:
    """Show a top-k list only when it has all k rows, otherwise nothing.

    ``top`` must already be limited to k rows; the window has no partitions and
    sees just those.
    """
    return (
        top.withColumn("_rows", F.count("*").over(Window.partitionBy()))
        .where(F.col("_rows") >= k)
        .drop("_rows")
    )
