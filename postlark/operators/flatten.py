"""Flatten nested posts to the twelve columns of ``schemas.POST``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.functions.text import created_at_text
from postlark.schemas import REJECTED


def flatten_posts(posts: DataFrame) -> DataFrame:
    """Project ``schemas.NESTED_POST`` rows onto ``schemas.POST``.

    Place and coordinates are only meaningful together: when either is missing,
    both become an empty string. The column ``_rejected`` of a ``scan_posts`` is kept.
    """
    rejected = [REJECTED] if REJECTED in posts.columns else []
    located = F.col("place").isNotNull() & F.col("place.coordinates").isNotNull()
    return posts.select(
        F.col("user.name").alias("UserName"),
        F.col("user.id").alias("UserID"),
        created_at_text(F.col("created_at")).alias("created_at"),
        F.get("display_text_range", F.lit(0)).alias("TextRangeStart"),
        F.get("display_text_range", F.lit(1)).alias("TextRangeEnd"),
        F.col("favorite_count").alias("FavoriteCount"),
        F.col("lang").alias("Language"),
        F.when(located, F.coalesce("place.country", F.lit(""))).otherwise("").alias("Place"),
        F.when(located, F.to_json("place.coordinates")).otherwise("").alias("Coordinates"),
        F.col("retweet_count").alias("RetweetCount"),
        F.col("text").alias("Text"),
        F.col("retweeted_status").isNotNull().alias("isRetweet"),
        *rejected,
    )
