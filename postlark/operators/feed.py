"""Rows for display: feed lines and chart points."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feed_lines(
    posts: DataFrame,
    user: str = "UserName",
    text: str = "Text",
    keys: Sequence[str] = (),
) -> DataFrame:
    """One ``user:text`` line per post, next to any ``keys`` to tell lines apart.

    A missing part prints as ``null``.
    """
    missing = F.lit("null")
    line = F.concat(F.coalesce(user, missing), F.lit(":"), F.coalesce(text, missing))
    return posts.select(*keys, line.alias("line"))


def chart_series(result: DataFrame, name: str, value: str) -> DataFrame:
    """Chart points ``(name string, value double)`` from a report."""
    return result.select(F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
