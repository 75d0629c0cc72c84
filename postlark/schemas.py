"""Schemas of the tables this package reads and writes. Every column is nullable."""

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


# The flat post record. A headerless CSV landing file binds its
# fields by position, so the order of these columns is part of the format.
POST = _table(
    ("UserName", T.StringType()),
    ("UserID", T.LongType()),
    ("created_at", T.StringType()),
    ("TextRangeStart", T.IntegerType()),
    ("TextRangeEnd", T.IntegerType()),
    ("FavoriteCount", T.IntegerType()),
    ("Language", T.StringType()),
    ("Place", T.StringType()),
    ("Coordinates", T.StringType()),
    ("RetweetCount", T.IntegerType()),
    ("Text", T.StringType()),
    ("isRetweet", T.BooleanType()),
)

# A post as a feed delivers it, before flattening.
NESTED_POST = _table(
    ("user", _table(("name", T.StringType()), ("id", T.LongType()))),
    ("created_at", T.TimestampType()),
    ("display_text_range", T.ArrayType(T.IntegerType())),
    ("favorite_count", T.IntegerType()),
    ("lang", T.StringType()),
    (
        "place",
        _table(
            ("country", T.StringType()),
            (
                "coordinates",
                T.ArrayType(
                    T.ArrayType(_table(("lat", T.DoubleType()), ("lon", T.DoubleType())))
                ),
            ),
        ),
    ),
    ("retweet_count", T.IntegerType()),
    ("text", T.StringType()),
    ("retweeted_status", _table(("id", T.LongType()))),
)

LANGUAGE_NAMES = _table(("code", T.StringType()), ("name", T.StringType()))

LANGUAGE_COUNTS = _table(("language", T.StringType()), ("tweet_count", T.LongType()))

LANGUAGE_DISTRIBUTION = _table(
    ("language", T.StringType()),
    ("tweet_count", T.LongType()),
    ("share", T.DoubleType()),
)

WORD_COUNTS = _table(("word", T.StringType()), ("word_count", T.LongType()))

FEED = _table(
    ("UserID", T.LongType()),
    ("created_at", T.StringType()),
    ("line", T.StringType()),
    ("arrived", T.TimestampType()),
)

# The column that holds a line nobody could read, and else NULL.
REJECTED = "_rejected"
