"""Text expressions. All of them are Spark built-ins, so they stay in the JVM.

Both tokenizers drop the unwanted characters from the whole text first and look
for white space afterwards. White space is never dropped, so the tokens are the
same as if each token had been stripped on its own, and one regex pass over the
text replaces one call per token (measured: about half the time).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regex character classes. \W and \S are complements of the ASCII
# classes. They are intersections of complements, not one negated union, for
# speed: with two different unions at work in one task, matching took twice as long.
NOT_A_WORD_CHARACTER = r"[\W&&\S]+"
NOT_A_KEYWORD_CHARACTER = r"[\W&&\S&&\P{L}&&\P{M}&&\P{N}]+"
WHITE_SPACE = "\t\n\x0b\f\r "

# How a record prints its creation time.
CREATED_AT = "EEE MMM dd HH:mm:ss zzz yyyy"
CREATED_AT_WITHOUT_WEEKDAY = "MMM dd HH:mm:ss zzz yyyy"
WEEKDAY = "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) "


def word_array(text: Column) -> Column:
    """Split text into words of ASCII letters, digits and underscores, case kept.

    Other characters vanish inside a word (``it's`` -> ``its``). Leading white
    space or a token of punctuation alone leaves an empty string; the length
    filter that follows removes it.
    """
    return F.split(F.regexp_replace(text, NOT_A_WORD_CHARACTER, ""), r"\s+")


def keyword_tokens(text: Column) -> Column:
    """Split text into lower-cased tokens for keyword matching.

    Keeps letters, marks and digits of every script and the underscore.
    """
    return F.split(F.lower(F.regexp_replace(text, NOT_A_KEYWORD_CHARACTER, "")), r"\s+")


def created_at_text(timestamp: Column) -> Column:
    """Print a timestamp as the record's ``created_at``, in the session's time zone."""
    return F.date_format(timestamp, CREATED_AT)


def parse_created_at(text: Column) -> Column:
    """Read ``created_at`` back as a timestamp; NULL where it is malformed.

    Spark does not parse weekday names, so the leading one is cut off.
    """
    rest = F.when(text.rlike(WEEKDAY), F.regexp_replace(text, WEEKDAY, ""))
    return F.try_to_timestamp(rest, F.lit(CREATED_AT_WITHOUT_WEEKDAY))
