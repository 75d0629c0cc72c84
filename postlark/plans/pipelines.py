"""The reports a user asks for, each a short chain of operators."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from postlark.operators.feed import feed_lines
from postlark.operators.flatten import flatten_posts
from postlark.operators.keywords import keyword_filter
from postlark.operators.languages import language_counts, name_languages, with_share
from postlark.operators.words import require_full, top_words, word_counts


def intake(raw: DataFrame, keywords: str | Sequence[str]) -> DataFrame:
    """Nested posts that match the keywords, flattened. Batch or stream."""
    return flatten_posts(keyword_filter(raw, keywords, "text"))


def language_distribution(
    posts: DataFrame, names: DataFrame, language: str = "Language"
) -> DataFrame:
    """Posts per language with readable names and shares."""
    return name_languages(with_share(language_counts(posts, language)), names)


def most_frequent_words(
    posts: DataFrame, k: int = 5, text: str = "Text", full_only: bool = True
) -> DataFrame:
    """The k most frequent words; empty when there are fewer, unless ``full_only`` is off."""
    top = top_words(word_counts(posts, text), k)
    return require_full(top, k) if full_only else top


def feed(posts: DataFrame) -> DataFrame:
    """A readable line per post. Batch or stream."""
    return feed_lines(posts)


def session_top_words(
    posts: DataFrame, keywords: str | Sequence[str], k: int = 5, text: str = "Text"
) -> DataFrame:
    """The most frequent words among the posts that match the keywords."""
    return most_frequent_words(keyword_filter(posts, keywords, text), k, text)
