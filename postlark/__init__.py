"""Analytics over tables and streams of short text posts, written as Spark jobs."""

from postlark.functions.text import (
    created_at_text,
    keyword_tokens,
    parse_created_at,
    word_array,
)
from postlark.operators.feed import chart_series, feed_lines
from postlark.operators.flatten import flatten_posts
from postlark.operators.keywords import keyword_filter, parse_keywords
from postlark.operators.languages import language_counts, name_languages, with_share
from postlark.operators.words import require_full, top_words, word_counts, words
from postlark.plans.pipelines import (
    feed,
    intake,
    language_distribution,
    most_frequent_words,
    session_top_words,
)
from postlark.schemas import LANGUAGE_NAMES, NESTED_POST, POST
from postlark.sources.landing import (
    land_batches,
    landing_table,
    read_landing,
    stream_landing,
    write_landing,
)
from postlark.sources.lookup import Lookup, read_language_names
from postlark.sources.posts import (
    decode_posts,
    read_posts,
    readable_posts,
    register_posts,
    rejected_lines,
    rejected_payloads,
    scan_posts,
)
from postlark.streaming.reports import state_totals
from postlark.streaming.session import PostSession
from postlark.streaming.snapshots import AppendTable, ChangeTable, SnapshotTable, SumTable

__all__ = [
    "AppendTable",
    "ChangeTable",
    "LANGUAGE_NAMES",
    "Lookup",
    "NESTED_POST",
    "POST",
    "PostSession",
    "SnapshotTable",
    "SumTable",
    "chart_series",
    "created_at_text",
    "decode_posts",
    "feed",
    "feed_lines",
    "flatten_posts",
    "intake",
    "keyword_filter",
    "keyword_tokens",
    "land_batches",
    "landing_table",
    "language_counts",
    "language_distribution",
    "most_frequent_words",
    "name_languages",
    "parse_created_at",
    "parse_keywords",
    "read_landing",
    "read_language_names",
    "read_posts",
    "readable_posts",
    "register_posts",
    "rejected_lines",
    "rejected_payloads",
    "require_full",
    "scan_posts",
    "session_top_words",
    "state_totals",
    "stream_landing",
    "top_words",
    "with_share",
    "word_array",
    "word_counts",
    "words",
    "write_landing",
]
