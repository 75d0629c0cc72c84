"""Keyword filter: phrases are alternatives, the terms of a phrase must all occur."""

import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.functions.text import WHITE_SPACE, keyword_tokens


def _kept(character: str) -> bool:
    return character == "_" or unicodedata.category(character)[0] in "LMN"


def parse_keywords(keywords: str | Sequence[str] | None) -> list[list[str]]:
    """Turn ``"free coffee, tea"`` into ``[["free", "coffee"], ["tea"]]``.

    Terms lose the characters that ``keyword_tokens`` drops; empty terms and empty
    phrases are skipped. Raises ``ValueError`` when nothing is left to look for.
    """
    given = [] if keywords is None else [keywords] if isinstance(keywords, str) else keywords
    phrases = []
    for phrase in (part for entry in given for part in entry.split(",")):
        terms = []
        for token in re.split(f"[{WHITE_SPACE}]+", phrase):
            term = "".join(filter(_kept, token))
            if term and term not in terms:
                terms.append(term)
        if terms and terms not in phrases:
            phrases.append(terms)
    if not phrases:
        raise ValueError("keywords hold no term to look for")
    return phrases


def _lowered(terms: Iterable[str]) -> list[Column]:
    # Lowered by Spark, as the text is; Catalyst folds the calls to constants.
    return [F.lower(F.lit(term)) for term in terms]


# From this many phrases on, a post is compared only with those whose rarest term it holds.
INDEXED_PHRASES = 64


def _rarest_first(phrases: Sequence[Sequence[str]]) -> list[list[str]]:
    """Phrases with their rarest term first: the one that the fewest phrases have, of
    several the longest."""
    uses = Counter(term for terms in phrases for term in terms)
    return [sorted(terms, key=lambda term: (uses[term], -len(term), term)) for terms in phrases]


def _indexed(tokens: Column, phrases: Sequence[Sequence[str]]) -> Column:
    """True where a phrase has all its terms, by an inverted index from terms to phrases.

    A phrase stands in the index under its rarest term, in a bucket of the term's checksum.
    Each token looks into one bucket, which holds about one phrase; only where it is that
    phrase's first term are the others looked for. So what a post costs follows the tokens
    it has and the terms it hits, not the number of phrases. The index travels with the
    plan, as the phrases themselves do.
    """
    lowered = [list(dict.fromkeys(term.lower() for term in terms)) for terms in phrases]
    size = 1 << len(phrases).bit_length()
    buckets: list[list] = [[] for _ in range(size)]
    for terms in _rarest_first(lowered):
        buckets[zlib.crc32(terms[0].encode()) % size].append(terms)
    # One constant, which Catalyst reads once: ten thousand literals would take seconds to plan.
    text = F.lit(json.dumps(buckets, ensure_ascii=False, separators=(",", ":")))
    index = F.from_json(text, "array<array<array<string>>>")

    def holds(terms: Column) -> Column:
        others = F.slice(terms, 2, F.size(terms))
        return F.forall(others, lambda term: F.array_contains(tokens, term))

    def phrase_found(token: Column) -> Column:
        place = F.crc32(token.cast("binary")) % size + 1
        bucket = F.element_at(index, place.cast("int"))
        return F.exists(bucket, lambda terms: (F.element_at(terms, 1) == token) & holds(terms))

    return F.exists(tokens, phrase_found)


def keyword_condition(text: Column, phrases: Sequence[Sequence[str]]) -> Column:
    """True where one phrase has all its terms as whole tokens, in any case.

    Each token is looked up once in the set of all terms, so a list of hundreds
    of keywords costs hardly more than a few. Phrases are then checked against
    the few terms found; from ``INDEXED_PHRASES`` on through an index.
    """
    if len(phrases) >= INDEXED_PHRASES:
        tokens = F.array(keyword_tokens(text))  # named by the lambda, as ``found`` below
        return F.exists(tokens, lambda one: one.isNotNull() & _indexed(one, phrases))
    single = [terms[0] for terms in phrases if len(terms) == 1]
    several = [terms for terms in phrases if len(terms) > 1]
    every = _lowered(sorted({term for terms in phrases for term in terms}))

    def matches(found: Column) -> Column:
        alternatives = []
        if single:
            alternatives.append(F.exists(found, lambda term: term.isin(*_lowered(single))))
        if several:
            wanted = F.array(*[F.array(*_lowered(terms)) for terms in several])
            alternatives.append(
                F.exists(
                    wanted,
                    lambda terms: F.forall(terms, lambda term: F.array_contains(found, term)),
                )
            )
        return (F.size(found) > 0) & reduce(or_, alternatives)

    found = F.array_distinct(F.filter(keyword_tokens(text), lambda token: token.isin(*every)))
    # The one-element array gives ``found`` a name inside the lambda. Used directly
    # it would be worked out again at each mention: filters share no subexpressions.
    return F.exists(F.array(found), matches)


def keyword_filter(
    posts: DataFrame,
    keywords: str | Sequence[str] | None,
    text: str = "Text",
    also: Column | None = None,
) -> DataFrame:
    """Keep the posts that match; rows with NULL text never do.

    Rows for which ``also`` is true are kept too.
    """
    condition = keyword_condition(F.col(text), parse_keywords(keywords))
    return posts.where(condition if also is None else also | condition)
