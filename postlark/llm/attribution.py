"""Token counts of the sections of a document, from one encoding of the whole text.

A document is encoded once. The character span of every token is joined to the spans of
the sections: both are sorted, so the first and last section that a token touches are
found by binary search. A token that touches several sections is allocated by a rule:

* ``majority``: to the section with most of its characters, the earlier one if equal
* ``first``, ``last``: to the section of its first or last character
* ``split``: to each by its share of characters

A token that touches one section counts there, a token that touches none counts nowhere.
With sections that cover the text, counts add up to the document's tokens.

Sections are the lines of a text, given spans, or fields that are joined to one text.

Defined cases: a NULL or empty text has one empty line without tokens, NULL spans are no
sections, a NULL field is an empty one. Spans are kept inside the text and apart. Repeated
documents and NULL ids are reported row by row. A long text is encoded whole. An empty
table gives no rows. Extra columns are not read.
"""

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.llm.common import concat_range, slices

RULES = ("majority", "first", "last", "split")

# Fixed value: how the tokenizer's vocabulary expects a text to be cut before merging.
PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)

_SECTIONS = "doc_id long, section int, start int, stop int, n_tokens double"
_SECTIONS_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("section", pa.int32()),
        ("start", pa.int32()),
        ("stop", pa.int32()),
        ("n_tokens", pa.float64()),
    ]
)


@lru_cache(maxsize=2)
def byte_encoding(path: str):
    """A byte-level tokenizer from a rank file, and the bytes of each of its ids."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(token) for token in ranks]
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, sizes


def token_spans(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of consecutive tokens of ``sizes`` bytes in UTF-8 ``data``.

    A token that holds part of a character's bytes spans that character.
    """
    character = np.cumsum((data & 0xC0) != 0x80)  # of each byte, from 1
    stops = np.cumsum(sizes)
    return character[stops - sizes] - 1, character[stops - 1]


def lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines of UTF-8 ``data`` in characters; a line break ends its line."""
    character = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.concatenate([[0], breaks[breaks < len(data)]]).astype(np.int64)
    stops = np.concatenate([starts[1:], [len(data)]])
    return character[starts], character[stops]


def attribute(token_start, token_stop, start, stop, rule: str = "majority") -> np.ndarray:
    """Tokens per section; sections are sorted and do not overlap. Empty ones get none."""
    full = stop > start
    if not full.all():
        counts = np.zeros(len(start))
        counts[full] = attribute(token_start, token_stop, start[full], stop[full], rule)
        return counts
    first = np.searchsorted(stop, token_start, "right")
    last = np.searchsorted(start, token_stop, "left") - 1
    counts = np.zeros(len(start))
    touched = last - first + 1
    counts += np.bincount(first[touched == 1], minlength=len(start))
    several = touched > 1
    first, last, touched = first[several], last[several], touched[several]
    if not len(first):
        return counts
    if rule in ("first", "last"):
        return counts + np.bincount(first if rule == "first" else last, minlength=len(start))
    token = np.repeat(np.flatnonzero(several), touched)
    section = concat_range(first, touched)
    overlap = np.minimum(token_stop[token], stop[section]) - np.maximum(
        token_start[token], start[section]
    )
    begins = np.cumsum(touched) - touched
    if rule == "split":
        total = np.repeat(np.add.reduceat(overlap, begins), touched)
        return counts + np.bincount(section, overlap / total, minlength=len(start))
    most = np.repeat(np.maximum.reduceat(overlap, begins), touched)
    place = np.where(overlap == most, np.arange(len(overlap)), len(overlap))
    winner = section[np.minimum.reduceat(place, begins)]
    return counts + np.bincount(winner, minlength=len(start))


def given(spans: list[dict] | None, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Given sections in the order of their starts: which each is, its start and its stop.

    They are kept inside the text; one that begins inside the section before it begins
    where that ends.
    """
    spans = [one or {} for one in spans or []]
    pairs = [(one.get("start") or 0, one.get("stop") or 0) for one in spans]
    pairs = np.clip(np.array(pairs, np.int64).reshape(-1, 2), 0, length)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    start, stop = pairs[order, 0], pairs[order, 1]
    stop = np.maximum.accumulate(np.maximum(start, stop)) if len(order) else stop
    start = np.maximum(start, np.concatenate([start[:1], stop[:-1]]))
    return order, start, stop


def section_tokens(
    documents: DataFrame,
    ranks: str,
    rule: str = "majority",
    sections: str | None = None,
    fields: Sequence[str] | None = None,
    separator: str = "\n",
) -> DataFrame:
    """Per section of every document: ``doc_id, section, start, stop, n_tokens``.

    Sections count from 0; ``start`` and ``stop`` count characters. They are the lines of
    ``text``; or the spans of the column ``sections``, an array of structs of ``start`` and
    ``stop``, numbered as they stand there; or the columns ``fields``, joined by
    ``separator``, which belongs to the field before it. ``ranks`` is the path of the
    tokenizer's rank file, the same on every machine.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {', '.join(RULES)}")
    if sections is not None and fields is not None:
        raise ValueError("give sections or fields, not both")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    if fields is not None:
        parts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in fields]
        text = F.concat(*[p for part in parts for p in (part, F.lit(separator))][:-1])
        stops = [F.length(F.concat(part, F.lit(separator))) for part in parts[:-1]] + [F.length(parts[-1])]
        rows = documents.select(doc_id, text.alias("text"), F.array(*stops).alias("spans"))
    elif sections is not None:
        spans = F.transform(
            sections, lambda s: F.struct(s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop"))
        )
        rows = documents.select(doc_id, F.col("text"), spans.alias("spans"))
    else:
        rows = documents.select(doc_id, "text")

    def spans_of(data: np.ndarray, text: str, told) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if sections is not None:
            return given(told, len(text))
        if fields is not None:
            stops = np.cumsum(np.array(told, np.int64))
            return np.arange(len(stops)), stops - np.array(told, np.int64), stops
        start, stop = lines(data)
        return np.arange(len(start)), start, stop

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = byte_encoding(ranks)
        for batch in batches:
            for piece in slices(batch):
                spans, counts = [], []
                told = piece.column("spans").to_pylist() if "spans" in piece.schema.names else [None] * len(piece)
                for text, own in zip(piece.column("text").to_pylist(), told):
                    text = text or ""
                    data = np.frombuffer(text.encode(), np.uint8)
                    spans.append(spans_of(data, text, own))
                    ids = encoding.encode_to_numpy(text, disallowed_special=())
                    tokens = token_spans(data, sizes[ids]) if len(data) else (data, data)
                    counts.append(attribute(*tokens, *spans[-1][1:], rule))
                each = np.array([len(found) for found in counts])
                rows = pa.array(np.repeat(np.arange(len(each)), each))
                columns = [
                    piece.column("doc_id").take(rows),
                    *[pa.array(np.concatenate([span[i] for span in spans]).astype(np.int32)) for i in range(3)],
                    pa.array(np.concatenate(counts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_SECTIONS_ARROW)

    return rows.mapInArrow(count, _SECTIONS)
