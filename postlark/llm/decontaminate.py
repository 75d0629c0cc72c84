"""Find and remove benchmark passages by an FM-index of every shard of documents.

A window is 10 consecutive words of a benchmark item; a shorter item is one window. A
shard is a slice of a task's documents. Only words of the benchmark can take part in an
occurrence, so a shard's index is built over its runs of such words that are long enough
for the shortest window; no occurrence is lost by that. Each different window is searched
backwards once per shard, its occurrences are located by sampled suffix positions, and
overlapping ones are merged to spans.

Scale: documents are neither shuffled nor joined. The benchmark is the query set: it is
sent to the tasks in blocks of about ``BLOCK_BYTES`` of text, one pass over the documents
per block, and a block is given up before the next is sent.

Defined cases: a NULL or empty text has no words and no hits, a NULL or empty item no
windows. Rows with the same ``item_id`` are one item; a NULL one is the item ``null``. A
very long text is searched whole. Repeated documents are each reported. Without
benchmark rows nothing is hit, without documents there are no rows. ``decontaminate``
passes on all columns; columns that it adds on the way have names of their own.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlark.llm.common import byte_table, concat_range, dictionary_words, slices, stored, unused
from postlark.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 4 << 20

# Words are digits, letters a-z and whatever is beyond ASCII.
WORD_BYTES = byte_table(lambda byte: 48 <= byte <= 57 or 97 <= byte <= 122)
_WORD_PATTERN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

_HITS = T.StructType(
    [
        T.StructField("words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("stops", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_HITS_ARROW = pa.struct(
    [
        ("words", pa.int64()),
        ("starts", pa.list_(pa.int64())),
        ("stops", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())),
    ]
)


@dataclass
class Phrases:
    """The different windows of some items: rows of word numbers from 1, by length."""

    vocabulary: pa.Array
    by_length: dict[int, np.ndarray]
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> offsets, item numbers
    names: list[str]

    @classmethod
    def of(cls, rows: list[tuple]) -> "Phrases":
        words = dictionary_words(pa.array([text for _, text in rows], pa.string()), WORD_BYTES)
        names = sorted({"null" if item is None else str(item) for item, _ in rows})
        number = {name: i for i, name in enumerate(names)}
        item_of = np.array(["null" if i is None else str(i) for i, _ in rows], object)
        codes = words.codes.astype(np.int32) + 1
        by_length, items = {}, {}
        sizes = words.counts
        for length in sorted(set(np.minimum(sizes[sizes > 0], WINDOW).tolist())):
            chosen = np.flatnonzero(np.minimum(sizes, WINDOW) == length)
            windows = sizes[chosen] - length + 1
            starts = concat_range(words.offsets[chosen], windows)
            matrix = codes[starts[:, None] + np.arange(length)]
            owner = np.repeat([number[item_of[i]] for i in chosen], windows)
            phrases, place = np.unique(matrix, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([place.ravel(), owner], axis=1), axis=0)
            offsets = np.searchsorted(pairs[:, 0], np.arange(len(phrases) + 1))
            by_length[length], items[length] = phrases, (offsets, pairs[:, 1])
        return cls(words.dictionary, by_length, items, names)


def find(texts: pa.Array, phrases: Phrases):
    """Occurrences in one shard.

    Returns the words, the hit words as a mask, and the (text, item) pairs that occur.
    """
    words = dictionary_words(texts, WORD_BYTES)
    hit = np.zeros(len(words.codes), bool)
    pairs = np.zeros((0, 2), np.int64)
    if not len(hit) or not phrases.by_length:
        return words, hit, pairs
    numbers = pc.fill_null(pc.index_in(words.dictionary, value_set=phrases.vocabulary), -1)
    text = (numbers.to_numpy(zero_copy_only=False) + 1)[words.codes]
    # Runs of benchmark words within a document.
    known = text > 0
    begins, ends = known.copy(), known.copy()
    begins[1:] &= ~known[:-1]
    ends[:-1] &= ~known[1:]
    edges = words.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(text))]
    begins[edges] = known[edges]
    ends[edges - 1] = known[edges - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long_enough = ends - begins >= min(phrases.by_length)
    begins, ends = begins[long_enough], ends[long_enough]
    if not len(begins):
        return words, hit, pairs
    lengths = ends - begins
    joined = np.zeros(int((lengths + 1).sum()), np.int64)
    origin = np.full(len(joined), -1, np.int64)
    places = concat_range(np.cumsum(lengths + 1) - lengths - 1, lengths)
    origin[places] = concat_range(begins, lengths)
    joined[places] = text[origin[places]]
    index = FMIndex(joined, len(phrases.vocabulary))
    edge = np.zeros(len(hit) + 1, np.int64)
    found = []
    for length, rows in phrases.by_length.items():
        low, high = index.search(rows)
        counts = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(rows)), counts)
        if not len(which):
            continue
        start = origin[index.locate(concat_range(low, counts))]
        edge += np.bincount(start, minlength=len(edge)) - np.bincount(
            start + length, minlength=len(edge)
        )
        document = np.searchsorted(words.offsets, start, "right") - 1
        both = np.unique(np.stack([document, which], axis=1), axis=0)
        offsets, items = phrases.items[length]
        each = offsets[both[:, 1] + 1] - offsets[both[:, 1]]
        named = items[concat_range(offsets[both[:, 1]], each)]
        found.append(np.stack([np.repeat(both[:, 0], each), named], axis=1))
    if found:
        hit = np.cumsum(edge)[:-1] > 0
        pairs = np.unique(np.concatenate(found), axis=0)
    return words, hit, pairs


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of hit words."""
    steps = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def _hits(texts: pa.Array, phrases: Phrases) -> list[dict]:
    words, hit, pairs = find(texts, phrases)
    out = [
        {"words": size, "starts": [], "stops": [], "items": []} for size in words.counts.tolist()
    ]
    for document in np.unique(pairs[:, 0]).tolist():
        begin, end = words.offsets[document], words.offsets[document + 1]
        starts, stops = _spans(hit[begin:end])
        out[document]["starts"], out[document]["stops"] = starts.tolist(), stops.tolist()
    for document, item in pairs.tolist():
        out[document]["items"].append(phrases.names[item])
    return out


def _merged(found: list[dict]) -> dict:
    """The hits of several blocks of the benchmark in one document."""
    hit = np.zeros(found[0]["words"], bool)
    for hits in found:
        for start, stop in zip(hits["starts"], hits["stops"]):
            hit[start:stop] = True
    starts, stops = _spans(hit)
    items = sorted({item for hits in found for item in hits["items"]})
    return {"words": len(hit), "starts": starts.tolist(), "stops": stops.tolist(), "items": items}


def benchmark_blocks(benchmark: DataFrame) -> Iterator[Phrases]:
    """The benchmark in blocks of about ``BLOCK_BYTES`` of text, read one at a time; an item
    longer than that makes a longer block."""
    rows = benchmark.select(F.col("item_id"), F.col("text"))
    blocks = _block_count(benchmark)
    if blocks <= 1:
        yield Phrases.of([tuple(row) for row in rows.collect()])
        return
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        yield Phrases.of([tuple(row) for row in rows.where(number == block).collect()])


def _block_count(benchmark: DataFrame) -> int:
    return -(-(benchmark.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // BLOCK_BYTES)


def _searched(documents: DataFrame, phrases, column: str, every: bool = True) -> DataFrame:
    """The documents, or only those with hits, and a column of their hits; ``phrases`` is
    a broadcast."""
    schema = T.StructType([*documents.schema.fields, T.StructField(column, _HITS)])
    place = documents.columns.index("text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, place):
                hits = _hits(piece.column(place), phrases.value)
                columns = [*piece.columns, pa.array(hits, _HITS_ARROW)]
                found = pa.RecordBatch.from_arrays(columns, [*piece.schema.names, column])
                if not every:
                    found = found.filter(pa.array([bool(one["starts"]) for one in hits], pa.bool_()))
                yield found

    return documents.mapInArrow(search, schema)


def _with_hits(documents: DataFrame, benchmark: DataFrame, column: str) -> DataFrame:
    """The documents and a column of their hits; one pass per block of the benchmark.

    With several blocks each pass stores its hits before the next, so that no more than
    one block is held by the executors at a time; hits are put together by row at the end.
    """
    context = documents.sparkSession.sparkContext
    if _block_count(benchmark) <= 1:
        (phrases,) = benchmark_blocks(benchmark)
        return _searched(documents, context.broadcast(phrases), column)
    key = unused("row", documents.columns)
    kept = stored(documents.withColumn(key, F.monotonically_increasing_id()), "documents")
    parts = []
    for phrases in benchmark_blocks(benchmark):
        sent = context.broadcast(phrases)
        # The first pass counts the words of every document.
        found = _searched(kept.select(key, "text"), sent, column, every=not parts)
        parts.append(stored(found.select(key, column), "hits"))
        sent.destroy()
    hits = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.collect_list(column).alias(column))

    @F.arrow_udf(_HITS)
    def merge(lists: pa.Array) -> pa.Array:
        return pa.array([_merged(one) for one in lists.to_pylist()], _HITS_ARROW)

    joined = kept.join(hits, key)
    return joined.select(*documents.columns, merge(column).alias(column))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, spans, items``; spans count words from 0."""
    found = _with_hits(documents.select("doc_id", "text"), benchmark, "hits")
    hits = F.col("hits")
    spans = F.arrays_zip(hits["starts"].alias("start"), hits["stops"].alias("stop"))
    covered = F.aggregate(
        F.zip_with(hits["stops"], hits["starts"], lambda stop, start: stop - start),
        F.lit(0).cast("long"),
        lambda total, words: total + words,
    )
    return found.select(
        "doc_id",
        hits["words"].alias("n_words"),
        covered.alias("n_hit"),
        spans.alias("spans"),
        F.array_sort(hits["items"]).alias("items"),
    )


def cut(text: str, hits: dict) -> str:
    """The text without the hit words and what stands between them."""
    data = text.encode()
    words = [match.span() for match in _WORD_PATTERN.finditer(data)]
    kept, at = [], 0
    for start, stop in zip(hits["starts"], hits["stops"]):
        kept.append(data[at : words[start][0]])
        at = words[stop - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with every occurrence of a window cut out; other texts as they were.

    What stood around a cut may form a new window; cutting goes on until none is left.
    A document that loses all its words is dropped; ``n_chars``, if there is such a
    column, is counted anew where a text was cut.
    """
    context = documents.sparkSession.sparkContext
    if _block_count(benchmark) <= 1:
        (phrases,) = benchmark_blocks(benchmark)
        return _cut_out(documents, context.broadcast(phrases))
    while True:  # a cut for one block may make a window of another
        for phrases in benchmark_blocks(benchmark):
            sent = context.broadcast(phrases)
            documents = stored(_cut_out(documents, sent), "decontaminated")
            sent.destroy()
        if contamination(documents, benchmark).where(F.col("n_hit") > 0).isEmpty():
            return documents


def _cut_out(documents: DataFrame, phrases) -> DataFrame:
    names = documents.columns
    place, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for piece in slices(batch, place):
                texts, changed = piece.column(place), {}
                rows = list(range(len(texts)))
                while rows:
                    now = pa.array([changed[i] for i in rows], pa.string()) if changed else texts
                    hits = _hits(now, phrases.value)
                    hit = [(i, one) for i, one in zip(rows, hits) if one["starts"]]
                    for i, one in hit:
                        changed[i] = cut(changed[i] if i in changed else texts[i].as_py(), one)
                    rows = [i for i, _ in hit]
                yield _replaced(piece, place, chars, changed)

    return documents.mapInArrow(clean, documents.schema)


def _replaced(piece: pa.RecordBatch, place: int, chars: int | None, changed: dict) -> pa.RecordBatch:
    if not changed:
        return piece
    columns = list(piece.columns)
    texts = columns[place].to_pylist()
    for i, text in changed.items():
        texts[i] = text
    columns[place] = pa.array(texts, columns[place].type)
    if chars is not None:
        counts = columns[chars].to_pylist()
        for i, text in changed.items():
            counts[i] = len(text)
        columns[chars] = pa.array(counts, columns[chars].type)
    gone = {i for i, text in changed.items() if not _WORD_PATTERN.search(text.encode())}
    left = [i not in gone for i in range(len(piece))]
    return pa.RecordBatch.from_arrays(columns, schema=piece.schema).filter(pa.array(left))


def digests(found: DataFrame) -> DataFrame:
    """The items of ``contamination`` as a count and a digest."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
