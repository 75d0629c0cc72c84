"""Near-duplicates: banded MinHash candidates, odd sketches, exact checks on full sets.

A document is the set of its different shingles of five words. Documents with equal sets
are one class and only its first member goes on. 128 MinHash samples of the set make 32
band keys of four samples; classes that share a key are candidates. The samples are also
folded into an odd sketch: a bitmap in which every sample flips one bit. The ones in the
XOR of two sketches tell how many samples differ, most precisely for similar sets, so
pairs that are clearly too different are dropped without reading their texts. What is
left is compared on the full sets; only that decides.

Which pairs are compared: first every class with the least class of each of its buckets.
The links found give components. Buckets whose classes are then in different components
are looked at again with their texts: classes of different components that are close by
sketch are compared on their sets, until what is similar is joined. Pairs inside a
component need no look, and only joining links are given out, so a group of thousands of
near copies makes as many rows as it has members and band keys, not its square. Large
buckets are split to blocks that meet pairwise.

A pair of similarity 0.75 shares no band with a probability of 5e-6, and is dropped by
its sketch with one of about 1e-6; links are otherwise exact.

Defined cases: texts are lower-cased for A-Z only. Fewer than five words make one shingle
of them all. A NULL, empty or blank text has no shingles and no links. Rows with a NULL
``doc_id`` are linked with nothing (``component_id`` NULL, kept). A ``doc_id`` on several
rows names each of them. Long texts are used whole. An empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlark.llm.common import LOWER_WORDS, concat_range, dictionary_words, mix64, slices, stored, unused
from postlark.llm.components import components

SHINGLE = 5
LEAST_PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
# A pair at the least similarity differs in 57 bits on average; this is 4.8 deviations more.
MOST_BITS = 100
# A block of a bucket: classes, and shingles of their texts.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, SAMPLES, np.uint64)
_SALTS = _rng.integers(0, 1 << 63, SAMPLES, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_SIGNATURES = "doc_id long, row long, n_shingles long, node binary, bands array<long>, sketch array<long>"
_SIGNATURES_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("n_shingles", pa.int64()),
        ("node", pa.binary()),
        ("bands", pa.list_(pa.int64())),
        ("sketch", pa.list_(pa.int64())),
    ]
)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's different shingles."""
    words = dictionary_words(texts, LOWER_WORDS)
    if len(words.dictionary):
        names = words.dictionary.to_numpy(zero_copy_only=False)
        hashed = mix64(pd.util.hash_array(names, categorize=False))[words.codes]
    else:
        hashed = np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(hashed) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        rolled *= _STEP
        rolled += hashed[k : len(hashed) - SHINGLE + 1 + k]
    rolled = mix64(rolled)
    for start, stop in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        if stop - start >= SHINGLE:
            yield np.unique(rolled[start : stop - SHINGLE + 1])
        elif stop > start:
            few = np.array([stop - start], np.uint64)
            for k in range(start, stop):
                few = few * _STEP + hashed[k : k + 1]
            yield mix64(few)
        else:
            yield hashed[:0]


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        part = _FACTORS[:, None] * shingles[None, start : start + 1024]
        part += _TERMS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = mix64(samples ^ _SALTS).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        key = mix64(key * _STEP + rows[:, row])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Which bits an odd number of samples hit, as 64-bit words."""
    at = (mix64(samples + _SALTS) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def node_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _rows(documents: DataFrame) -> DataFrame:
    """``doc_id, row, text``; ``row`` is a hash of the id and the text. Ids may repeat, so rows
    with one id and different texts are told apart by it."""
    doc_id = F.col("doc_id").cast("long")
    return documents.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("row"), "text")


def _texts(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """``row, text``: each text that some rows ask for, once, however often it is repeated.

    How many rows ask grows with the documents, so they are never broadcast: the join is by
    shuffle at every size, and the grouping after it uses its partitions.
    """
    asked = _rows(documents).select("row", "text").join(rows.distinct().hint("merge"), "row", "left_semi")
    return stored(asked.groupBy("row").agg(F.first("text").alias("text")), "texts")


def signatures(documents: DataFrame) -> DataFrame:
    """``doc_id, row, n_shingles, node, bands, sketch``; ``node`` names the set of shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                sizes, nodes, bands, sketches = [], [], [], []
                for shingles in shingle_sets(piece.column("text")):
                    sizes.append(len(shingles))
                    if not len(shingles):
                        nodes.append(None), bands.append(None), sketches.append(None)
                        continue
                    samples = min_hashes(shingles)
                    nodes.append(node_of(shingles))
                    bands.append(band_keys(samples))
                    sketches.append(odd_sketch(samples))
                columns = [piece.column("doc_id"), piece.column("row"), sizes, nodes, bands, sketches]
                yield pa.RecordBatch.from_arrays(
                    [
                        column if isinstance(column, pa.Array) else pa.array(column, field.type)
                        for column, field in zip(columns, _SIGNATURES_ARROW)
                    ],
                    schema=_SIGNATURES_ARROW,
                )

    return _rows(documents).mapInArrow(sign, _SIGNATURES)


def close_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sketches differ in few bits."""
    words = SKETCH_BITS // 64
    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    differing = sum(
        (F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(words)),
        F.lit(0),
    )
    return pairs.join(right, "b").join(left, "a").where(differing <= MOST_BITS).select("a", "b")


def linked(pairs: DataFrame, documents: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes that are similar enough, on the sets of their texts.

    ``first`` has the row that stands for a node. Texts travel, as they are smaller
    than the hashes of their shingles.
    """
    named = pairs.join(first.toDF("b", "row_b"), "b").join(first.toDF("a", "row_a"), "a")
    named = stored(named, "pairs")
    asked = named.select(F.col("row_a").alias("row")).union(named.select("row_b"))
    texts = _texts(documents, asked)
    with_b = named.join(texts.toDF("row_b", "text_b"), "row_b").select("a", "b", "row_a", "text_b")
    with_both = with_b.join(texts.toDF("row_a", "text_a"), "row_a").select("a", "b", "text_a", "text_b")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, "text_a"):
                for piece in slices(half, "text_b"):
                    sets_a = shingle_sets(piece.column("text_a"))
                    sets_b = shingle_sets(piece.column("text_b"))
                    keep = []
                    names = zip(piece.column("a").to_pylist(), piece.column("b").to_pylist())
                    for one, other, named in zip(sets_a, sets_b, names):
                        if (node_of(one), node_of(other)) != named:  # two rows of one hash
                            keep.append(False)
                            continue
                        keep.append(_alike(one, other))
                    yield piece.select(["a", "b"]).cast(schema).filter(pa.array(keep, pa.bool_()))

    return with_both.mapInArrow(check, "a binary, b binary").distinct()


def _alike(one: np.ndarray, other: np.ndarray) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= LEAST_PERCENT * (len(one) + len(other) - common)


def forest(sets: list[np.ndarray], sketch: np.ndarray, root: np.ndarray, side: np.ndarray | None):
    """Links between sets of different components, as few as join what is similar.

    ``root`` numbers the component of each set; with ``side`` only sets of different
    sides are compared. A set is compared with those that are close by sketch and not
    joined to it yet: a few one by one, many by counting in lists of who has a shingle.
    """
    parent = np.arange(int(root.max()) + 1)
    sizes = np.array([len(one) for one in sets])
    lists = None
    for i in range(len(sets) - 1):
        near = np.bitwise_count(sketch[i + 1 :] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= MOST_BITS
        near &= parent[root[i + 1 :]] != parent[root[i]]
        if side is not None:
            near &= side[i + 1 :] != side[i]
        near = i + 1 + np.flatnonzero(near)
        if len(near) > 16:
            if lists is None:
                _, ids = np.unique(np.concatenate(sets), return_inverse=True)
                owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
                heads = np.concatenate([[0], np.cumsum(np.bincount(ids))])
                lists, starts = ids, np.cumsum(sizes) - sizes
            mine = lists[starts[i] : starts[i] + sizes[i]]
            holders = owner[concat_range(heads[mine], heads[mine + 1] - heads[mine])]
            common = np.bincount(holders, minlength=len(sets))[near]
            near = near[100 * common >= LEAST_PERCENT * (sizes[i] + sizes[near] - common)]
            checked = True
        else:
            checked = False
        for j in near.tolist():
            if parent[root[j]] != parent[root[i]] and (checked or _alike(sets[i], sets[j])):
                yield i, j
                parent[parent == parent[root[j]]] = parent[root[i]]


def across(members: DataFrame, documents: DataFrame) -> DataFrame:
    """Links ``a, b`` between components that meet in a bucket.

    ``members``: ``key, node, root, sketch, n_shingles, row``. Buckets with the same
    members are looked at once. A bucket is split to blocks of bounded size, and every
    two blocks meet in a task.
    """
    name = F.xxhash64("node")
    buckets = (
        members.groupBy("key")
        .agg(
            F.count("*").alias("size"),
            F.sum(F.col("n_shingles") + 1).alias("shingles"),
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.struct(F.sum(name.cast("decimal(38,0)")), F.bit_xor(F.xxhash64("node", F.lit(1)))).alias("who"),
        )
        .where("size > 2 AND low != high")
        .groupBy("size", "who")
        .agg(F.min(F.struct("key", "shingles")).alias("one"))
        .select("one.key", "size", "one.shingles")
    )
    mixed = members.join(buckets, "key")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(name, blocks).cast("int")
    spread = stored(
        mixed.select(
            "key", "node", "root", "sketch", "row", own.alias("own"),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
        ).select(
            "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
            "own", "node", "root", "sketch", "row",
        ),
        "blocks",
    )
    texts = _texts(documents, spread.select("row"))
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingle_sets(pa.array(frame["text"], pa.string())))
        same = [node_of(one) == node for one, node in zip(sets, frame["node"])]
        rows = np.flatnonzero(same)  # not another row of that hash
        rows = rows[np.unique(frame["node"].to_numpy()[rows], return_index=True)[1]] if len(rows) else rows
        frame, sets = frame.iloc[rows], [sets[i] for i in rows]
        nodes, out = frame["node"].tolist(), []
        if len(nodes) > 1:
            sketch = np.array(frame["sketch"].tolist(), np.int64).view(np.uint64)
            side = frame["own"].to_numpy() if frame["one"].iloc[0] != frame["two"].iloc[0] else None
            found = forest(sets, sketch, pd.factorize(frame["root"])[0], side)
            out = [(nodes[i], nodes[j]) for i, j in found]
        return pd.DataFrame(out, columns=["a", "b"])

    return spread.join(texts, "row").groupBy("key", "one", "two").applyInPandas(link, schema)


def _joined(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures, the document that stands for each node, and the root of linked nodes."""
    signed = stored(signatures(documents), "signatures")
    named = signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(
        named.groupBy("node").agg(F.min(F.struct("doc_id", "row", "n_shingles", "bands", "sketch")).alias("one")).select(
            "node", "one.*"
        ),
        "classes",
    )
    first = classes.select("node", "doc_id")
    stand = classes.select("node", "row")
    sketches = classes.select("node", "sketch")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = (
        keyed.groupBy("key")
        .agg(F.min("node").alias("least"), F.count("*").alias("size"))
        .where(F.col("size") > 1)
    )
    members = stored(keyed.join(shared, "key").select("key", "node", "least"), "buckets")
    pairs = (
        members.where(F.col("node") != F.col("least"))
        .select(F.col("least").alias("a"), F.col("node").alias("b"))
        .distinct()
    )
    links = stored(linked(close_sketches(pairs, sketches), documents, stand), "links")
    roots = components(links)

    # Buckets whose classes are still apart.
    apart = (
        members.join(roots, "node", "left")
        .select("key", "node", F.coalesce("root", "node").alias("root"))
        .join(classes.select("node", "sketch", "n_shingles", "row"), "node")
    )
    more = stored(across(apart, documents), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return signed, first, roots


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    signed, first, roots = _joined(documents)
    smallest = (
        first.join(roots, "node")
        .groupBy("root")
        .agg(F.min("doc_id").alias("component_id"))
    )
    labels = first.join(roots.join(smallest, "root").select("node", "component_id"), "node", "left").select(
        "node", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    labelled = signed.select("doc_id", "n_shingles", "node").join(stored(labels, "labels"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(
        F.col("doc_id").isNotNull(), F.col("component_id")
    )
    return labelled.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """The documents, all columns, of which one row per component is kept.

    Rows are told apart by ``doc_id`` and text: only those go whose own text is a near copy,
    also without a ``doc_id``. The smallest ``doc_id`` stays, NULL last; of rows with the same
    id and text one stays. Texts without shingles all stay.
    """
    doc_id = F.col("doc_id").cast("long")
    key, name = F.xxhash64(doc_id, F.col("text")), unused("_key", documents.columns)
    signed, _, roots = _joined(documents.select(key.alias("doc_id"), "text"))
    rows = signed.where(F.col("node").isNotNull()).groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    rows = stored(rows.join(roots, "node", "left").select(
        F.col("doc_id").alias(name), F.coalesce("root", "node").alias("root"), "n"
    ), "near-rows")
    ids = documents.select(key.alias(name), doc_id.alias("id")).distinct()
    order = F.struct(F.col("id").isNull(), "id", name, "n")
    best = rows.join(ids, name).groupBy("root").agg(F.min(order).alias("best"))
    best = stored(best.select(f"best.{name}", "best.n"), "near-best")
    gone = stored(rows.select(name).join(best, name, "left_anti"), "near-duplicates")
    again = best.where("n > 1").select(name)
    left = documents.withColumn(name, key).join(gone, name, "left_anti")
    once = left.join(again, name, "left_anti").select(documents.columns)
    if again.isEmpty():
        return once
    columns = [F.col(column) for column in documents.columns]
    one = left.join(again, name, "left_semi").groupBy(name).agg(
        F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("one")
    )
    return once.unionByName(one.select("one.*"))
