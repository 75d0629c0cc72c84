"""The prefix trie of conversations, by union-find over neighbours in sorted order.

Every conversation is its sequence of turn digests. In sorted order conversations with a
common beginning stand side by side, and neighbours share as many turns as their longest
common prefix (LCP). Taking the edges between neighbours from the longest LCP down and
merging their components gives the trie: a component merged at depth ``D`` is a branching
node, and the nodes above it up to the next merge have the same members.

Sorted conversations are cut into blocks. A block knows the LCP with the last conversation
before it and the first one after it, so each block builds its own forest: nodes that lie
inside are finished, and the few that reach across a boundary (prefixes of the block's first
or last conversation) are sent on in sums, one row per block and node, and merged by digest.
What a node counts is a sum over its conversations, each with the LCP to the one before it:

* a conversation adds a child to the prefix at depth ``d`` if it is longer and its LCP is
  at most ``d``; it ends in a leaf if it is longer than its LCP with the next one;
* it saves, below depth ``d``, the words of its turns from ``d`` up to its LCP.

Scale: texts are reduced to a digest of 16 bytes and a word count at the scan. Copies of a
conversation are split by their ids, as the sort is by sequence and id, so a copy that a
third of all conversations share fills many blocks. A merge meets one row per block. A task
holds one block: ``BLOCK_BYTES`` of digests or one longer conversation. The ids of
conversations that end at a node reach across blocks as strings, hashed in order without
being held. Digests are the first half of SHA-256; equal digests are taken for equal turns.

Defined cases: rows without a ``conv_id`` belong to no conversation. NULL roles and texts are
empty. Rows of one turn number are ordered by their digest, repeated rows are turns of their
own. Remainders have the sign of the id, as in SQL. Without conversations there is no root
and no row. Other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlark.llm.common import concat_range, stored, word_count
from postlark.llm.files import each_row

DIGEST = 16
BLOCK_BYTES = 1 << 18
BLOCK_ROWS = 4_096

_BLOCK = "part int, seq int, ids binary, sizes binary, keys binary, words binary, first binary, last binary"
_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)
# A row of a block's forest: a finished node, or a part of one that other blocks share.
# ``node`` and ``parent`` are digests, set where a boundary runs through the node or its parent.
_PIECE = f"block long, open boolean, node binary, parent binary, ends string, {_NODE}"
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
_PIECE_ARROW = pa.schema([(field.split()[0], _ARROW[field.split()[1]]) for field in _PIECE.split(", ")])


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, digest, words``: the turns of each conversation, numbered from 0."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.substring(F.unhex(F.sha2(content.cast("binary"), 256)), 1, DIGEST).alias("digest"),
        word_count(text).alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.withColumn("at", F.row_number().over(order) - 1).select("conv_id", "at", "digest", "words")


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, key, words``: conversations whose head comes from the first of their family.

    The first ``h`` turns come from conversation ``c - c % family``, with ``h`` the CRC-32 of
    the id in decimal modulo ``most``; the conversation's own turns after its first ``h`` follow.
    """
    numbered = stored(turns(conversations), "turns")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % family
    turn = F.struct(F.col("at"), F.lower(F.hex("digest")).alias("hex"), "words")
    own = numbered.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("at") >= head, turn))).alias("own")
    )
    heads = (
        numbered.where((F.col("at") < most - 1) & (base == F.col("conv_id")))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(turn)).alias("heads"))
    )
    joined = own.withColumn("base", base).join(heads, "base", "left")
    borrowed = F.slice(F.coalesce("heads", F.array().cast(joined.schema["own"].dataType)), 1, head.cast("int"))
    whole = joined.select("conv_id", F.concat(borrowed, "own").alias("turns"))
    return whole.select(
        "conv_id",
        F.unhex(F.array_join(F.col("turns.hex"), "")).alias("key"),
        F.col("turns.words").alias("words"),
    )


def _blocks(sequences: DataFrame) -> DataFrame:
    """Sorted conversations packed into blocks, numbered by the order of the whole table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seq, part = [], 0, 0, None

        def block():
            ids, keys, words = zip(*held)
            lengths = np.array([len(key) // DIGEST for key in keys], np.int64)
            row = [
                part, seq, np.array(ids, np.int64).tobytes(), lengths.tobytes(), b"".join(keys),
                np.array([w for one in words for w in one], np.int64).tobytes(), keys[0], keys[-1],
            ]
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
            names = [field.split()[0] for field in _BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "key", "words", "part"))
            for conv_id, key, words, part in zip(*columns):
                if held and (size + len(key) > BLOCK_BYTES or len(held) >= BLOCK_ROWS):
                    yield block()
                    held, size, seq = [], 0, seq + 1
                held.append((conv_id, key, words))
                size += len(key)
        if held:
            yield block()

    ordered = sequences.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    packed = stored(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(pack, _BLOCK), "blocks")
    # A row per partition reaches the driver: how many blocks it made.
    counts = sorted(packed.groupBy("part").count().collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    offsets = sequences.sparkSession.createDataFrame(starts, "part int, start long")
    return packed.join(offsets, "part").withColumn("block", F.col("start") + F.col("seq")).drop("part", "seq", "start")


def _with_neighbours(blocks: DataFrame) -> DataFrame:
    """Blocks with the last sequence before them and the first one after them."""
    before = blocks.select((F.col("block") + 1).alias("block"), F.col("last").alias("before"))
    after = blocks.select((F.col("block") - 1).alias("block"), F.col("first").alias("after"))
    kept = blocks.drop("first", "last")
    return kept.join(before, "block", "left").join(after, "block", "left")


def _common(one: bytes | None, other: bytes | None) -> int:
    """How many turns two sequences share at the beginning; -1 if one is missing."""
    if one is None or other is None:
        return -1
    n = min(len(one), len(other))
    a, b = np.frombuffer(one[:n], np.uint8), np.frombuffer(other[:n], np.uint8)
    differ = np.flatnonzero(a != b)
    return int(differ[0] if len(differ) else n) // DIGEST


class Forest:
    """The trie of one block's conversations: components of union-find, with their depths."""

    def __init__(self, ids, sizes, keys, words, before, after):
        self.ids, self.sizes = ids, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.n = len(ids)
        # Turns as pairs of numbers, so that neighbours are compared all at once.
        pairs = np.frombuffer(keys, np.uint64).reshape(-1, 2) if keys else np.empty((0, 2), np.uint64)
        inner = np.zeros(self.n, np.int64)
        shorter = np.minimum(sizes[:-1], sizes[1:])
        row = np.repeat(np.arange(1, self.n), shorter)
        left, right = (concat_range(self.starts[i : i + self.n - 1], shorter) for i in (0, 1))
        same = (pairs[left] == pairs[right]).all(axis=1)
        at = concat_range(np.zeros(self.n - 1, np.int64), shorter)
        inner[1:] = shorter
        np.minimum.at(inner, row[~same], at[~same])
        self.first, self.last = keys[: sizes[0] * DIGEST], keys[len(keys) - sizes[-1] * DIGEST :]
        # lcp[i] is shared by conversations i - 1 and i; both ends look across the boundary.
        self.lcp = np.append(inner, _common(self.last, after))
        self.lcp[0] = _common(before, self.first)
        cumulated = np.concatenate([[0], np.cumsum(words)])
        self.cumulated = cumulated
        # Words of the turns each conversation shares with the one before it.
        shared = np.maximum(self.lcp[:-1], 0)
        self.saved = cumulated[self.starts[:-1] + shared] - cumulated[self.starts[:-1]]
        self.saved_sums = np.concatenate([[0], np.cumsum(self.saved)])
        self.leaf_sums = np.concatenate([[0], np.cumsum(self.lcp[1:] < sizes)])

    def components(self) -> list[tuple[int, int, int, int, int]]:
        """``left, right, top, depth, above`` of every component: its conversations, the depths
        of its nodes, from just below the next merge down to where it came to be, and the
        number of the component it is merged into (-1: none). Parents come after children."""
        out, above = [], []
        parent = list(range(self.n))
        left, right = list(range(self.n)), list(range(self.n))
        inside: list[list[int]] = [[] for _ in range(self.n)]

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def finished(one: int, top: int) -> int:
            for child in inside[one]:
                above[child] = len(out)
            out.append((left[one], right[one], top, depth[one]))
            above.append(-1)
            return len(out) - 1

        depth = self.sizes.tolist()
        lcp = self.lcp.tolist()
        size = [1] * self.n
        for i in sorted(range(1, self.n), key=lambda i: -lcp[i]):
            a, b, at = find(i - 1), find(i), lcp[i]
            for one in (a, b):
                # A component that was deeper ends here; one of the same depth goes on.
                if depth[one] > at:
                    inside[one] = [finished(one, at + 1)]
            if size[a] < size[b]:
                a, b = b, a
            parent[b] = a
            size[a] += size[b]
            left[a], right[a] = min(left[a], left[b]), max(right[a], right[b])
            depth[a] = at
            if len(inside[a]) < len(inside[b]):
                inside[a], inside[b] = inside[b], inside[a]
            inside[a] += inside[b]
            inside[b] = []
        finished(find(0), 0)
        return [(*one, up) for one, up in zip(out, above)]

    def children(self, left: int, right: int, depth: int) -> int:
        lcp, sizes = self.lcp[left : right + 1], self.sizes[left : right + 1]
        return int(((lcp <= depth) & (sizes > depth)).sum())

    def ends(self, left: int, right: int, depth: int) -> str:
        """Ids of the conversations that end at a node; they stand at its beginning."""
        stop = left + int(np.searchsorted(self.sizes[left : right + 1] > depth, True))
        return ",".join(map(str, self.ids[left:stop].tolist()))

    def prefixes(self) -> dict[tuple[bool, int], bytes]:
        """Digests of the prefixes of the first and the last conversation, by depth."""
        out = {}
        for side, key in ((False, self.first), (True, self.last)):
            state = hashlib.sha256()
            out[side, 0] = state.digest()
            for depth in range(1, len(key) // DIGEST + 1):
                state.update(key[(depth - 1) * DIGEST : depth * DIGEST])
                out[side, depth] = state.digest()
        return out

    def pieces(self, block: int) -> Iterator[tuple]:
        prefixes = self.prefixes()
        least = _RangeMin(self.ids)
        # The turns shared across the boundaries; -1 where the table ends, so that the root
        # of a block that is alone is its own.
        into, onward = int(self.lcp[0]), int(self.lcp[-1])

        def shared(left: int, right: int, depth: int) -> bytes | None:
            """The digest of a node that reaches across a boundary."""
            if left == 0 and depth <= into:
                return prefixes[False, depth]
            if right == self.n - 1 and depth <= onward:
                return prefixes[True, depth]
            return None

        components = self.components()
        for left, right, top, bottom, up in components:
            own, n = least(left, right), right - left + 1
            start = self.starts[left]
            sums = int(self.saved_sums[right + 1] - self.saved_sums[left])
            leaves = int(self.leaf_sums[right + 1] - self.leaf_sums[left])
            for depth in range(top, bottom + 1):
                node = shared(left, right, depth)
                # Words above the node; its first conversation saves nothing below it.
                above = int(self.cumulated[start + max(depth - 1, 0)] - self.cumulated[start])
                saved = sums - n * above
                if self.lcp[left] < depth:
                    saved -= int(self.saved[left]) - above
                if depth < bottom:
                    children, ended = int(self.lcp[left] <= depth), ""
                else:
                    children, ended = self.children(left, right, bottom), self.ends(left, right, bottom)
                if not depth:
                    parent = mother = None
                else:
                    around = (left, right) if depth > top else components[up][:2]
                    mother = shared(*around, depth - 1)
                    parent = None if mother else least(*around)
                digest = None if node else hashlib.sha256(ended.encode()).hexdigest()
                yield (
                    block, node is not None, node, mother, ended if node else None,
                    own, depth, parent, n, children, leaves, saved, digest,
                )


class _RangeMin:
    """Least ids of ranges, by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, left: int, right: int) -> int:
        level = (right - left + 1).bit_length() - 1
        row = self.levels[level]
        return int(min(row[left], row[right + 1 - (1 << level)]))


def _forests(blocks: DataFrame) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(given):
            for block, ids, sizes, keys, words, before, after in given:
                numbers = [np.frombuffer(one, np.int64) for one in (ids, sizes, words)]
                yield from Forest(*numbers[:2], keys, numbers[2], before, after).pieces(block)

        yield from each_row(rows, _PIECE_ARROW)(batches)

    columns = ("block", "ids", "sizes", "keys", "words", "before", "after")
    return blocks.select(*columns).mapInArrow(build, _PIECE)


def _ends(parts: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of shared nodes, hashed block by block in their order."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(given):
            node, state = None, None
            for one, ends in given:
                if one != node:
                    if node is not None:
                        yield node, state.hexdigest()
                    node, state = one, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if node is not None:
                yield node, state.hexdigest()

        schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
        yield from each_row(rows, schema)(batches)

    some = parts.where(F.col("ends") != "").select("node", "block", "ends")
    ordered = some.repartition("node").sortWithinPartitions("node", "block").select("node", "ends")
    return ordered.mapInArrow(hashed, "node binary, ends_sha256 string")


def trie(sequences: DataFrame) -> DataFrame:
    """A row per node of the trie of ``conv_id, key, words``."""
    pieces = stored(_forests(_with_neighbours(_blocks(sequences))), "forests")
    names = [field.split()[0] for field in _NODE.split(", ")]
    parts = pieces.where("open")
    counts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = parts.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent"),
        *[F.sum(name).alias(name) for name in counts],
    )
    merged = stored(merged, "merged")
    nothing = F.lit(hashlib.sha256().hexdigest())
    mothers = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shared = (
        merged.join(_ends(parts), "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
        .join(mothers, "parent", "left")
    )
    # A node that many others hang on meets them block by block.
    local = parts.select("block", F.col("node").alias("parent")).join(mothers, "parent")
    inner = pieces.where(~F.col("open"))
    hanging = inner.where(F.col("parent").isNotNull()).drop("parent_conv_id").join(local, ["block", "parent"])
    alone = inner.where(F.col("parent").isNull())
    return alone.select(names).unionByName(hanging.select(names)).unionByName(shared.select(names))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; see ``rebuilt``."""
    return trie(stored(rebuilt(conversations), "sequences"))
