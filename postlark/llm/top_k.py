"""Exact search for the k largest inner products by dual trees over blocks.

Vectors are dealt to blocks around pivots, which a bounded sample gives; large clusters are
split by a hash, so a vector that many rows share fills several blocks. Every block holds
its rows and is a query group with those of its rows that are queries: queries and data
are indexed together. Groups and blocks first meet as centres and radii only. Each group
searches the blocks that promise most; its worst kth score then excludes every block whose
bound is lower, and the group searches the others. Within a pair of blocks, ``cover_tree``
prunes in the same way. The result is exact; pivots only decide how much is pruned.

Scale: a task holds one group and one block. Centres are compared in chunks of
``CHUNK`` blocks, joined by the number of the chunk. Only pivots, a row per pivot and
two counts reach the driver.

Defined cases: vectors that are NULL or hold NULL or non-finite components take no part.
Vectors of different lengths are filled up with zeros. Rows are told apart even if they
repeat an id: a query's own row is left out, others with its id are not. A NULL id is no
query and comes last among equal scores. Scores beyond 64 bits are cut to that range. With
fewer than k candidates all are returned. An empty table gives no rows.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlark.llm.common import stored
from postlark.llm.cover_tree import Best, bound, build, search

SCALE = 256
PIVOTS, SAMPLE_ROWS = 16, 2_000
BLOCK_ROWS = 8_192
CHUNK = 1_024
FIRST_BLOCKS = 2
NO_ID = (1 << 63) - 1

_FOUND = "query_key long, query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, query: Column) -> DataFrame:
    """``key, vec_id, is_query, v``: whole numbers ``floor(SCALE * x)``, a key per row."""
    good = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    rows = vectors.where(F.col("embedding").isNotNull()).where(good)
    return stored(
        rows.select(
            F.monotonically_increasing_id().alias("key"),
            F.col("vec_id").cast("long").alias("vec_id"),
            F.coalesce(query, F.lit(False)).alias("is_query"),
            F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"),
        ),
        "vectors",
    )


def _matrix(lists: list) -> np.ndarray:
    """Vectors as rows of doubles, or of Python's integers where doubles are not exact."""
    width = max((len(one) for one in lists), default=0)
    lists = [[*one, *[0] * (width - len(one))] for one in lists]
    most = max((abs(x) for one in lists for x in (min(one, default=0), max(one, default=0))), default=0)
    exact = most * most * max(width, 1) < 1 << 53
    return np.array(lists, np.float64 if exact else object).reshape(len(lists), width)


def _padded(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(one.shape[1], other.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (one, other))


def pivots(rows: DataFrame) -> np.ndarray:
    """Vectors far from each other, of a sample of at most about ``SAMPLE_ROWS`` rows."""
    every = max(rows.count() // SAMPLE_ROWS, 1)
    chosen = rows.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("v").limit(2 * SAMPLE_ROWS)
    sample = _matrix([row.v for row in chosen.collect()]).astype(np.float64)
    if not len(sample):
        return sample
    picked = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < PIVOTS and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def blocks(rows: DataFrame) -> DataFrame:
    """``block, shape, data, queries, n_queries``: a row per block, trees and all."""
    centres = pivots(rows)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("v").to_pylist()).astype(np.float64)
            own, fixed = _padded(own, centres)
            gaps = (fixed**2).sum(axis=1) - 2 * own @ fixed.T
            pivot = pa.array(gaps.argmin(axis=1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pivot, *batch.columns], ["pivot", *batch.schema.names])

    schema = T.StructType([T.StructField("pivot", T.LongType()), *rows.schema.fields])
    dealt = stored(rows.mapInArrow(nearest, schema), "dealt")
    sizes = dict(dealt.groupBy("pivot").count().collect())  # a row per pivot
    parts = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, -(-n // BLOCK_ROWS))]) if sizes else None
    salt = F.pmod(F.xxhash64("key"), parts[F.col("pivot")]) if sizes else F.lit(0)
    keyed = dealt.withColumn("block", F.col("pivot") * 1_000_000_000 + salt)

    def pack(frame: pd.DataFrame) -> dict:
        vectors = _matrix(frame["v"].tolist())
        order, root = build(vectors.astype(np.float64))
        frame = frame.iloc[order]
        ids = frame["vec_id"].fillna(NO_ID).to_numpy(np.int64)
        return {"v": vectors[order], "ids": ids, "keys": frame["key"].to_numpy(np.int64), "root": root}

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        frame["vec_id"] = frame["vec_id"].astype("Int64")
        data, asked = pack(frame), frame[frame["is_query"]]
        queries = pack(asked)
        shape = [(n.centre, n.norm, n.radius) if (n := one["root"]) else None for one in (data, queries)]
        row = [frame["block"].iloc[0], *map(pickle.dumps, (shape, data, queries)), len(asked)]
        return pd.DataFrame([row], columns=["block", "shape", "data", "queries", "n_queries"])

    made = keyed.groupBy("block").applyInPandas(
        index, "block long, shape binary, data binary, queries binary, n_queries int"
    )
    return stored(made, "blocks")


def _bounds(made: DataFrame) -> DataFrame:
    """``query_block, block, most``: every group with every block, by centres and radii."""
    shapes = made.select("block", "shape", "n_queries")
    chunk = F.floor((F.row_number().over(Window.orderBy("block")) - 1) / CHUNK)
    chunks = shapes.withColumn("chunk", chunk).groupBy("chunk").agg(
        F.collect_list(F.struct("block", "shape")).alias("members")
    )
    last = -(-made.count() // CHUNK) - 1
    groups = shapes.where("n_queries > 0").select(
        F.col("block").alias("query_block"),
        F.col("shape").alias("query_shape"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(last, 0)).cast("long"))).alias("chunk"),
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group, shape, members in zip(*(column.to_pylist() for column in batch.columns)):
                centre, norm, radius = pickle.loads(shape)[1]
                for member in members:
                    other, its_norm, its_radius = pickle.loads(member["shape"])[0]
                    one, two = _padded(centre[None], other[None])
                    out.append((group, member["block"], float(bound(one[0], norm, radius, two[0], its_norm, its_radius))))
            columns = [pa.array(column) for column in zip(*out)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays(columns, ["query_block", "block", "most"])

    joined = groups.join(chunks, "chunk").select("query_block", "query_shape", "members")
    return joined.mapInArrow(meet, "query_block long, block long, most double")


def _compare(pairs: DataFrame, made: DataFrame, k: int) -> DataFrame:
    """The k best of every query of a group in each block it is paired with.

    ``pairs``: ``query_block, block, known``, where ``known`` lists ``key, score`` of
    queries whose kth score is at least that.
    """
    groups = made.select(F.col("block").alias("query_block"), "queries")
    rows = (
        pairs.join(groups, "query_block").join(made.select("block", "data"), "block").select("queries", "data", "known")
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked, data = (pickle.loads(batch.column(c)[i].as_py()) for c in (0, 1))
                known = {row["key"]: row["score"] for row in batch.column(2)[i].as_py() or ()}
                least = np.array([known.get(key, -np.inf) for key in asked["keys"].tolist()])
                best = Best(len(least), k, least)
                q, d = _padded(asked["v"], data["v"])
                for one, root in ((asked, asked["root"]), (data, data["root"])):
                    _widen(root, q.shape[1])
                search(q, asked["keys"], asked["root"], d, data["keys"], data["ids"], data["root"], best)
                out = [
                    (key, vec_id, None if other == NO_ID else other, max(-(1 << 63), min(int(-minus), NO_ID)))
                    for key, vec_id, found in zip(asked["keys"].tolist(), asked["ids"].tolist(), best.rows)
                    for minus, other in found
                ]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, kind) for column, kind in zip(zip(*out), [pa.int64()] * 4)],
                        ["query_key", "query_id", "vec_id", "score"],
                    )

    return rows.mapInArrow(look, _FOUND)


def _widen(node, width: int) -> None:
    """Fill up the centres of a tree whose vectors are shorter than those it meets."""
    if node is not None and len(node.centre) < width:
        node.centre = np.pad(node.centre, (0, width - len(node.centre)))
        for child in node.children:
            _widen(child, width)


def top_k(vectors: DataFrame, query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows that ``query`` holds for."""
    rows = quantized(vectors, query)
    made = blocks(rows)
    bounds = stored(_bounds(made), "bounds")
    place = F.row_number().over(Window.partitionBy("query_block").orderBy(F.desc("most"), "block"))
    ranked = stored(bounds.withColumn("place", place), "ranked")
    nothing = F.lit(None).cast("array<struct<key:long,score:double>>").alias("known")
    first = ranked.where(F.col("place") <= FIRST_BLOCKS).select("query_block", "block", nothing)
    found = stored(_compare(first, made, k), "found")

    # The kth score of a query so far, if it has k candidates by now.
    in_first = Window.partitionBy("query_key").orderBy(F.desc("score"))
    kth = (
        found.withColumn("at", F.row_number().over(in_first))
        .where(F.col("at") == k)
        .select("query_key", F.col("score").cast("double").alias("score"))
    )
    homes = stored(_homes(made), "homes")
    known = homes.join(kth, "query_key", "left").groupBy("query_block").agg(
        F.collect_list(
            F.when(F.col("score").isNotNull(), F.struct(F.col("query_key").alias("key"), "score"))
        ).alias("known"),
        F.min(F.coalesce("score", F.lit(float("-inf")))).alias("worst"),
    )
    second = (
        ranked.where(F.col("place") > FIRST_BLOCKS)
        .join(known, "query_block")
        .where(F.col("most") >= F.col("worst"))
        .select("query_block", "block", "known")
    )
    every = found.unionByName(_compare(second, made, k))
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        every.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _homes(made: DataFrame) -> DataFrame:
    """``query_block, query_key`` of every query."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, queries in zip(*(column.to_pylist() for column in batch.columns)):
                own = pickle.loads(queries)["keys"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), block)), pa.array(own)], ["query_block", "query_key"]
                )

    return made.where("n_queries > 0").select("block", "queries").mapInArrow(keys, "query_block long, query_key long")
