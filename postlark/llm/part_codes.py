"""Vector codes by parts, with nearest entries found through distances to pivots (LAESA).

Vectors become whole numbers and are cut into equal parts; each position has a codebook of
entries, and a vector's code is the nearest entry of each of its parts. Entries begin as the
parts of the vectors with the smallest ids and move to the mean of their parts in rounds.

The distances of every part to ``PIVOTS`` fixed points of its position are computed once and
stored with it. In a round, only the few distances from pivots to entries are new. By the
triangle inequality the difference of a part's and an entry's distance to the same pivot is
at most the distance between them; the largest such difference bounds it from below. A part
meets the entries in the order of their bounds, with exact distances in whole numbers, until
the next bound is above the best distance found. Bounds are lowered by what rounding can add,
and equal distances are told apart by index, so the result is that of a full comparison.

Scale: each round is one scan of the stored parts. Tasks sum the parts of each entry before
the shuffle; sums (entries times components) and the first entries are all that reaches the
driver, and codebooks are all that reaches the tasks. Errors are summed by label inside tasks
first, so a label that a third of all rows carry travels as one row per task.

Defined cases: vectors that are NULL, hold NULL or non-finite components, or whose length is
no multiple of the number of parts take no part; neither do those longer or shorter than the
first of the remaining ones, by id. Components are cut to a range in which squared distances
fit 64 bits (2**27 at 64 components). NULL ids give no entries but are coded. Rows that repeat
an id count as rows, in the order of their components among the first. With fewer vectors
than entries the codebooks are shorter. Without vectors there are no rows.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlark.llm.common import stored

SCALE = 256
PIVOTS = 4


class Codebooks:
    """Entries of every position, shaped (parts, entries, components), and the pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray | None = None):
        self.entries = entries
        self.pivots = _far_apart(entries) if pivots is None else pivots
        gaps = entries[:, :, None, :] - self.pivots[:, None, :, :]
        self.to_pivots = np.sqrt((gaps.astype(np.float64) ** 2).sum(axis=3))

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> "Codebooks":
        """Entries at the rounded-down means of their parts; those without parts stay."""
        entries = self.entries.copy()
        for (part, entry), (n, total) in sums.items():
            entries[part, entry] = [one // n for one in total]
        return Codebooks(entries, self.pivots)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def distances(self, parts: np.ndarray) -> np.ndarray:
        """From every part (rows, parts, components) to the pivots of its position."""
        out = np.empty((len(parts), *self.pivots.shape[:2]), np.float32)
        for i in range(self.pivots.shape[1]):
            out[:, :, i] = np.sqrt(((parts - self.pivots[:, i]).astype(np.float64) ** 2).sum(axis=2))
        return out

    def nearest(self, parts: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry, and how many exact
        distances each row took."""
        n, positions = len(parts), len(self.entries)
        index, error = np.zeros((n, positions), np.int64), np.zeros((n, positions), np.int64)
        taken = np.zeros(n, np.int64)
        for position in range(positions):
            best, least = _search(
                parts[:, position], near[:, position].astype(np.float64),
                self.entries[position], self.to_pivots[position], taken,
            )
            index[:, position], error[:, position] = best, least
        return index, error, taken


def _search(parts, near, entries, to_pivots, taken) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.abs(near[:, None, :] - to_pivots[None]).max(axis=2)
    # Distances to pivots are stored in single precision.
    bounds -= 2.5e-7 * (near.max(axis=1)[:, None] + to_pivots.max(axis=1))
    np.square(np.maximum(bounds, 0, out=bounds), out=bounds)
    bounds *= 1 - 1e-12
    order = np.argsort(bounds, axis=1, kind="stable")
    rows = np.arange(len(parts))
    best = np.full(len(parts), len(entries), np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max, np.int64)
    for step in range(len(entries)):
        entry = order[rows, step]
        open_ = bounds[rows, entry] <= least[rows]
        rows, entry = rows[open_], entry[open_]
        if not len(rows):
            break
        gap = parts[rows] - entries[entry]
        distance = (gap * gap).sum(axis=1)
        taken[rows] += 1
        better = (distance < least[rows]) | ((distance == least[rows]) & (entry < best[rows]))
        best[rows[better]], least[rows[better]] = entry[better], distance[better]
    return best, least


def _far_apart(entries: np.ndarray) -> np.ndarray:
    """Of each position, entries far from each other: the first, then always the farthest."""
    picked = []
    for own in entries:
        chosen = [0]
        gap = ((own - own[0]).astype(np.float64) ** 2).sum(axis=1)
        while len(chosen) < min(PIVOTS, len(own)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((own - own[chosen[-1]]).astype(np.float64) ** 2).sum(axis=1))
        picked.append(own[chosen])
    return np.stack(picked)


def _whole(vectors: DataFrame, parts: int) -> DataFrame:
    """``vec_id, label, v``: the vectors that take part, as whole numbers."""
    good = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    rows = vectors.where(F.col("embedding").isNotNull()).where(good)
    rows = rows.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = stored(
        rows.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), whole.alias("v")
        ),
        "vectors",
    )
    first = rows.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "v").select(F.size("v")).limit(1).collect()
    size = first[0][0] if first else 0
    most = math.isqrt((1 << 62) // max(size, 1)) // 2
    cut = F.transform("v", lambda x: F.greatest(F.least(x, F.lit(most)), F.lit(-most)))
    return rows.where(F.size("v") == size).withColumn("v", cut)


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1)


def codes(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2
) -> tuple[DataFrame, Codebooks | None]:
    """``vec_id, label, code, error, evaluations`` of every vector, and the codebooks.

    ``evaluations`` is the number of exact distances; a full comparison takes one for each
    part and entry.
    """
    spark = vectors.sparkSession
    whole = _whole(vectors, parts)
    first = whole.where(F.col("vec_id").isNotNull()).orderBy("vec_id", "v").limit(entries).select("v").collect()
    if not first:
        return spark.createDataFrame([], f"vec_id long, {_label(vectors)}, code string, error long, evaluations long"), None
    start = np.array([row.v for row in first], np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2)))
    measured = stored(_measured(whole, books, parts), "parts")
    for _ in range(rounds):
        books = books.moved(_sums(measured, books, parts))
    return _coded(measured, books, parts, _label(vectors)), books


def _label(vectors: DataFrame) -> str:
    return f"label {vectors.schema['label'].dataType.simpleString()}"


def _measured(whole: DataFrame, books: Codebooks, parts: int) -> DataFrame:
    """Vectors with the distances of their parts to the pivots, computed this once."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = books.distances(_matrix(batch.column("v"), parts)).reshape(batch.num_rows, -1)
                ends = np.arange(batch.num_rows + 1, dtype=np.int32) * near.shape[1]
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "near"])

    return whole.mapInArrow(measure, f"vec_id long, {_label(whole)}, v array<long>, near array<float>")


def _found(batch: pa.RecordBatch, books: Codebooks, parts: int):
    own = _matrix(batch.column("v"), parts)
    near = _matrix(batch.column("near"), parts)
    return own, *books.nearest(own, near)


def _sums(measured: DataFrame, books: Codebooks, parts: int) -> dict:
    """Count and sum of the parts of every entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(books.entries.shape[:2], np.int64)
        totals = np.zeros_like(books.entries)
        for batch in batches:
            if batch.num_rows:
                own, index, _, _ = _found(batch, books, parts)
                for part in range(parts):
                    n[part] += np.bincount(index[:, part], minlength=n.shape[1])
                    np.add.at(totals[part], index[:, part], own[:, part])
        part, entry = np.nonzero(n)
        size = totals.shape[2]
        columns = [
            np.repeat(part, size), np.repeat(entry, size), np.tile(np.arange(size), len(part)),
            np.repeat(n[part, entry], size), totals[part, entry].ravel(),
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(one.astype(np.int64)) for one in columns], ["part", "entry", "at", "n", "total"]
        )

    partial = measured.select("v", "near").mapInArrow(add, "part long, entry long, at long, n long, total long")
    rows = (
        partial.groupBy("part", "entry", "at")
        .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .orderBy("part", "entry", "at")
        .collect()
    )
    out: dict = {}
    for row in rows:
        out.setdefault((row.part, row.entry), (row.n, []))[1].append(int(row.total))
    return out


def _coded(measured: DataFrame, books: Codebooks, parts: int, label: str) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, index, error, taken = _found(batch, books, parts)
                text = [bytes(row).hex() for row in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array(text),
                     pa.array(error.sum(axis=1)), pa.array(taken)],
                    ["vec_id", "label", "code", "error", "evaluations"],
                )

    return measured.mapInArrow(code, f"vec_id long, {label}, code string, error long, evaluations long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Coded vectors with the sum of the errors of their label; NULLs are one label."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.withColumnRenamed("label", "of_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
