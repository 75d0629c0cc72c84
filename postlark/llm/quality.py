"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

A text becomes 14 statistics, which are standardized and mapped to random Fourier
features; their inner products approximate a Gaussian kernel. Tasks sum the normal
equations of their labelled rows, the driver adds up these sums and solves for ridge
weights. Raw scores of the labelled rows are then mapped to probabilities by isotonic
regression over narrow bins of the raw score.

Scale: the text is read once for the statistics, whose table is small, and every labelled
training row takes part. Each task sums its own rows and ``SUM_TASKS`` tasks add up the sums,
so the driver gets that many of ``FEATURES`` squared numbers, whatever the input; bins are
bounded by the range of the raw score. Scoring needs no shuffle.

Defined cases: a NULL or empty text has all statistics 0 and is scored like any other. Of
labels, rows with NULL ``quality`` or ``doc_id`` are left out; repeated labels each count.
A NULL ``doc_id`` is held out. Without any label to learn from every score is 0.5. An empty
table gives no rows. Only ``text`` makes a score.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlark.llm.common import LOWER_WORDS, SLICE_BYTES, dictionary_words, slices, stored, unused

FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.3
FEATURES = 128
WIDTH = 4.0  # of the kernel, in standard deviations of a statistic
RIDGE = 1.0
SUM_TASKS = 32
BINS, LOWEST, HIGHEST = 4096, -1.0, 2.0
STATISTICS = 14

# What each byte is: 1 upper-case letter, 2 lower-case, 3 digit, 4 white space, 5 other
# ASCII, 6 first byte of a character beyond ASCII, 0 the bytes after it.
_KINDS = np.zeros(256, np.uint8)
for _byte in range(128):
    _char = chr(_byte)
    _KINDS[_byte] = (
        1 if "A" <= _char <= "Z" else 2 if "a" <= _char <= "z" else 3 if _char.isdigit()
        else 4 if _char in "\t\n\x0b\x0c\r " else 5
    )
_KINDS[0xC0:] = 6


def held_out(doc_id: Column) -> Column:
    remainder = F.crc32(doc_id.cast("string")) % FOLDS
    return F.coalesce(remainder == HELD_FOLD, F.lit(True))


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics per text."""
    words = dictionary_words(texts, LOWER_WORDS)
    texts = texts.fill_null("").cast(pa.large_binary())
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    kinds = _KINDS[data]

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[ends]).astype(float)

    upper, lower, digits, space, marks, wide = (per_text(kinds == kind) for kind in range(1, 7))
    twice = np.zeros(len(data), bool)
    twice[1:] = (kinds[1:] == 5) & (kinds[:-1] == 5)
    pairs, breaks = per_text(twice), per_text(data == 10)
    n = words.counts.astype(float)
    codes, starts = words.codes, words.offsets
    distinct, most = np.zeros(len(n)), np.zeros(len(n))
    for i in np.flatnonzero(n).tolist():
        counts = np.unique(codes[starts[i] : starts[i + 1]], return_counts=True)[1]
        distinct[i], most[i] = len(counts), counts.max()
    same = np.zeros(len(codes) + 1, np.int64)
    if len(codes):
        equal = np.zeros(len(codes), bool)
        equal[1:] = codes[1:] == codes[:-1]
        equal[starts[:-1][(n > 0)]] = False
        np.cumsum(equal, out=same[1:])
    repeats = np.diff(same[starts]).astype(float)
    names = words.dictionary.to_numpy(zero_copy_only=False)
    bare = np.array([not any(c.isalnum() for c in name) for name in names], bool)
    symbols = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(bare[codes] if len(codes) else [], out=symbols[1:])
    symbols = np.diff(symbols[starts]).astype(float)
    chars = upper + lower + digits + space + marks + wide
    some, per_word = np.maximum(chars, 1), np.maximum(n, 1)
    letters = np.maximum(upper + lower + wide, 1)
    return np.stack(
        [
            np.log1p(n),
            np.log1p((chars - space) / per_word),
            upper / letters,
            digits / some,
            marks / some,
            space / some,
            wide / some,
            pairs / per_word,
            breaks / per_word,
            distinct / per_word,
            np.log1p(distinct),
            most / per_word,
            repeats / per_word,
            symbols / per_word,
        ],
        axis=1,
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    chance: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        angles = ((rows - self.mean) / self.scale) @ self.directions + self.phases
        waves = np.sqrt(2 / FEATURES) * np.cos(angles)
        return np.concatenate([waves, np.ones((len(rows), 1))], axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.raw):
            return np.full(len(rows), 0.5)
        return np.interp(self.features(rows) @ self.weights, self.raw, self.chance)


def isotonic(x: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool neighbours until means rise with ``x``; returns places and values of the pools."""
    pools: list[list[float]] = []
    for place, value, size in zip(x.tolist(), mean.tolist(), weight.tolist()):
        pools.append([place * size, value * size, size])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    table = np.array(pools)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics_of(texts: pa.Array) -> pa.Array:
    """The statistics of a batch of texts; nothing but the texts comes to Python."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    rows = [statistics(piece.column("text")) for piece in slices(batch, size=SLICE_BYTES // 4)]
    flat = np.concatenate([np.zeros((0, STATISTICS)), *rows]).ravel()
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * STATISTICS)
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, stats`` of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _statistics_of("text").alias("stats"))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled rows that are not held out."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(
        F.col("quality").isNotNull()
    )
    rows = stored(
        stats.where(~F.col("held_out")).join(labels, "doc_id").select("doc_id", "stats", F.col("quality").cast("double").alias("quality")),
        "labelled",
    )
    each = [F.col("stats")[i] for i in range(STATISTICS)]
    moments = rows.agg(
        F.count("*"), *[F.avg(value) for value in each], *[F.stddev_pop(value) for value in each]
    ).head()
    rng = np.random.default_rng(9)
    directions = rng.normal(size=(STATISTICS, FEATURES)) / WIDTH
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    empty = np.zeros(0)
    if not moments[0]:
        zeros = np.zeros(STATISTICS)
        return Model(zeros, zeros + 1, directions, phases, np.zeros(FEATURES + 1), empty, empty)
    mean, scale = np.array(moments[1 : STATISTICS + 1]), np.array(moments[STATISTICS + 1 :])
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = Model(mean, scale, directions, phases, np.zeros(FEATURES + 1), empty, empty)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, side = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            features = model.features(_matrix(batch.column("stats")))
            square += features.T @ features
            side += features.T @ batch.column("quality").to_numpy()
        if square.any():
            both = np.concatenate([square.ravel(), side]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([both], pa.binary())], ["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch.column("sums"):
                own = np.frombuffer(one.as_py())
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # Every task sums its own rows; a few tasks add up these sums before the driver does.
    parts = rows.select("stats", "quality").mapInArrow(sums, "sums binary")
    few = parts.repartition(SUM_TASKS).mapInArrow(added, "sums binary").collect()
    total = sum(np.frombuffer(part.sums) for part in few)
    square = total[: (FEATURES + 1) ** 2].reshape(FEATURES + 1, FEATURES + 1)
    damp = np.eye(FEATURES + 1) * RIDGE
    damp[-1, -1] = 1e-9
    model.weights = np.linalg.solve(square + damp, total[(FEATURES + 1) ** 2 :])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.features(_matrix(batch.column("stats"))) @ model.weights
            bins = np.round((np.clip(values, LOWEST, HIGHEST) - LOWEST) * BINS)
            columns = [pa.array(bins.astype(np.int64)), batch.column("quality")]
            yield pa.RecordBatch.from_arrays(columns, ["bin", "quality"])

    binned = rows.select("stats", "quality").mapInArrow(raw, "bin long, quality double")
    bins = sorted(
        binned.groupBy("bin").agg(F.avg("quality"), F.count("*")).collect()
    )  # at most (HIGHEST - LOWEST) * BINS + 1 rows
    places = np.array([row[0] for row in bins]) / BINS + LOWEST
    model.raw, model.chance = isotonic(
        places, np.array([row[1] for row in bins]), np.array([float(row[2]) for row in bins])
    )
    return model


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, STATISTICS)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of measured documents."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(model.score(_matrix(batch.column("stats"))))
            columns = [batch.column("doc_id"), batch.column("held_out"), values]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score"])

    out = stats.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    stats = stored(measured(documents), "statistics")
    return scored(stats, fit(stats, labels))


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns; no shuffle of texts.

    Texts are written once beside their statistics, so that they are measured once and
    never leave the JVM but for that; the rows are then filtered by their statistics.
    """
    name = unused("stats", documents.columns)
    kept = stored(documents.withColumn(name, _statistics_of("text")), "measured")
    doc_id = F.col("doc_id").cast("long")
    stats = kept.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(name).alias("stats"))
    model = fit(stats, labels)

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(_matrix(rows)))

    return kept.where(score(name) >= THRESHOLD).select(documents.columns)
