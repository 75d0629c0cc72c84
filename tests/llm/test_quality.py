"""The quality classifier: its parts against plain definitions, and held-out accuracy."""

import zlib

import numpy as np
import pytest

from postlark.llm import quality as Q
from postlark.llm.queries import op9_fourier_quality


def test_isotonic_is_the_best_rising_fit():
    place, value = Q.isotonic(np.arange(6.0), np.array([0.0, 1, 0, 1, 1, 0]), np.ones(6))
    assert place.tolist() == [0, 1.5, 4] and np.allclose(value, [0, 0.5, 2 / 3])


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    zeros = np.zeros(Q.STATISTICS)
    kernels = []
    x, y = rng.normal(size=(2, Q.STATISTICS)) * 0.7
    for seed in range(200):
        rng = np.random.default_rng(seed)
        directions = rng.normal(size=(Q.STATISTICS, Q.FEATURES)) / Q.WIDTH
        model = Q.Model(zeros, zeros + 1, directions, rng.uniform(0, 2 * np.pi, Q.FEATURES), zeros, zeros, zeros)
        a, b = model.features(np.stack([x, y]))[:, :-1]
        kernels.append(a @ b)
    assert np.mean(kernels) == pytest.approx(np.exp(-((x - y) ** 2).sum() / (2 * Q.WIDTH**2)), abs=0.02)


def test_held_out_documents_are_told_apart(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = op9_fourier_quality(spark, sf_dir)
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert auc > 0.98
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.99
    assert np.mean([r.predicted for r in rows if r.quality == 0]) < 0.1
    everything = got.collect()
    assert len(everything) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in everything)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in everything)


def test_edge_cases(spark):
    texts = [None, "", "a", "word " * 50000, "x | y!!", "ok", "ok"]
    rows = [(i if i < 6 else None, text, 0.5) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame(
        [(1, 0), (1, 0), (2, 1), (3, 0), (4, None), (None, 1), (5, 1)], "doc_id long, quality int"
    )
    got = Q.quality_scores(frame, labels).collect()
    assert len(got) == 7 and all(0 <= row.score <= 1 for row in got)
    none = Q.quality_scores(frame, labels.where("false")).collect()
    assert {row.score for row in none} == {0.5}
    assert Q.quality_scores(frame.where("false"), labels).collect() == []
    kept = Q.good_documents(frame, labels)
    assert kept.schema == frame.schema and kept.count() <= 7


def test_scores_equal_plain_normal_equations(spark):
    """The whole model again in plain numpy: features, ridge, calibration, scores."""
    import pyarrow as pa

    sf_dir = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    stats = {doc_id: Q.statistics(pa.array([text]))[0] for doc_id, text in rows}
    known = [
        (r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in stats
    ]
    x = np.array([stats[doc_id] for doc_id, _ in known])
    y = np.array([float(quality) for _, quality in known])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1)
    rng = np.random.default_rng(9)
    directions = rng.normal(size=(Q.STATISTICS, Q.FEATURES)) / Q.WIDTH
    phases = rng.uniform(0, 2 * np.pi, Q.FEATURES)

    def features(values):
        waves = np.sqrt(2 / Q.FEATURES) * np.cos((values - mean) / scale @ directions + phases)
        return np.concatenate([waves, np.ones((len(values), 1))], axis=1)

    damp = np.eye(Q.FEATURES + 1) * Q.RIDGE
    damp[-1, -1] = 1e-9
    z = features(x)
    weights = np.linalg.solve(z.T @ z + damp, z.T @ y)
    bins = np.round((np.clip(z @ weights, Q.LOWEST, Q.HIGHEST) - Q.LOWEST) * Q.BINS)
    places = np.unique(bins)
    # The best rising fit: at each place the largest of the least means around it.
    means = [(y[bins == b].sum(), (bins == b).sum()) for b in places]
    sums = np.cumsum([[0, 0], *means], axis=0)
    rising = [
        max(min((sums[j] - sums[i])[0] / (sums[j] - sums[i])[1] for j in range(k + 1, len(places) + 1)) for i in range(k + 1))
        for k in range(len(places))
    ]
    pools, at = np.unique(np.round(rising, 12), return_inverse=True)
    weight = np.array([n for _, n in means])
    centre = [np.average(places[at == i] / Q.BINS + Q.LOWEST, weights=weight[at == i]) for i in range(len(pools))]
    got = {r.doc_id: r.score for r in Q.quality_scores(documents, labels).collect()}
    for doc_id, values in stats.items():
        raw = (features(values[None]) @ weights)[0]
        assert got[doc_id] == pytest.approx(np.interp(raw, centre, pools), abs=1e-6)


def test_good_documents_are_those_scored_good(spark):
    sf_dir = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("n_chars", "STATS")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in Q.quality_scores(documents, labels).where("predicted = 1").collect()}
    kept = Q.good_documents(documents, labels)
    assert kept.columns == documents.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} == good and len(rows) == len(good)
    texts = {r.doc_id: tuple(r) for r in documents.collect()}
    assert all(tuple(r) == texts[r.doc_id] for r in rows)
