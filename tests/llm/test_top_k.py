"""Cover-tree search against a comparison with every row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlark.llm import cover_tree, top_k


def brute(rows, k=5):
    good = [
        (i, vec_id, [math.floor(256 * x) for x in v])
        for i, (vec_id, v) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, query, v in good:
        if query is None or query % 50:
            continue
        found = sorted(
            (-sum(a * b for a, b in zip(v, w)), vec_id is None, vec_id or 0)
            for j, vec_id, w in good
            if j != i
        )[:k]
        out += [(query, rank, None if none else vec_id, -s) for rank, (s, none, vec_id) in enumerate(found, 1)]
    return sorted(out, key=str)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    same = rng.normal(size=8).tolist()
    rows += [(i, same) for i in range(400, 700)]
    rows += [(701, None), (750, [1.0, None, 2.0]), (800, [float("nan")] * 8), (850, [float("inf")] * 8)]
    rows += [(900, [0.5, -0.5]), (901, []), (50, rng.normal(size=8).tolist()), (None, same), (950, [1e6] * 8)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(top_k, "BLOCK_ROWS", 40)
        monkeypatch.setattr(top_k, "CHUNK", 3)
        monkeypatch.setattr(cover_tree, "LEAF", 4)
    rows = rows_of(int(small))
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = top_k.top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    query = F.col("vec_id") % 50 == 0
    assert top_k.top_k(spark.createDataFrame([], schema), query).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert list(map(tuple, top_k.top_k(two, query).collect())) == [(0, 1, 1, 131072)]


def test_node_pairs_are_pruned_without_loss():
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(20, 6)) * 2000
    data = np.round(middle[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 6)) * 10)
    queries = data[::50]
    (qo, qr), (do, dr) = cover_tree.build(queries), cover_tree.build(data)
    best = cover_tree.Best(len(queries), 5, np.full(len(queries), -np.inf))
    ids, keys = np.arange(3000), np.arange(3000)
    compared = cover_tree.search(queries[qo], keys[::50][qo], qr, data[do], keys[do], ids[do], dr, best)
    assert compared < 0.5 * (len(queries) / 8) * (3000 / 64)
    scores = queries @ data.T
    for place, i in enumerate(qo.tolist()):
        scores[i, 50 * i] = -np.inf
        want = np.lexsort((ids, -scores[i]))[:5]
        assert [j for _, j in best.rows[place]] == want.tolist()
