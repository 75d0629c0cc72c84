"""Part codes against rounds of full comparisons in plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from postlark.llm import part_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries=64, rounds=2):
    kept = []
    for vec_id, vector, label in rows:
        if vector and len(vector) % parts == 0 and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(256 * x) for x in vector], label))
    named = sorted((row for row in kept if row[0] is not None), key=lambda row: row[:2])
    size = len(named[0][1])
    kept = [row for row in kept if len(row[1]) == size]
    named = [row for row in named if len(row[1]) == size]
    width = size // parts
    cut = lambda v, j: v[j * width : (j + 1) * width]
    books = [[cut(v, j) for _, v, _ in named[:entries]] for j in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, one)), e) for e, one in enumerate(book))

    for _ in range(rounds):
        for j in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, j), books[j])[1], []).append(cut(v, j))
            for e, those in groups.items():
                books[j][e] = [sum(column) // len(those) for column in zip(*those)]
    out = []
    for vec_id, v, label in kept:
        found = [near(cut(v, j), books[j]) for j in range(parts)]
        out.append((vec_id, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, [one for book in books for entry in book for one in entry]


def check(spark, rows, parts=16, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    coded, books = part_codes.codes(frame, parts, **options)
    expected, numbers = brute([tuple(row) for row in frame.collect()], parts, **options)
    got = [(r.vec_id, r.label, r.code, r.error) for r in coded.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert books.digest() == hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    return coded


def test_codes_equal_a_full_comparison(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(10)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], i % 7 or None) for i in range(400)]
    coded = check(spark, rows)
    # Bounds leave a part of the 64 entries of each of the 16 parts to compare.
    assert coded.agg(F.avg("evaluations")).first()[0] < 16 * 64 / 3


def test_odd_rows(spark):
    """Ties, repeated rows and ids, NULLs, other lengths, few vectors and large components."""
    same = [0.25] * 8
    rows = [(3, same, 1), (3, same, 1), (1, [0.5, -0.5] * 4, None), (None, [0.1] * 8, 2), (7, same, 1)]
    rows += [(4, None, 1), (0, [1.0, None] * 4, 1), (0, [float("nan")] * 8, 1), (0, [float("-inf")] * 8, 1)]
    rows += [(9, [0.5] * 16, 1), (10, [0.5] * 7, 1), (11, [], 1), (12, [3e4, -3e4] * 4, 3), (3, [0.0] * 8, None)]
    check(spark, rows, parts=4)
    check(spark, rows, parts=8, entries=2, rounds=3)


def test_components_beyond_the_range_are_cut(spark):
    rows = [(1, [3e38, -3e38] * 2, None), (2, [0.0] * 4, None)]
    coded, _ = part_codes.codes(spark.createDataFrame(rows, SCHEMA), 2)
    assert {(r.vec_id, r.code, r.error) for r in coded.collect()} == {(1, "0000", 0), (2, "0101", 0)}


def test_empty_tables_and_tables_without_ids(spark):
    for rows in ([], [(None, [0.5] * 4, 1)], [(1, None, 1)]):
        coded, books = part_codes.codes(spark.createDataFrame(rows, SCHEMA), 2)
        assert coded.count() == 0 and books is None


def test_label_errors_add_up_over_equal_labels(spark):
    rows = [(1, 5, None), (2, 7, None), (3, 1, 4), (4, 2, 4), (5, 9, 6)]
    coded = spark.createDataFrame(rows, "vec_id long, error long, label int")
    got = {row.vec_id: row.label_error for row in part_codes.with_label_errors(coded).collect()}
    assert got == {1: 12, 2: 12, 3: 3, 4: 3, 5: 9}


def test_extra_columns_with_clashing_names(spark):
    rows = [(i, [i / 9, -i / 7, 0.5, 0.25], i % 2, 1, 2, 3) for i in range(9)]
    frame = spark.createDataFrame(rows, SCHEMA + ", v int, near int, code int")
    coded, _ = part_codes.codes(frame, 2)
    assert coded.columns == ["vec_id", "label", "code", "error", "evaluations"] and coded.count() == 9


@pytest.mark.parametrize("entries", [1, 2, 64])
def test_bounds_never_exclude_the_nearest(entries):
    import numpy as np

    rng = np.random.default_rng(entries)
    books = part_codes.Codebooks(rng.integers(-9, 9, (3, entries, 4)))
    moved = part_codes.Codebooks(rng.integers(-9, 9, (3, entries, 4)), books.pivots)
    parts = rng.integers(-9, 9, (500, 3, 4))
    index, error, _ = moved.nearest(parts, books.distances(parts))
    full = ((parts[:, :, None] - moved.entries[None]) ** 2).sum(axis=3)
    assert (index == full.argmin(axis=2)).all() and (error == full.min(axis=2)).all()
