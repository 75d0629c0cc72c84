"""The mix against plain sums: targets by resharing, thresholds by sorted hashes."""

import hashlib
from collections import defaultdict
from math import floor

import pytest

from postlark.llm import mixing as M


def expected(rows):
    sized = [(d, s, len((t or "").split()), t) for d, s, t in rows]
    names = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for _, src, n, _ in sized if src == s) for s in names}
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full = set()
    while len(full) < len(names):
        left = 1.5 * sum(own.values()) - sum(2 * own[s] for s in full)
        share = left / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and share * weight[s] >= 2 * own[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * own[s] if s in full else share * weight[s] for s in names}
    out = []
    for s in names:
        base = floor(target[s] / own[s] + 1e-12) if own[s] else 0
        budget = target[s] - base * own[s]
        by_hash = defaultdict(list)
        for d, src, n, t in sized:
            if src == s:
                key = str(d) if d is not None else "null " + (t or "")
                by_hash[int(hashlib.md5(key.encode()).hexdigest()[:15], 16)].append((d, n))
        used, open_ = 0, True
        for h in sorted(by_hash):
            words = sum(n for _, n in by_hash[h])
            # the last group that starts within the budget is taken if that is nearer
            fits = used + words <= budget or used + words - budget < budget - used
            open_ = open_ and used <= budget and fits
            out += [(d, n, own[s], target[s], n * (base + open_)) for d, n in by_hash[h]]
            used += words
    return out


def compare(got, want):
    key = lambda r: (str(r[0]), r[1], r[4])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (g[0], g[1], g[2]) == (w[0], w[1], w[2])
        if w[1]:
            assert g[4] == w[4]
        assert g[3] == pytest.approx(w[3])


ROWS = [
    *[(i, f"s{i % 7}", "w " * (1 + i * 37 % 90)) for i in range(300)],
    (1000, None, None), (1001, None, "a b c"), (None, "s1", "x y"), (None, "s1", "x y"), (1002, "empty", ""),
    (1003, "empty", " \n"), (5, "s5", "again " * 10), (1004, "s2", "long " * 30_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, source string, text string, size int")


def test_equals_plain_sums_and_reruns_agree(spark):
    rows = frame(spark, ROWS)
    got = [tuple(r) for r in M.mix(rows).collect()]
    compare(got, expected(ROWS))
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in M.mix(rows.repartition(5)).collect())


def test_documents_are_repeated_as_told(spark):
    rows = frame(spark, ROWS)
    mixed = M.mixed_documents(rows)
    assert mixed.columns == rows.columns
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert words == sum(r.taken for r in M.mix(rows).collect())


@pytest.mark.parametrize("rows", [[], [(1, "a", None)], [(1, None, "x y z")]])
def test_few_rows(spark, rows):
    got = [tuple(r) for r in M.mix(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    if rows and rows[0][2]:
        assert got == [(1, 3, 3, 4.5, 3)]  # both ways end equally near: left out
    assert M.mixed_documents(frame(spark, rows)).columns == ["doc_id", "source", "text", "size"]


def test_a_users_columns_of_our_names_are_kept(spark):
    rows = [(i, f"w{i} " * (i % 7), f"s{i % 3}", i, -i) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_copy int, _MIX_LIMITS int")
    got = M.mixed_documents(frame)
    assert got.columns == frame.columns
    assert {tuple(row) for row in got.collect()} <= set(rows)
