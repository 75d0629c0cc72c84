"""Near-duplicates against a comparison of all pairs of sets."""

import random
import re

import pytest

from postlark.llm import near_dup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def expected(rows):
    sets = [shingles(text) for _, text in rows]
    label = [doc_id for doc_id, _ in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and None not in (label[i], label[j])
        and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return sorted(
        [(d, len(s), c, d is None or d == c) for (d, _), s, c in zip(rows, sets, label)], key=str
    )


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 7, 40, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    for _ in range(25):  # a chain of drifting copies, and a shared passage
        base = base[3:] + [word() for _ in range(3)]
        rows.append(" ".join(base))
        rows.append(" ".join([*passage, *(word() for _ in range(rng.randrange(10, 60)))]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "A b"), (504, "a B"), (None, "a b"), (3, rows[7][1]), (505, "x " * 9000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # small blocks, so that every way is taken
        monkeypatch.setattr(N, "BLOCK", 3)
    rows = corpus(seed)
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    got = sorted((tuple(row) for row in N.near_duplicates(frame).collect()), key=str)
    assert got == expected(rows)


def test_forest_joins_what_is_similar():
    rng = random.Random(3)
    base = [rng.randrange(10**9) for _ in range(100)]
    sets = []
    for _ in range(60):
        one = list(base)
        for i in rng.sample(range(100), rng.choice([2, 8, 14, 20])):
            one[i] = rng.randrange(10**9)
        sets.append(N.np.unique(N.np.array(one, N.np.uint64)))
    sketch = N.np.array([N.odd_sketch(N.min_hashes(one)) for one in sets]).view(N.np.uint64)
    root = N.np.arange(len(sets))
    for i, j in N.forest(sets, sketch, root.copy(), None):
        assert N._alike(sets[i], sets[j])
        root[root == root[j]] = root[i]
    apart = [(i, j) for i in range(60) for j in range(i) if N._alike(sets[i], sets[j]) and root[i] != root[j]]
    assert not apart and len(set(root.tolist())) > 1


def test_no_rows(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_component_stays(spark):
    text = lambda k: " ".join(f"t{k}x{i}" for i in range(40))
    rows = [
        (1, text(1), "a"), (2, text(1) + " more", "b"), (2, text(2), "c"),  # one text of id 2 is a copy
        (3, text(3), "d"), (3, text(3), "d"), (3, text(3), "e"),  # the same text again
        (None, text(4), "f"), (None, text(4) + " more", "g"), (None, text(1), "h"), (None, text(5), "i"),
        (7, None, "j"), (7, None, "j"), (8, "", "k"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = N.without_near_duplicates(frame)
    assert kept.columns == frame.columns
    got = [r.lang for r in kept.collect()]
    assert sorted(x for x in got if x not in "defg") == ["a", "c", "i", "j", "j", "k"]
    assert len([x for x in got if x in "de"]) == 1 and len([x for x in got if x in "fg"]) == 1


def test_removal_follows_the_kept_flags(spark):
    rows = corpus(1)
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string")
    ids = [d for d, _ in rows]
    want = {d for d, _, _, keep in expected(rows) if keep and ids.count(d) == 1}
    kept = {r.doc_id for r in N.without_near_duplicates(frame).collect()}
    assert kept - {3, None, rows[7][0]} == want - {3, None, rows[7][0]}


def test_many_near_copies_under_one_id(spark):
    """Rows are told apart by id and text, so 2,000 copies of one id make no 2,000 squared."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(2000):
        copy = list(base)
        copy[rng.randrange(80)] = f"x{i}"
        rows.append((5, " ".join(copy)))
    rows += [(5, " ".join(base))] * 300 + [(9, " ".join(f"c{i}" for i in range(40)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = N.near_duplicates(frame).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 5, True), (9, 9, True)}
    asked = spark.createDataFrame([(5, " ".join(base))] * 2, "doc_id long, text string")
    wanted = N._rows(asked).select("row")
    assert N._texts(frame, wanted).count() == 1  # 300 repeated rows are one text


def test_a_users_key_column_is_kept(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "u1"), (2, text, "u2"), (3, "other words", "u3"), (1, text, "u1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _KEY string")
    got = N.without_near_duplicates(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id, r._KEY) for r in got.collect()) == [(1, "u1"), (3, "u3")]
