"""The FM-index against plain search, and the removal of benchmark passages."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from postlark.llm import decontaminate as D
from postlark.llm.fm_index import FMIndex

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(text, items):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        item = words(item)
        size = min(D.WINDOW, len(item))
        for i in range(len(item) - size + 1) if size else ():
            for k in range(len(own) - size + 1):
                if own[k : k + size] == item[i : i + size]:
                    hit |= set(range(k, k + size))
                    names.add("null" if name is None else str(name))
    return len(own), len(hit), sorted(names)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=5))
def test_search_and_locate_equal_plain_search(runs):
    text = np.array([x for run in runs for x in [*run, 0]], np.int64)
    index = FMIndex(text, 3)
    for length in (1, 2, 4):
        phrases = np.array(list(np.ndindex(*(3,) * length))) + 1
        for phrase, low, high in zip(phrases, *index.search(phrases)):
            want = [
                i for i in range(len(text) - length + 1) if (text[i : i + length] == phrase).all()
            ]
            assert sorted(index.locate(np.arange(low, max(low, high)))) == want


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (12, "Alpha beta"), (12, "gamma DELTA!"), (3, ""), (4, None), (None, "zeta"), (7, "alpha beta")]
TEXTS = [
    None, "", "!!", LONG, f"x {LONG.upper()} y", " ".join(f"w{i}" for i in range(9)),
    "alpha, beta; gamma delta zeta", "alphabeta", f"{LONG} z {LONG}",
    "y " * 5000 + LONG + " y" * 5000, "é alpha beta é",
]


def documents(spark, texts=TEXTS):
    rows = [(i, text, len(text or ""), 5) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, hits int")


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def check(spark):
    rows = D.contamination(documents(spark), items(spark)).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        assert (row.n_words, row.n_hit, list(row["items"])) == expected(TEXTS[row.doc_id], ITEMS)


def test_spans_and_items_equal_plain_search(spark):
    check(spark)


def test_a_benchmark_of_several_blocks_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    assert len(list(D.benchmark_blocks(items(spark)))) > 1
    check(spark)
    kept = D.decontaminate(documents(spark), items(spark)).collect()
    assert all(expected(row.text, ITEMS)[1] == 0 for row in kept)


def test_repeated_documents_and_null_ids(spark, monkeypatch):
    rows = [(None, LONG, "a"), (None, LONG, "b"), (2, "alpha beta", "c"), (2, "alpha beta", "c"), (2, None, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string")
    for size in (D.BLOCK_BYTES, 40):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        got = D.contamination(frame, items(spark)).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == [
            ("2", 0, 0), ("2", 2, 2), ("2", 2, 2), ("None", 30, 30), ("None", 30, 30)
        ]


def test_blocks_of_the_benchmark_are_given_up_one_by_one(spark, monkeypatch):
    """No pass holds the phrases of another: each broadcast is destroyed after its pass."""
    monkeypatch.setattr(D, "BLOCK_BYTES", 40)
    context, alive, most = spark.sparkContext, [], []
    original = context.broadcast

    def broadcast(value):
        sent = original(value)
        destroy = sent.destroy
        alive.append(sent)
        most.append(len(alive))
        sent.destroy = lambda: (alive.remove(sent), destroy())
        return sent

    monkeypatch.setattr(context, "broadcast", broadcast)
    check(spark)
    assert len(most) > 2 and max(most) == 1 and not alive


def test_removal(spark):
    split = " ".join(f"w{i}" for i in range(5)) + f" {LONG} " + " ".join(f"w{i}" for i in range(5, 12))
    frame = documents(spark, [*TEXTS, split])
    assert frame.columns == D.decontaminate(frame, items(spark)).columns
    kept = {row.doc_id: row for row in D.decontaminate(frame, items(spark)).collect()}
    assert kept[4].text == "x  y" and kept[4].n_chars == 4
    assert kept[1].text == "" and kept[0].text is None and kept[5].text == TEXTS[5]
    assert 3 not in kept and len(TEXTS) not in kept  # nothing left of them
    assert all(expected(row.text, ITEMS)[1] == 0 for row in kept.values())


def test_no_rows(spark):
    assert D.contamination(documents(spark).where("false"), items(spark)).collect() == []
    rows = D.contamination(documents(spark), items(spark).where("false")).collect()
    assert len(rows) == len(TEXTS) and not any(row.n_hit for row in rows)
