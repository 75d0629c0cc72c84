"""Section token counts against a plain walk over every token."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlark.llm import attribution as A
from postlark.llm.queries import BYTE_BPE

TEXTS = [None, "", "\n", "ab\n\n\ncd é\n日本 x\r\n\n", "😀😀\nz", "one line", "a\n" * 500 + "\n" * 40 + "x" * 3000]


def plain(token_spans, sections, rule):
    counts = [0.0] * len(sections)
    for start, stop in token_spans:
        over = [max(0, min(stop, b) - max(start, a)) for a, b in sections]
        touched = [i for i, x in enumerate(over) if x]
        if not touched:
            continue
        if rule == "split":
            for i in touched:
                counts[i] += over[i] / sum(over)
        else:
            best = {"first": touched[0], "last": touched[-1], "majority": over.index(max(over))}
            counts[best[rule]] += 1
    return counts


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.integers(1, 5), max_size=20),
    st.lists(st.tuples(st.integers(0, 2), st.integers(1, 6)), min_size=1, max_size=8),
    st.sampled_from(A.RULES),
)
def test_interval_join_equals_plain_overlaps(tokens, gaps_and_sizes, rule):
    stops = np.cumsum(np.array(tokens, np.int64))
    spans = list(zip((stops - tokens).tolist() if tokens else [], stops.tolist()))
    sections, at = [], 0
    for gap, size in gaps_and_sizes:
        sections.append((at + gap, at + gap + size))
        at += gap + size
    start, stop = np.array(sections).T
    got = A.attribute(stops - np.array(tokens, np.int64), stops, start, stop, rule)
    assert np.allclose(got, plain(spans, sections, rule))


@pytest.mark.parametrize("rule", A.RULES)
def test_counts_per_line(spark, rule):
    encoding, _ = A.byte_encoding(BYTE_BPE)
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, section int")
    got = {}
    for row in A.section_tokens(frame, BYTE_BPE, rule).collect():
        got.setdefault(row.doc_id, []).append(row)
    assert set(got) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        text, rows = text or "", sorted(got[i], key=lambda row: row.section)
        assert [row.section for row in rows] == list(range(len(rows)))
        assert "".join(text[row.start : row.stop] for row in rows) == text
        ids, spans, at = encoding.encode_ordinary(text), [], 0
        ends = [len(piece) for piece in encoding.decode_tokens_bytes(ids)]
        owner = [k for k, c in enumerate(text) for _ in c.encode()]
        for size in ends:
            spans.append((owner[at], owner[at + size - 1] + 1))
            at += size
        want = plain(spans, [(row.start, row.stop) for row in rows], rule)
        assert np.allclose([row.n_tokens for row in rows], want)
        assert round(sum(row.n_tokens for row in rows), 6) == len(ids)


def test_no_rows_and_wrong_rule(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert A.section_tokens(frame, BYTE_BPE).collect() == []
    with pytest.raises(ValueError):
        A.section_tokens(frame, BYTE_BPE, "nearest")


def spans_of(text):
    """Character spans of the tokens of a text, by the library alone."""
    encoding, _ = A.byte_encoding(BYTE_BPE)
    owner = [k for k, c in enumerate(text) for _ in c.encode()]
    spans, at = [], 0
    for piece in encoding.decode_tokens_bytes(encoding.encode_ordinary(text)):
        spans.append((owner[at], owner[at + len(piece) - 1] + 1))
        at += len(piece)
    return spans


@pytest.mark.parametrize("rule", A.RULES)
def test_given_spans(spark, rule):
    """Out of order, with gaps, overlapping, empty, outside the text, NULL."""
    text = "Überall ist hier ein Text, und dann 日本語 noch einer.\nEnde"
    told = [(12, 30), (0, 9), (8, 15), (40, 40), (50, 900), (None, 3), (-5, 2)]
    rows = [(1, text, told), (2, text, None), (3, text, []), (4, None, [(0, 5)]), (1, text, told), (None, text, told)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,stop:int>>")
    found = A.section_tokens(frame, BYTE_BPE, rule, sections="parts").collect()
    assert {r.doc_id for r in found} == {1, 4, None}
    assert [tuple(r)[1:] for r in found if r.doc_id == 4] == [(0, 0, 0, 0.0)]
    once = sorted(tuple(r)[1:] for r in found if r.doc_id is None)
    assert sorted(tuple(r)[1:] for r in found if r.doc_id == 1) == sorted(once * 2)
    assert [section for section, *_ in once] == list(range(len(told)))
    shown = {section: (start, stop) for section, start, stop, _ in once}
    assert shown[1] == (3, 9) and shown[2] == (9, 15) and shown[0] == (15, 30) and shown[5] == (2, 3)
    in_order = sorted((s for s in shown if shown[s][1] > shown[s][0]), key=shown.get)
    want = dict(zip(in_order, plain(spans_of(text), [shown[s] for s in in_order], rule)))
    assert np.allclose([n for *_, n in once], [want.get(section, 0) for section, *_ in once])


def test_fields(spark):
    rows = [(1, "A title", None, "The body\nof it"), (2, "", "x", ""), (3, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, title string, note string, body string")
    found = A.section_tokens(frame, BYTE_BPE, "first", fields=["title", "note", "body"], separator=" | ").collect()
    encoding, _ = A.byte_encoding(BYTE_BPE)
    for doc_id, *fields in rows:
        own = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.section)
        text = " | ".join(field or "" for field in fields)
        assert [text[r.start : r.stop] for r in own] == [
            *[(field or "") + " | " for field in fields[:-1]], fields[-1] or ""
        ]
        spans = [(r.start, r.stop) for r in own]
        assert [r.n_tokens for r in own] == plain(spans_of(text), spans, "first")
        assert sum(r.n_tokens for r in own) == len(encoding.encode_ordinary(text))
    with pytest.raises(ValueError):
        A.section_tokens(frame, BYTE_BPE, fields=["title"], sections="note")


def test_repeated_rows_and_null_ids(spark):
    frame = spark.createDataFrame([(None, "a b\nc"), (None, "a b\nc"), (1, "x"), (1, "x")], "doc_id long, text string")
    got = sorted(map(str, A.section_tokens(frame, BYTE_BPE).collect()))
    assert len(got) == 6 and all(got.count(row) == 2 for row in got)
