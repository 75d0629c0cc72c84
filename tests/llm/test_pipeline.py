"""The pipeline's stages against brute force, each on its own input."""

import os
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from postlark.llm import decontaminate
from postlark.llm.common import scratch, stored
from postlark.llm.queries import WORD_BPE
from tests.llm.test_decontaminate import expected as hits
from tests.llm.test_near_dup import expected as duplicates

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    read = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    docs, tables = read("documents"), []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).persist()
        tables.append(docs)
    assert all(t.columns == columns for t in tables[:-1])
    rows = [[tuple(r) for r in t.collect()] for t in tables]

    bad = {r.doc_id for r in read("labels").where("quality = 0").collect()}
    good = {r.doc_id for r in read("labels").where("quality = 1").collect()}
    kept = {row[0] for row in rows[0]}
    assert len(good & kept) > 0.97 * len(good) and len(bad & kept) < 0.2 * len(bad)

    once = duplicates([row[:2] for row in rows[0]])
    assert {row[0] for row in rows[1]} == {d for d, _, _, keep in once if keep}

    items = [tuple(r) for r in read("benchmark").select("item_id", "text").collect()]
    before = {row[0]: row[1] for row in rows[1]}
    for row in rows[2]:
        if row[1] == before[row[0]]:
            continue
        assert hits(before[row[0]], items)[1] and not hits(row[1], items)[1] and row[4] == len(row[1])
    phrases = decontaminate.Phrases.of(items)
    import pyarrow as pa

    found = decontaminate._hits(pa.array([row[1] for row in rows[2]]), phrases)
    assert not any(one["starts"] for one in found)

    sizes, source = {r[0]: len((r[1] or "").split()) for r in rows[2]}, {r[0]: r[3] for r in rows[2]}
    copies = Counter(row[0] for row in rows[3])
    assert max(copies.values()) <= 2
    total, largest = sum(sizes.values()), max(sizes.values())
    taken = Counter()
    for doc_id, n in copies.items():
        taken[source[doc_id]] += n * sizes[doc_id]
    names = sorted(set(source.values()))
    own = {s: sum(sizes[d] for d in sizes if source[d] == s) for s in names}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * total - sum(2 * own[s] for s in full)
        share = left / sum(weights[s] for s in names if s not in full)
        more = {s for s in names if s not in full and share * weights[s] > 2 * own[s]}
        if not more:
            break
        full |= more
    for s in names:
        assert abs(taken[s] - (2 * own[s] if s in full else share * weights[s])) <= largest

    tokenizer, start, want = Tokenizer.from_file(WORD_BPE), 0, []
    for row in sorted(rows[3], key=lambda r: r[0]):
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2]
        want.append((row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows[4]) == want


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), "test-stage")
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key int, stats int, hits int, row int"


def odd_documents(spark, rows):
    return spark.createDataFrame([(*row, len(row[1] or ""), 1, 2, 3, 4) for row in rows], ODD_COLUMNS)


def test_odd_rows_empty_tables_and_clashing_columns(spark):
    good = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("n_chars > 300").limit(5)
    texts = [row.text for row in good.collect()]
    rows = [(i, text, "en", "s") for i, text in enumerate(texts)]
    rows += [(None, texts[0], None, None), (3, None, None, "s"), (4, "", "en", None), rows[2], rows[2]]
    rows += [(77, "long words of one text " * 26_000, "en", "s")]
    docs = odd_documents(spark, rows)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        if number < 4:
            assert out.columns == docs.columns
        docs = stored(out, "odd-stage")
    assert docs.count() > 0
    docs = odd_documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_DIR), "empty-stage")
    assert docs.count() == 0


def test_scratch_tables_are_removed(spark):
    with scratch(spark) as folder:
        assert corpus_pipeline.run(spark, SF_DIR).count() > 50
        assert os.path.exists(folder)
    assert not os.path.exists(folder)
