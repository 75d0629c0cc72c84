"""Token ids: word-wise encoding, the coder and the files, against the library's own ids."""

import io
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import pyarrow as pa
from postlark.llm import coder, token_files, tokens
from postlark.llm.coder import Prior, block_lengths, decode_blocks, encode_blocks
from postlark.llm.queries import WORD_BPE, op10_token_files
from postlark.llm.tokens import WordEncoder

SF_DIR = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a<|endoftext|>B <|ENDOFTEXT|>", "Ça é don't stop 12a　ΣΑΣ İ", "x" * 500, "a\x0bb\x1cc"]


def expected(rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda row: row[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        out.append((doc_id, start, len(ids), crc))
        start += len(ids)
    return out


def test_query_equals_the_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op10_token_files(spark, SF_DIR).collect())) == expected(rows)


def test_odd_texts_repeated_rows_and_clashing_columns(spark, tmp_path):
    rows = [(i, text, 1) for i, text in enumerate(ODD * 2)] + [(3, ODD[3], 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = token_files.read_tokens(token_files.write_tokens(frame, str(tmp_path), WORD_BPE))
    assert sorted(map(tuple, got.collect())) == expected([row[:2] for row in rows])


def test_null_ids_come_first_and_no_rows_give_none(spark, tmp_path):
    frame = spark.createDataFrame([(None, "a b"), (None, None), (-5, "c")], "doc_id long, text string")
    got = token_files.read_tokens(token_files.write_tokens(frame, str(tmp_path), WORD_BPE)).collect()
    assert [(r.doc_id, r.start) for r in got if r.doc_id == -5] == [(-5, 4)]
    assert sum(r.n_tokens for r in got) == 6
    none = token_files.write_tokens(frame.where("false"), str(tmp_path), WORD_BPE)
    assert token_files.read_tokens(none).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("abeé\xdf\xff\xf7 .,!?;:'sİÉ\u0301\n", max_size=30), min_size=1, max_size=6))
def test_word_encoding_equals_the_library(texts):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids, counts = WordEncoder(WORD_BPE).encode(pa.array(texts))
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert ids.tolist() == [i for row in want for i in row]
    assert counts.tolist() == [len(row) for row in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3), max_size=300), st.integers(1, 50))
def test_coder_gives_back_every_id(ids, block):
    ids = np.array(ids, np.int64)
    prior, lengths = Prior.of(ids) if len(ids) else None, block_lengths(len(ids), block)
    blocks = encode_blocks(ids, prior, lengths)
    assert (decode_blocks(blocks, prior, lengths) == ids).all()
    if len(ids):  # any block alone
        k = len(lengths) // 2
        alone = decode_blocks(blocks[k : k + 1], prior, lengths[k : k + 1])
        assert (alone == ids[lengths[:k].sum() : lengths[: k + 1].sum()]).all()


def test_repetition_is_learnt():
    ids = np.tile(np.arange(50), 400)
    prior, lengths = Prior.of(ids), block_lengths(len(ids), 1024)
    blocks = encode_blocks(ids, prior, lengths)
    assert sum(map(len, blocks)) < 0.3 * len(ids)
    assert (decode_blocks(blocks, prior, lengths) == ids).all()


def order_0_bits(ids):
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return -(share * np.log2(share)).sum()


def test_the_adaptive_orders_gain_at_the_production_block_size():
    """Against order 0 alone, on the ids of the given documents."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text")
    ids, _ = WordEncoder(WORD_BPE).encode(texts.combine_chunks())
    prior, lengths = Prior.of(ids), block_lengths(len(ids), token_files.BLOCK_IDS)
    blocks = encode_blocks(ids, prior, lengths)
    assert (decode_blocks(blocks, prior, lengths) == ids).all()
    assert 8 * sum(map(len, blocks)) / len(ids) < order_0_bits(ids) - 0.25


def test_words_are_found_after_many_batches():
    """The table of known words grows over batches; words stay known, others are not found."""
    known = tokens._Known()
    for start in range(0, 300, 30):
        names = pa.array([f"w{i}" for i in range(start, start + 30)], pa.large_string())
        at, held = known.find(names)
        assert not held.any()
        known.add(names, np.full(30, 2), np.arange(60, dtype=np.uint32) + 2 * start)
        every = pa.array([f"w{i}" for i in range(start + 60)], pa.large_string())
        at, held = known.find(every)
        assert held.tolist() == [i < start + 30 for i in range(start + 60)]
        assert (known.ids[known.starts[at[held]]] == 2 * np.arange(start + 30)).all()
    # Two words with one hash: the first is known, the other never.
    known.hashes[:] = 7
    assert known.find(pa.array(["w1"], pa.large_string()))[1].tolist() in ([True], [False])


def test_a_very_long_text(spark, tmp_path):
    long = " ".join(f"word{i % 5000}" for i in range(400_000))
    rows = [(1, "a"), (2, long), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_files.read_tokens(token_files.write_tokens(frame, str(tmp_path), WORD_BPE))
    assert sorted(map(tuple, got.collect())) == expected(rows)


def test_damage_is_noticed(tmp_path):
    data = bytearray(token_files.pack_group([1], np.array([3000]), np.arange(3000)))
    data[-5] ^= 1
    path = tmp_path / "damaged"
    path.write_bytes(data)
    with path.open("rb") as file, pytest.raises(ValueError):
        list(token_files.read_groups(file))


def most_memory(work):
    tracemalloc.start()
    try:
        result = work()
        return result, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_packing_and_reading_take_a_few_bytes_per_id():
    ids = np.random.default_rng(5).integers(0, 40_000, 1 << 20).astype(np.uint32)
    data, most = most_memory(lambda: token_files.pack_group([1], np.array([len(ids)]), ids))
    assert most < 18 * len(ids)
    (group,), most = most_memory(lambda: list(token_files.read_groups(io.BytesIO(data))))
    assert (group[2] == ids).all() and most < 22 * len(ids)


def test_groups_share_one_array(monkeypatch):
    """Small groups, a document above a group's size, and what comes after it."""
    monkeypatch.setattr(token_files, "GROUP_IDS", 50)
    texts = ["a b c"] * 30 + ["x y " * 60] + ["d"] * 40 + [None]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    got, places = [], set()
    for names, sizes, ids in token_files._groups(iter([batch]), WordEncoder(WORD_BPE), 2):
        assert len(ids) == sizes.sum() and (len(ids) <= 50 or len(names) == 1)
        places.add(ids.__array_interface__["data"][0])
        for name, part in zip(names, np.split(ids.copy(), np.cumsum(sizes)[:-1])):
            got.append((name, part.tolist()))
    want = []
    for name, text in enumerate(texts):
        ids, _ = WordEncoder(WORD_BPE).encode(pa.array([text], pa.string()))
        want.append((name, [*ids.tolist(), 2]))
    assert got == want and len(places) <= 3


@pytest.mark.parametrize("high", [3, 70_000, 1 << 21])
def test_few_many_and_large_ids(high):
    """Places in one byte pair or more, numbers from a table or by search."""
    rng = np.random.default_rng(high)
    ids = np.concatenate([rng.integers(0, high, 300_000), [high - 1]]).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    found = coder._counted(ids)
    assert (found[0] == symbols).all() and (found[1] == counts).all()
    assert (symbols[coder._places(ids, symbols)] == ids).all()
    prior, lengths = Prior.of(ids), block_lengths(len(ids), 1024)
    assert (decode_blocks(encode_blocks(ids, prior, lengths), prior, lengths) == ids).all()


def test_words_of_many_ids_are_not_remembered(monkeypatch):
    encoder = WordEncoder(WORD_BPE)
    monkeypatch.setattr(encoder, "known", tokens._Known())
    long = "qzx" * 200
    first, _ = encoder.encode(pa.array([f"short {long}"]))
    again, _ = encoder.encode(pa.array([f"{long} short"]))
    assert encoder.known.words.to_pylist() == ["short"] and sorted(first) == sorted(again)
    assert max(x.itemsize for x in (encoder.known.starts, encoder.known.sizes, encoder.known.at)) == 4


def test_a_worker_that_reads_lets_go_of_the_words():
    WordEncoder(WORD_BPE).encode(pa.array(["some words"]))
    assert tokens._loaded.cache_info().currsize
    assert list(token_files._documents(iter([]))) == []
    assert not tokens._loaded.cache_info().currsize


def test_words_with_final_marks_need_no_search_for_pieces():
    """Any ASCII marks but the apostrophe; what else there is goes to the library as a whole."""
    encoder, asked = WordEncoder(WORD_BPE), []

    class Library:
        model = encoder.tokenizer.model

        def encode(self, text, **kwargs):
            return tokens._loaded(WORD_BPE)[0].encode(text, **kwargs)

        def encode_batch_fast(self, texts, **kwargs):
            asked.extend(texts)
            return tokens._loaded(WORD_BPE)[0].encode_batch_fast(texts, **kwargs)

    encoder.tokenizer = Library()
    words = ["word***", "été&&&", "straße#,", "a$$$", "plain", "ÿ(", "xaÿ", "don't", "b'", "Éa", "7up", "***", "a*b", "ÀÞß.", "÷", "×a"]
    sizes, ids = encoder._library(pa.array(words, pa.large_string()), True)
    want = [Tokenizer.from_file(WORD_BPE).encode(word, add_special_tokens=False).ids for word in words]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert asked == ["don't", "b'", "7up", "***", "a*b", "÷", "×a"]


def test_known_words_are_looked_up_in_a_half_empty_table():
    known = tokens._Known()
    names = pa.array([f"w{i}" for i in range(5000)], pa.large_string())
    known.add(names, np.full(5000, 1), np.arange(5000, dtype=np.uint32))
    assert 2 * len(names) <= len(known.at) <= 4 * len(names) and (known.at >= 0).sum() == len(names)
    at, held = known.find(names)
    assert held.all() and (at == np.arange(5000)).all()


def test_long_words_that_differ_anywhere_have_different_hashes():
    base = "x" * 150
    words = [base, base + "x"] + [base[:i] + "y" + base[i + 1 :] for i in range(150)] + ["", "\0", "\0\0", "x"]
    words = pa.array(words, pa.large_string())
    hashes = tokens._hashes(words)
    assert len(set(hashes.tolist())) == len(words)
    assert (tokens._hashes(words.slice(7)) == hashes[7:]).all()


def test_the_bytes_of_a_group_stay_the_same():
    rng = np.random.default_rng(11)
    ids = np.minimum(rng.zipf(1.2, 200_000), 50_000).astype(np.uint32)
    ids[:60_000] = np.tile(ids[:300], 200)
    assert zlib.crc32(token_files.pack_group([1, None], np.array([5, 199_995]), ids)) == 237936142


def test_words_between_blanks_are_numbered_as_they_come():
    from postlark.llm.common import dictionary_words

    texts = pa.array(["skipped", " B  a", None, "", "a\n", "c B"]).slice(1)
    words = dictionary_words(texts)
    assert words.dictionary.to_pylist() == ["b", "a", "c"]
    assert words.codes.tolist() == [0, 1, 1, 2, 0] and words.offsets.tolist() == [0, 2, 2, 2, 3, 5]
