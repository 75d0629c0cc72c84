"""The conversation trie against one made of plain dictionaries."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from postlark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    for conv_id, turns in own.items():
        turns.sort(key=lambda t: (t[0], turn_digest(*t[1:])))
        own[conv_id] = [t[1:] for t in turns]
    whole = {}
    for conv_id in list(own):
        h = zlib.crc32(str(conv_id).encode()) % 4
        base = conv_id - int(math.fmod(conv_id, 20))
        whole[conv_id] = tuple(own[base][:h] if base in own else []) + tuple(own[conv_id][h:])
    members = defaultdict(list)
    for conv_id, path in whole.items():
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv_id)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, those in members.items():
        size = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for depth in range(len(path) + 1):
            saved[path[:depth]] += (len(those) - 1) * size
            leaves[path[:depth]] += path not in children
    out = []
    for path, those in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in those if len(whole[c]) == len(path)))
        out.append((
            min(those), len(path), min(members[path[:-1]]) if path else None, len(those),
            children[path] if path in children else 0, leaves[path], saved[path],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda row: row[:2])


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(row) for row in prefix_trie.prefix_trie(frame).collect()), key=lambda row: row[:2])
    assert got == brute(rows)


@pytest.mark.parametrize("block", [1, 7, 4_096])
def test_trie_equals_plain_dictionaries(spark, monkeypatch, block):
    """Few different turns make deep common prefixes, which blocks of every size cut."""
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    rng = random.Random(block)
    rows = []
    for conv_id in range(-30, 250):
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv_id, rng.choice([turn, turn, None]), rng.choice(["u", None]), rng.choice(["a", "b b", None])))
    check(spark, rows + [(None, 1, "u", "x"), (None, None, None, None)])


def test_copies_over_many_blocks(spark, monkeypatch):
    """One conversation that most ids share, one it continues, turnless and very long ones."""
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 5)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 20) for t in range(4)]
    rows += [(c, 0, "user", "only") for c in range(10_001, 10_010)]
    rows += [(8_000, t, "user", f"turn {min(t, 6)}") for t in range(600)]
    rows += [(8_020, 0, "user", "long " * 100_000)] * 3
    check(spark, rows)


def test_one_conversation_and_none(spark):
    check(spark, [(5, 1, None, None)])
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    rows = [(c, t, "u", f"t{t % 2}") for c in range(40) for t in range(c % 5)]
    names = ("at", "digest", "words", "key", "block", "node", "depth", "part")
    frame = spark.createDataFrame([row + (1,) * len(names) for row in rows], SCHEMA + "".join(f", {n} int" for n in names))
    got = sorted((tuple(row) for row in prefix_trie.prefix_trie(frame).collect()), key=lambda row: row[:2])
    assert got == brute(rows)


def test_components_are_the_intervals_of_common_prefixes():
    """Union-find gives, for each depth, the runs of conversations that share so many turns."""
    rng = np.random.default_rng(1)
    paths = sorted(bytes(rng.integers(0, 2, rng.integers(0, 7)).tolist()) for _ in range(60))
    keys = b"".join(bytes([turn]) * 16 for path in paths for turn in path)
    sizes = np.array([len(path) for path in paths])
    forest = prefix_trie.Forest(np.arange(60), sizes, keys, np.ones(int(sizes.sum()), np.int64), None, None)
    found = set()
    components = forest.components()
    for left, right, top, bottom, up in components:
        found |= {(left, right, depth) for depth in range(top, bottom + 1)}
        if up >= 0:
            assert components[up][3] == top - 1 and components[up][0] <= left <= right <= components[up][1]
    expected = {}
    for i, path in enumerate(paths):
        for depth in range(len(path) + 1):
            left, _ = expected.get(path[:depth], (i, i))
            expected[path[:depth]] = (left, i)
    assert found == {(left, right, len(path)) for path, (left, right) in expected.items()}
