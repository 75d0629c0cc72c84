"""Encode texts with a public tokenizer, each different word once."""

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from postlark.llm.common import LOWER_WORDS, byte_table, concat_range, dictionary_words, mix64

# How many words a Python worker remembers, at some 50 bytes each, and as much again while
# words are added. Words met later, and those of many ids, are encoded when they occur.
CACHED_WORDS = 1_000_000
MOST_IDS = 64
# The library's results are large objects, so few words are given to it at once.
AT_ONCE = 10_000
HASHED_BYTES = 64  # at the front of a word, eight at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWEST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes
# Words of a text whose ids are put together at once.
JOINED_WORDS = 1 << 17

_WORDS = byte_table(lambda byte: not (byte == 0x20 or 0x09 <= byte <= 0x0D), lower=False)


# Words of Latin letters (A-Z lower-cased before) and final marks. Their letters and their marks
# are two pieces to the tokenizer, and normalizing does no more than lower the letters.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))).replace("\xf7", "")
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()).replace("'", "")
_HIGH = _LETTERS + _LETTERS[27:].upper().replace("\u0178", "")  # not that of y with two dots
_SIMPLE = f"^[{_HIGH}]+[{re.escape(_MARKS)}]*$"
_BARE = f"^[{_HIGH}]+"


def _hashes(words: pa.Array) -> np.ndarray:
    """A number per word: eight bytes after the other, mixed with what the bytes before gave.

    What a long word has after its first bytes are digits of a polynomial modulo 2**64.
    """
    words = pa.concat_arrays([words])
    if not len(words):
        return np.zeros(0, np.uint64)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    raw = np.zeros(int(ends[-1] - ends[0]) + 8, np.uint8)
    if data is not None:
        raw[:-8] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    eight = np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,))  # those from each byte on
    out = sizes.astype(np.uint64)
    for low in range(0, HASHED_BYTES, 8):
        more = np.flatnonzero(sizes > low)
        part = eight[starts[more] + low] & _LOWEST[np.minimum(sizes[more] - low, 8)]
        mixed = (out[more] ^ part) * _ODD
        out[more] = mixed ^ (mixed >> np.uint64(29))
    long = np.flatnonzero(sizes > HASHED_BYTES)
    if len(long):
        left = sizes[long] - HASHED_BYTES
        digits = raw[concat_range(starts[long] + HASHED_BYTES, left)].astype(np.uint64) + np.uint64(1)
        digits *= np.full(int(left.max()), _ODD).cumprod()[concat_range(np.zeros(len(left), np.int64), left)]
        out[long] ^= np.add.reduceat(digits, np.cumsum(left) - left)
    return mix64(out)


class _Known:
    """The words a worker has encoded so far, found by a hash table.

    The table outlives batches: a batch costs a few looks per word of its own, not a table
    of all words. ``at`` has the words' places, a word's at the first free one after what its
    hash says; at most half of it is used. Of words with one hash only one is ever found.
    """

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.starts = self.sizes = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.full(1 << 10, -1, np.int32)

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(len(self.at) - 1)).astype(np.int64)

    def find(self, words: pa.Array, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where each word is kept, and whether it is."""
        if not len(self.words) or not len(words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        hashes = _hashes(words) if hashes is None else hashes
        out, last = np.full(len(words), -1, np.int32), len(self.at) - 1
        open_, place = np.arange(len(words)), self._first(hashes)
        while len(open_):
            at = self.at[place]
            same = (self.hashes[at] == hashes[open_]) & (at >= 0)
            out[open_[same]] = at[same]
            more = np.flatnonzero((at >= 0) & ~same)
            open_, place = open_[more], (place[more] + 1) & last
        held = np.flatnonzero(out >= 0)
        equal = pc.equal(self.words.take(pa.array(out[held])), words.take(pa.array(held)))
        found = np.zeros(len(words), bool)
        found[held] = equal.to_numpy(zero_copy_only=False)
        return np.maximum(out, 0), found

    def add(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray, hashes: np.ndarray | None = None) -> None:
        hashes = _hashes(words) if hashes is None else hashes
        numbers = np.arange(len(self.words), len(self.words) + len(words), dtype=np.int32)
        self.hashes = np.concatenate([self.hashes, hashes])
        self.words = pa.concat_arrays([self.words, words])
        starts = (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])
        if 2 * len(self.words) > len(self.at):
            self.at = np.full(1 << (2 * len(self.words) - 1).bit_length(), -1, np.int32)
            numbers = np.arange(len(self.words), dtype=np.int32)
        place, last = self._first(self.hashes[numbers]), len(self.at) - 1
        while len(numbers):
            free = self.at[place] < 0
            self.at[place[free]] = numbers[free]  # of several words one gets the place
            more = np.flatnonzero(self.at[place] != numbers)
            numbers, place = numbers[more], (place[more] + 1) & last


@lru_cache(maxsize=2)
def _loaded(path: str):
    from tokenizers import Tokenizer, pre_tokenizers

    spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    # The tokenizer's characters for the bytes that are not spelt as themselves.
    pairs = [(chr(byte), char) for letter in _LETTERS for byte, char in zip(letter.encode(), spell(letter)[0][0])]
    return Tokenizer.from_file(path), {byte: char for byte, char in pairs if byte != char}, {"": []}, _Known()


def forget() -> None:
    """Let go of the tokenizers and words that this worker holds."""
    _loaded.cache_clear()


def _texts(words: pa.Array) -> list[str]:
    """As ``to_pylist``, in a tenth of the time."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of lists of ids, and all ids."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))


def _merged(places: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids put where ``places`` say, from several sizes and joined ids."""
    sizes = np.empty(sum(map(len, places)), np.int64)
    for at, (own, _) in zip(places, found):
        sizes[at] = own
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint32)
    for at, (own, ids) in zip(places, found):
        out[concat_range(starts[at], own)] = ids
    return sizes, out


class WordEncoder:
    """Encodes whole texts with a byte-level tokenizer whose tokens never span white space.

    Such a tokenizer gives a text the ids of its words, one after the other, so each
    different word of a batch is encoded once by the library. The tokenizer lower-cases,
    so words are lower-cased before they are compared, unless a text may hold a special
    token, whose case counts. Simple words go to the library's merges directly, without
    its search for pieces.
    """

    def __init__(self, path: str):
        self.tokenizer, self.letters, self.marks, self.known = _loaded(path)

    def _marks(self, marks: str) -> list[int]:
        if marks not in self.marks and len(self.marks) < AT_ONCE:
            self.marks[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids
        found = self.marks.get(marks)
        return self.tokenizer.encode(marks, add_special_tokens=False).ids if found is None else found

    def _library(self, words: pa.Array, lowered: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words that are not known yet."""
        sizes, parts = [], []
        for start in range(0, len(words), AT_ONCE):
            some, simple = words.slice(start, AT_ONCE), None
            if lowered:
                simple = pc.match_substring_regex(some, _SIMPLE)
            if simple is None or not pc.any(simple).as_py():
                found = self._pieces(some)
            else:
                other = pc.invert(simple)
                places = [np.flatnonzero(mask.to_numpy(zero_copy_only=False)) for mask in (simple, other)]
                found = _merged(places, [self._simple(some.filter(simple)), self._pieces(some.filter(other))])
            sizes.append(found[0])
            parts.append(found[1])
        none = np.zeros(0, np.uint32)
        return np.concatenate([none.astype(np.int64), *sizes]), np.concatenate([none, *parts])

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(_texts(words), add_special_tokens=False)
        return _joined([encoding.ids for encoding in found])

    def _simple(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bare = pc.ascii_rtrim(words, _MARKS)
        spelt = " ".join(_texts(bare)).lower().encode().decode("latin-1")
        for byte, char in self.letters.items():
            spelt = spelt.replace(byte, char)
        merge = self.tokenizer.model.tokenize
        sizes, ids = _joined([[token.id for token in merge(letters)] for letters in spelt.split(" ")])
        marked = pc.less(pc.binary_length(bare), pc.binary_length(words))
        marks = pc.replace_substring_regex(words.filter(marked), _BARE, "").dictionary_encode()
        if not len(marks):
            return sizes, ids
        own_sizes, own = _joined([self._marks(text) for text in marks.dictionary.to_pylist()])
        codes = marks.indices.to_numpy()
        which = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        after = np.zeros(len(sizes), np.int64)
        after[which] = own_sizes[codes]
        begin = np.cumsum(own_sizes) - own_sizes
        # Letters have the even places and marks the odd ones.
        pieces = np.arange(len(sizes)) * 2
        both, out = _merged([pieces, pieces + 1], [(sizes, ids), (after, own[concat_range(begin[codes], after[which])])])
        return both.reshape(-1, 2).sum(axis=1), out

    def words(self, dictionary: pa.Array, counts: np.ndarray, lowered: bool = True):
        """Starts and sizes of the different words' ids, and those ids.

        New words are remembered while there is room.
        """
        known = self.known
        hashes = _hashes(dictionary)
        at, held = known.find(dictionary, hashes)
        at, new = at[held], np.flatnonzero(~held)
        fresh = dictionary.take(pa.array(new))
        sizes, ids = self._library(fresh, lowered)
        # Together, as the ids of all known words are many more than those of these words.
        own = known.sizes[at].astype(np.int64)
        told = own, known.ids[concat_range(known.starts[at].astype(np.int64), own)]
        sizes_all, values = _merged([np.flatnonzero(held), new], [told, (sizes, ids)])
        starts_all = np.cumsum(sizes_all) - sizes_all
        # The more frequent ones first, as there may not be room for all.
        room = max(CACHED_WORDS - len(known.words), 0) if lowered else 0
        if room and len(new):
            often = np.argsort(-counts[new], kind="stable")
            often = often[sizes[often] <= MOST_IDS][:room]
            places = concat_range((np.cumsum(sizes) - sizes)[often], sizes[often])
            known.add(fresh.take(pa.array(often)), sizes[often], ids[places], hashes[new[often]])
        return starts_all, sizes_all, values

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and the number of ids of each text."""
        lowered = not pc.any(pc.match_substring(texts, "<|")).as_py()
        words = dictionary_words(texts, LOWER_WORDS if lowered else _WORDS)
        counts = np.bincount(words.codes, minlength=len(words.dictionary))
        starts, sizes, values = self.words(words.dictionary, counts, lowered)
        ends = np.zeros(len(words.codes) + 1, np.int64)
        np.cumsum(sizes[words.codes], out=ends[1:])
        ids = np.empty(int(ends[-1]), np.uint32)
        for low in range(0, len(words.codes), JOINED_WORDS):
            codes = words.codes[low : low + JOINED_WORDS]
            ids[ends[low] : ends[low + len(codes)]] = values[concat_range(starts[codes], sizes[codes])]
        return ids, np.diff(ends[words.offsets])
