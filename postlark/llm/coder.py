"""An adaptive context-mixing range coder for token ids, run over many blocks at once.

Each block starts with a fresh model. The model mixes three predictions of the next id:
the one that last followed the two ids before it (order 2), the one that last followed
the id before it (order 1), and a distribution over all ids (order 0, the starting
knowledge that the blocks of a group share). How much each prediction is trusted is
learnt while coding, per state of confidence. The mix drives a range coder with a 62-bit
interval and 16-bit digits.

Blocks are coded side by side: step ``t`` codes id ``t`` of every block with a few numpy
calls, so the time per id is that of vector arithmetic. A block can be decoded without
the others.
"""

from dataclasses import dataclass

import numpy as np

# Fixed values of the format.
SLOTS = 512
STATES = 32
RATE = 5
HALF = 1 << 16
LEAST, MOST = 64, HALF - 4096
START = 8192
SPAN_BITS, DIGIT_BITS = 62, 16
LAST_DIGITS = 4

WRITTEN = 128  # blocks whose digits are joined, or ids looked up, at once
AT_ONCE = 1 << 18  # ids that are counted or numbered at once
TABLE = 1 << 20  # ids below this are counted and numbered by a table


@dataclass
class Prior:
    """Order 0: the different ids, and their frequencies, which add up to ``2**bits``."""

    symbols: np.ndarray
    freqs: np.ndarray
    bits: int

    @classmethod
    def of(cls, ids: np.ndarray) -> "Prior":
        symbols, counts = _counted(ids)
        bits = max(16, int(len(symbols)).bit_length() + 2)
        room = (1 << bits) - len(symbols)
        freqs = counts * room // max(int(counts.sum()), 1) + 1
        freqs[np.argmax(freqs)] += (1 << bits) - int(freqs.sum())
        return cls(symbols.astype(np.int64), freqs.astype(np.int64), bits)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.freqs) - self.freqs


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in ascending order, and how often each occurs."""
    most = int(ids.max()) + 1 if len(ids) else 0
    if most > TABLE:
        return np.unique(ids, return_counts=True)
    counts = np.zeros(most, np.int64)
    for start in range(0, len(ids), AT_ONCE):
        counts += np.bincount(ids[start : start + AT_ONCE], minlength=most)
    symbols = np.flatnonzero(counts)
    return symbols, counts[symbols]


def _place_type(symbols: np.ndarray) -> type:
    """A small type that holds each place in ``symbols``."""
    return np.uint16 if len(symbols) <= 1 << 16 else np.int32


def _places(ids: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Where each id stands in ``symbols``."""
    out = np.empty(len(ids), _place_type(symbols))
    table = None
    if len(symbols) and symbols[-1] < TABLE:
        table = np.zeros(int(symbols[-1]) + 1, out.dtype)
        table[symbols] = np.arange(len(symbols))
    for start in range(0, len(ids), AT_ONCE):
        some = ids[start : start + AT_ONCE]
        out[start : start + AT_ONCE] = np.searchsorted(symbols, some) if table is None else table[some]
    return out


class _Model:
    """The predictions and confidences of ``lanes`` blocks.

    Order 1 is the first and order 2 the second half (or row) of all that holds both, so that
    one numpy call works on both. An entry of ``table`` is a symbol times 4 plus the trust in
    it. An entry of ``odds`` holds the chance of order 2 in its lower and of order 1 in its
    upper half. Numbers have 8 or 32 bits wherever they fit: a call is the faster the smaller
    they are.
    """

    def __init__(self, lanes: int):
        self.slots = np.arange(2 * lanes, dtype=np.int32).reshape(2, lanes) * SLOTS
        self.states = np.arange(lanes) * STATES
        self.table = np.zeros(2 * lanes * SLOTS, np.int32)
        self.odds = np.full(lanes * STATES, START << 16 | START, np.uint32)
        self.hash = np.empty((2, lanes), np.int32)
        self.chance = np.empty((2, lanes), np.uint32)
        self.hits = np.empty((2, lanes), np.int32)

    def predict(self, last: np.ndarray, before: np.ndarray):
        """The guesses of both orders, and the shares of order 2, 1 and 0 in 65536ths."""
        # Only the lower bits of the products are used, so these may overflow.
        one, two = self.hash
        np.multiply(last, 40503, out=one)
        np.multiply(before, 60493, out=two)
        two += one
        one >>= 7
        two >>= 9
        self.hash &= SLOTS - 1
        self.hash += self.slots
        self.at = self.hash.ravel().astype(np.intp)
        self.entries = self.table.take(self.at, mode="clip")
        self.trust = (self.entries & 3).astype(np.int8).reshape(2, -1)
        self.guess = (self.entries >> 2).reshape(2, -1)
        state = self.trust[1] << 2
        state += self.trust[0]
        state += (self.guess[0] == self.guess[1]).view(np.int8) << 4
        self.state = state.astype(np.intp)
        self.state += self.states
        odds = self.odds.take(self.state, mode="clip")
        np.right_shift(odds, 16, out=self.chance[0])
        np.bitwise_and(odds, 0xFFFF, out=self.chance[1])
        rest = HALF - self.chance[1]
        share1 = rest * self.chance[0]
        share1 >>= 16
        rest -= share1
        return *self.guess, self.chance[1].view(np.int32), share1.view(np.int32), rest.view(np.int32)

    def settle(self, right2: np.ndarray, right1: np.ndarray):
        """As numbers: whether order 2 hit, order 1 hit and order 2 did not, neither, and order 2 did not."""
        first, second = self.hits
        np.copyto(second, right2)
        np.copyto(first, right1 > right2)
        missed = 1 - second
        return second, first, missed - first, missed

    def learn(self, symbols: np.ndarray, missed: np.ndarray) -> None:
        """Learn from the symbols that came, after ``settle``.

        A chance moves towards 1 or 0. Trust rises by one up to 3 after a hit and is
        halved after a miss; an untrusted guess that misses is replaced. Written as
        sums of products, which numpy works out faster than choices.
        """
        chance = self.chance.view(np.int32)
        move = self.hits * (MOST - LEAST)
        move += LEAST
        move -= chance
        move >>= RATE
        move[0] *= missed
        chance += move
        self.chance[0] <<= 16
        self.chance[0] |= self.chance[1]
        self.odds[self.state] = self.chance[0]
        right = self.guess == symbols
        down = self.trust + 1
        down >>= 1
        up = (self.trust < 3).view(np.int8) + down
        up *= right.view(np.int8)
        up -= down
        lost = (self.trust == 0) > right
        entries = self.entries.reshape(2, -1)
        entries += up.astype(np.int32)
        change = (symbols << 2) - entries
        change *= lost.astype(np.int32)
        entries += change
        self.table[self.at] = self.entries


def _steps(prior: Prior) -> np.ndarray:
    """Where each symbol begins in its upper and how wide it is in its lower half, then the whole."""
    return np.append(prior.starts << 32 | prior.freqs, 1 << prior.bits)


def _interval(model: _Model, hits: tuple, shares: tuple, symbols: np.ndarray, steps: np.ndarray, shift: int):
    """Where the symbols' parts of the interval begin and how wide they are, in 2**-(16 + bits)."""
    (hit2, hit1, direct, missed), (share2, share1, share0) = hits, shares
    start = missed * share2
    start += direct * share1
    part = hit2 * share2
    part += hit1 * share1
    part += direct * share0
    at = symbols - (len(steps) - 1)  # a guess that hit has its order's whole part
    at *= direct
    at += len(steps) - 1
    step = steps.take(at, mode="clip")
    part = part.astype(np.int64)
    start = start.astype(np.int64)
    start <<= shift
    start += (step >> 32) * part
    step &= 0xFFFFFFFF
    step *= part
    return start, step


def block_lengths(total: int, block: int) -> np.ndarray:
    """Split ``total`` ids into equal blocks of at most ``block``; the longer ones first."""
    lanes = -(-total // block)
    if not lanes:
        return np.zeros(0, np.int64)
    return np.full(lanes, total // lanes) + (np.arange(lanes) < total % lanes)


def _grid(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Blocks as columns: row ``t`` holds value ``t`` of every block that has one."""
    steps, lanes = int(lengths[0]), len(lengths)
    grid, end = np.zeros((steps, lanes), values.dtype), 0
    for start in range(0, lanes, WRITTEN):  # as many as the caches hold
        some = lengths[start : start + WRITTEN, None]
        rows = np.zeros((len(some), steps), values.dtype)
        rows[np.arange(steps) < some] = values[end : end + int(some.sum())]
        grid[:, start : start + WRITTEN] = rows.T
        end += int(some.sum())
    return grid


def encode_blocks(ids: np.ndarray, prior: Prior, lengths: np.ndarray) -> list[bytes]:
    """Code consecutive runs of ids as blocks; ``lengths`` as of ``block_lengths``."""
    if not len(lengths):
        return []
    grid = _grid(_places(ids, prior.symbols), lengths)
    lanes, full = len(lengths), int(lengths[-1])
    shift, steps = prior.bits, _steps(prior)
    model = _Model(lanes)
    low = np.zeros(lanes, np.int64)
    span = np.full(lanes, (1 << SPAN_BITS) - 1, np.int64)
    # The digits, and how many they are plus 4 if the number is above two digits by a carry.
    heads = np.empty(grid.shape, np.uint32)
    emitted = np.empty(grid.shape, np.int8)
    last = before = np.zeros(lanes, np.int32)
    for t, row in enumerate(grid):
        symbols = row.astype(np.int32)
        p1, p2, *shares = model.predict(last, before)
        hits = model.settle(p2 == symbols, p1 == symbols)
        start, size = _interval(model, hits, shares, symbols, steps, shift)
        if t >= full:  # a finished block takes the whole interval: nothing changes
            done = lengths <= t
            start[done], size[done] = 0, HALF << shift
        unit = span >> (16 + shift)
        start *= unit
        low += start
        np.multiply(unit, size, out=span)
        count, bits = _digits_out(span)
        # Without digits nothing is taken, also not a carry: ``low`` is below 2**63.
        keep = (SPAN_BITS - count * DIGIT_BITS + (count == 0).view(np.int8)).astype(np.int64)
        head = low >> keep
        heads[t], emitted[t] = head, count + ((head > 0xFFFFFFFF).view(np.int8) << 2)
        head <<= keep
        low -= head
        low <<= bits
        span <<= bits
        model.learn(symbols, hits[-1])
        last, before = symbols, last
    del grid, model
    # A few blocks at a time, as joining digits takes several times their memory.
    parts = (slice(start, start + WRITTEN) for start in range(0, lanes, WRITTEN))
    return [block for part in parts for block in _written(heads[:, part], emitted[:, part], low[part])]


def _digits_out(span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many digits are settled (0 to 2), so that the interval is wide again, and their bits."""
    count = (span < 1 << (SPAN_BITS - DIGIT_BITS)).view(np.int8)
    count = count + (span < 1 << (SPAN_BITS - 2 * DIGIT_BITS)).view(np.int8)
    return count, (count * DIGIT_BITS).astype(np.int64)


def _written(heads: np.ndarray, emitted: np.ndarray, low: np.ndarray) -> list[bytes]:
    """Join the digits of each block and carry what went over into the digits before."""
    steps, lanes = heads.shape
    counts = np.ones((lanes, steps + LAST_DIGITS), np.int8)
    counts[:, :steps] = emitted.T
    values = np.empty((lanes, steps + LAST_DIGITS), np.uint32)
    values[:, :steps] = heads.T
    for i in range(LAST_DIGITS):
        left = SPAN_BITS - DIGIT_BITS * (i + 1)
        part = low >> left if left >= 0 else low << -left
        values[:, steps + i] = part if i == 0 else part & 0xFFFF
    per_lane = (counts & 3).sum(axis=1, dtype=np.int64)
    used = np.flatnonzero(counts.ravel())
    counts, values = counts.ravel()[used], values.ravel()[used]
    ends = np.cumsum(counts & 3, dtype=np.int64)
    out = np.zeros(int(ends[-1]), np.int32)
    two = np.flatnonzero(counts & 2)
    out[ends[two] - 2] = (values[two] >> DIGIT_BITS).view(np.int32) + ((counts[two] >> 2).astype(np.int32) << DIGIT_BITS)
    values[two] &= 0xFFFF
    out[ends - 1] = values.view(np.int32)
    while True:  # a block's number is below 1, so nothing is carried out of its first digit
        carry = out >> DIGIT_BITS
        if not carry.any():
            break
        out &= 0xFFFF
        out[:-1] += carry[1:]
    data, stops = out.astype("<u2").tobytes(), np.cumsum(per_lane) * 2
    return [data[stop - 2 * n : stop] for n, stop in zip(per_lane, stops)]


def decode_blocks(blocks: list[bytes], prior: Prior, lengths: np.ndarray) -> np.ndarray:
    """The ids of blocks coded by ``encode_blocks``, joined."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    lanes, steps = len(lengths), int(lengths.max())
    flat = np.frombuffer(b"".join([*blocks, b"\0" * 8]), "<u2")
    sizes = np.array([len(block) // 2 for block in blocks])
    at = np.cumsum(sizes) - sizes
    first = [flat[at + i].astype(np.int64) for i in range(LAST_DIGITS)]
    code = (first[0] << 46) | (first[1] << 30) | (first[2] << 14) | (first[3] >> 2)
    # The window of 62 bits ends two bits before a digit does; so do the 32 that follow.
    ahead = flat[:-2].astype(np.uint32)
    ahead <<= 30
    ahead |= flat[1:-1].astype(np.uint32) << 14
    ahead |= flat[2:] >> 2
    del flat
    at, end = at + 3, len(ahead) - 1
    span = np.full(lanes, (1 << SPAN_BITS) - 1, np.int64)
    shift, parts = prior.bits, _steps(prior)
    lookup = np.repeat(np.arange(len(prior.symbols), dtype=_place_type(prior.symbols)), prior.freqs)
    highest = (HALF << shift) - 1
    model = _Model(lanes)
    grid = np.empty((steps, lanes), _place_type(prior.symbols))
    last = before = np.zeros(lanes, np.int32)
    for t in range(steps):
        p1, p2, *shares = model.predict(last, before)
        share2, share1, share0 = shares
        unit = span >> (16 + shift)
        value = (code.view(np.uint64) // unit.view(np.uint64)).view(np.int64)
        np.minimum(value, highest, out=value)
        top = (value >> shift).astype(np.int32)
        edge = share2 + share1
        hits = hit2, hit1, direct, _ = model.settle(top < share2, top < edge)
        # Below 2**53, so floating point division gives the exact whole part.
        value -= edge.astype(np.int64) << shift
        place = (value / share0).astype(np.int64)
        place *= direct
        symbols = lookup.take(place, mode="clip") * direct
        symbols += p2 * hit2
        symbols += p1 * hit1
        start, size = _interval(model, hits, shares, symbols, parts, shift)
        start *= unit
        code -= start
        np.multiply(unit, size, out=span)
        count, bits = _digits_out(span)
        code <<= bits
        span <<= bits
        np.subtract(32, bits, out=bits)
        code |= ahead.take(at, mode="clip").astype(np.int64) >> bits
        at += count
        np.minimum(at, end, out=at)
        grid[t] = symbols
        model.learn(symbols, hits[-1])
        last, before = symbols, last
    del ahead, model
    ids, values = np.empty(int(lengths.sum()), np.uint32), prior.symbols.astype(np.uint32)
    end = 0
    for start in range(0, lanes, WRITTEN):
        some = slice(start, start + WRITTEN)
        found = values[grid[:, some].T[np.arange(steps) < lengths[some, None]]]
        ids[end : end + len(found)] = found
        end += len(found)
    return ids
