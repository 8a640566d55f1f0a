"""A context-mixing range coder for token ids, many blocks in lockstep.

Every block starts from the same empty model, so blocks decode independently; numpy codes one token of every
block at a time. Ids are numbered in the order in which a block first uses them. Three experts give the next number a distribution:

- order 0: adaptive counts of all numbers, with an escape for ids that are new (these follow as a part coded by adaptive counts and plain low bits);
- order 1 and order 2: for each context of one or two numbers, the two numbers that follow it most, with counts that grow when they are right and decay when they are not.

The distributions are mixed: order 2 with a trust, else order 1 with a trust, else order 0. Trusts are kept for every pair of counts and follow
the probability with which an expert explains what came (a step of expectation maximisation). A number's interval is its whole probability in the mixture.
The model uses integers and basic floating-point arithmetic only, so both directions compute the same bits.
"""

from __future__ import annotations

import numpy as np

TOKENS, TOTAL, SLOTS, AHEAD = 4096, 1 << 24, 1 << 12, 128
_I, _F = np.int32, np.float32
_U = np.uint64
_TOP, _BOT = _U(1 << 32), _U(1 << 28)
#: Steps of trust and escape, their bounds, and what a use adds to a count.
RATE, TRUST, ESCAPE_RATE, ESCAPE, USE = _F(1 / 24), _F(0.93), _F(1 / 32), (_F(0.002), _F(0.7)), 4
#: Ids that can be coded.
MOST_ID = (1 << 20) - 1

#: Shares of the two numbers of a context by their counts (8 * first + second), and the trust in the context before anything is known.
_A, _B = (x.ravel() for x in np.meshgrid(np.arange(8), np.arange(8), indexing="ij"))
_FIRST, _SECOND = (np.where(_A > 0, x / np.maximum(_A + _B, 1.0), 0.0).astype(np.float32) for x in (_A, _B))
_TRUST = np.where(_A > 0, np.minimum(0.12 + 0.13 * _A, 0.85), 0.0).astype(np.float32)


def _changes() -> tuple[np.ndarray, np.ndarray]:
    """For counts (8 * first + second) and what came (1 the first, 2 the second, 0 neither): the new counts, and what becomes of
    the numbers: 0 both stay, 1 they swap, 2 the new one is second, 3 it is first."""
    counts, what = np.zeros(256, np.int32), np.zeros(256, np.int8)
    for k in range(64):
        for came in range(4):
            first, second = divmod(k, 8)
            if came & 1 and first:
                now, how = (min(first + 1, 7), second), 0
            elif came & 2 and second:
                more = min(second + 1, 7)
                now, how = ((more, first), 1) if more > first else ((first, more), 0)
            else:
                now, how = ((max(first - 1, 1), 1), 2) if first else ((1, 0), 3)
            counts[4 * k + came], what[4 * k + came] = 8 * now[0] + now[1], how
    return counts, what


_COUNTS, _WHAT = _changes()
#: What stays of an entry, and where a new number goes.
_KEEP = np.array([(1 << 30) - 64, 0, 4095 << 6, 0], np.int32)[_WHAT]
_NEW = np.array([0, 0, 1 << 18, 1 << 6], np.int32)[_WHAT]


class _Model:
    """Tables are flat; a lane's part begins at its number times the part's length. Pairs of rows are order 2 and order 1."""

    def __init__(self, lanes: int, longest: int):
        self.width = longest + AHEAD + 1
        lane = np.arange(lanes)
        self.slot, self.state = np.stack([lane, lane + lanes]) * SLOTS, np.stack([lane, lane + lanes]) * 64
        self.row, self.sum_row = lane * self.width, lane * (self.width + 1)
        self.table = np.zeros(2 * lanes * SLOTS, np.int32)  # counts (8 * first + second) in 6 bits, then the numbers in 12 each
        self.trust = np.tile(_TRUST, 2 * lanes)
        self.escape = np.full(lanes, ESCAPE[1], _F)
        self.counts = np.zeros((lanes, self.width), np.uint16)
        self.counts[:, :AHEAD] = 1  # numbers that may come before the sums are made again
        self.sums, self.total = np.zeros((lanes, self.width + 1), np.uint16), np.zeros(lanes)
        self.flat_counts, self.flat_sums = self.counts.ravel(), self.sums.ravel()
        self.known = np.zeros(lanes, np.int64)
        self.high, self.high_sum = np.ones((lanes, 256), np.uint16), np.zeros((lanes, 257), np.uint16)
        self.flat_high_sum = self.high_sum.ravel()
        self.before, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step = 0

    def predict(self, n: int) -> None:
        """For the first n lanes: the numbers predicted, their parts of TOTAL, the escape's part, and order 0's width for a count of 1."""
        if self.step % AHEAD == 0 or (self.step < AHEAD and self.step & (self.step - 1) == 0):
            reach = int(self.known.max()) + AHEAD
            np.cumsum(self.counts[:, :reach], axis=1, dtype=np.uint16, out=self.sums[:, 1 : reach + 1])
            self.total = self.sums[:, reach].astype(np.float64)
            self.share = (1 / self.total).astype(_F)
            np.cumsum(self.high, axis=1, dtype=np.uint16, out=self.high_sum[:, 1:])
        self.at = self.slot[:, :n].copy()
        last = self.last[:n]
        self.at[0] += ((last * 40503 + self.before[:n] * 30011) >> 2) & (SLOTS - 1)
        self.at[1] += last & (SLOTS - 1)
        self.e = e = self.table.take(self.at)
        self.k = k = e & 63
        self.b, self.a = e >> 18, (e >> 6) & 4095
        self.s = self.state[:, :n] + k
        self.t = t = self.trust.take(self.s)
        self.fa, self.fb = _FIRST.take(k), _SECOND.take(k)
        m = t * _F(TOTAL)
        m[1] -= m[0] * t[1]
        self.ma, self.mb = (m * self.fa).astype(_I), (m * self.fb).astype(_I)
        both = self.ma + self.mb
        rest = TOTAL - both[0] - both[1]
        self.end = (rest * self.escape[:n]).astype(_I)
        self.unit = (rest - self.end) / self.total[:n]

    def _before(self, x: np.ndarray) -> np.ndarray:
        """What the predicted numbers below x take."""
        own = self.ma * (self.a < x)
        own += self.mb * (self.b < x)
        return own[0] + own[1]

    def begin(self, x: np.ndarray) -> np.ndarray:
        """Where the interval of each lane's number x begins."""
        return (self.flat_sums.take(self.sum_row[: len(x)] + x) * self.unit).astype(_I) + self.end + self._before(x)

    def interval(self, x: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the numbers x; ids that are new have the escape's."""
        at = self.sum_row[: len(x)] + x
        c0, c1 = self.flat_sums.take(at), self.flat_sums.take(at + 1)
        self.n0 = (c1 - c0).astype(_F)
        low = (c0 * self.unit).astype(_I)
        self.is_a, self.is_b = self.a == x, self.b == x
        own = self.ma * self.is_a
        own += self.mb * self.is_b
        size = (c1 * self.unit).astype(_I)
        size -= low
        size += own[0]
        size += own[1]
        low += self.end
        low += self._before(x)
        return np.where(new, _I(0), low), np.where(new, self.end, size)

    def update(self, x: np.ndarray, new: np.ndarray) -> None:
        """After interval() of the same lanes. The number of a new id is in no table, and the count of what is not there is 0."""
        n = len(x)
        escape, t = self.escape[:n], self.t
        hit = self.fa * self.is_a
        hit += self.fb * self.is_b
        hit *= t
        whole = 1 - t
        whole[1] *= np.where(new, escape * _F(2.0**-10), (1 - escape) * (self.n0 * self.share[:n]))
        whole[1] += hit[1]
        whole[0] *= whole[1]
        whole[0] += hit[0]
        hit /= whole
        miss = 1 - hit
        by = hit - t
        by *= RATE
        by[1] *= miss[0]
        by += t
        self.trust[self.s] = np.minimum(by, TRUST, out=by)
        escape = escape + (new - escape) * (ESCAPE_RATE * miss[0] * miss[1])
        self.escape[:n] = np.minimum(np.maximum(escape, ESCAPE[0]), ESCAPE[1])
        came = self.k << 2
        came += self.is_a
        came += self.is_b * _I(2)
        what = _WHAT.take(came)
        self.table[self.at] = (self.e & _KEEP.take(came)) + x * _NEW.take(came) + _COUNTS.take(came)
        swap = np.flatnonzero(what.ravel() == 1)
        if len(swap):
            a, b = self.a.ravel().take(swap), self.b.ravel().take(swap)
            self.table[self.at.ravel().take(swap)] = (b << 6) + (a << 18) + _COUNTS.take(came.ravel().take(swap))
        self.flat_counts[self.row[:n] + x] += USE
        lane = np.flatnonzero(new)
        if len(lane):
            self.flat_counts[self.row.take(lane) + x.take(lane) + AHEAD] = 1
            self.known[lane] += 1
        self.before[:n] = self.last[:n]
        self.last[:n] = x
        self.step += 1


class _Encoder:
    def __init__(self, lanes: int, tokens: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.width = tokens // 2 + 64
        self.out, self.n = np.zeros(lanes * self.width, np.uint32), np.zeros(lanes, np.int64)

    def make_room(self, words: int) -> None:
        """So that each lane can take this many more words."""
        if int(self.n.max()) + words > self.width:
            old, lanes = self.width, len(self.n)
            self.width = int(self.n.max()) + words + old // 4
            out = np.zeros((lanes, self.width), np.uint32)
            out[:, :old] = self.out.reshape(lanes, old)
            self.out = out.ravel()

    def code(self, lane: np.ndarray | slice, begin: np.ndarray, size: np.ndarray, total: np.ndarray | None = None) -> None:
        """Without total, it is TOTAL."""
        r = self.range[lane] >> _U(24) if total is None else self.range[lane] // total.astype(np.uint64)
        low, r = self.low[lane] + begin.astype(np.uint64) * r, r * size.astype(np.uint64)
        settled = (low ^ (low + r)) < _TOP
        k = np.flatnonzero(settled | (r < _BOT))
        while len(k):
            lk, rk, settled = low.take(k), r.take(k), settled.take(k)
            if not settled.all():
                rk = np.where(settled, rk, (_U(0) - lk) & (_BOT - _U(1)))
            rk <<= _U(32)
            who = k if isinstance(lane, slice) else lane.take(k)
            n = self.n.take(who)
            self.out[n + who * self.width] = lk >> _U(32)
            self.n[who] = n + 1
            lk <<= _U(32)
            low[k], r[k] = lk, rk
            settled = (lk ^ (lk + rk)) < _TOP
            more = settled | (rk < _BOT)
            k = k[more]
            settled = settled[more]
            if len(k):
                full = np.zeros(len(low), bool)
                full[k] = settled
                settled = full
        self.low[lane], self.range[lane] = low, r

    def finish(self) -> list[bytes]:
        for shift in (32, 0):
            self.out[np.arange(len(self.n)) * self.width + self.n] = (self.low >> _U(shift)) & _U(0xFFFFFFFF)
            self.n += 1
        return [self.out[i * self.width : i * self.width + n].astype("<u4").tobytes() for i, n in enumerate(self.n)]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        words = [np.frombuffer(p, "<u4") for p in payloads]
        self.data = np.zeros((len(words), max(map(len, words)) + 8), np.uint64)
        for i, w in enumerate(words):
            self.data[i, : len(w)] = w
        self.low, self.range = np.zeros(len(words), np.uint64), np.full(len(words), 2**64 - 1, np.uint64)
        self.code, self.n = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
        for _ in range(2):
            self.code = (self.code << _U(32)) | self.data[np.arange(len(words)), self.n]
            self.n += 1

    def target(self, lane: np.ndarray, total: np.ndarray | int) -> np.ndarray:
        self.unit = self.range[lane] // np.asarray(total).astype(np.uint64)
        return np.minimum((self.code[lane] - self.low[lane]) // self.unit, np.asarray(total).astype(np.uint64) - _U(1)).astype(np.int64)

    def take(self, lane: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        low, r, code = self.low[lane] + begin.astype(np.uint64) * self.unit, self.unit * size.astype(np.uint64), self.code[lane]
        while True:
            settled = (low ^ (low + r)) < _TOP
            move = settled | (r < _BOT)
            if not move.any():
                break
            k = np.flatnonzero(move)
            cramped = k[~settled[k]]
            r[cramped] = (_U(0) - low[cramped]) & (_BOT - _U(1))
            code[k] = (code[k] << _U(32)) | self.data[lane[k], self.n[lane[k]]]
            self.n[lane[k]] += 1
            low[k] <<= _U(32)
            r[k] <<= _U(32)
        self.low[lane], self.range[lane], self.code[lane] = low, r, code


def numbered(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id's number in the order of first use, and whether it is used first."""
    n = len(block)
    seen = np.zeros(int(block.max()) + 1 if n else 1, np.int32)
    seen[block[::-1]] = np.arange(n - 1, -1, -1, dtype=np.int32)  # of equal ids the last assigned stays: the first in the block
    first = seen[block]
    new = first == np.arange(n)
    return (np.cumsum(new, dtype=np.int32) - 1)[first], new


def low_bits(block: np.ndarray) -> int:
    """Bits of an id below the part that is coded by counts."""
    top = int(block.max()) if len(block) else 0
    if top > MOST_ID:
        raise ValueError(f"id {top}; ids up to {MOST_ID} can be coded")
    return max(8, top.bit_length() - 8)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of up to TOKENS ids as bytes; the first byte holds its low_bits()."""
    if not blocks:
        return []
    order = np.argsort([-len(b) for b in blocks], kind="stable")
    longest = len(blocks[order[0]])
    if longest > TOKENS:
        raise ValueError(f"a block of {longest} ids; {TOKENS} at most")
    bits = np.array([low_bits(blocks[i]) for i in order], np.int64)
    numbers, fresh, ids = np.zeros((len(blocks), longest), np.int16), np.zeros((len(blocks), longest), bool), np.zeros((len(blocks), longest), np.uint16 if bits.max() == 8 else np.int32)
    for lane, i in enumerate(order):
        n = len(blocks[i])
        ids[lane, :n] = blocks[i]
        numbers[lane, :n], fresh[lane, :n] = numbered(blocks[i])
    numbers, fresh, ids = np.ascontiguousarray(numbers.T), np.ascontiguousarray(fresh.T), np.ascontiguousarray(ids.T)
    live = np.searchsorted([-len(blocks[i]) for i in order], -np.arange(longest), side="left")
    model, coder = _Model(len(blocks), longest), _Encoder(len(blocks), longest)
    for t in range(longest):
        n = int(live[t])
        x, new = numbers[t, :n].astype(np.int32), fresh[t, :n]
        if t % 32 == 0:
            coder.make_room(32 * 8 + 8)
        model.predict(n)
        coder.code(slice(0, n), *model.interval(x, new))
        lane = np.flatnonzero(new)
        if len(lane):
            own, shift = ids[t].take(lane).astype(np.int64), bits.take(lane)
            high = own >> shift
            low, at = own - (high << shift), lane * 257 + high
            flat = model.flat_high_sum
            first = flat.take(at).astype(np.int64)
            size = flat.take(at + 1).astype(np.int64) - first
            coder.code(lane, (first << shift) + low * size, size, flat.take(lane * 257 + 256).astype(np.int64) << shift)
            model.high.ravel()[lane * 256 + high] += 8
        model.update(x, new)
    out: list[bytes] = [b""] * len(blocks)
    for i, shift, data in zip(order, bits.tolist(), coder.finish(), strict=True):
        out[i] = bytes([shift]) + data
    return out


def decode(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The blocks that encode() was given; sizes are their lengths."""
    if not payloads:
        return []
    order = np.argsort([-n for n in sizes], kind="stable")
    longest = sizes[order[0]]
    live = np.searchsorted([-sizes[i] for i in order], -np.arange(longest), side="left")
    model, coder = _Model(len(sizes), longest), _Decoder([payloads[i][1:] for i in order])
    bits = np.array([payloads[i][0] for i in order], np.int64)
    ids, names = np.zeros((longest, len(sizes)), np.int32), np.zeros((len(sizes), longest + 1), np.int32)
    for t in range(longest):
        n = int(live[t])
        model.predict(n)
        everyone = np.arange(n)
        at = coder.target(everyone, TOTAL)
        new = at < model.end
        low, high = np.zeros(n, np.int32), model.known[:n].astype(np.int32)
        while (high - low > 1).any():
            middle = (low + high) >> 1
            right = model.begin(middle) <= at
            low, high = np.where(right & (high - low > 1), middle, low), np.where(right | (high - low < 2), high, middle)
        x = np.where(new, model.known[:n], low).astype(np.int32)
        coder.take(everyone, *model.interval(x, new))
        lane = np.flatnonzero(new)
        if len(lane):
            shift, sums = bits[lane], model.high_sum[lane].astype(np.int64)
            at = coder.target(lane, sums[:, 256] << shift)
            part = (sums <= (at >> shift)[:, None]).sum(axis=1) - 1
            first = sums[np.arange(len(lane)), part]
            size = sums[np.arange(len(lane)), part + 1] - first
            rest = (at - (first << shift)) // size
            coder.take(lane, (first << shift) + rest * size, size)
            names[lane, x[lane]] = (part << shift) + rest
            model.high.ravel()[lane * 256 + part] += 8
        ids[t, :n] = names[everyone, x]
        model.update(x, new)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(sizes)
    for lane, i in enumerate(order):
        out[i] = ids[: sizes[i], lane].copy()
    return out
