"""Texts of Arrow batches as flat numpy byte arrays: slicing, words, hashes.

All functions are vectorised over a batch. A missing text counts as an empty one.
Words are maximal runs of ASCII letters and digits and of bytes above 127; case is folded for
ASCII and for the Latin-1 letters (other scripts compare as written).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document is handled alone.
SLICE_BYTES = 2_000_000

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection whose bits all depend on all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins (one more offset than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows in pieces of about limit bytes of text, each with its bytes and offsets."""
    for batch in batches:
        data, offs = flat(batch.column(batch.schema.get_field_index(column)))
        n, i = batch.num_rows, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 capitals in UTF-8."""
    out = _FOLD[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(at):
        b = data[at]
        up = at[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
        out[up] += 32
    return out


def fold_text(text: str) -> str:
    """fold() for one string, for tests and small tables."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text)


def alternating(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values, cut where a new text begins, and which are of True."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    edge[offs] = True
    at = np.flatnonzero(edge)
    return at[:-1], at[1:], inside[at[:-1]]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut where a new text begins."""
    starts, ends, keep = alternating(inside, offs)
    return starts[keep], ends[keep]


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def short_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans of up to 16 bytes are read as two words, others go to span_hashes()."""
    n = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))
    out = (word[starts] & _MASK[np.minimum(n, 8)]) * _U(_P) + n.astype(np.uint64)
    more = np.flatnonzero((n > 8) & (n <= 16))
    out[more] ^= mix((word[starts[more] + 8] & _MASK[n[more] - 8]) + _U(_Q))
    out = mix(out)
    long = np.flatnonzero(n > 16)
    if len(long):
        # few of them: their bytes alone
        size = n[long]
        begin = np.cumsum(size) - size
        own = data[np.repeat(starts[long] - begin, size) + np.arange(int(size.sum()))]
        out[long] = span_hashes(own, begin, begin + size)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (a polynomial in prefix sums, then mixed)."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers(_P, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(inverse(_P), n + 1)[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every folded word, and the number of words before each text."""
    starts, ends = runs(_WORD[data], offs)
    return span_hashes(fold(data), starts, ends), starts, ends, np.searchsorted(starts, offs)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each k successive words that lie in one text, and the position of its first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(_Q, n), out=prefix[1:])
    at = within(bounds, k)
    return mix((prefix[at + k] - prefix[at]) * powers(inverse(_Q), n + 1)[at]), at


def within(bounds: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k successive words lie in one text."""
    n = int(bounds[-1])
    ok = np.ones(n, dtype=bool)
    for back in range(1, k):
        at = bounds[1:] - back
        ok[at[at >= bounds[:-1]]] = False
    return np.flatnonzero(ok)


def owner(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each word position lies in."""
    return np.searchsorted(bounds, at, side="right") - 1


def word_list(text: str | None) -> list[str]:
    """The words of one text as words() finds them, for tests and small tables."""
    raw = (text or "").encode()
    starts, ends = runs(_WORD[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]))
    return [fold_text(raw[a:b].decode()) for a, b in zip(starts, ends, strict=True)]
