"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact verification.

For every item of n words, every run of n words of every document is a window. Windows and items are
multisets of 3-word shingles weighted by their count. A window is reported for an item when their
fingerprints of BITS bits differ in at most RADIUS bits and their weighted Jaccard similarity
(sum of minima over sum of maxima) is at least THRESHOLD. A document with fewer shingles than the item is one window as a whole.

1. Windows: one of that similarity shares at least 2nt/(1+t) of its n shingles with an item of its size (a whole document of m shingles: t(m+n)/(1+t)), so
   only windows with as many from the shingles of all items of that size are fingerprinted. No match is lost by that.
2. Fingerprints are differences of running sums of the shingles' signs, so a window costs the same whatever its size.
3. The index is kept by item size. Within a size it has BLOCKS blocks of 16 bits; by the pigeonhole principle two fingerprints within RADIUS are within some
   block's limit in that block, as the limits plus one add up to RADIUS + 1. Items near in a block are candidates; their whole distance decides.
4. Candidates within the radius are compared by their exact weighted shingles.

The radius itself is a sieve: at the threshold, three shingles of four are shared and a bit differs with probability 0.23, so some 1 in 1,000 windows
right at it lie beyond 80 bits of 256 (practically none of those at 0.7 and above).

The benchmark's index is sent to the executors; it does not grow with the documents, and a pass takes items of up to CHARS_A_PASS characters (some 150 MB of index).
Documents are not shuffled for the search.

Defined results: items and texts that are missing, or shorter than a shingle, match nothing. Very long texts are searched whole. Of several windows of one document for one
item the most similar counts, then the earliest. Repeated rows give repeated matches, and rows without id are matched too. Case and punctuation don't count. Other columns
play no part in find_leaks(), whatever their names, and pass through drop_leaks(). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.arrow_text import flat, mix, owner, slices, windows, words

SHINGLE, BITS, BLOCKS, RADIUS, THRESHOLD = 3, 256, 16, 80, 0.6
#: Bits by which fingerprints may differ in each block.
LIMITS = [(RADIUS + 1) // BLOCKS - 1 + (b < (RADIUS + 1) % BLOCKS) for b in range(BLOCKS)]
CHARS_A_PASS = 20_000_000
#: Span of shingles whose signs are summed at a time, and pairs of windows and items looked at at a time.
SUMMED, LOT = 16_384, 1_000_000
_U = np.uint64


def shingle_bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of BITS bits of each shingle."""
    lanes = np.stack([mix(shingles + np.uint64(i * 0x632BE59BD9B4E019 % 2**64)) for i in range(BITS // 64)], axis=-1)
    return np.unpackbits(lanes.view(np.uint8).reshape(*shingles.shape, BITS // 8), axis=-1).astype(np.int8) * 2 - 1


def fingerprints(shingles: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The SimHash (as bytes) of the n shingles from each begin; a shingle counts as often as it occurs. begin ascends."""
    out = np.empty((len(begin), BITS // 8), np.uint8)
    i = 0
    while i < len(begin):
        j = int(np.searchsorted(begin, begin[i] + SUMMED))
        low, high = begin[i:j], begin[i:j] + n[i:j]
        base = int(low[0])
        change = np.zeros(int(high.max()) - base + 1, np.int64)
        np.add.at(change, low - base, 1)
        np.add.at(change, high - base, -1)
        inside = np.cumsum(change[:-1]) > 0
        place = np.concatenate([[0], np.cumsum(inside)])
        sums = np.zeros((int(place[-1]) + 1, BITS), np.int32)
        np.cumsum(shingle_bits(shingles[base : base + len(inside)][inside]), axis=0, dtype=np.int32, out=sums[1:])
        for k in range(0, j - i, 4096):
            out[i + k : min(i + k + 4096, j)] = np.packbits(sums[place[high[k : k + 4096] - base]] > sums[place[low[k : k + 4096] - base]], axis=-1)
        i = j
    return out


class Index:
    """The items' shingles, and for each size of item the fingerprints in blocks."""

    def __init__(self, ids: list, texts: list[str | None]):
        data, offs = flat(pa.array(texts, pa.string()))
        hashes, _, _, bounds = words(data, offs)
        sh, at = windows(hashes, bounds, SHINGLE)
        row = owner(bounds, at)
        size = np.bincount(row, minlength=len(ids)).astype(np.int64)
        kept = np.flatnonzero(size)
        self.ids, self.sizes = [ids[i] for i in kept.tolist()], size[kept]
        self.vocabulary, which = np.unique(sh, return_inverse=True)
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.vocabulary >> _U(42)).astype(np.int64)] = True
        v = max(1, len(self.vocabulary))
        #: item * len(vocabulary) + shingle, with its count in the item
        self.cells, self.counts = np.unique((np.cumsum(size > 0) - 1)[row] * v + which, return_counts=True)
        prints = fingerprints(sh, np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.kinds, kind = np.unique(self.sizes, return_inverse=True)
        order = np.argsort(kind, kind="stable")
        edge = np.searchsorted(kind[order], np.arange(len(self.kinds) + 1))
        self.own = [order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        self.prints = [np.ascontiguousarray(prints[x]).view(np.uint16) for x in self.own]
        #: sizes that have each shingle: shingle * number of sizes + size, ascending
        self.pairs = np.unique((self.cells % v) * max(1, len(self.kinds)) + kind[self.cells // v]) if len(self.cells) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.pairs, np.arange(v + 1) * max(1, len(self.kinds)))

    def needed(self, n: int | np.ndarray, item: int | np.ndarray) -> np.ndarray:
        """Shingles that a window of n shares with an item of the size given."""
        return np.ceil((n + item) * THRESHOLD / (1 + THRESHOLD) - 1e-9)

    def candidates(self, prints: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """All (fingerprint, item, distance) of items of one size within RADIUS, each found once; and how many were near in a block."""
        own, found, near_ones = self.prints[kind], [], 0
        step = max(1, LOT // len(own))
        for i in range(0, len(prints), step):
            some = np.ascontiguousarray(prints[i : i + step]).view(np.uint16)
            near = np.zeros((len(some), len(own)), bool)
            for b, limit in enumerate(LIMITS):
                near |= np.bitwise_count(some[:, b, None] ^ own[None, :, b]) <= limit
            who, item = np.nonzero(near)
            near_ones += len(who)
            far = np.bitwise_count(some[who] ^ own[item]).sum(axis=1, dtype=np.int64)
            ok = far <= RADIUS
            found.append((who[ok] + i, self.own[kind][item[ok]], far[ok]))
        return *(np.concatenate(x) for x in zip(*found, strict=True)), near_ones

    def similarity(self, shingle: np.ndarray, begin: np.ndarray, n: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of windows and items; shingle: numbers in the vocabulary, -1 for others."""
        out, v = np.zeros(len(begin)), len(self.vocabulary)
        ends = np.cumsum(n)
        i = 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 4 * LOT, side="right")))
            size = n[i:j]
            pair = np.repeat(np.arange(j - i), size)
            own = shingle[np.repeat(begin[i:j] - (np.cumsum(size) - size), size) + np.arange(len(pair))]
            pair, own = pair[own >= 0], own[own >= 0]
            cell, times = np.unique(pair * v + own, return_counts=True)
            pair, own = cell // v, cell % v
            key = item[i:j][pair] * v + own
            at = np.minimum(np.searchsorted(self.cells, key), len(self.cells) - 1)
            both = np.bincount(pair, np.where(self.cells[at] == key, np.minimum(times, self.counts[at]), 0), minlength=j - i)
            out[i:j] = both / (size + self.sizes[item[i:j]] - both)
            i = j
        return out

    def matches(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, float, int]]:
        """(text, item, first word, words, similarity, distance), the best window of each text and item."""
        if not self.ids:
            return []
        hashes, _, _, bounds = words(data, offs)
        sh, at = windows(hashes, bounds, SHINGLE)
        maybe = np.flatnonzero(self.bloom[(sh >> _U(42)).astype(np.int64)])
        where = np.minimum(np.searchsorted(self.vocabulary, sh[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[where] == sh[maybe]
        hit, where = maybe[same], where[same]
        shingle = np.full(len(sh), -1, np.int64)
        shingle[hit] = where
        # how many shingles of each text the items of each size have
        edge = np.searchsorted(at, bounds)
        n_own, n_kinds = np.diff(edge), len(self.kinds)
        n = self.first[where + 1] - self.first[where]
        kind = self.pairs[np.repeat(self.first[where] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] % n_kinds
        pair, n_hit = np.unique(np.repeat(owner(bounds, at[hit]), n) * n_kinds + kind, return_counts=True)
        text, kind = pair // n_kinds, pair % n_kinds
        keep = n_hit >= self.needed(np.minimum(n_own[text], self.kinds[kind]), self.kinds[kind])
        found = []  # windows: first shingle, number of shingles, size of items
        for t, k in zip(text[keep].tolist(), kind[keep].tolist(), strict=True):
            low, high, size = int(edge[t]), int(edge[t + 1]), int(self.kinds[k])
            if high - low <= size:
                found.append((np.array([low]), np.array([high - low]), np.array([k])))
                continue
            own = shingle[low:high]
            key = own * n_kinds + k
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hits = np.concatenate([[0], np.cumsum((own >= 0) & (self.pairs[place] == key))])
            begin = np.flatnonzero(hits[size:] - hits[:-size] >= self.needed(size, size)) + low
            found.append((begin, np.full(len(begin), size), np.full(len(begin), k)))
        if not found:
            return []
        begin, n, kind = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(begin, kind="stable")
        begin, n, kind = begin[order], n[order], kind[order]
        prints = fingerprints(sh, begin, n)
        some = []
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            who, item, far, _ = self.candidates(prints[own], k)
            some.append((own[who], item, far))
        who, item, far = (np.concatenate(x) for x in zip(*some, strict=True)) if some else (np.zeros(0, np.int64),) * 3
        sim = self.similarity(shingle, begin[who], n[who], item)
        ok = sim >= THRESHOLD
        who, item, far, sim = who[ok], item[ok], far[ok], sim[ok]
        text = owner(bounds, at[begin[who]])
        order = np.lexsort((begin[who], -sim, item, text))
        text, item, who, sim, far = text[order], item[order], who[order], sim[order], far[order]
        best = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])) if len(text) else np.zeros(0, np.int64)
        first = at[begin[who]] - bounds[text]
        return [(int(text[i]), int(item[i]), int(first[i]), int(n[who[i]]) + SHINGLE - 1, float(sim[i]), int(far[i])) for i in best]


def _indexes(benchmark: DataFrame, item_id: str, text: str, a_pass: int) -> list[Index]:
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("t is not null")
    parts = max(1, -(-(items.agg(F.sum(F.char_length("t"))).first()[0] or 0) // a_pass))
    out = []
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).orderBy("i", "t").toArrow()
        out.append(Index(rows["i"].to_pylist(), rows["t"].to_pylist()))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", a_pass: int = CHARS_A_PASS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity, distance) of every leaked item."""
    kinds = dict(docs.dtypes)[doc_id], dict(benchmark.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, first_word int, n_words int, similarity double, distance int"
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)
    out = None
    for index in _indexes(benchmark, item_id, item_text, a_pass):
        spark_index = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=spark_index) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch, data, offs in slices(batches, "text"):
                if found := own.matches(data, offs):
                    row, item, first, n, sim, far = (list(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([own.ids[i] for i in item], item_type), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(sim), pa.array(far, pa.int32())], ["doc_id", "item_id", "first_word", "n_words", "similarity", "distance"])

        part = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", a_pass: int = CHARS_A_PASS) -> DataFrame:
    """docs without the documents that hold a leaked item; a narrow pass, all columns kept."""
    for index in _indexes(benchmark, item_id, item_text, a_pass):
        spark_index = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=spark_index) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch, data, offs in slices(batches, text):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in own.matches(data, offs)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
