"""Twenty similarities of sparse documents, and three of angles, of all pairs.

A similarity is a sum over shared terms, a sum over the terms only one document has, and a last step. Sums over exclusive terms
are a document's total less its shared part; where every term is shared they are exactly 0, so equal documents have distance 0.

The columns are written once, as blocks, which workers map into memory. The rows stream past them: neither features nor pairs are shuffled.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.operators.blocks import BLOCK_DOCS, BLOCK_ENTRIES, Block, Packed, entries, new_folder, pack, sizes, write_blocks

EPS = 2.220446049250313e-16
#: Shared terms added up, and pairs of documents held, at a time; documents and entries of a block, and rows, where a table of terms and documents is held as well.
LOT_ENTRIES, LOT_PAIRS, TABLE_DOCS, TABLE_ENTRIES, TABLE_ROWS = 200_000, 200_000, 256, 50_000, 128
#: Blocks of columns that a worker keeps.
KEPT_BLOCKS = 4


@dataclass(frozen=True)
class Sim:
    """shared(x, y): summed over shared terms; alone(v): over exclusive ones; last(sum, X, Y) with X and Y the documents' sums of values. All take and return arrays."""

    shared: Callable[[np.ndarray, np.ndarray], np.ndarray]
    last: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    alone: Callable[[np.ndarray], np.ndarray] | None = None
    zero_is_nan: bool = False


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, and 0 where b is 0."""
    a, b = np.broadcast_arrays(a, b)
    return np.divide(a, b, out=np.zeros(a.shape), where=b != 0)


def _inverse(d: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1.0 / (EPS + d)


def _xlog(v: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0.0, v * np.log(np.where(v == 0, 1.0, share(2 * v, total))))


def _square(d: np.ndarray) -> np.ndarray:
    return d * d


def _angle(s: np.ndarray) -> np.ndarray:
    return 2 * np.arccos(np.clip(s, 0.0, 1.0)) / np.pi


_sum = lambda a, x, y: a

SIMS: dict[str, Sim] = {
    "linear": Sim(np.multiply, _sum),
    "polynomial": Sim(np.multiply, lambda a, x, y: a * a),
    "sigmoidal": Sim(np.multiply, lambda a, x, y: np.tanh(a)),
    "histint": Sim(np.minimum, _sum),
    "gaussian": Sim(lambda x, y: _square(x - y), lambda d, x, y: np.exp(-0.25 * d), _square),
    "manhattan": Sim(lambda x, y: np.abs(x - y), _inverse, np.abs),
    "sqeucl": Sim(lambda x, y: _square(x - y), _inverse, _square),
    "minkowski": Sim(lambda x, y: np.abs(x - y) ** 3, _inverse, lambda v: v * v * v),
    "canberra": Sim(lambda x, y: share(np.abs(x - y), x + y), _inverse, lambda v: _square(np.sign(v)), True),
    "chisq": Sim(lambda x, y: share(_square(x - y), x + y), _inverse, lambda v: v, True),
    "hellinger": Sim(lambda x, y: _square(np.sqrt(x) - np.sqrt(y)), _inverse, lambda v: v),
    "jenshan": Sim(lambda x, y: _xlog(x, x + y) + _xlog(y, x + y), _inverse, lambda v: v * log(2)),
    "simpson": Sim(np.minimum, lambda a, x, y: share(a, np.minimum(x, y))),
    "braun": Sim(np.minimum, lambda a, x, y: share(a, np.maximum(x, y))),
    "kulczynski": Sim(np.minimum, lambda a, x, y: np.where((x != 0) & (y != 0), 0.5 * (share(a, x) + share(a, y)), 0.0)),
    "jaccard": Sim(np.minimum, lambda a, x, y: share(a, x + y - a)),
    "dice": Sim(np.minimum, lambda a, x, y: share(2 * a, x + y)),
    "otsuka": Sim(np.minimum, lambda a, x, y: share(a, np.sqrt(x) * np.sqrt(y))),
    "sokal": Sim(np.minimum, lambda a, x, y: share(a, 2 * x + 2 * y - 3 * a)),
}
#: The dot product of vectors scaled to length 1, and two forms of its angle.
ANGLES: dict[str, Sim] = {
    "cosine": Sim(np.multiply, _sum),
    "angularsim": Sim(np.multiply, lambda a, x, y: 1 - _angle(a)),
    "angulardist": Sim(np.multiply, lambda a, x, y: _angle(a)),
}
NAMES = (*SIMS, "chebyshev", *ANGLES)


class _Side:
    """Entries of n documents, by document for rows and by term for columns: numbers of terms and zeros, sums of values and of alone(value), similarities with themselves."""

    def __init__(self, n: int, doc: np.ndarray, value: np.ndarray, sim: str):
        spec = ANGLES.get(sim) or SIMS.get(sim)
        add = lambda w=None: np.bincount(doc, w, minlength=n)
        if sim in ANGLES:
            size = sizes("length", doc, value, n)
            value = value / np.where(size > 0, size, 1.0)[doc]
        self.doc, self.value, self.n, self.zeros, self.sum = doc, value, add(), add(value == 0), add(value).astype(np.float64)
        if spec is None:  # chebyshev
            self.own, self.none = np.ones(n), self.n == 0
            return
        self.alone = spec.alone(value) if spec.alone else None
        self.all = add(self.alone) if spec.alone else None
        d = add(spec.shared(value, value)).astype(np.float64)
        if sim in ANGLES:  # scaled to length 1 it is 1; summed it would be off by 1e-16, of which acos makes 1e-8
            d = np.where(d > 0, 1.0, d)
        self.own, self.none = spec.last(d, self.sum, self.sum), np.zeros(n, bool)
        if spec.zero_is_nan:
            self.own = np.where(self.zeros > 0, np.nan, self.own)


def _exclusive(most: np.ndarray, first: np.ndarray, value: np.ndarray, shared: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Raises most[i, j] to the largest value of document i that j doesn't share; first: bounds of the values by document, which fall; shared: whether j has the entry."""
    i, j = np.nonzero(np.ones(most.shape, bool))
    at = first[i]
    while len(i):
        on = at < first[i + 1]
        i, j, at = i[on], j[on], at[on]
        on = value[at] > most[i, j]
        i, j, at = i[on], j[on], at[on]
        on = shared(at, j)
        most[i[~on], j[~on]] = value[at[~on]]
        i, j, at = i[on], j[on], at[on] + 1


def _falling(n: int, doc: np.ndarray, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds by document, and its terms and sizes of values from the largest."""
    size = np.abs(value)
    order = np.lexsort((-size, doc))
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]), place[order], size[order]


class _Columns:
    """A block of columns and what every row needs of it."""

    def __init__(self, path: str, sim: str):
        self.block, self.sim = Block.read(path), sim
        b = self.block
        self.side, self.m = _Side(len(b.ids), b.doc.astype(np.int64), b.value, sim), len(b.ids)
        if sim == "chebyshev":
            self.place = np.repeat(np.arange(len(b.terms)), b.df)
            self.has = np.zeros((len(b.terms) + 1, self.m), bool)  # the last row: terms that no column has
            self.has[self.place, b.doc] = True
            self.falling = _falling(self.m, self.side.doc, self.place, b.value)

    def against(self, rows: _Side, place: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """(from, to, sims, which are NULL) of a range of rows and all columns; place: the block's place of each entry's term, or -1."""
        spec, own, m = ANGLES.get(self.sim) or SIMS.get(self.sim), self.side, self.m
        first = np.concatenate([[0], np.cumsum(rows.n)])
        used = np.flatnonzero(place >= 0)
        bounds, doc, value, term = np.searchsorted(used, first), rows.doc[used], rows.value[used], place[used]
        alone = rows.alone[used] if spec and spec.alone else None
        count, start = (self.block.df[term], self.block.first[term]) if len(term) else (np.zeros(0, np.int64),) * 2
        before = np.concatenate([[0], np.cumsum(count)])
        i, n, most = 0, len(rows.n), TABLE_ROWS if spec is None else max(1, LOT_PAIRS // m)
        while i < n:
            e = max(i + 1, min(n, i + most, int(np.searchsorted(before[bounds], before[bounds[i]] + LOT_ENTRIES, side="right")) - 1))
            lot = slice(bounds[i], bounds[e])
            c = count[lot]
            at = np.repeat(start[lot] - (before[lot] - before[bounds[i]]), c)
            at += np.arange(len(at))
            key = np.repeat((doc[lot] - i) * m, c)
            key += own.doc.take(at)
            x, y = np.repeat(value[lot], c), own.value.take(at)
            add = lambda w, key=key, size=(e - i, m): np.bincount(key, w, minlength=size[0] * size[1]).reshape(size)
            if spec is None:
                gap = np.zeros((e - i) * m)
                np.maximum.at(gap, key, np.abs(x - y))
                gap = gap.reshape(e - i, m)
                all_of = slice(first[i], first[e])
                bound, its, size = _falling(e - i, rows.doc[all_of] - i, place[all_of], rows.value[all_of])
                _exclusive(gap, bound, size, lambda at, j, its=its: self.has[its[at], j])
                held = np.zeros((e - i, len(self.has)), bool)
                held[doc[lot] - i, term[lot]] = True
                other = gap.T.copy()
                _exclusive(other, self.falling[0], self.falling[2], lambda at, j, held=held: held[j, self.falling[1][at]])
                yield i, e, 1 - other.T, rows.none[i:e, None] & own.none[None, :]
                i = e
                continue
            d = add(spec.shared(x, y)).astype(np.float64, copy=False)
            if spec.alone:
                both = add(None)
                d = d + np.where(rows.n[i:e, None] > both, rows.all[i:e, None] - add(np.repeat(alone[lot], c)), 0.0)
                d = d + np.where(own.n[None, :] > both, own.all[None, :] - add(own.alone.take(at)), 0.0)
            sims = spec.last(d, rows.sum[i:e, None], own.sum[None, :])
            if spec.zero_is_nan and (rows.zeros[i:e].any() or own.zeros.any()):
                zero = (add((x == 0) & (y == 0)) > 0) | (rows.zeros[i:e, None] > add(x == 0)) | (own.zeros[None, :] > add(y == 0))
                sims = np.where(zero, np.nan, sims)
            yield i, e, sims, None
            i = e


_columns: OrderedDict[tuple[str, str], _Columns] = OrderedDict()


def _columns_of(path: str, sim: str) -> _Columns:
    if (path, sim) not in _columns:
        while len(_columns) >= KEPT_BLOCKS:
            _columns.popitem(last=False)
        _columns[path, sim] = _Columns(path, sim)
    _columns.move_to_end((path, sim))
    return _columns[path, sim]


def _known(sim: str) -> None:
    if sim not in NAMES:
        raise ValueError(f"unknown similarity {sim!r}; known: {', '.join(NAMES)}")


def self_values(features: DataFrame, docs: DataFrame, sim: str) -> DataFrame:
    """(doc_id, own): the similarity of every document with itself."""
    _known(sim)
    packed = pack(features, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, _, values = entries(batch)
            side = _Side(batch.num_rows, doc, values, sim)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "own": pa.array(side.own, mask=side.none)})

    return packed.table.mapInArrow(run, f"doc_id {packed.id_type}, own double")


def cross_packed(rows: Packed, cols: Packed, sim: str = "linear", normalize: bool = False) -> DataFrame:
    """(row_id, col_id, sim) of every packed document of rows with every one of cols.

    normalize divides by the mean of the two documents' similarities with themselves.
    """
    _known(sim)
    docs, most = (TABLE_DOCS, TABLE_ENTRIES) if sim == "chebyshev" else (BLOCK_DOCS, BLOCK_ENTRIES)
    paths = [path for path, _ in write_blocks(cols, new_folder(cols.table.sparkSession, "blocks"), docs, most)]
    finish = rows.finish or (lambda batch: batch)
    col_type = cols.arrow_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(finish, batches):
            doc, terms, values = entries(batch)
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                side = _Side(batch.num_rows, doc, values, sim)
                for path in paths:
                    columns = _columns_of(path, sim)
                    names = pa.array(columns.block.ids, col_type)
                    for i, e, sims, none in columns.against(side, columns.block.places(terms)):
                        if normalize:
                            mean = (side.own[i:e, None] + columns.side.own[None, :]) / 2
                            none = side.none[i:e, None] | columns.side.none[None, :] | (mean == 0) | (False if none is None else none)
                            sims = sims / np.where(mean == 0, 1.0, mean)
                        yield pa.record_batch(
                            {
                                "row_id": batch.column("doc_id").take(pa.array(np.repeat(np.arange(i, e), columns.m))),
                                "col_id": names.take(pa.array(np.tile(np.arange(columns.m), e - i))),
                                "sim": pa.array(sims.ravel(), mask=None if none is None else none.ravel()),
                            }
                        )

    return rows.table.mapInArrow(run, f"row_id {rows.id_type}, col_id {cols.id_type}, sim double")


def cross_similarity(rows: DataFrame, row_docs: DataFrame, cols: DataFrame, col_docs: DataFrame, sim: str = "linear", normalize: bool = False) -> DataFrame:
    """cross_packed() of (doc_id, term, value) and the documents of each side."""
    _known(sim)
    return cross_packed(pack(rows, row_docs), pack(cols, col_docs), sim, normalize)


def self_similarity(features: DataFrame, docs: DataFrame, sim: str = "linear", normalize: bool = False) -> DataFrame:
    """(row_id, col_id, sim) of all ordered pairs, each document with itself included."""
    return cross_similarity(features, docs, features, docs, sim, normalize)
