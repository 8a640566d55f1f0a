"""Documents packed into rows and, in blocks, into files of the shared folder, so that pairs of documents are worked on without being shuffled.

A packed document is one row: (doc_id, terms, values), its terms as 64-bit hashes. A block is an Arrow file that holds some thousand
documents turned round, by term. Workers map it into memory, so every task can go over all blocks while the disk holds each document once.
The shared folder must be one that pyarrow.fs opens; what is written stays there, as checkpoints do, unless it is deleted.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.session import shared_folder

#: Documents and entries of a block, at most (a document of more entries is a block of its own).
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 4_000_000
#: Weights of one file.
WEIGHTS_A_FILE = 1_000_000
#: Documents whose entries make one batch of rows.
LONG_DOCS = 1000
#: Files that a worker keeps open.
OPEN_FILES = 64


@dataclass
class Packed:
    """Packed documents; finish: what a worker does to a batch of them before anything else."""

    table: DataFrame
    finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None

    @property
    def id_type(self) -> str:
        return self.table.schema["doc_id"].dataType.simpleString()

    @property
    def arrow_type(self) -> pa.DataType:
        return to_arrow_type(self.table.schema["doc_id"].dataType)


def pack(features: DataFrame, docs: DataFrame) -> Packed:
    """From (doc_id, term, value) and the documents, of which some may have no terms."""
    own = features.groupBy("doc_id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("value").cast("double").alias("v"))).alias("e"))
    listed = docs.select("doc_id").distinct().join(own, "doc_id", "left")
    return Packed(listed.select("doc_id", F.coalesce("e.t", F.array().cast("array<bigint>")).alias("terms"), F.coalesce("e.v", F.array().cast("array<double>")).alias("values")))


# Files


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)


def save(table: pa.Table, folder: str) -> str:
    """The new file's path. Its name is new as well, so that an attempt that is repeated doesn't write to what another reads."""
    path = f"{folder}/{uuid4().hex}.arrow"
    system, inner = _opened(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return path


def load(path: str) -> pa.Table:
    """Mapped into memory where the file is a local one."""
    system, inner = _opened(path)
    source = pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)
    return pa.ipc.open_file(source).read_all()


def delete(folder: str) -> None:
    system, inner = _opened(folder)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)


_files: OrderedDict[str, pa.Table] = OrderedDict()


def _kept(path: str) -> pa.Table:
    """load() of a file that this worker is likely to have open."""
    if path not in _files:
        if len(_files) >= OPEN_FILES:
            _files.popitem(last=False)
        _files[path] = load(path)
    _files.move_to_end(path)
    return _files[path]


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)


# Weights, for documents that are packed without a join


def save_weights(weights: DataFrame) -> list[tuple[int, str]]:
    """(term, weight) as files of hashes in order, each a range of them: (least hash, path), in order."""
    folder = new_folder(weights.sparkSession, "weights")
    n = max(1, -(-weights.count() // WEIGHTS_A_FILE))
    part = F.shiftright((F.shiftright("h", 32) + F.lit(2**31).cast("bigint")) * F.lit(n).cast("bigint"), 32)

    def write(table: pa.Table) -> pa.Table:
        table = table.select(["h", "w"]).sort_by("h")
        return pa.table({"low": table["h"][:1], "path": [save(table, folder)]})

    own = weights.select(F.xxhash64("term").alias("h"), F.col("weight").cast("double").alias("w")).withColumn("part", part)
    return sorted((r.low, r.path) for r in own.groupBy("part").applyInArrow(write, "low long, path string").collect())


def weights_of(terms: np.ndarray, files: list[tuple[int, str]]) -> np.ndarray:
    """Weights of hashes; NaN for those that are unknown."""
    known, at = np.unique(terms, return_inverse=True)
    found = np.full(len(known), np.nan)
    bounds = [0, *np.searchsorted(known, [low for low, _ in files[1:]]), len(known)]
    for (_, path), a, b in zip(files, bounds[:-1], bounds[1:], strict=True):
        if b > a:
            table = _kept(path)
            h, w = _numbers(table["h"]), _numbers(table["w"])
            place = np.minimum(np.searchsorted(h, known[a:b]), len(h) - 1)
            found[a:b] = np.where(h[place] == known[a:b], w[place], np.nan)
    return found[at]


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the document, term and value of every entry, by document."""
    terms, values = batch.column("terms"), batch.column("values")
    return np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)), _numbers(terms.flatten()), _numbers(values.flatten())


def batch_of(ids: pa.Array, doc: np.ndarray, terms: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))]).astype(np.int32))
    return pa.record_batch({"doc_id": ids, "terms": pa.ListArray.from_arrays(ends, pa.array(terms)), "values": pa.ListArray.from_arrays(ends, pa.array(values))})


def sizes(norm: str, doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """What the values of each of n documents are divided by, see maps.norm_size()."""
    if norm == "max":
        most = np.zeros(n)
        np.maximum.at(most, doc, np.abs(values))
        return most
    if norm == "length":
        return np.sqrt(np.bincount(doc, values * values, minlength=n))
    total, count = np.bincount(doc, values, minlength=n), np.maximum(np.bincount(doc, minlength=n), 1)
    if norm == "std":
        gap = values - (total / count)[doc]
        return np.sqrt(np.bincount(doc, gap * gap, minlength=n) / count)
    return total if norm == "sum" else total / count


def _weigh(batch: pa.RecordBatch, files: list[tuple[int, str]], renorm: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the entries that have weights, their documents, terms, and values times weights over their norm."""
    doc, terms, values = entries(batch)
    weight = weights_of(terms, files) if files else np.full(len(terms), np.nan)
    known = np.flatnonzero(~np.isnan(weight))
    doc, terms, values = doc[known], terms[known], values[known] * weight[known]
    if renorm == "binary":
        values = np.ones(len(values))
    elif renorm:
        size = sizes(renorm, doc, values, batch.num_rows)
        values = values / np.where(size != 0, size, 1.0)[doc]
    return known, doc, terms, values


def weighted(files: list[tuple[int, str]], renorm: str | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """A finish of Packed: values times weights, without terms that have none, over their norm."""
    return lambda batch: batch_of(batch.column("doc_id"), *_weigh(batch, files, renorm)[1:])


def weighted_long(files: list[tuple[int, str]], renorm: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """weighted(), to a row (doc_id, term, value) for each entry; the batches also hold the terms' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LONG_DOCS):
                part = batch.slice(at, LONG_DOCS)
                known, doc, _, values = _weigh(part, files, renorm)
                yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(doc)), "term": part.column("names").flatten().take(pa.array(known)), "value": values})

    return run


# Blocks


class Block:
    """Documents by term: terms, sorted; first, where each begins in doc and value; doc counts from 0, in the order of ids."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, first: np.ndarray, doc: np.ndarray, value: np.ndarray):
        self.ids, self.terms, self.first, self.doc, self.value = ids, terms, first.astype(np.int64), doc, value
        self.df = np.diff(first)

    @staticmethod
    def of(ids: np.ndarray, doc: np.ndarray, terms: np.ndarray, value: np.ndarray) -> Block:
        order = np.argsort(terms, kind="stable")
        terms, doc, value = terms[order], doc[order].astype(np.uint16 if len(ids) <= 2**16 else np.int32), value[order]
        starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
        return Block(ids, terms[starts], np.append(starts, len(terms)).astype(np.int32 if len(terms) < 2**31 else np.int64), doc, value)

    @staticmethod
    def read(path: str) -> Block:
        row = load(path)
        part = lambda name: _numbers(row[name].combine_chunks().flatten())
        return Block(part("ids"), part("terms"), part("first"), part("doc"), part("value"))

    def scaled(self) -> Block:
        """Every document at length 1."""
        size = sizes("length", self.doc, self.value, len(self.ids))
        return Block(self.ids, self.terms, self.first, self.doc, self.value / np.where(size > 0, size, 1.0)[self.doc])

    def by_doc(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bounds, place of the term, value): the entries by document."""
        order = np.argsort(self.doc, kind="stable")
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.df)
        return np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=len(self.ids)))]), term[order], self.value[order]

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each of some terms is among the block's; -1 for none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)


def _written(ids: list[pa.Array], parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], folder: str) -> tuple[str, int]:
    """A file of one row of lists, and its number of documents."""
    name, before = pa.concat_arrays(ids), np.cumsum([0, *(len(i) for i in ids)])
    block = Block.of(np.empty(len(name)), np.concatenate([d + n for (d, _, _), n in zip(parts, before[:-1], strict=True)]), np.concatenate([t for _, t, _ in parts]), np.concatenate([v for _, _, v in parts]))
    one = lambda x: pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x)
    return save(pa.table({"ids": one(name), **{c: one(pa.array(getattr(block, c))) for c in ("terms", "first", "doc", "value")}}), folder), len(name)


def write_blocks(packed: Packed, folder: str, docs: int = BLOCK_DOCS, most: int = BLOCK_ENTRIES) -> list[tuple[str, int]]:
    """(path, documents) of blocks that hold the packed documents; the driver gets no more than these."""
    finish = packed.finish or (lambda batch: batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n, size = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal n, size
            path, count = _written(ids, parts, folder)
            ids.clear(), parts.clear()
            n = size = 0
            return pa.record_batch({"path": [path], "n": pa.array([count], pa.int64())})

        for batch in map(finish, batches):
            at = 0
            while at < batch.num_rows:
                each = batch.slice(at, docs - n)
                ends = np.cumsum(pc.list_value_length(each.column("terms")).to_numpy(zero_copy_only=False))
                fits = int(np.searchsorted(ends, most - size, side="right"))
                if fits == 0 and n:
                    yield flush()
                    continue
                each = each.slice(0, max(1, fits))
                ids.append(each.column("doc_id"))
                parts.append(entries(each))
                n, size, at = n + each.num_rows, size + len(parts[-1][0]), at + each.num_rows
                if n >= docs or size >= most:
                    yield flush()
        if n:
            yield flush()

    return [(r.path, r.n) for r in packed.table.mapInArrow(run, "path string, n long").collect()]
