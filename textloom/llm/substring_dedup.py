"""Repeated passages, by compaction of a token De Bruijn graph.

Edges are the runs of K words (K is the shortest passage looked for), from the node of their first K - 1 words to that of their last.

1. Every edge of every document goes to the bucket of its hash, packed in binary with its coordinate (document, word). A
   bucket finds the edges that occur more than once, and for each occurrence but the first its source (the first occurrence; in the first one's own document,
   the occurrence before it) and the number of occurrences.
2. Back at its document, a run of successive edges whose sources are successive and whose multiplicity is the same is a nonbranching path:
   it is one row from here on. A node where multiplicity changes is a branch.
3. Paths are joined with the path that ends where they begin, in the document and in the source; chains of these are passages. Passages of one document, source and shift that overlap are one.
   Where other passages of the document lie between two of them (an edge that a third document holds earlier has its source there), the words between are a gap.
4. Source coordinates are verified: a digest of the words at both ends is compared, of passages and of gaps, so that equal hashes alone report nothing. Passages join over
   verified gaps, so that a repeat is one row whatever else holds parts of it, and passages within longer ones of their document go.

Packed edges take some 8 bytes in the shuffle, and no list of pairs is ever made: a passage in n documents makes n - 1 rows. The number of buckets
follows the size of the text; many buckets share a partition, and beyond COARSE bits edges are first gathered by the leading bits of their hash, so that packed edges stay many to a payload.
Verification reads the texts again; its requests are broadcast if there are few, else joined.

Defined results: case and punctuation don't count. Missing, empty and short texts repeat nothing; rows without id are left out. Ids may be of any type that sorts. A passage that a document itself holds
earlier is reported with that document as source; it may overlap its source. Repeated rows of one id and text count once. Of different texts under one id, passages that fail verification are not
reported. Very long texts are searched whole. Other columns play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.arrow_text import _WORD, fold, mix, slices, windows, words
from textloom.llm.session import cut, quoted

K = 50
#: Bytes of text packed at a time, edges a bucket should get, and spans and gaps up to which verification broadcasts its requests.
PACKED_BYTES, BUCKET_EDGES, BROADCAST_SPANS = 3_000_000, 2_000_000, 200_000
#: Bits of the hash up to which one shuffle makes the buckets, partitions at most, and edges dealt to finer buckets at a time.
COARSE, PARTITIONS, DEALT = 12, 1 << 16, 4_000_000
#: Bytes of the hash that a packed edge keeps beside its bucket; what is equal by chance fails verification.
REST = 5
_U = np.uint64


def pack_ints(values: np.ndarray) -> bytes:
    """Integers, differences zigzagged to the narrowest type, compressed; the first 5 bytes hold width and count."""
    v = np.diff(values.astype(np.int64), prepend=0)
    z = ((v << 1) ^ (v >> 63)).view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if not len(z) or int(z.max()) < 1 << (8 * w - (w == 8)) or w == 8)
    planes = z.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    body = zstandard.ZstdCompressor(level=1).compress(planes)
    return bytes([width]) + len(z).to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def unpack_ints(data: bytes, at: int) -> tuple[np.ndarray, int]:
    width, n, size = data[at], int.from_bytes(data[at + 1 : at + 5], "little"), int.from_bytes(data[at + 5 : at + 9], "little")
    planes = zstandard.ZstdDecompressor().decompress(data[at + 9 : at + 9 + size], max_output_size=max(1, n * width)) if n else b""
    z = np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").ravel().astype(np.uint64)
    v = (z >> _U(1)).view(np.int64) ^ -(z & _U(1)).view(np.int64)
    return np.cumsum(v), at + 9 + size


def unpack_columns(data: bytes, n: int) -> tuple[list[np.ndarray], int]:
    out, at = [], 0
    for _ in range(n):
        column, at = unpack_ints(data, at)
        out.append(column)
    return out, at


def _dealt(bucket: np.ndarray, ids: np.ndarray, pos: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
    """(bucket, payload) of edges: ids, how many edges of each, positions, and REST bytes of each edge's hash."""
    order = np.argsort(bucket, kind="stable")
    bucket, ids, pos, rest = (x[order] for x in (bucket, ids, pos, rest))
    edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        new = np.concatenate([[0], np.flatnonzero(ids[a + 1 : b] != ids[a : b - 1]) + 1, [b - a]])
        out.append(pack_ints(ids[a:b][new[:-1]]) + pack_ints(np.diff(new)) + pack_ints(pos[a:b]) + rest[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :REST].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int64)), pa.array(out, pa.binary())], ["bucket", "payload"])


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, position and rest of the hash of each edge."""
    (ids, n, pos), at = unpack_columns(payload, 3)
    rest = np.zeros((len(pos), 8), np.uint8)
    rest[:, :REST] = np.frombuffer(payload, np.uint8, offset=at).reshape(-1, REST)
    return np.repeat(ids, n), pos, rest.view("<u8").ravel()


def _edges(batches: Iterator[pa.RecordBatch], bits: int, k: int) -> Iterator[pa.RecordBatch]:
    """(bucket, payload): coordinates and the rest of the hash of each edge."""
    for batch, data, offs in slices(batches, "text", PACKED_BYTES):
        hashes, _, _, bounds = words(data, offs)
        h, at = windows(hashes, bounds, k)
        if len(h):
            text = np.searchsorted(bounds, at, side="right") - 1
            yield _dealt((h >> _U(64 - bits)).astype(np.uint16), batch.column(0).to_numpy()[text], at - bounds[text], (h << _U(bits)) >> _U(64 - 8 * REST))


def _finer(batches: Iterator[pa.RecordBatch], coarse: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Edges of coarse buckets dealt to those of all bits."""

    def flush() -> pa.RecordBatch:
        bucket, ids, pos, rest = (np.concatenate(x) for x in zip(*kept, strict=True))
        return _dealt((bucket << (bits - coarse)) | (rest >> _U(8 * REST - bits + coarse)).astype(np.int64), ids, pos, rest)

    kept: list[tuple] = []
    for batch in batches:
        for key, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids, pos, rest = _unpacked(payload.as_py())
            kept.append((np.full(len(ids), key, np.int64), ids, pos, rest))
            if sum(len(x[1]) for x in kept) >= DEALT:
                yield flush()
                kept = []
    if kept:
        yield flush()


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The payloads of each key; rows come sorted by key."""
    now, kept = None, []
    for batch in batches:
        for key, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if key != now and kept:
                yield kept
                kept = []
            now = key
            kept.append(payload.as_py())
    if kept:
        yield kept


def _repeated(batches: Iterator[pa.RecordBatch], homes: int) -> Iterator[pa.RecordBatch]:
    """(home, payload): occurrences of repeated edges with their source and multiplicity, packed by the home of their document."""
    for payloads in _by_key(batches):
        doc, pos, h = (np.concatenate(x) for x in zip(*map(_unpacked, payloads), strict=True))
        pos = pos.astype(np.int32)
        del payloads
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        own = order[again]
        doc, pos, h = doc[own], pos[own], h[own]
        if not len(h):
            continue
        order = np.lexsort((pos, doc, h))
        doc, pos, h = doc[order], pos[order], h[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])
        doc, pos, h = doc[new], pos[new], h[new]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.append(begin, len(h)))
        src, src_pos, times = np.repeat(doc[begin], n), np.repeat(pos[begin], n), np.repeat(n, n)
        same = doc == src
        again = np.flatnonzero(same)
        src_pos[again] = pos[again - 1]  # of the edge's last occurrence before; the first one's is dropped below
        use = ~same
        use[again] = True
        use[begin] = False
        home = (mix(doc[use].view(np.uint64)) % _U(homes)).astype(np.int64)
        order = np.lexsort((pos[use], doc[use], home))
        home, columns = home[order], [x[use][order] for x in (doc, pos, src, src_pos.astype(np.int64) - pos, times)]
        edge = np.concatenate([[0], np.flatnonzero(home[1:] != home[:-1]) + 1, [len(home)]]) if len(home) else np.zeros(1, np.int64)
        out = [b"".join(pack_ints(x[a:b]) for x in columns) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(home[edge[:-1]] if len(home) else home), pa.array(out, pa.binary())], ["home", "payload"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of successive edges with successive sources and one multiplicity."""
    for payloads in _by_key(batches):
        doc, pos, src, shift, times = (np.concatenate(x) for x in zip(*(unpack_columns(p, 5)[0] for p in payloads), strict=True))
        order = np.lexsort((src, pos, doc))
        doc, pos, src, shift, times = (x[order] for x in (doc, pos, src, shift, times))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (shift[1:] != shift[:-1]) | (times[1:] != times[:-1])])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(pos)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[at], pos[at], pos[last] + 1, src[at], shift[at])], ["doc_id", "first", "beyond", "source", "shift"])


def _chains(paths: DataFrame, k: int) -> DataFrame:
    """(doc_id, first, beyond, source, shift) of passages, in words: paths joined with the one that ends where they begin."""
    before = paths.select("doc_id", "source", "shift", F.col("beyond").alias("first"), F.lit(True).alias("joined"))
    linked = paths.join(before, ["doc_id", "source", "shift", "first"], "left")
    chain = F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(Window.partitionBy("doc_id", "source", "shift").orderBy("first"))
    spans = linked.withColumn("chain", chain).groupBy("doc_id", "source", "shift", "chain").agg(F.min("first").alias("first"), F.max("beyond").alias("beyond"))
    return spans.select("doc_id", "first", (F.col("beyond") + (k - 1)).alias("beyond"), "source", "shift")


def _joined(spans: DataFrame, flag: str | None = None) -> DataFrame:
    """Spans of one document, source and shift that overlap or touch as one; with a flag, only those that hold one with the flag."""
    order = Window.partitionBy("doc_id", "source", "shift").orderBy("first", "beyond")
    reach = F.max("beyond").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("starts", F.when(F.col("first") <= reach, 0).otherwise(1))
    whole = starts.withColumn("part", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "source", "shift", "part")
    found = whole.agg(F.min("first").alias("first"), F.max("beyond").alias("beyond"), *([F.max(flag).alias(flag)] if flag else []))
    return (found.filter(flag) if flag else found).select("doc_id", "first", "beyond", "source", "shift")


def _gaps(spans: DataFrame) -> DataFrame:
    """The words between successive spans of one document, source and shift where spans of the document cover all that lies between."""
    order = Window.partitionBy("doc_id").orderBy("first", "beyond")
    reach = F.max("beyond").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("starts", F.when(F.col("first") <= reach, 0).otherwise(1))
    islands = starts.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("beyond").over(Window.partitionBy("doc_id", "source", "shift", "island").orderBy("first"))
    return islands.withColumn("before", before).filter("before is not null").select("doc_id", F.col("before").alias("first"), F.col("first").alias("beyond"), "source", "shift")


def _maximal(spans: DataFrame) -> DataFrame:
    """Spans that lie in no other one of their document."""
    order = Window.partitionBy("doc_id").orderBy("first", F.desc("beyond"), "source", "shift")
    reach = F.max("beyond").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("reach", reach).filter("reach is null or beyond > reach").drop("reach")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, first, n, digest) of the words at each span asked for; spans beyond the text have none."""
    for batch, data, offs in slices(batches, "text"):
        _, starts, ends, bounds = words(data, offs)
        use = _WORD[data]
        gap = ends[ends < len(data)]
        gap = gap[~use[gap]]
        clean = fold(data)
        clean[gap] = 32
        use[gap] = True
        place = np.concatenate([[0], np.cumsum(use)])
        clean = clean[use].tobytes()
        out = []
        for i, (key, asked) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            for x in asked:
                a, b = int(bounds[i]) + x["first"], int(bounds[i]) + x["first"] + x["n"]
                if b <= bounds[i + 1]:
                    out.append((key, x["first"], x["n"], hashlib.blake2b(clean[place[starts[a]] : place[ends[b - 1]]], digest_size=16).digest()))
        if out:
            key, first, n, digest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], ["id", "first", "n", "digest"])


def _verified(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans (and their other columns) whose words are those of their source."""
    n, there = (F.col("beyond") - F.col("first")).alias("n"), (F.col("first") + F.col("shift")).alias("there")
    ends = spans.select("doc_id", "first", n).union(spans.select("source", there, n)).toDF("id", "first", "n")
    asked = ends.distinct().groupBy("id").agg(F.collect_list(F.struct("first", "n")).alias("asked"))
    if spans.count() <= BROADCAST_SPANS:
        asked = F.broadcast(asked)
    found = cut(docs.join(asked, "id").select("id", "text", "asked").mapInArrow(_digests, "id long, first long, n long, digest binary").distinct())
    both = spans.select("*", n, there)
    return both.join(found.toDF("doc_id", "first", "n", "digest"), ["doc_id", "first", "n"]).join(found.toDF("source", "there", "n", "digest"), ["source", "there", "n", "digest"]).select(*spans.columns)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(doc_id, first_word, n_words, source_doc_id, source_first_word): passages of at least k words that an earlier document, or the document itself, holds before."""
    rows = docs.filter(F.col(quoted(doc_id)).isNotNull()).select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text"))
    kind, names = dict(rows.dtypes)["id"], None
    if kind in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumn("id", F.col("id").cast("long"))
    else:  # numbered in their order
        names = cut(rows.select("id").distinct().orderBy("id").withColumn("number", F.monotonically_increasing_id()))
        rows = rows.join(names, "id").select(F.col("number").alias("id"), "text")
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, chars / 6 / BUCKET_EDGES)))))
    coarse, parts = min(bits, COARSE), min(1 << bits, PARTITIONS)
    edges = rows.mapInArrow(lambda b: _edges(b, coarse, k), "bucket long, payload binary")
    if bits > coarse:
        edges = edges.repartition(1 << coarse, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _finer(b, coarse, bits), "bucket long, payload binary")
    repeated = edges.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _repeated(b, 1 << bits), "home long, payload binary")
    paths = repeated.repartition(parts, "home").sortWithinPartitions("home").mapInArrow(_paths, "doc_id long, first long, beyond long, source long, shift long")
    spans = cut(_joined(_chains(cut(paths), k)))
    asked = cut(spans.withColumn("whole", F.lit(True)).union(_gaps(spans).withColumn("whole", F.lit(False))))
    found = _maximal(_joined(_verified(asked, rows).distinct(), "whole")).select("doc_id", F.col("first").alias("first_word"), (F.col("beyond") - F.col("first")).alias("n_words"), F.col("source").alias("source_doc_id"), (F.col("first") + F.col("shift")).alias("source_first_word"))
    if names is not None:
        for column in ("doc_id", "source_doc_id"):
            found = found.withColumnRenamed(column, "number").join(names.withColumnRenamed("id", column), "number").drop("number")
    elif kind != "bigint":
        found = found.withColumns({c: F.col(c).cast(kind) for c in ("doc_id", "source_doc_id")})
    return found.select("doc_id", "first_word", "n_words", "source_doc_id", "source_first_word")
