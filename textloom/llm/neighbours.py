"""Approximate nearest neighbours by multi-index hashing of learned binary codes, of a stated set of queries among all rows.

1. Codes: vectors are scaled to length 1, centred, turned to their principal axes (of which MOST_BITS at most are used) and rotated so that the signs lose least (the
   rotation alternates between codes and an orthogonal fit). Fitted on the SAMPLE_BYTES of vectors whose ids have the lowest hashes; every row is indexed.
2. Index: a code is cut into substrings of 8 bits, and each substring has an inverted list from its value to the codes that have it.
3. Search: by the pigeonhole principle two codes within t * substrings + substrings - 1 bits are within t bits in some substring, so
   probing the lists of all values that near retrieves every code of that radius. All of them are reranked by their floats. Where the lists to be probed hold more codes than
   there are, the distances of all codes are counted instead, which retrieves the same.
4. Radius: a query widens t until a neighbour better than its k-th best so far would lie beyond the radius with a probability
   of at most MISS. The probability follows from the angle: each bit differs with probability angle / pi.

Rows are dealt to blocks of bounded size, each with its index, and so are queries; every block of queries searches every block of rows (with one query in 50 rows, a row is
shuffled once as long as there are fewer than 50 blocks), a window merges the k best of each query, and no row is made for a pair. Queries with near neighbours stop after few lists. Queries
without them need wide radii whatever the index, so the work on them is that of all queries times all rows.

Defined results: vectors that are missing, of length 0, with missing or non-finite parts, or not of the commonest dimension (ties: the lower) are neither queries nor
neighbours, and so are rows without id. Ids may be of any type that sorts. Of repeated rows of one id the least vector counts. Equal similarities rank by id.
A query has fewer than k neighbours only if there are fewer other vectors. Similarity is the cosine. Very long vectors are compared whole. An empty table, or no queries, gives no rows. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.session import cut, quoted

K, MISS, STEPS, SEED = 10, 0.03, 8, 11
#: Rows and bytes of vectors of a block, bytes of the vectors fitted on, and bits of a code.
BLOCK, BLOCK_BYTES, SAMPLE_BYTES, MOST_BITS = 16_384, 32_000_000, 64_000_000, 256
#: Queries searched at a time.
LOT = 128


def unit(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, of length 1."""
    x = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Coder:
    """Centre and rotation; codes are the signs, padded with zeros to whole bytes."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray):
        self.mean, self.rotation = mean, rotation

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def fit(x: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Coder:
    """From vectors of length 1."""
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh((x.T @ x) / len(x) - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :MOST_BITS]
    y = (x - mean) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))
    for _ in range(steps):
        u, _, w = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
        turn = (u @ w).T
    return Coder(mean, axes @ turn)


def radius_needed(similarity: np.ndarray, bits: int, miss: float = MISS) -> np.ndarray:
    """The radius beyond which a vector of this similarity lies with a probability of at most miss."""
    p = np.clip(np.arccos(np.linspace(-1, 1, 2001)) / np.pi, 1e-300, 1 - 1e-16)
    i = np.arange(bits + 1)[:, None]
    ways = np.array([lgamma(bits + 1) - lgamma(k + 1) - lgamma(bits - k + 1) for k in range(bits + 1)])[:, None]
    beyond = 1 - np.cumsum(np.exp(ways + i * np.log(p) + (bits - i) * np.log1p(-p)), axis=0)
    table = (beyond > miss).sum(axis=0)
    at = np.clip(np.floor((np.nan_to_num(similarity, neginf=-1) + 1) * 1000), 0, 2000).astype(int)
    return np.minimum(table[at], bits)


def probes(t: int) -> np.ndarray:
    """What a substring is XORed with to reach all values within t bits."""
    return np.array([sum(1 << b for b in c) for r in range(t + 1) for c in combinations(range(8), r)], np.uint8)


class Index:
    """Codes and vectors of one block, with the inverted lists of each substring. Items are numbered in the order of their ids."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, bits: int):
        self.vectors, self.codes, self.bits = vectors, codes, bits
        self.words = self._words(codes)
        self.lists = [np.argsort(codes[:, b], kind="stable") for b in range(codes.shape[1])]
        self.first = [np.searchsorted(codes[own, b], np.arange(257)) for b, own in enumerate(self.lists)]

    @staticmethod
    def _words(codes: np.ndarray) -> np.ndarray:
        """Codes as 64-bit words, padded with zeros."""
        return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))).view(np.uint64)

    def within(self, codes: np.ndarray, t: int) -> np.ndarray:
        """For each query code, which codes lie within t * substrings + substrings - 1 bits: all of them, and only those."""
        m, n = codes.shape[1], len(self.codes)
        if m * len(probes(t)) < 256:  # the lists probed hold fewer codes than there are
            found = np.zeros((len(codes), n), bool)
            for b in range(m):
                value = (codes[:, b, None] ^ probes(t)[None, :]).astype(np.int64)
                low, size = self.first[b][value], self.first[b][value + 1] - self.first[b][value]
                who = np.repeat(np.arange(len(codes)), size.sum(axis=1))
                low, size = low.ravel(), size.ravel()
                found[who, self.lists[b][np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]] = True
            who, item = np.nonzero(found)
            found[who, item] = np.bitwise_count(codes[who] ^ self.codes[item]).sum(axis=1) < (t + 1) * m
            return found
        own = self._words(codes)
        far = np.bitwise_count(own[:, 0, None] ^ self.words[None, :, 0]).astype(np.uint16)
        for b in range(1, own.shape[1]):
            far += np.bitwise_count(own[:, b, None] ^ self.words[None, :, b])
        return far < (t + 1) * m

    def search(self, itself: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, item and similarity of the k best of each query; itself: the query's own item, or -1."""
        out: list[tuple] = []
        open_, t, m = np.arange(len(itself)), 0, codes.shape[1]
        last = -(-self.bits // m)
        while len(open_) and len(self.codes):
            radius, still = (t + 1) * m - 1, []
            for i in range(0, len(open_), LOT):
                q = open_[i : i + LOT]
                found = self.within(codes[q], t)
                known = np.flatnonzero(itself[q] >= 0)
                found[known, itself[q][known]] = False
                if found.mean() < 0.02:
                    who, item = np.nonzero(found)
                    sims = np.full(found.shape, -np.inf)
                    sims[who, item] = np.einsum("ij,ij->i", vectors[q[who]], self.vectors[item])
                else:
                    sims = np.where(found, vectors[q] @ self.vectors.T, -np.inf)
                top = min(k, sims.shape[1])
                kth = -np.partition(-sims, top - 1, axis=1)[:, top - 1]
                done = np.ones(len(q), bool) if t >= last else np.isfinite(kth) & (radius >= radius_needed(kth, self.bits))
                who, item = np.nonzero((sims >= kth[:, None]) & np.isfinite(sims) & done[:, None])
                s = sims[who, item]
                order = np.lexsort((item, -s, who))
                who, item, s = who[order], item[order], s[order]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                use = rank < k
                out.append((q[who[use]], item[use], s[use]))
                still.append(q[~done])
            open_, t = np.concatenate(still), t + 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _clean(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    v = F.col(quoted(vector)).cast("array<double>")
    good = rows.filter(F.col(quoted(vec_id)).isNotNull()).select(F.col(quoted(vec_id)).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    size2 = F.aggregate(F.col("v"), F.lit(0.0), lambda a, x: a + x * x)
    good = good.filter((size2 > 0) & (size2 < float("inf")))
    first = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = first.d if first else 0
    return cut(good.filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))), dim


def nearest(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, queries: DataFrame | None = None, block: int = BLOCK, coder: Coder | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, similarity): the k nearest of every vector, or of those whose ids (vec_id) queries lists."""
    spark = rows.sparkSession
    clean, dim = _clean(rows, vec_id, vector)
    kind = dict(clean.dtypes)["id"]
    n = clean.count()
    asked = clean.select("id") if queries is None else clean.join(queries.select(F.col(quoted(vec_id)).alias("id")).distinct(), "id", "left_semi").select("id")
    n_asked = asked.count()
    if n < 2 or not n_asked:
        return spark.createDataFrame([], f"vec_id {kind}, rank int, neighbour_id {kind}, similarity double")
    if coder is None:
        some = clean.orderBy(F.xxhash64("id"), "id").limit(max(1000, SAMPLE_BYTES // (4 * dim))).select("v").toArrow().combine_chunks()
        coder = fit(unit(some.to_batches()[0]))
    shared, bits = spark.sparkContext.broadcast(coder), coder.rotation.shape[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary()), pa.array([c.tobytes() for c in shared.value.codes(x)], pa.binary())], ["id", "v", "c"])

    block = max(1, min(block, BLOCK_BYTES // (4 * dim)))
    n_a, n_b = (max(1, -(-x // block)) for x in (n_asked, n))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)) if count > 1 else F.array(F.lit(0)))
    dealt = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    own = cut(clean.mapInArrow(coded, f"id {kind}, v binary, c binary"))
    items = own.select("id", "v", "c", F.lit(False).alias("query"), every(n_a).alias("a"), dealt(n_b).alias("b"))
    wanted = own.join(asked, "id", "left_semi").select("id", "v", "c", F.lit(True).alias("query"), dealt(n_a).alias("a"), every(n_b).alias("b"))

    def pair(table: pa.Table) -> pa.Table:
        table = table.sort_by([("query", "ascending"), ("id", "ascending")]).combine_chunks()
        n_items = table.num_rows - int(pc.sum(table["query"]).as_py())
        v = np.frombuffer(b"".join(table["v"].to_pylist()), np.float32).reshape(table.num_rows, dim)
        c = np.frombuffer(b"".join(table["c"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        ids, asked_ids = table["id"].slice(0, n_items), table["id"].slice(n_items)
        itself = pc.fill_null(pc.index_in(asked_ids, value_set=ids.combine_chunks()), -1).to_numpy().astype(np.int64) if n_items else np.full(len(asked_ids), -1)
        q, item, s = Index(v[:n_items], c[:n_items], bits).search(itself, v[n_items:], c[n_items:], k)
        return pa.table({"vec_id": asked_ids.take(pa.array(q)), "neighbour_id": ids.take(pa.array(item)), "similarity": s.astype(np.float64)})

    found = wanted.union(items).groupBy("a", "b").applyInArrow(pair, f"vec_id {kind}, neighbour_id {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "similarity")
