"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is a multiset of 3-word shingles, each weighted by its count. Every shingle is a Poisson
process of arrivals whose rate is its weight; each arrival falls on one of SIZE slots, and a slot keeps the
shingle that arrives first. A process stops once its next arrival is later than every slot's first.
Two signatures agree in a slot with the probability Jaccard similarity of the documents.

1. Documents with the same words in the same order (by a 64-bit hash of them and their number) are one class, so that thousands of copies are one row.
2. Classes are banded. Of buckets with equal members (by their number, lowest member and a hash of all) one stays. A bucket of more than BLOCK classes is dealt to blocks, and
   every two blocks are a bucket: no task holds more than 2 * BLOCK classes, and every two classes still meet.
3. Buckets are split where signatures agree in less than SKIP, far below THRESHOLD, and buckets equal after that are one again.
4. Members of what is left are joined with their weighted shingles, and a breadth-first search links pairs whose exact probability Jaccard similarity is at least THRESHOLD;
   that links the same components as all pairs would, without making the pairs.
5. Components over all buckets are the groups. Copies are members by their class; they are no edges.

A pair is missed only if no band agrees (by binomial odds some 10 % of pairs at THRESHOLD, 4 % at 0.6, 0.2 % at 0.7) or if its signatures agree in
less than SKIP (at THRESHOLD less than 1 in 100,000); no pair below THRESHOLD is linked.

Defined results: rows are decided one by one, by id and text; ids may be of any type that sorts. Case and punctuation don't count. A text without words, or a missing one, has no duplicates, and so
has a row without id; these stay. A text of fewer than 3 words is one shingle. Very long texts are compared whole. Of each group the row of the lowest id stays (of several with that id, the one of the lowest
hash of its words, then the least text); so texts under one id that are no near copies all stay, and rows repeated in id and text are one. Other columns play no part, whatever their names, and
are kept; of rows repeated in id and text, those of any one stay. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow_text import inverse, mix, owner, powers, slices, windows, words
from textloom.llm.components import components
from textloom.llm.session import cut, quoted, unused

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 24, 4, 0.55
#: Agreement of signatures below which a pair is not compared.
SKIP = 0.3
SIZE = BANDS * ROWS
#: Classes of a block of a large bucket.
BLOCK = 4096
_U = np.uint64
_STEP, _R = 0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F | 1


def weighted_shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle of each text."""
    sh, at = windows(hashes, bounds, k)
    row = owner(bounds, at)
    n = np.diff(bounds)
    for short in np.flatnonzero((n > 0) & (n < k)):
        whole, _ = windows(hashes[bounds[short] : bounds[short + 1]], np.array([0, n[short]]), int(n[short]))
        sh, row = np.append(sh, whole), np.append(row, short)
    if not len(sh):
        return row, sh, np.zeros(0, np.int64)
    key = sh ^ mix(row.astype(np.uint64) + _U(1))
    order = np.argsort(key)
    new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    first = order[new]
    return row[first], sh[first], np.diff(np.append(new, len(order)))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, size: int = SIZE) -> np.ndarray:
    """The element that arrives first in each slot, by text; 0 for texts without elements."""
    first = np.full(n_texts * size, np.inf)
    won = np.zeros(n_texts * size, np.uint64)
    time, r = np.zeros(len(row)), 0
    last = np.full(n_texts, np.inf)
    while len(row):
        x = mix(element + _U(r * _STEP % 2**64))
        time = time - np.log(((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        live = time < last[row]
        row, element, weight, time, x = row[live], element[live], weight[live], time[live], x[live]
        slot = row * size + (mix(x ^ _U(0x5851F42D4C957F2D)) % _U(size)).astype(np.int64)
        np.minimum.at(first, slot, time)
        wins = time == first[slot]
        won[slot[wins]] = element[wins]
        which = np.unique(row)
        last[which] = first.reshape(n_texts, size)[which].max(axis=1)
        r += 1
    return won.reshape(n_texts, size)


def digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of all words of each text in their order."""
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_R, len(hashes)), out=prefix[1:])
    return mix((prefix[bounds[1:]] - prefix[bounds[:-1]]) * powers(inverse(_R), len(hashes) + 1)[bounds[:-1]])


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of the sorted shingles a with counts x and b with counts y."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = a[at] == b
    x_both, y_both = x[at[both]], y[both]
    ratio = y_both / x_both
    order = np.argsort(ratio)
    ratio, x_both, y_both = ratio[order], x_both[order], y_both[order]
    # sum of max(x/x_i, y/y_i): shingles up to the ratio of i count by x, those beyond by y
    upto = np.searchsorted(ratio, ratio, side="right")
    below = x.sum() - x_both.sum() + np.concatenate([[0], np.cumsum(x_both)])[upto]
    above = y.sum() - np.concatenate([[0], np.cumsum(y_both)])[upto]
    return float((1 / (below / x_both + above / y_both)).sum())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in slices(batches, "text"):
        hashes, _, _, bounds = words(data, offs)
        n_words = np.diff(bounds)
        sig = signatures(*weighted_shingles(hashes, bounds), batch.num_rows)
        digest = digests(hashes, bounds)
        parts = mix(sig).reshape(-1, BANDS, ROWS)
        band = np.zeros(parts.shape[:2], np.uint64)
        for i in range(ROWS):
            band = mix(band * _U(3) + parts[:, :, i])
        band = mix(band + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(_STEP))
        has = pa.array(n_words > 0)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(digest.view(np.int64)),
                pa.array(n_words.astype(np.int64)),
                pa.array([x.tobytes() for x in (mix(sig) >> _U(56)).astype(np.uint8)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(band) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band.view(np.int64).ravel())),
            ],
            ["id", "t", "digest", "n", "sig", "bands"],
        ).filter(has)


def similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return ((one == others).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def links(sig: np.ndarray, threshold: float = THRESHOLD, verify: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Tree edges of the components that all pairs above the threshold, and verified, would make."""
    out, rest = [], np.arange(1, len(sig))
    frontier = [0]
    while len(rest):
        if not frontier:
            frontier, rest = [int(rest[0])], rest[1:]
            continue
        i = frontier.pop()
        near = similarity(sig[i], sig[rest]) >= threshold
        if verify:
            near[near] = [verify(i, int(j)) for j in rest[near]]
        out += [(i, int(j)) for j in rest[near]]
        frontier += rest[near].tolist()
        rest = rest[~near]
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows with whole buckets, and where each bucket begins (one more than buckets); they come sorted by bucket."""

    def table(kept: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(kept)
        bucket = rows.column(0).to_numpy()
        return rows, np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            bucket = batch.column(0).to_numpy()
            cut_at = int(np.searchsorted(bucket, bucket[-1]))
            if cut_at:
                yield table([*kept, batch.slice(0, cut_at)])
                kept = []
            elif kept and kept[-1].column(0)[-1].as_py() != bucket[0]:
                yield table(kept)
                kept = []
            kept.append(batch.slice(cut_at))
    if kept:
        yield table(kept)


def _sigs(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, SIZE)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id) of the parts of buckets (bucket, id, sig) that signatures hold together; the new bucket is a hash of its ids."""
    for rows, edge in _whole(batches):
        ids, sig = rows.column("id").to_numpy(), _sigs(rows)
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        two = two[((sig[two] == sig[two + 1]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= SKIP]
        parts = [ids[i : i + 2] for i in two.tolist()]
        for i, n in zip(edge[:-1].tolist(), size.tolist(), strict=True):
            if n > 2:
                part = np.arange(n)
                for a, b in links(sig[i : i + n], SKIP):
                    part[b] = part[a]
                order = np.argsort(part, kind="stable")
                new = np.flatnonzero(np.diff(part[order])) + 1
                parts += [ids[i + x] for x in np.split(order, new) if len(x) > 1]
        parts = [x for x in map(np.unique, parts) if len(x) > 1]
        if parts:
            key = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(key, np.int64), [len(x) for x in parts])), pa.array(np.concatenate(parts))], ["bucket", "id"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, sig, shingles, counts) of the texts (id, text, sig, buckets), once a bucket; no counts if all are 1."""
    for batch, data, offs in slices(batches, "text"):
        hashes, _, _, bounds = words(data, offs)
        row, sh, n = weighted_shingles(hashes, bounds)
        order = np.lexsort((sh, row))
        row, sh, n = row[order], sh[order], n[order].astype(np.uint32)
        edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
        many = np.concatenate([[0], np.cumsum(n > 1)])
        for at in np.array_split(np.arange(batch.num_rows), max(1, batch.num_rows // 500)):
            buckets = batch.column(3).take(pa.array(at))
            who = np.repeat(at, buckets.value_lengths().to_numpy())
            packed = {i: (sh[edge[i] : edge[i + 1]].tobytes(), n[edge[i] : edge[i + 1]].tobytes() if many[edge[i + 1]] > many[edge[i]] else b"") for i in at.tolist()}
            own = pa.array(who)
            yield pa.RecordBatch.from_arrays(
                [buckets.flatten(), batch.column(0).take(own), batch.column(2).take(own), pa.array([packed[i][0] for i in who.tolist()], pa.binary()), pa.array([packed[i][1] for i in who.tolist()], pa.binary())],
                ["bucket", "id", "sig", "shingles", "counts"],
            )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within the buckets of rows (bucket, id, sig, shingles, counts)."""
    for rows, edge in _whole(batches):
        ids, sig = rows.column("id").to_numpy(), _sigs(rows)
        sh = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        n = [np.frombuffer(x, np.uint32).astype(np.float64) if x else np.ones(len(y)) for x, y in zip(rows.column("counts").to_pylist(), sh, strict=True)]
        found = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            near = lambda a, b, i=i: probability_jaccard(sh[i + a], n[i + a], sh[i + b], n[i + b]) >= THRESHOLD - 1e-9
            found += [(i + a, i + b) for a, b in links(sig[i:j], SKIP, near)]
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])


def _groups(docs: DataFrame, doc_id: str, text: str, block: int) -> DataFrame:
    """(id, t, root, kept) of every different row (id, t) whose text has words; t: a hash of the text. Groups are those of equal root, and one row of each is kept."""
    own = F.col(quoted(text))
    texts = docs.filter(F.col(quoted(doc_id)).isNotNull()).select(F.col(quoted(doc_id)).alias("id"), own.alias("text"), F.xxhash64(own).alias("t"))
    kind = dict(texts.dtypes)["id"]
    signed = cut(texts.mapInArrow(_sign, f"id {kind}, t long, digest long, n long, sig binary, bands array<long>"))
    # k: a class; its first row stands for it
    rep = F.min_by(F.struct("id", "t", "sig", "bands"), F.struct("id", "t")).alias("r")
    classes = cut(signed.groupBy("digest", "n").agg(rep).select(F.xxhash64("digest", "n").alias("k"), "digest", "n", "r.*"))
    bands = classes.select("k", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("k")).alias("all"), F.min("k").alias("low")).filter("size > 1")
    buckets = shared.groupBy("size", "all", "low").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("size") / block).alias("blocks"))
    members = bands.join(buckets, "band").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("own"))
    small = members.filter("blocks = 1").select(F.col("band").alias("bucket"), "k")
    large = members.filter("blocks > 1").withColumn("j", F.explode(others)).select(F.xxhash64("band", F.least("own", "j"), F.greatest("own", "j")).alias("bucket"), "k")
    rows = small.union(large).join(classes.select("k", "sig"), "k").select("bucket", F.col("k").alias("id"), "sig")
    parts = rows.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_split, "bucket long, id long")
    asked = parts.distinct().groupBy("id").agg(F.collect_list("bucket").alias("buckets")).withColumnRenamed("id", "k").join(classes.select("k", "id", "t", "sig"), "k")
    found = texts.join(cut(asked), ["id", "t"]).select(F.col("k").alias("id"), "text", "sig", "buckets")
    shingles = found.mapInArrow(_shingles, "bucket long, id long, sig binary, shingles binary, counts binary")
    near = shingles.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_search, "a long, b long")
    roots = components(near).withColumnRenamed("id", "k")
    own = cut(classes.select("k", "digest", "n", "id", "t").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k")))
    first = own.groupBy("root").agg(F.min(F.struct("id", "digest", "n", "t")).alias("first"))
    rows = signed.select("id", "t", "digest", "n").distinct().join(own.select("digest", "n", "root"), ["digest", "n"]).join(first, "root")
    return rows.select("id", "t", "root", (F.struct("id", "digest", "n", "t") == F.col("first")).alias("kept"), F.col("first.id").alias("group_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, group_id, kept) of every document that has a near duplicate; group_id is the lowest id of the group. An id with different texts is listed for each."""
    rows = cut(_groups(docs, doc_id, text, block))
    groups = rows.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("root")
    return rows.join(groups, "root").select(F.col("id").alias("doc_id"), "group_id", "kept")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with one row of each group."""
    name, name_t = unused(docs.columns, "gone", "gone_text")
    rows = cut(_groups(docs, doc_id, text, block))
    one, own_id, own_t = docs, F.col(quoted(doc_id)), F.xxhash64(F.col(quoted(text)))
    gone = rows.filter("not kept").select(F.col("id").alias(name), F.col("t").alias(name_t))
    one = docs.join(gone, (own_id == F.col(name)) & (own_t == F.col(name_t)), "left_anti")
    again = docs.filter(own_id.isNotNull()).groupBy(own_id.alias(name), own_t.alias(name_t)).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    again = cut(again.join(rows.filter("kept").select(F.col("id").alias(name), F.col("t").alias(name_t)), [name, name_t]).select(name, name_t))
    if again.isEmpty():
        return one
    same = (own_id == F.col(name)) & (own_t == F.col(name_t))
    return one.join(again, same, "left_anti").unionByName(one.join(again, same, "left_semi").dropDuplicates([doc_id, text]))
