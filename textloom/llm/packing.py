"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention is masked to the document, so a
sequence costs the sum over its pieces). Pieces, longest first, go to the sequence of lowest cost
that still has room; the number of sequences is the least that could hold all tokens, and one more is opened when a piece fits nowhere.

The greedy rule is global, and it is followed exactly without passing over the pieces: pieces have at most `capacity` different lengths, so plan() needs only
how many there are of each. Sequences that have taken the same lengths are alike; a step gives one piece each to a whole range of them. Ranges only ever split at
a length's last piece, so there are no more of them than lengths, and the driver's work doesn't grow with the documents. Pieces are sorted by length on the executors, and each finds its
step by its place in the order. Only ids and lengths are shuffled, and no group of pieces is gathered in one task.

Defined results: tokens are whitespace-separated words unless a column with counts is named. A
document longer than a sequence is cut into pieces of the full length and a rest. Missing and empty
texts, and missing or negative counts, make one piece of 0 tokens. Ties go to the lower doc_id (missing ids first), then
the earlier piece, then the sequence opened first. Repeated rows are packed as often as they occur. An empty table makes no pieces. Columns other than the id and the
text or count play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.session import cut

CAPACITY, LINEAR, QUADRATIC = 8192, 1.0, 1.0 / 2048


def place(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each piece, one after another; lengths must descend. plan() gives the same by ranges."""
    n_open = max(1, -(-int(lengths.sum()) // capacity))
    cost, room = np.zeros(n_open), np.full(n_open, capacity, dtype=np.int64)
    out = np.empty(len(lengths), dtype=np.int64)
    for i, n in enumerate(lengths):
        fits = np.where(room >= n, cost, np.inf)
        k = int(fits.argmin())
        if fits[k] == np.inf:
            k = len(cost)
            cost, room = np.append(cost, 0.0), np.append(room, capacity)
        out[i] = k
        cost[k] += linear * n + quadratic * n * n
        room[k] -= n
    return out


def plan(lengths: list[int], counts: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place() of counts pieces of each of the descending lengths: for each step its first piece, its first sequence, and how many successive pieces go to one sequence."""
    n_open = max(1, -(-sum(n * c for n, c in zip(lengths, counts, strict=True)) // capacity))
    ready: list[tuple[float, int, int, int]] = [(0.0, 0, n_open, capacity)]  # cost, first sequence, sequences, room: those with room for the length at hand
    waiting: dict[int, list[tuple[float, int, int]]] = {}  # by room: those that have room for shorter pieces only
    rooms: list[int] = []  # of waiting, as a heap of their negatives
    first, seq, each, at, last = [], [], [], 0, n_open

    def put(cost: float, low: int, n: int, room: int, length: int) -> None:
        if room >= length:
            heappush(ready, (cost, low, n, room))
        elif room >= 0:
            if room not in waiting:
                waiting[room] = []
                heappush(rooms, -room)
            waiting[room].append((cost, low, n))

    for length, count in zip(lengths, counts, strict=True):
        while rooms and -rooms[0] >= length:
            room = -heappop(rooms)
            for cost, low, n in waiting.pop(room):
                heappush(ready, (cost, low, n, room))
        own = linear * length + quadratic * length * length
        while count:
            first.append(at)
            if not ready:  # a new sequence takes as many as it can
                fit = capacity // length
                full, rest = divmod(count, fit)
                seq.append(last)
                each.append(fit)
                for n, k in ((full, fit), (1, rest)):
                    if n and k:
                        cost = 0.0
                        for _ in range(k):
                            cost += own
                        put(cost, last, n, capacity - k * length, length)
                        last += n
                at, count = at + count, 0
                continue
            cost, low, n, room = heappop(ready)
            seq.append(low)
            if not own:  # pieces that cost nothing stay together while there is room
                take = min(count, room // length) if length else count
                each.append(take)
                put(cost, low, 1, room - take * length, length)
                if n > 1:
                    heappush(ready, (cost, low + 1, n - 1, room))
                at, count = at + take, count - take
                continue
            each.append(1)
            take = min(n, count)
            put(cost + own, low, take, room - length, length)
            if take < n:
                heappush(ready, (cost, low + take, n - take, room))
            at, count = at + take, count - take
    return np.array(first, np.int64), np.array(seq, np.int64), np.array(each, np.int64)


def lengths(docs: DataFrame, text: str = "text", tokens: str | None = None, doc_id: str = "doc_id") -> DataFrame:
    if tokens:
        n = F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0))
    else:
        squeezed = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
        n = F.when(squeezed == "", 0).otherwise(F.char_length(squeezed) - F.char_length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1)
    return docs.select(F.col(doc_id).alias("doc_id"), n.cast("long").alias("n"))


def pack(docs: DataFrame, text: str = "text", tokens: str | None = None, doc_id: str = "doc_id", capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, seq_id, cost), one row for each piece."""
    sized = lengths(docs, text, tokens, doc_id)
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / capacity).cast("long"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("n_tokens"))
    # in order, and numbered within partitions; what is cut keeps its partitions
    ordered = cut(cut(pieces).orderBy(F.desc("n_tokens"), F.asc_nulls_first("doc_id"), "piece").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part"), "n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict()
    total: dict[int, int] = {}
    n_parts: dict[int, int] = {}
    for p, length, n in zip(sizes["part"], sizes["n_tokens"], sizes["n"], strict=True):
        total[length] = total.get(length, 0) + n
        n_parts[p] = n_parts.get(p, 0) + n
    descending = sorted(total, reverse=True)
    before = np.zeros(max(n_parts, default=0) + 1, np.int64)
    for p, n in n_parts.items():
        before[p] = n
    before = np.cumsum(before) - before
    shared = docs.sparkSession.sparkContext.broadcast((before, *plan(descending, [total[n] for n in descending], capacity, linear, quadratic)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, seq, each = shared.value
        for batch in batches:
            at, n, piece = (batch.column(c).to_numpy() for c in ("at", "n_tokens", "piece"))
            at = before[at >> 33] + (at & ((1 << 33) - 1))
            step = np.searchsorted(first, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("piece"), pa.array(piece * capacity), batch.column("n_tokens"), pa.array(seq[step] + (at - first[step]) // each[step]), pa.array(linear * n + quadratic * n * n)], ["doc_id", "piece", "first_token", "n_tokens", "seq_id", "cost"])

    kind = dict(sized.dtypes)["doc_id"]
    return ordered.mapInArrow(run, f"doc_id {kind}, piece long, first_token long, n_tokens long, seq_id long, cost double")
