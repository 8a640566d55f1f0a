"""Token counts of a unigram tokenizer by Viterbi, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces; dynamic programming carries the best score and its number of pieces from character to
character. Rules, those of sentencepiece's unigram model: a space counts as a mark, and a text begins with one more; the higher sum of scores wins, then the longer
last piece. A character that is no piece may stand as unknown, 10 below the lowest score. If the vocabulary has byte pieces, it counts as
its UTF-8 bytes; if not, successive unknown characters count as one.

No piece holds a mark behind another character, a line feed or a tab, so texts are cut before each run of spaces and around line feeds and tabs, and each
distinct part of a worker's texts is segmented once. Parts go through automaton and table side by side, a character of all of them at a time.

The vocabulary is read from a sentencepiece model: its ordinary pieces in rank order, scored by Zipf's law (minus the logarithm of
the rank), as no unigram model is at hand; counts differ from those of the model's own merges.

Defined results: missing and empty texts have 0 tokens and score 0. Repeated rows, and rows without id, are counted each. Long texts are counted whole.
Columns other than the id and the text play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow_text import flat, mix, slices
from textloom.llm.spans_cache import HashTable, SpanCache

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Characters of a part up to which it is segmented beside others, and of the parts handled at once.
SHORT, LOT = 64, 2_000_000
_U = np.uint64


def vocabulary(path: str = TOKENIZER) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of the ordinary pieces, and whether there are byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    own.sort(key=lambda i: (-model.get_score(i), i))
    return [(model.id_to_piece(i), -float(np.log(rank))) for rank, i in enumerate(own, 1)], any(model.is_byte(i) for i in range(model.get_piece_size()))


def _edge(state: np.ndarray, char: np.ndarray) -> np.ndarray:
    """The key of a transition."""
    return np.maximum(mix((state.astype(np.uint64) << _U(21)) + char.astype(np.uint64) + _U(1)), _U(1))


class Segmenter:
    """The automaton as arrays: transitions in a hash table; for each state its failure link and the longest piece that ends there (0 if none);
    for each such state the next shorter piece."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool = True):
        if any(MARK in p.lstrip(MARK) or "\n" in p or "\t" in p for p, _ in pieces):
            raise ValueError("a piece goes on beyond a mark, a line feed or a tab")
        self.byte_pieces, self.unknown = byte_pieces, min(s for _, s in pieces) - UNKNOWN_PENALTY
        child: list[dict[str, int]] = [{}]
        ends: list[tuple[int, int, float]] = []
        for piece, score in pieces:
            state = 0
            for char in piece:
                to = child[state].get(char)
                if to is None:
                    to = child[state][char] = len(child)
                    child.append({})
                state = to
            ends.append((state, len(piece), score))
        n = len(child)
        self.size, self.score = np.zeros(n, np.int64), np.zeros(n)
        for state, size, score in ends:
            self.size[state], self.score[state] = size, score
        fail, longest, shorter, layer = [0] * n, [0] * n, [0] * n, [0]
        while layer:  # shallower states first
            below = []
            for state in layer:
                for char, to in child[state].items():
                    link = fail[state] if state else None
                    while link is not None and char not in child[link]:
                        link = fail[link] if link else None
                    fail[to] = 0 if link is None else child[link][char]
                    shorter[to] = longest[fail[to]]
                    longest[to] = to if self.size[to] else shorter[to]
                    below.append(to)
            layer = below
        self.fail, self.longest, self.shorter = (np.array(x, np.int32) for x in (fail, longest, shorter))
        self.edges = HashTable()
        state, char, to = (np.array(x, np.int64) for x in zip(*((i, ord(c), t) for i, own in enumerate(child) for c, t in own.items()), strict=True))
        self.edges.add(_edge(state, char), to.astype(np.int32))

    def best(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of pieces of each part, marks included."""
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(n) - n
        score, count = np.zeros(len(parts)), np.zeros(len(parts), np.int64)
        order = np.argsort(-n, kind="stable")
        at = 0
        while at < len(order):
            longest = int(n[order[at]])
            some = order[at : at + max(1, LOT // max(longest, SHORT))]
            if longest > SHORT:  # not beside much shorter ones
                some = some[n[some] > longest // 2]
            score[some], count[some] = self._lot(chars, start[some], n[some])
            at += len(some)
        return score, count

    def _lot(self, chars: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """best() of parts whose lengths descend."""
        lanes, longest = len(n), int(n[0]) if len(n) else 0
        best, count = np.zeros((longest + 1, lanes)), np.zeros((longest + 1, lanes), np.int64)
        state, unknown_before = np.zeros(lanes, np.int32), np.zeros(lanes, bool)
        live = np.searchsorted(-n, -np.arange(longest), side="left")
        for j in range(longest):
            m = int(live[j])
            c = chars.take(start[:m] + j)
            now = state[:m].copy()
            to = self.edges.find(_edge(now, c))
            open_ = np.flatnonzero((to < 0) & (now > 0))
            while len(open_):
                now[open_] = self.fail.take(now[open_])
                to[open_] = self.edges.find(_edge(now[open_], c[open_]))
                open_ = open_[(to[open_] < 0) & (now[open_] > 0)]
            state[:m] = now = np.maximum(to, 0)
            top, pieces, single = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, bool)
            lane = np.flatnonzero(self.longest.take(now))
            piece = self.longest.take(now.take(lane))
            while len(lane):  # from longer to shorter pieces
                size = self.size.take(piece)
                from_ = (j + 1 - size) * lanes + lane
                value = best.ravel().take(from_) + self.score.take(piece)
                better = value > top.take(lane)
                won = lane[better]
                top[won], pieces[won] = value[better], count.ravel().take(from_[better]) + 1
                single[lane[size == 1]] = True
                piece = self.shorter.take(piece)
                lane, piece = lane[piece > 0], piece[piece > 0]
            alone = best[j, :m] + self.unknown
            unknown = ~single & (alone > top)
            best[j + 1, :m] = np.where(unknown, alone, top)
            own = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) if self.byte_pieces else ~unknown_before[:m]
            count[j + 1, :m] = np.where(unknown, count[j, :m] + own, pieces)
            unknown_before[:m] = unknown
        at = n * lanes + np.arange(lanes)
        return best.ravel().take(at), count.ravel().take(at)


def parts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with a space before each text that isn't empty and a space for each mark, the parts' starts and ends there, and their texts."""
    raw = data.tobytes()
    if MARK.encode() in raw:
        data, offs = flat(pa.array([raw[a:b].decode().replace(MARK, " ") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.string()))
    full = offs[:-1][np.diff(offs) > 0]
    data = np.insert(data, full, 32)
    n = len(data)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = full + np.arange(len(full))
    space, cut = data == 32, (data == 10) | (data == 9)
    begins = cut.copy()
    begins[1:] |= (space[1:] & ~space[:-1]) | cut[:-1]
    begins[first] = True
    starts = np.flatnonzero(begins)
    return data, starts, np.append(starts[1:], n), np.flatnonzero(np.diff(offs) > 0)[np.searchsorted(first, starts, side="right") - 1]


@lru_cache(1)
def _cache(path: str) -> SpanCache:
    segmenter = Segmenter(*vocabulary(path))

    def scores(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = segmenter.best([x.decode().replace(" ", MARK) for x in spans])
        return np.stack(found, axis=1).ravel(), np.full(len(spans), 2, np.int64)

    return SpanCache(scores, np.float64)


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer)
        for batch, data, offs in slices(batches, "text"):
            data, starts, ends, row = parts(data, offs)
            found = cache.look_up(data, starts, ends)[0].reshape(-1, 2)
            n = np.bincount(row, found[:, 1], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.bincount(row, found[:, 0], minlength=batch.num_rows).astype(np.float64))], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens long, score double")
