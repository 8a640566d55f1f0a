"""Toxic documents, by noisy-channel deobfuscation and a lexicon learned from labels.

1. Language model: counts of 4-grams of letters within words over all documents, interpolated with shorter ones.
2. Channel: chunks that may be disguised (leetspeak, letters or syllables set apart, letters repeated) become
   lattices of what they may have been; Viterbi finds the path of highest model and channel probability.
3. Lexicon: from at most TRAIN_DOCS labelled documents (copies of a text count once), words and their beginnings of 6 to 8 bytes whose occurrences are in toxic
   documents more often than not, and RATIO times as often by words there, both by the lower bound of a Wilson interval, and in MIN_TOXIC toxic documents. No bound depends
   on a language's share of the labels.
   A word counts for its shortest beginning in the lexicon, so inflected forms of a rare language's stem add up.
4. Score: a toxic document holds a cue with a share p of such documents, and then at the rate r for each of its words; any other at the rate r0. A cue
   seen n times in a document of N words adds log(1 - p + p * (r / r0)^n * exp(-r N)), or nothing if that is below 0, so that a stray occurrence in a long text means little. The sum and the prior log-odds are
   the score; the document is toxic above THRESHOLD. Words that deobfuscation restores count as if they stood there.

What Viterbi looks at, when documents are scored, is every chunk, or run of chunks of up to two letters, where a cue may begin once symbols stand for letters, separators are gone and repeats are one
(both sides reduced alike, so no cue is lost by that), but for chunks with a plain cue. For training, when no cue is known, it is every chunk that looks disguised.

Only counts and the lexicon are shuffled; documents are scored where they are read.

Defined results: missing and empty texts are not toxic. Without labels of both kinds nothing is toxic. A document
labelled more than once, or copies with different labels, are toxic if any label says so; labels without id or value don't count. Repeated rows
score alike, and rows without id are scored too. Long texts are scored whole. Other columns pass through drop_toxic(), and play no part in find_toxic(), whatever their names.
Symbols stand for letters in ASCII and for the few signs beyond that are listed; of other letters Latin-1 ones lose their accents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow_text import _WORD, flat, fold, fold_text, runs, slices, span_hashes
from textloom.llm.session import cut

TRAIN_DOCS, THRESHOLD = 20_000, 0.0
#: Toxic documents that a cue occurs in, and how many times as often it does there, word for word.
MIN_TOXIC, RATIO = 3, 2.0
#: Occurrences added to those in toxic and in other documents, and the interval's width.
SMOOTH, SMOOTH_CLEAN, Z = 0.5, 2.0, 1.96
#: Bytes of the beginnings that may be cues; whole words may be, too.
STEMS = (6, 7, 8)
#: Interpolation weights of the orders 4 to 1 and of the uniform distribution.
ORDER_WEIGHTS = (0.55, 0.25, 0.12, 0.05, 0.03)
A = 27  # letters and the word boundary, 0

LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " \t\n\r.-_*~,'`^/\\:;="
#: Log-probabilities of the channel: a letter written as a symbol, repeated, doubled, set apart, or a symbol that stands for itself.
AS_SYMBOL, REPEATED, DOUBLED, APART, ITSELF = -1.0, -1.0, -2.0, -0.7, -3.0


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars if ord(c) < 128]] = True
    return out


_LETTER = _mask("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _mask("0123456789")
_SYMBOL = _mask("@$!|+(")
_SEPARATOR = _mask("._*-~,'`^/\\:;=")
_SPACE = _mask(" \t\n\r\x0b\x0c")
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)


def letter_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of (three letters before, letter), flattened; 0 is a word boundary and nothing before it counts."""
    text = np.insert(fold(data), offs, 0)
    c = _CODE[text]
    b = np.concatenate([[0], c[:-1]])
    a = np.where(b > 0, np.concatenate([[0, 0], c[:-2]])[: len(c)], 0)
    z = np.where(a > 0, np.concatenate([[0, 0, 0], c[:-3]])[: len(c)], 0)
    use = (c > 0) | (b > 0)
    return np.bincount((((z * A + a) * A + b) * A + c)[use], minlength=A**4)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities [context of three, letter], interpolated over orders 4 to 1."""
    c4 = counts.reshape(A, A, A, A).astype(np.float64)
    p = np.full((A, A, A, A), ORDER_WEIGHTS[4] / A)
    for weight, axes in zip(ORDER_WEIGHTS, ((), (0,), (0, 1), (0, 1, 2)), strict=False):
        c = c4.sum(axis=axes, keepdims=True) if axes else c4
        n = c.sum(axis=3, keepdims=True)
        p = p + weight * np.divide(c, n, out=np.full_like(c, 1 / A), where=n > 0)
    return np.log(p / p.sum(axis=3, keepdims=True)).reshape(A**3, A)


def _plain(char: str) -> str:
    return unicodedata.normalize("NFKD", char)[0]


def lattice(chunk: str) -> list[list[tuple[str, float]]]:
    """For each run of one character, what it may stand for ('' nothing, ' ' a word boundary) and the channel's log-probability."""
    text, out, i = fold_text(chunk), [], 0
    while i < len(text):
        char, j = text[i], i
        while j < len(text) and text[j] == char:
            j += 1
        n, i = j - i, j
        if char in LEET:
            out.append([(x * k, AS_SYMBOL * n + (0.0 if k == n else REPEATED if n > 2 else 3 * REPEATED)) for x in LEET[char] for k in range(1, min(n, 2) + 1)] + [(" ", ITSELF * n)])
        elif char in SEPARATORS:
            out.append([("", APART), (" ", APART)])
        elif "a" <= (x := _plain(char)) <= "z" and len(x) == 1:
            out.append([(x * k, 0.0 if k == n else DOUBLED if n == 2 else REPEATED) for k in range(1, min(n, 2) + 1)])
        else:
            out.append([(" ", 0.0)])
    return out


def decode(chunk: str, model: np.ndarray) -> list[str]:
    """The words of the best path through the chunk's lattice."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for options in [*lattice(chunk), [(" ", 0.0)]]:
        after: dict[int, tuple[float, tuple | None]] = {}
        for at, (score, path) in states.items():
            for letters, cost in options:
                now, total = at, score + cost
                for x in letters:
                    code = ord(x) - 96 if x != " " else 0
                    if code or now:
                        total += model[now, code]
                    now = (now * A + code) % A**3 if code else 0
                if now not in after or total > after[now][0]:
                    after[now] = (total, (path, letters))
        states = after
    path, parts = max(states.values(), key=lambda x: x[0])[1], []
    while path:
        parts.append(path[1])
        path = path[0]
    return "".join(reversed(parts)).split()


def disguised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks that may be disguised words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = fold(data)
    starts, ends = runs(~_SPACE[data], offs)
    letter, digit = _LETTER[data] | (data >= 128), _DIGIT[data]
    inner = np.ones(n + 1, bool)
    inner[offs] = False  # inner[i]: bytes i-1 and i are of one text
    after = np.concatenate([letter[1:] | digit[1:], [False]]) & inner[1:]
    before = np.concatenate([[False], letter[:-1]]) & inner[:-1]
    leet = (_SYMBOL[data] & after) | ((data == 36) | (data == 64)) & before | (digit & (before | (np.concatenate([letter[1:], [False]]) & inner[1:])))
    apart = _SEPARATOR[data] & after & (before | (np.concatenate([[False], digit[:-1]]) & inner[:-1]))
    thrice = np.zeros(n, bool)
    if n > 2:
        thrice[2:] = (text[2:] == text[1:-1]) & (text[2:] == text[:-2]) & _LETTER[data[2:]] & inner[2:n] & inner[1 : n - 1]
    per = lambda x: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(x)]))
    n_letter, n_apart = per(letter | leet), per(apart)
    odd = ((per(leet) > 0) & (per(letter) > 1)) | (per(thrice) > 0) | ((n_apart > 1) & (n_letter <= n_apart + 2))
    lone = (ends - starts == 1) & (letter | digit | _SYMBOL[data])[starts]
    first, last = runs(lone, np.searchsorted(starts, offs))
    far = last - first > 2
    return np.concatenate([starts[odd], starts[first[far]]]), np.concatenate([ends[odd], ends[last[far] - 1]])


#: Letters that symbols may stand for, as classes 1 to 26 (i and l are one, and so are b and g); 27 ends a word; 0 is left out.
_CLASS = np.full(256, 27, np.uint8)
for _c in SEPARATORS:
    _CLASS[ord(_c)] = 0
for _c in "abcdefghijklmnopqrstuvwxyz":
    _CLASS[ord(_c)] = ord({"l": "i", "b": "g"}.get(_c, _c)) - 96
for _c, _x in LEET.items():
    if ord(_c) < 128:
        _CLASS[ord(_c)] = _CLASS[ord(_x[0])]
#: The second byte of Latin-1 letters (after 0xC3), of signs after 0xC2, and the last one of the euro sign.
_LATIN = np.full(256, 27, np.uint8)
for _i in range(0x80, 0xC0):
    _x = unicodedata.normalize("NFKD", chr(0xC0 + _i - 0x80).lower())[0]
    _LATIN[_i] = _CLASS[ord(_x)] if "a" <= _x <= "z" else 27
MOST_CLASSES = 10


def classes(text: np.ndarray) -> np.ndarray:
    """The class of each byte of a folded text; bytes that only lead to another are left out."""
    out = _CLASS[text]
    wide = np.flatnonzero(text >= 0x80)
    if len(wide):
        lead = text[np.maximum(wide - 1, 0)]
        b = text[wide]
        own = np.where(lead == 0xC3, _LATIN[b], 27)
        own[(lead == 0xC2) & (b == 0xA3)] = _CLASS[ord("l")]
        own[(lead == 0xC2) & (b == 0xA1)] = _CLASS[ord("i")]
        own[(b == 0xC2) | (b == 0xC3) | (b == 0xE2)] = 0
        euro = wide[(b == 0xAC) & (lead == 0x82)]
        out[wide] = own
        out[euro], out[euro - 1] = _CLASS[ord("e")], 0
    return out


def skeleton(cue: bytes) -> int:
    """The first MOST_CLASSES classes of a cue, repeats as one, five bits each."""
    c = classes(fold(np.frombuffer(cue, np.uint8)))
    c = c[c > 0]
    c = c[np.concatenate([[True], c[1:] != c[:-1]])][:MOST_CLASSES] if len(c) else c
    out = 0
    for x in c.tolist():
        out = out << 5 | x
    return out


def suspects(data: np.ndarray, offs: np.ndarray, skeletons: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks, and of the runs of chunks of up to two letters, where one of the skeletons may begin."""
    starts, ends = runs(~_SPACE[data], offs)
    if not len(starts) or not len(skeletons):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = classes(fold(data))
    before = np.concatenate([[0], np.cumsum(c > 0)])
    size = before[ends] - before[starts]
    first, last = runs(size <= 2, np.searchsorted(starts, offs))
    first, last = first[last - first > 1], last[last - first > 1]
    place = np.flatnonzero(c > 0)
    kept = c[place]
    lengths = sorted({(int(x).bit_length() + 4) // 5 for x in skeletons})
    out = []
    for low, high in ((starts, ends), (starts[first], ends[last - 1])):
        group = np.zeros(len(data), np.int32)
        group[low] = 1
        group = np.cumsum(group, dtype=np.int32)[place]  # of bytes in a group: its number, from 1
        inside = before[high] - before[low]
        whole = np.zeros(len(place) + 1, np.int32)
        np.add.at(whole, before[low][inside > 0], 1)
        np.add.at(whole, before[high][inside > 0], -1)
        use = np.cumsum(whole[:-1]) > 0
        own, at, g = kept[use], place[use], group[use]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (g[1:] != g[:-1])
        # a cue begins where the byte before is no letter
        lead = ~(_LETTER[data] | (data >= 128))
        head = new & ((at == 0) | lead[np.maximum(at - 1, 0)] | np.concatenate([[True], g[1:] != g[:-1]]))
        own, g, head = own[new], g[new], np.flatnonzero(head[new])
        key, hit = np.zeros(len(head), np.int64), np.zeros(len(head), bool)
        alive = np.arange(len(head))
        for n in range(1, lengths[-1] + 1):
            i = head[alive] + n - 1
            ok = i < len(own)
            ok[ok] = g[i[ok]] == g[head[alive[ok]]]
            alive, i = alive[ok], i[ok]
            key[alive] = key[alive] << 5 | own[i]
            if n in lengths:
                hit[alive] |= np.isin(key[alive], skeletons)
        some = np.unique(g[head[hit]]) - 1
        out.append((low[some], high[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Restorer:
    """Decodes chunks that may be disguised; remembers the ones seen."""

    model: np.ndarray
    known: dict[bytes, list[str]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"model": self.model, "known": {}}

    def restored(self, data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """The text and the word of everything restored from the chunks."""
        row, found, raw = np.searchsorted(offs, starts, side="right") - 1, [], data.tobytes()
        for r, a, b in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True):
            chunk = raw[a:b]
            got = self.known.get(chunk)
            if got is None:
                if len(self.known) > 200_000:
                    self.known.clear()
                got = self.known[chunk] = decode(chunk.decode(), self.model)
            found += [(r, w) for w in got]
        return np.array([r for r, _ in found], np.int64), [w for _, w in found]


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and hashes: of their beginnings, shortest first, then of the whole words. data is folded."""
    n = ends - starts
    for k in STEMS:
        own = np.flatnonzero(n > k)
        yield own, span_hashes(data, starts[own], starts[own] + k)
    yield np.arange(len(starts)), span_hashes(data, starts, ends)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all words."""
    starts, ends = runs(_WORD[data], offs)
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


@dataclass
class Model:
    """cue: sorted hashes; ratio: log of r / r0, rate: r, share: p of each; skeletons: those of the cues, sorted."""

    restorer: Restorer
    cue: np.ndarray
    ratio: np.ndarray
    rate: np.ndarray
    share: np.ndarray
    prior: float
    skeletons: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.cue >> np.uint64(48)).astype(np.int64)] = True

    def cues(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cue of each word, -1 for none."""
        out = np.full(len(starts), -1, np.int64)
        for word, h in features(data, starts, ends):
            some = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.cue, h[some]), len(self.cue) - 1)
            some, at = some[self.cue[at] == h[some]], at[self.cue[at] == h[some]]
            free = out[word[some]] < 0
            out[word[some[free]]] = at[free]
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of cues and number of those that had to be restored, by text."""
        n, none = len(offs) - 1, np.zeros(len(offs) - 1, np.int64)
        if not len(self.cue):
            return np.full(n, self.prior), none, none
        starts, ends, row = word_spans(data, offs)
        n_words = np.bincount(row, minlength=n)
        cue = self.cues(fold(data), starts, ends)
        plain = np.flatnonzero(cue >= 0)
        low, high = suspects(data, offs, self.skeletons)
        seen = np.searchsorted(starts[plain], low) < np.searchsorted(starts[plain], high)
        back, restored = self.restorer.restored(data, offs, low[~seen], high[~seen])
        row, cue = row[plain], cue[plain]
        if restored:
            own, own_offs = flat(pa.array(restored, pa.string()))
            more = self.cues(fold(own), own_offs[:-1], own_offs[1:])
            row, cue = np.concatenate([row, back[more >= 0]]), np.concatenate([cue, more[more >= 0]])
        key, first, times = np.unique(row * len(self.cue) + cue, return_index=True, return_counts=True)
        row, cue = key // len(self.cue), key % len(self.cue)
        told = np.log(np.maximum(1 - self.share[cue] + self.share[cue] * np.exp(np.minimum(times * self.ratio[cue] - self.rate[cue] * n_words[row], 50)), 1))
        return self.prior + np.bincount(row, told, minlength=n), np.bincount(row, minlength=n), np.bincount(row, first >= len(plain), minlength=n).astype(np.int64)


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(A**4, np.int64)
    for _, data, offs in slices(batches, "text"):
        total += letter_counts(data, offs)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])


def fit_language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    grams = docs.select(F.col(text).alias("text")).mapInArrow(_count_letters, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(A**4, np.int64)
    counts[grams["gram"].to_numpy()] = grams["n"].to_numpy()
    return language_model(counts)


def wilson(k: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = k / n
    return (p + Z * Z / (2 * n) - Z * np.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def _count(batches: Iterator[pa.RecordBatch], restorer: Restorer) -> Iterator[pa.RecordBatch]:
    """(cue, bad, bad_docs, bad_words, good) of words and beginnings in texts (text, toxic): occurrences in toxic texts, those texts, their words, occurrences in others. Without cue: the totals."""
    for batch, data, offs in slices(batches, "text"):
        toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
        starts, ends, row = word_spans(data, offs)
        n_words = np.bincount(row, minlength=len(toxic))
        back, restored = restorer.restored(data, offs, *disguised(data, offs))
        own, own_offs = flat(pa.array(restored, pa.string()))
        parts = [(row[w], h) for w, h in features(fold(data), starts, ends)] + [(back[w], h) for w, h in features(fold(own), own_offs[:-1], own_offs[1:])]
        row, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((row, h))
        row, h = row[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
        times, row, h = np.diff(np.append(first, len(h))), row[first], h[first]
        seen, at = np.unique(h, return_inverse=True)
        bad = toxic[row]
        sums = [np.bincount(at, x, minlength=len(seen)).astype(np.int64) for x in (times * bad, bad, n_words[row] * bad, times * ~bad)]
        totals = [int(x.sum()) for x in (n_words[toxic], toxic, ~toxic, n_words[~toxic])]
        for cue, values in ((pa.array(seen.view(np.int64)), [pa.array(x) for x in sums]), (pa.array([None], pa.int64()), [pa.array([x]) for x in totals])):
            yield pa.RecordBatch.from_arrays([cue, *values], ["cue", "bad", "bad_docs", "bad_words", "good"])


def _spell(batches: Iterator[pa.RecordBatch], restorer: Restorer, cues: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cue, spelt): the bytes of cues that occur in the texts."""
    for _, data, offs in slices(batches, "text"):
        more, more_offs = flat(pa.array(restorer.restored(data, offs, *disguised(data, offs))[1], pa.string()))
        for own, starts, ends in ((fold(data), *word_spans(data, offs)[:2]), (fold(more), more_offs[:-1], more_offs[1:])):
            raw, found = own.tobytes(), {}
            for k, (word, h) in zip((*STEMS, None), features(own, starts, ends), strict=True):
                for i in np.flatnonzero(np.isin(h, cues)).tolist():
                    a = int(starts[word[i]])
                    found[int(h[i])] = raw[a : a + k if k else int(ends[word[i]])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(list(found.values()), pa.binary())], ["cue", "spelt"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", toxic: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    restorer = Restorer(fit_language_model(docs, text))
    shared = docs.sparkSession.sparkContext.broadcast(restorer)
    known = labels.select(F.col(label_id).alias("id"), F.col(toxic).alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut(known.orderBy(F.xxhash64("id"), "id").limit(train_docs))
    rows = cut(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id").filter("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic")))
    sums = ("bad", "bad_docs", "bad_words", "good")
    counts = cut(rows.mapInArrow(lambda b: _count(b, shared.value), "cue long, bad long, bad_docs long, bad_words long, good long").groupBy("cue").agg(*[F.sum(c).alias(c) for c in sums]))
    total = counts.filter("cue is null").first()
    words_bad, n_bad, n_good, words_good = (total[c] for c in sums) if total else (0, 0, 0, 0)
    none = Model(restorer, np.zeros(0, np.uint64), *(np.zeros(0) for _ in range(3)), float("-inf"), np.zeros(0, np.int64))
    if not n_bad or not n_good or not words_bad:
        return none
    odds = max(words_good, 1) / words_bad
    cues = counts.filter(F.col("cue").isNotNull() & (F.col("bad_docs") >= MIN_TOXIC) & (F.col("bad") > F.col("good"))).orderBy("cue").toArrow()
    cue, bad, bad_docs, bad_words, good = cues["cue"].to_numpy().view(np.uint64), *(cues[c].to_numpy() for c in sums)
    low = wilson(bad, bad + good) if len(cue) else np.zeros(0)
    keep = (low > 0.5) & (low * odds > RATIO * (1 - low))
    if not keep.any():
        return none
    order = np.flatnonzero(keep)[np.argsort(cue[keep])]
    cue, bad, bad_docs, bad_words, good = (x[order] for x in (cue, bad, bad_docs, bad_words, good))
    spelt = rows.filter("toxic > 0").mapInArrow(lambda b: _spell(b, shared.value, cue), "cue long, spelt binary").distinct().collect()
    return Model(restorer, cue, np.log((bad + SMOOTH) / (good + SMOOTH_CLEAN) * odds), bad / bad_words, (bad_docs + SMOOTH) / (n_bad + 2 * SMOOTH), float(np.log(n_bad / n_good)), np.array(sorted({skeleton(r.spelt) for r in spelt}), np.int64))


def find_toxic(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, n_cues, n_restored) of the toxic documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, "text"):
            score, cues, restored = shared.value.scores(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(cues.astype(np.int64)), pa.array(restored)], ["doc_id", "score", "n_cues", "n_restored"]).filter(pa.array(score > threshold))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, score double, n_cues long, n_restored long")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the toxic documents; a narrow pass, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, text):
            yield batch.filter(pa.array(shared.value.scores(data, offs)[0] <= threshold))

    return docs.mapInArrow(run, docs.schema)
