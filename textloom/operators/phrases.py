"""Two-word phrases: adjacent pairs that are frequent for their words, and their replacement in texts."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import tokens
from textloom.session import cut

#: Phrases replaced in one pass; more take further passes, in order, so that an executor's automaton stays small.
PHRASES_A_PASS = 200_000


def bigram_scores(clean: DataFrame, text: str = "text", min_freq: float = 2.0) -> DataFrame:
    """(w1, w2, freq, score) of adjacent pairs that occur more than min_freq times; score: freq over the count of the commoner word."""
    words = clean.select(tokens(F.col(text)).alias("w"))
    single = words.select(F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("w1"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("w2"))).alias("p"))
    found = pairs.groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).cast("double").alias("freq")).filter(F.col("freq") > min_freq)
    first, second = single.select(F.col("w").alias("w1"), F.col("n").alias("n1")), single.select(F.col("w").alias("w2"), F.col("n").alias("n2"))
    return found.join(first, "w1").join(second, "w2").select("w1", "w2", "freq", (F.col("freq") / F.greatest("n1", "n2")).alias("score"))


def find_bigrams(clean: DataFrame, text: str = "text", threshold: float = 0.1) -> DataFrame:
    """The pairs that score above the threshold."""
    return bigram_scores(clean, text).filter(F.col("score") > threshold)


def _replacer(phrases: list[str]):
    """A function that replaces every phrase, in order, as str.replace would.

    Replacing only turns spaces into underscores and phrases hold one space, so a phrase that is not in the text at first never
    gets into it: one automaton finds those that are, and only they are replaced.
    """
    import ahocorasick

    automaton, places = ahocorasick.Automaton(), {}
    for i, phrase in enumerate(phrases):
        places.setdefault(phrase, []).append(i)
    for phrase, at in places.items():
        automaton.add_word(phrase, at)
    if phrases:
        automaton.make_automaton()

    def replace(text: str | None) -> str | None:
        if not text or not phrases:
            return text
        for i in sorted({i for _, at in automaton.iter(text) for i in at}):
            text = text.replace(phrases[i], phrases[i].replace(" ", "_"))
        return text

    return replace


#: Replacers that this worker has built, by the key of their phrases.
_built: dict[str, object] = {}


def _replacer_of(key: str, phrases: list[str]):
    if key not in _built:
        if len(_built) > 3:
            _built.clear()
        _built[key] = _replacer(phrases)
    return _built[key]


def replace_bigrams(clean: DataFrame, bigrams: DataFrame, text: str = "text", a_pass: int = PHRASES_A_PASS) -> DataFrame:
    """clean with phrases joined by an underscore, replaced as substrings one after another by (score desc, w1, w2).

    A pass broadcasts a_pass phrases at most, so neither the driver nor a worker ever holds more than those of one pass.
    """
    listed = bigrams.select("w1", "w2", "score").orderBy(F.desc("score"), "w1", "w2")
    n = bigrams.count()
    if n > a_pass:
        listed = cut(listed)  # each pass reads a range of it
    at, done = clean.columns.index(text), None
    for _ in range(-(-n // a_pass)):
        rest = listed if done is None else listed.filter((F.col("score") < done[2]) | ((F.col("score") == done[2]) & (F.struct("w1", "w2") > F.struct(F.lit(done[0]), F.lit(done[1])))))
        rows = (rest.orderBy(F.desc("score"), "w1", "w2").limit(a_pass) if n > a_pass else rest).collect()
        done = rows[-1]
        shared, key = clean.sparkSession.sparkContext.broadcast([f"{r.w1} {r.w2}" for r in rows]), uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            replace = _replacer_of(key, shared.value)
            for batch in batches:
                new = pa.array([replace(t) for t in batch.column(at).to_pylist()], pa.string())
                yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), new)

        clean = clean.mapInArrow(run, clean.schema)
    return clean
