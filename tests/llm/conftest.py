import random

import pytest

#: Names that operators use inside, as extra columns of their inputs.
CLASHING = ["id", "t", "v", "c", "n", "own", "row", "host", "line", "bucket", "sig", "bands", "digest", "word", "bad", "piece", "shard", "seq_id", "a", "b", "ids", "band", "asked", "rank", "item_id", "n_pages"]


def words(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def docs_frame(spark, rows):
    """rows: (doc_id, text, source)"""
    schema = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), *["clash"] * len(CLASHING)) for i, t, s in rows], schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(5)
    long = words(rng, 30_000, 100_000)
    return docs_frame(spark, [(1, None, "s"), (2, "", "s"), (3, long, None), (4, "one two", "s"), (4, "one two", "s"), (None, "lost words without an id at all", "s"), (5, " \n\n ", None), (6, "日本語 ünïcode ß — 😀", ""), (7, "one two", "s")])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
