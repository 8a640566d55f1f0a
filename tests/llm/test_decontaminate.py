import random

import numpy as np
import pyarrow as pa

from textloom.llm import decontaminate as d
from textloom.llm.arrow_text import flat, windows
from textloom.llm.arrow_text import words as hashed
from tests.llm.conftest import docs_frame, words


def simhash(shingles: np.ndarray) -> np.ndarray:
    return np.packbits(d.shingle_bits(shingles).sum(axis=0, dtype=np.int64) > 0)


def brute(texts: dict[int, str], items: dict[int, str]) -> dict[tuple[int, int], float]:
    """Every window of every text against every item."""
    shingles = lambda t: windows(*[(h, b) for h, _, _, b in [hashed(*flat(pa.array([t])))]][0], d.SHINGLE)[0]
    out = {}
    for j, item in items.items():
        own = shingles(item)
        n = len(own)
        if not n:
            continue
        print_ = simhash(own)
        for i, text in texts.items():
            sh = shingles(text)
            for p in range(len(sh) - n + 1):
                w = sh[p : p + n]
                both = sum(min((w == x).sum(), (own == x).sum()) for x in set(w) & set(own))
                sim = both / (2 * n - both)
                far = np.bitwise_count(simhash(w) ^ print_).sum()
                if sim >= d.THRESHOLD and far <= d.RADIUS:
                    out[i, j] = max(out.get((i, j), 0), sim)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = {j: words(rng, rng.choice([10, 10, 17, 25])) for j in range(6)}
    texts = {}
    for i in range(24):
        passage = rng.choice(list(items.values())).split()
        for _ in range(rng.randrange(4)):
            passage[rng.randrange(len(passage))] = "changed"
        texts[i] = f"{words(rng, rng.randrange(30))}. {' '.join(passage).upper()}! {words(rng, 20)}"
    bench = spark.createDataFrame([*items.items(), (90, None), (91, ""), (92, "two words")], "item_id long, text string")
    docs = docs_frame(spark, [(i, t, "s") for i, t in texts.items()])
    found = {(r.doc_id, r.item_id): r.similarity for r in d.find_leaks(docs, bench).collect()}
    expected = brute(texts, items)
    assert found.keys() == expected.keys() and len(found) > 10
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench, a_pass=200).collect()} == expected.keys()
    kept = d.drop_leaks(docs, bench)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {i for i, _ in expected} and kept.columns == docs.columns


def test_texts_shorter_than_an_item():
    """Cut at either end or changed, they are compared as a whole."""
    rng = random.Random(8)
    items = [words(rng, n) for n in (20, 20, 40, 59)]
    cuts = [(0, 18), (1, 20), (0, 30), (20, 59), (0, 9), (0, 59)]
    texts = [" ".join(items[j].split()[a:b]) for j, (a, b) in zip((0, 1, 2, 3, 0, 3), cuts, strict=True)] + ["two words", "", words(rng, 18)]
    found = {(m[0], m[1]): m[2:5] for m in d.Index(list(range(4)), items).matches(*flat(pa.array(texts)))}
    assert found == {(0, 0): (0, 18, 16 / 18), (1, 1): (0, 19, 17 / 18), (2, 2): (0, 30, 28 / 38), (3, 3): (0, 39, 37 / 57), (5, 3): (0, 59, 1.0)}


def test_fingerprints_are_those_of_each_window():
    rng = np.random.default_rng(2)
    shingles = rng.integers(0, 2**63, 60_000).astype(np.uint64)
    begin = np.sort(rng.integers(0, 59_000, 300))
    n = rng.integers(1, 1000, 300)
    assert (d.fingerprints(shingles, begin, n) == np.array([simhash(shingles[b : b + k]) for b, k in zip(begin, n, strict=True)])).all()


def test_multi_index_finds_all_within_the_radius():
    rng = random.Random(4)
    index = d.Index(list(range(50)), [words(rng, 20) for _ in range(50)])
    noise = np.random.default_rng(1)
    own = index.prints[0].view(np.uint8)
    prints = own[noise.integers(50, size=200)] ^ np.packbits(noise.random((200, d.BITS)) < 0.3, axis=1)
    who, item, _, near = index.candidates(prints, 0)
    far = np.bitwise_count(prints[:, None] ^ own[None]).sum(axis=2)
    assert set(zip(who.tolist(), index.own[0].searchsorted(item).tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(far <= d.RADIUS)), strict=True))
    assert near < far.size


def test_share_of_items_that_random_windows_probe():
    """Sizes and blocks together leave few pairs to be compared."""
    rng, noise = random.Random(5), np.random.default_rng(3)
    index = d.Index(list(range(400)), [words(rng, rng.randrange(14, 60)) for _ in range(400)])
    near = sum(index.candidates(noise.integers(0, 256, (100, d.BITS // 8)).astype(np.uint8), k)[3] for k in range(len(index.kinds)))
    assert near / (100 * len(index.kinds) * 400) < 0.02


def test_kinds_of_ids(spark):
    """Ids of items of any type, and of documents."""
    text = "one two three four five six seven eight nine ten"
    for kind, value in (("smallint", 7), ("string", "seven"), ("decimal(10,2)", 7), ("date", None)):
        bench = spark.createDataFrame([(1, text)], "x int, text string").selectExpr(f"cast({'NULL' if value is None else repr(value)} as {kind}) item_id", "text")
        docs = spark.createDataFrame([("a", "so " + text), ("b", "else")], "doc_id string, text string")
        assert [(r.doc_id, r.similarity) for r in d.find_leaks(docs, bench).collect()] == [("a", 1.0)]


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four"), (2, None)], "item_id long, text string")
    assert d.find_leaks(odd, bench).count() == d.find_leaks(none, bench).count() == 0
    assert d.find_leaks(odd, bench.limit(0)).count() == 0
    assert d.drop_leaks(odd, bench).count() == odd.count()
