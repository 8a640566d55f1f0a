import random
from collections import Counter

import numpy as np
import pyarrow as pa

from textloom.llm import near_dedup as d
from textloom.llm.arrow_text import flat, word_list
from textloom.llm.arrow_text import words as hashed
from textloom.llm.components import components
from tests.llm.conftest import docs_frame, words


def shingles(text):
    own = word_list(text)
    return Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))


def similarity(a, b):
    """Of the weights as probabilities, what ProbMinHash estimates."""
    a, b = shingles(a), shingles(b)
    p, q = sum(a.values()), sum(b.values())
    return sum(1 / sum(max(a[z] / a[x], b[z] / b[x]) for z in a.keys() | b.keys()) for x in a.keys() & b.keys()) if p and q else 0.0


def changed(rng, text, n):
    own = text.split()
    for _ in range(n):
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
    return " ".join(own)


def test_agreement_estimates_probability_jaccard():
    rng = random.Random(1)
    errors = []
    for n in (0, 2, 5, 12, 30):
        a = words(rng, 150, 40)
        b = changed(rng, a, n)
        h, _, _, bounds = hashed(*flat(pa.array([a, b])))
        sig = d.signatures(*d.weighted_shingles(h, bounds), 2, size=4096)
        errors.append(abs((sig[0] == sig[1]).mean() - similarity(a, b)))
    assert max(errors) < 0.04


def test_against_brute_force(spark):
    """Near copies are grouped and only they are; the lowest id stays."""
    rng = random.Random(2)
    texts, truth = {}, {}
    for g in range(40):
        base = words(rng, 120)
        for k in range(rng.choice([1, 1, 2, 3])):
            i = len(texts)
            texts[i] = base if k == 1 else changed(rng, base, 4 if k else 0)
            truth[i] = g
    for i, a in texts.items():
        for j, b in texts.items():
            if i < j:
                s = similarity(a, b)
                assert (s > 0.7) == (truth[i] == truth[j]) and not 0.3 < s < 0.7
    docs = docs_frame(spark, [(i, t.upper() if i % 2 else t, "s") for i, t in texts.items()])
    lowest = {g: min(i for i in truth if truth[i] == g) for g in truth.values()}
    expected = {(i, lowest[g], i == lowest[g]) for i, g in truth.items() if sum(x == g for x in truth.values()) > 1}
    assert {(r.doc_id, r.group_id, r.kept) for r in d.near_duplicates(docs).collect()} == expected
    kept = d.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(lowest.values()) and kept.columns == docs.columns


def test_thousands_of_copies(spark):
    rng = random.Random(3)
    base = words(rng, 80)
    docs = docs_frame(spark, [(i, base if i % 2 else changed(rng, base, 1), "s") for i in range(1500)])
    assert [r.doc_id for r in d.drop_near_duplicates(docs).collect()] == [0]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    expected = {(x, find(x)) for x in list(root) if find(x) != x}
    assert {(r.id, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == expected


def test_odd_rows(odd, none):
    assert {(r.doc_id, r.group_id) for r in d.near_duplicates(odd).collect()} == {(4, 4), (7, 4)}
    kept = [r.doc_id for r in d.drop_near_duplicates(odd).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 2, 3, 4, 5, 6] and kept.count(None) == 1
    assert d.near_duplicates(none).count() == d.drop_near_duplicates(none).count() == 0


def test_search_keeps_components_of_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(256, size=(3, d.SIZE), dtype=np.uint8)
    sig = base[rng.integers(3, size=30)].copy()
    sig[rng.random(sig.shape) < 0.1] = 7
    near = np.array([[d.similarity(a, b[None])[0] >= d.THRESHOLD for b in sig] for a in sig])
    reach = np.linalg.matrix_power(near.astype(float), 30) > 0
    joined = np.eye(30, dtype=bool)
    for a, b in d.links(sig):
        joined[a, b] = joined[b, a] = True
    assert ((np.linalg.matrix_power(joined.astype(float), 30) > 0) == reach).all()


def test_exact_similarity():
    rng = random.Random(6)
    for _ in range(200):
        a, b = (Counter(rng.randrange(12) for _ in range(rng.randrange(1, 40))) for _ in range(2))
        x, y = (sorted(z.items()) for z in (a, b))
        exact = sum(1 / sum(max(a[z] / a[i], b[z] / b[i]) for z in a.keys() | b.keys()) for i in a.keys() & b.keys())
        (sa, na), (sb, nb) = ((np.array([k for k, _ in z], np.uint64), np.array([float(v) for _, v in z])) for z in (x, y))
        assert abs(d.probability_jaccard(sa, na, sb, nb) - exact) < 1e-9


def test_pairs_near_the_threshold_are_decided_exactly(spark):
    """Pairs of 0.4 to 0.7: none below the threshold is linked, and above it only those are missed that share no band."""
    rng = random.Random(7)
    texts, truth = [], []
    for _ in range(300):
        a = words(rng, 120)
        b = changed(rng, a, rng.randrange(8, 18))
        texts += [a, b]
        truth.append(similarity(a, b))
    docs = docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    linked = {r.group_id // 2 for r in d.near_duplicates(docs).collect()}
    h, _, _, bounds = hashed(*flat(pa.array(texts)))
    sig = d.signatures(*d.weighted_shingles(h, bounds), len(texts)).reshape(-1, 2, d.BANDS, d.ROWS)
    banded = (sig[:, 0] == sig[:, 1]).all(axis=2).any(axis=1)
    assert sum(0.5 < s < 0.6 for s in truth) > 30
    assert linked == {i for i, s in enumerate(truth) if s >= d.THRESHOLD and banded[i]}


def rows_frame(spark, rows):
    """(doc_id, text, note), with columns of names that operators might use inside."""
    names = ["gone", "gone_text", "_gone", "__gone", "__again", "__rank", "size", "root", "kept", "k", "group_id", "first", "count"]
    return spark.createDataFrame([(i, t, n, *["clash"] * len(names)) for i, t, n in rows], "doc_id string, text string, note string, " + ", ".join(f"`{c}` string" for c in names))


def test_rows_are_decided_one_by_one(spark):
    """Repeated ids, differing texts under one id, missing texts and string ids: every group keeps one row, and nothing else goes."""
    rng = random.Random(11)
    a, b = words(rng, 60), words(rng, 60)
    docs = rows_frame(spark, [("1", a, "x"), ("1", b, "y"), ("2", None, "z"), ("2", b + " and three more", "z"), ("3", a.upper(), "x"), ("3", words(rng, 40), "x"), (None, a, "x"), ("1", a, "again")])
    kept = d.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or "", r.text or "") for r in kept.collect())
    assert [(i, t) for i, t in got if i in ("1", "2", "")] == sorted([("1", a), ("1", b), ("2", ""), ("", a)])
    assert [i for i, _ in got].count("3") == 1 and len(got) == 5
    assert sorted((r.doc_id, r.group_id, r.kept) for r in d.near_duplicates(docs).collect()) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "1", False)]


def test_each_group_keeps_one_row(spark):
    """Brute force over rows with repeated ids and texts."""
    rng = random.Random(12)
    bases = [words(rng, 80) for _ in range(12)]
    rows = []
    for _ in range(150):
        base = rng.choice(bases)
        rows.append((str(rng.randrange(60)), rng.choice([base, base.title(), changed(rng, base, 2)]), "n"))
    group = {t: next(g for g, base in enumerate(bases) if similarity(t.lower(), base) > 0.6) for _, t, _ in rows}
    kept = d.drop_near_duplicates(rows_frame(spark, rows)).collect()
    assert sorted(group[r.text] for r in kept) == sorted(set(group.values()))
    assert all(r.doc_id == min(i for i, t, _ in rows if group[t] == group[r.text]) for r in kept)


def test_blocks_of_large_buckets_find_the_same(spark):
    rng = random.Random(13)
    bases = [words(rng, 100) for _ in range(4)]
    shared = words(rng, 40)
    docs = docs_frame(spark, [(i, changed(rng, rng.choice(bases), rng.randrange(1, 4)) + " " + shared, "s") for i in range(400)])
    found = {tuple(r) for r in d.near_duplicates(docs).collect()}
    assert found == {tuple(r) for r in d.near_duplicates(docs, block=16).collect()} and len(found) > 300


def test_a_bucket_of_many(spark):
    """Ten thousand different texts that all share their bands."""
    rng = random.Random(14)
    base = words(rng, 60)
    docs = docs_frame(spark, [(i, f"{base} end{i}", "s") for i in range(10_000)])
    assert [r.doc_id for r in d.drop_near_duplicates(docs).collect()] == [0]
