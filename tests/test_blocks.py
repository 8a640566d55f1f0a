"""Documents in blocks: what they write, and the results against all pairs."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import plain
from textloom.operators import blocks, pairs, similarity
from textloom.operators.features import Tfidf
from textloom.plans import catalog


def corpus(spark, n, ids="long", seed=3):
    """Documents of 0 to 12 of 60 terms, with copies (ties) and empty ones."""
    rng = random.Random(seed)
    own = [{f"t{t}": rng.choice([0.25, 0.5, 1.0, 2.0]) for t in rng.sample(range(60), rng.randrange(12))} for _ in range(n)]
    own[1::7] = [own[0]] * len(own[1::7])
    features = spark.createDataFrame([(d, t, v) for d, x in enumerate(own) for t, v in x.items()], "doc_id long, term string, value double").withColumn("doc_id", F.col("doc_id").cast(ids))
    return features, spark.range(n).select(F.col("id").cast(ids).alias("doc_id"))


@pytest.mark.parametrize("ids", ["long", "string"])
def test_blocks_are_written_once_whatever_their_number(spark, monkeypatch, ids):
    features, docs = corpus(spark, 90, ids)
    every = {(r.row_id, r["rank"], r.col_id, round(r.sim, 9)) for r in pairs.top_k(similarity.self_similarity(features, docs), 4).collect()}
    written = []

    def measured(folder):
        inner = folder.removeprefix("file:")
        written.append(sum(len(blocks.Block.read(f"{inner}/{f}").ids) for f in os.listdir(inner)))
        delete(folder)
        assert not os.path.exists(inner)

    delete = blocks.delete
    monkeypatch.setattr(pairs, "delete", measured)
    for block in (7, 1000):
        found = pairs.nearest_by_dot(features, docs, features, docs, 4, block=block)
        assert "Exchange" not in found._jdf.queryExecution().toString()
        assert {(r.row_id, r["rank"], r.col_id, round(r.sim, 9)) for r in found.collect()} == every
    assert written == [90, 90]


def test_dense_and_single_precision_lose_no_neighbour(monkeypatch):
    rng = np.random.default_rng(2)
    doc = np.repeat(np.arange(600), 40)
    terms = np.concatenate([rng.choice(300, 40, replace=False) for _ in range(600)])
    value = rng.random(len(doc)) ** 4
    value[doc >= 590] = value[doc < 10]
    terms[doc >= 590] = terms[doc < 10]
    full = np.zeros((600, 300))
    full[doc, terms] = value
    part = lambda a, b: blocks.Block.of(np.arange(a, b), doc[(doc >= a) & (doc < b)] - a, terms[(doc >= a) & (doc < b)], value[(doc >= a) & (doc < b)])
    rows, cols = part(0, 400), part(200, 600)
    exact = full[:400] @ full[200:].T
    np.fill_diagonal(exact[200:, :200], -np.inf)
    order = np.lexsort((np.broadcast_to(-np.arange(200, 600), exact.shape), -np.round(exact, 9)), axis=1)[:, :5]
    monkeypatch.setattr(pairs, "LOT_ENTRIES", 500)
    for share, most in ((0, 1024), (0.01, 100), (2, 0)):  # all terms dense, some, none
        monkeypatch.setattr(pairs, "DENSE_SHARE", share)
        monkeypatch.setattr(pairs, "DENSE_TERMS", most)
        x = np.bincount(rows.doc, rows.value, minlength=400)
        for low in (np.full(400, -np.inf), np.take_along_axis(exact, order, axis=1)[:, -1]):
            row, col, sim = pairs._candidates(rows, rows.by_doc(), x, cols, low, "linear", 5, True)
            best = pairs._ranked(row, cols.ids[col], sim, 5)
            assert (cols.ids[col[best]].reshape(400, 5) == order + 200).all()
            assert np.allclose(sim[best], np.take_along_axis(exact, order, axis=1).ravel(), atol=1e-12)


@pytest.mark.parametrize("renorm", ["length", "max", "sum", "mean", "std", "binary", None])
def test_packed_features_are_the_long_ones(spark, monkeypatch, renorm):
    monkeypatch.setattr(blocks, "WEIGHTS_A_FILE", 3)
    docs = spark.createDataFrame([(1, "a b b c"), (2, "c d"), (3, None), (4, "e f g a a a"), (5, "zz")], "doc_id long, text string")
    model = Tfidf(identify_bigrams=False, renorm=renorm).fit(docs.filter("doc_id < 5"))
    packed, shape = model.packed(docs), "doc_id long, terms array<bigint>, values array<double>"
    finish = packed.finish
    rows = packed.table.mapInArrow(lambda batches: map(finish, batches), shape).collect()
    names = {r.h: r.term for r in spark.createDataFrame([(t,) for t in "abcdefg"], "term string").select("term", F.xxhash64("term").alias("h")).collect()}
    long = {(r.doc_id, r.term): round(r.value, 9) for r in model.transform(docs).collect()}
    assert {(r.doc_id, names[t]): round(v, 9) for r in rows for t, v in zip(r.terms, r["values"], strict=True)} == long
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5] and len(model.files) > 1


def test_similarities_of_queries_shuffle_neither_features_nor_pairs(spark):
    for name in ("sim_map_chebyshev", "sim_map_dice_normalized"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Cartesian" not in plan and plan.count("Exchange") <= 1, plan  # spread() of the documents


@pytest.mark.parametrize("sim", ["chebyshev", "manhattan", "chisq", "jaccard", "angularsim"])
def test_similarities_of_many_blocks_and_lots(spark, monkeypatch, sim):
    rng = random.Random(4)
    low = -1.0 if sim == "chebyshev" else 0.0
    own = [{f"t{t}": rng.choice([low, 0.0, 0.5, 1.0, rng.random()]) for t in rng.sample(range(15), rng.randrange(9))} for _ in range(40)]
    own[7], own[9], own[11] = {}, {}, own[3]
    packed = blocks.pack(spark.createDataFrame([(d, t, v) for d, x in enumerate(own) for t, v in x.items()], "doc_id long, term string, value double"), spark.range(40).toDF("doc_id"))
    for name, most in (("BLOCK_DOCS", 6), ("TABLE_DOCS", 6), ("TABLE_ENTRIES", 20), ("TABLE_ROWS", 5), ("LOT_ENTRIES", 30), ("LOT_PAIRS", 50)):
        monkeypatch.setattr(similarity, name, most)
    for normalize in (False, True):
        found = {(r.row_id, r.col_id): r.sim for r in similarity.cross_packed(packed, packed, sim, normalize).collect()}
        assert len(found) == 1600
        one = {i: plain(sim, own[i], own[i]) for i in range(40)}
        for (i, j), got in found.items():
            expected = plain(sim, own[i], own[j])
            if normalize and expected is not None:
                # the angle of a document with itself is exact
                mean = ((1.0 if any(own[i].values()) else 0.0) + (1.0 if any(own[j].values()) else 0.0)) / 2 if sim == "angularsim" else None if None in (one[i], one[j]) else (one[i] + one[j]) / 2
                expected = expected / mean if mean else None
            assert got == (None if expected is None else pytest.approx(expected, rel=1e-9, abs=1e-7, nan_ok=True)), (i, j)


def test_distances_in_blocks(spark, monkeypatch):
    for name, most in (("BLOCK_VECTORS", 7), ("LOT_VECTORS", 20)):
        monkeypatch.setattr(pairs, name, most)
    rng = random.Random(6)
    own = {f"v{i}": [rng.gauss(0, 100) for _ in range(5)] for i in range(30)} | {"short": [1.0], "none": None, "part": [1.0, None, 0.0, 2.0, 1.0], "twin": None}
    own["twin"] = own["v3"]
    found = pairs.pairwise_distance(spark.createDataFrame(list(own.items()), "vec_id string, embedding array<double>"))
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {(r.row_id, r.col_id): r.dist for r in found.collect()}
    assert len(rows) == 34 * 34 and rows["v3", "twin"] == 0 == rows["short", "short"]
    for (i, j), d in rows.items():
        x, y = own[i], own[j]
        known = x is not None and y is not None and len(x) == len(y) and None not in x and None not in y
        assert d == (pytest.approx(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5) if known else None)


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0] * 9, [float(i * i) for i in range(1000)], [0.0] * 400 + [float(i) for i in range(399)], [0.0] * 400 + [5.0] * 400, [1.0, None, float("nan")], [None], [-2.0, 1e300, 7.0, 7.5]])
def test_median_is_exact(spark, monkeypatch, values):
    for name, most in (("RANGES", 8), ("MOST_VALUES", 1)):
        monkeypatch.setattr(pairs, name, most)
    frame = spark.createDataFrame([(v,) for v in values], "d double")
    expected = frame.agg(F.percentile("d", F.lit(0.5))).first()[0]
    assert repr(pairs.median(frame, "d")) == repr(expected)


def test_transforming_shuffles_nothing(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LONG_DOCS", 2)
    docs = spark.createDataFrame([(1, "new york a"), (2, "new york b b"), (3, None), (4, "new york"), (5, "c")], "doc_id long, text string")
    model = Tfidf().fit(docs)
    found = model.transform(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan, plan
    rows = {(r.doc_id, r.term): r.value for r in found.collect()}
    assert rows.keys() == {(1, "new_york"), (1, "a"), (2, "new_york"), (2, "b"), (4, "new_york"), (5, "c")}
    for d in (1, 2, 4, 5):
        assert sum(v * v for (i, _), v in rows.items() if i == d) == pytest.approx(1.0)
