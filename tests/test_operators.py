import math
import random

import numpy as np
import pytest

from textloom.functions.text import clean_text, norm_whitespace
from textloom.operators import embed, folds, knn, linear, maps, pairs, phrases, similarity
from textloom.operators import features as features_module
from textloom.operators.features import Tfidf, TfidfModel, feature_matrix, idf_weights, term_counts
from textloom.plans import catalog
from textloom.streaming.features import stream_features

from pyspark.sql import functions as F


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def cells(df):
    return {(r.doc_id, r.term): r.value for r in df.collect()}


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Visit https://a.b/c?d now", "visit now"), ("HTTP://X.Y", "http x y"), ("Café ½ Straße ﬁn", "cafe 11 strae fin"), ("Year 1989, e-mail_x", "year 1111 e-mail x"), ("", ""), ("  \t\n ", ""), (None, ""), ("a b c", "a b c"), ("http://a\u2003b", "b")],
)
def test_clean(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(clean_text(F.col("t"))).first()[0]
    # white space outside ASCII is decomposed or dropped before links are cut
    assert got == ("a b c" if text == "a b c" else expected)


def test_white_space(spark):
    assert spark.createDataFrame([("\x1c a　 b\x85\n",)], "t string").select(norm_whitespace(F.col("t"))).first()[0] == "a b"


def test_inversion_keeps_repeats(spark):
    table = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "k int, v array<string>")
    assert {r["value"]: r["keys"] for r in maps.invert_lists(table, "k", "v").collect()} == {"a": [1, 1], "b": [1, 2]}
    turned = maps.transpose(spark.createDataFrame([(1, {"a": 1.0, "b": 2.0}), (2, {"b": 3.0})], "k int, m map<string,double>"), "k", "m")
    assert {r["key"]: r["entries"] for r in turned.collect()} == {"a": {1: 1.0}, "b": {1: 2.0, 2: 3.0}}


@pytest.mark.parametrize(("norm", "n_all", "size"), [("sum", 0, -1.0), ("max", 0, 4.0), ("length", 0, math.sqrt(26)), ("mean", 0, -1 / 3), ("mean", 6, -1 / 6), ("std", 0, np.std([3, -4, 0])), ("std", 6, np.std([3, -4, 0, 0, 0, 0]))])
def test_norms(spark, norm, n_all, size):
    values = [3.0, -4.0, 0.0] if norm != "length" else [3.0, -4.0, 1.0]
    rows = spark.createDataFrame([(1, v) for v in values] + [(2, 0.0)], "k int, value double")
    got = maps.normalise(rows, "k", norm=norm, n_all=n_all).collect()
    assert sorted(r.value for r in got if r.k == 1) == pytest.approx(sorted(v / size for v in values))
    assert [r.value for r in got if r.k == 2] == [0.0]


def test_binary_and_unknown_norms(spark):
    rows = spark.createDataFrame([(1, 0.0)], "k int, value double")
    assert maps.normalise(rows, "k", norm="binary").first().value == 1.0
    with pytest.raises(ValueError, match="unknown norm"):
        maps.normalise(rows, "k", norm="mode")


def test_merge(spark):
    a, b = (spark.createDataFrame(x, "k string, value double") for x in ([("x", 1.0), ("y", 2.0)], [("y", 5.0), ("z", 3.0)]))
    for op, y in (("max", 5.0), ("sum", 7.0), ("min", 2.0), (lambda p: p[0] * p[1], 10.0), (maps.on_columns(lambda x, y: x - y), -3.0)):
        assert {r.k: r.value for r in maps.combine(a, b, ["k"], op=op).collect()} == {"x": 1.0, "y": y, "z": 3.0}


def test_phrases(spark):
    docs = docs_of(spark, "new york is new york", "new york", "renew yorkshire", "a a a")
    assert {(r.w1, r.w2): (r.freq, r.score) for r in phrases.bigram_scores(docs).collect()} == {("new", "york"): (3.0, 1.0)}
    joined = {r.doc_id: r.text for r in phrases.replace_bigrams(docs, phrases.find_bigrams(docs)).collect()}
    assert joined == {0: "new_york is new_york", 1: "new_york", 2: "renew_yorkshire", 3: "a a a"}
    assert phrases.bigram_scores(docs_of(spark, "", "one")).count() == 0


def test_replacement_is_that_of_each_phrase_in_order(spark):
    rng = random.Random(1)
    letters = ["a", "b", "ab", "ba", "c"]
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(200)]
    found = [(rng.choice(letters), rng.choice(letters), round(rng.random(), 1)) for _ in range(12)]
    order = [f"{a} {b}" for a, b, _ in sorted(set(found), key=lambda x: (-x[2], x[0], x[1]))]

    def brute(text):
        for p in order:
            text = text.replace(p, p.replace(" ", "_"))
        return text

    bigrams = spark.createDataFrame(sorted(set(found)), "w1 string, w2 string, score double")
    for size in (100, 3):
        assert [r.text for r in phrases.replace_bigrams(docs_of(spark, *texts), bigrams, a_pass=size).orderBy("doc_id").collect()] == [brute(t) for t in texts]


def test_tfidf(spark):
    docs = docs_of(spark, "a b b", "a b", "c", "")
    weights = {r.term: (r.df, r.weight) for r in idf_weights(term_counts(docs), 4).collect()}
    top = math.log(4)
    assert weights == {"a": (2, pytest.approx(math.log(2) / top)), "b": (2, pytest.approx(math.log(2) / top)), "c": (1, pytest.approx(1.0))}
    params = Tfidf(renorm=None, identify_bigrams=False)
    model = params.fit(docs)
    assert cells(model.transform(docs)) == {(0, "a"): pytest.approx(0.25), (0, "b"): pytest.approx(0.5), (1, "a"): pytest.approx(0.5), (1, "b"): pytest.approx(0.5), (2, "c"): pytest.approx(1.0)}
    unit = Tfidf(identify_bigrams=False).fit(docs).transform(docs).groupBy("doc_id").agg(F.sum(F.col("value") ** 2).alias("s")).collect()
    assert [r.s for r in unit] == pytest.approx([1.0] * 3)


def test_fitting_on_some_drops_other_terms_and_keeps_zero_weights(spark):
    docs = docs_of(spark, "a b", "a", "a z")
    model = Tfidf(renorm=None, identify_bigrams=False).fit(docs, fit_ids=spark.createDataFrame([(0,), (1,)], "doc_id long"))
    assert cells(model.transform(docs)) == {(0, "a"): 0.0, (0, "b"): 1.0, (1, "a"): 0.0, (2, "a"): 0.0}


def test_saved_model(spark, tmp_path):
    docs = docs_of(spark, *["new york times"] * 4, "old york")
    model = Tfidf().fit(docs)
    model.save(str(tmp_path))
    again = TfidfModel.load(spark, str(tmp_path), Tfidf())
    assert cells(again.transform(docs)) == cells(model.transform(docs))
    assert {t for _, t in cells(model.transform(docs))} >= {"new_york_times"} or {t for _, t in cells(model.transform(docs))} >= {"new_york"}


def test_matrix(spark):
    features = spark.createDataFrame([(1, "b", 2.0), (1, "ab", 1.0), (2, "a", 3.0)], "doc_id long, term string, value double")
    assert {(r.doc_id, r.col_idx, r.value) for r in feature_matrix(features)[0].collect()} == {(1, 2, 2.0), (1, 1, 1.0), (2, 0, 3.0)}
    assert {(r.doc_id, r.col_idx) for r in feature_matrix(features, terms=["b", "q"])[0].collect()} == {(1, 0)}


X = {"x": {"a": 0.5, "b": 0.5}, "y": {"b": 0.5, "c": 1.0}, "z": {}, "x2": {"a": 0.5, "b": 0.5}, "w": {"a": 0.0}, "u": {"c": 0.25, "d": 3.0, "a": 0.125}}
EPS = 2.220446049250313e-16


def plain(name, x, y):
    """From the definitions, term by term."""
    union = sorted(x.keys() | y.keys())
    p = [(x.get(t, 0.0), y.get(t, 0.0)) for t in union]
    dot, a, sx, sy = sum(i * j for i, j in p), sum(min(i, j) for i, j in p), sum(x.values()), sum(y.values())
    length = lambda v: math.sqrt(sum(i * i for i in v.values())) or 1.0
    cos = dot / (length(x) * length(y))
    ratio = lambda n, d: n / d if d else 0.0
    over = lambda f: 1 / (EPS + sum(f(i, j) for i, j in p))
    nan = lambda n, d: n / d if d else math.nan
    term = lambda v, t: v * math.log(2 * v / t) if v else 0.0
    return {
        "linear": lambda: dot, "polynomial": lambda: dot**2, "sigmoidal": lambda: math.tanh(dot), "histint": lambda: a, "gaussian": lambda: math.exp(-0.25 * sum((i - j) ** 2 for i, j in p)),
        "manhattan": lambda: over(lambda i, j: abs(i - j)), "sqeucl": lambda: over(lambda i, j: (i - j) ** 2), "minkowski": lambda: over(lambda i, j: abs(i - j) ** 3),
        "canberra": lambda: over(lambda i, j: nan(abs(i - j), i + j)), "chisq": lambda: over(lambda i, j: nan((i - j) ** 2, i + j)), "chebyshev": lambda: 1 - max(abs(i - j) for i, j in p) if p else None,
        "hellinger": lambda: over(lambda i, j: (math.sqrt(i) - math.sqrt(j)) ** 2), "jenshan": lambda: over(lambda i, j: term(i, i + j) + term(j, i + j)),
        "simpson": lambda: ratio(a, min(sx, sy)), "braun": lambda: ratio(a, max(sx, sy)), "kulczynski": lambda: 0.5 * (a / sx + a / sy) if sx and sy else 0.0, "jaccard": lambda: ratio(a, sx + sy - a), "dice": lambda: ratio(2 * a, sx + sy),
        "otsuka": lambda: ratio(a, math.sqrt(sx) * math.sqrt(sy)), "sokal": lambda: ratio(a, 2 * sx + 2 * sy - 3 * a),
        "cosine": lambda: cos, "angularsim": lambda: 1 - 2 * math.acos(min(1, max(0, cos))) / math.pi, "angulardist": lambda: 2 * math.acos(min(1, max(0, cos))) / math.pi,
    }[name]()


@pytest.fixture(scope="module")
def sparse(spark):
    features = spark.createDataFrame([(d, t, v) for d, own in X.items() for t, v in own.items()], "doc_id string, term string, value double").cache()
    return features, spark.createDataFrame([(d,) for d in X], "doc_id string").cache()


@pytest.mark.parametrize("name", similarity.NAMES)
def test_similarities(sparse, name):
    found = {(r.row_id, r.col_id): r.sim for r in similarity.self_similarity(*sparse, name).collect()}
    assert found.keys() == {(i, j) for i in X for j in X}
    for (i, j), got in found.items():
        expected = plain(name, X[i], X[j])
        assert got == (None if expected is None else pytest.approx(expected, rel=1e-9, abs=1e-7, nan_ok=True)), (i, j)
    if name in ("manhattan", "sqeucl", "hellinger", "jenshan", "canberra"):
        assert found["x", "x2"] == 4503599627370496.0


def test_normalized_similarity(sparse):
    found = {(r.row_id, r.col_id): r.sim for r in similarity.self_similarity(*sparse, "linear", True).collect()}
    assert found["x", "x2"] == pytest.approx(1.0) and found["x", "y"] == pytest.approx(0.25 / ((0.5 + 1.25) / 2)) and found["z", "z"] is None
    with pytest.raises(ValueError, match="unknown similarity"):
        similarity.self_similarity(*sparse, "nothing")


def test_angle_of_a_document_with_itself_is_exact(spark):
    rng = random.Random(8)
    own = {d: {f"t{t}": rng.random() for t in rng.sample(range(40), 6)} for d in range(30)} | {30: {"t0": 0.0}, 31: {}}
    features, docs = spark.createDataFrame([(d, t, v) for d, x in own.items() for t, v in x.items()], "doc_id long, term string, value double"), spark.range(32).toDF("doc_id")
    found = {(r.row_id, r.col_id): r.sim for r in similarity.self_similarity(features, docs, "angularsim", True).collect()}
    for i in own:
        for j in own:
            if i >= 30 and j >= 30:
                assert found[i, j] is None
            elif i != j:
                assert abs(found[i, j] - plain("angularsim", own[i], own[j])) < 1e-12, (i, j)
    for name, whole, none in (("cosine", 1.0, 0.0), ("angularsim", 1.0, 0.0), ("angulardist", 0.0, 1.0)):
        assert {r.doc_id: r.own for r in similarity.self_values(features, docs, name).collect()} == {d: whole if d < 30 else none for d in own}


def test_blocks_give_the_neighbours_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(d, f"t{t}", rng.choice([0.5, 1.0, 2.0])) for d in range(40) for t in rng.sample(range(30), rng.randrange(6))]
    features, docs = spark.createDataFrame(rows, "doc_id long, term string, value double"), spark.range(41).toDF("doc_id")
    every = {(r.row_id, r["rank"], r.col_id, r.sim) for r in pairs.top_k(similarity.self_similarity(features, docs), 4).collect()}
    for block in (7, 1000):
        assert {(r.row_id, r["rank"], r.col_id, r.sim) for r in pairs.nearest_by_dot(features, docs, features, docs, 4, block=block).collect()} == every


def test_affinities(spark):
    dist = spark.createDataFrame([(i, j, float(abs(i - j))) for i in range(5) for j in range(5)], "row_id int, col_id int, dist double")
    p = np.zeros((5, 5))
    for r in pairs.distance_to_affinity(dist, perp=2.0).collect():
        p[r.row_id, r.col_id] = r.sim
    assert p.sum() == pytest.approx(1) and (p == p.T).all() and (np.diag(p) == 0).all()


def test_knn(spark):
    labels = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(6)], "doc_id int, category string")
    sims = [[0.9, 0.8, 0.1, 0.1, 0.7, 0.6], [0.0] * 6]
    frame = spark.createDataFrame([(10 + r, c, s) for r, own in enumerate(sims) for c, s in enumerate(own)], "row_id int, col_id int, sim double")
    test, train = spark.createDataFrame([(10,), (11,)], "doc_id int"), spark.range(6).select(F.col("id").cast("int").alias("doc_id"))
    assert {r.category: r.k_c for r in knn.category_sizes(labels, train, 4, True, 1).collect()} == {"a": 4, "b": 2}
    got = {(r.doc_id, r.category): r.score for r in knn.knn(frame, test, labels, train, 4, True, 1).collect()}
    assert got == {(10, "a"): pytest.approx(1.7 / 3.0), (10, "b"): 0.0, (11, "a"): 0.0, (11, "b"): 0.0}
    got = {(r.doc_id, r.category): r.score for r in knn.knn(frame, test, labels, train, 4, False, 1, False).collect()}
    assert got == {(10, "a"): 0.5, (10, "b"): 0.5, (11, "a"): 0.0, (11, "b"): 0.0}
    scores = knn.knn(frame, test, labels, train, 4, False, 1, False)
    assert {r.doc_id: r.category for r in knn.labels_max(scores).collect()} == {10: "a", 11: "a"}
    assert {r.doc_id: r.categories for r in knn.labels_threshold(scores, 0.5).collect()} == {10: ["a", "b"], 11: []}
    truth = spark.createDataFrame([(10, "b"), (11, "a")], "doc_id int, category string")
    assert {r.category: (r.tp, r.fp, r.fn) for r in knn.f1(truth, knn.labels_max(scores)).collect()} == {"a": (1, 1, 0), "b": (0, 0, 1), None: (1, 1, 1)}


def test_folds(spark):
    rows = folds.kfold(spark.createDataFrame([(i,) for i in (5, -3, 8, 100, 7, 2, 900)], "doc_id long"), 3).collect()
    order = [-3, 2, 5, 7, 8, 100, 900]
    assert {(r.fold, r.doc_id) for r in rows if r.is_test} == {(i % 3, d) for i, d in enumerate(order)} and len(rows) == 21
    labels = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(8)], "doc_id long, category string")
    tested = [r for r in folds.balanced_kfold(labels, 3, seed=4).collect() if r.is_test]
    assert sorted(r.doc_id for r in tested) == list(range(8))
    for c in "ab":
        n = [sum(r.category == c and r.fold == f for r in tested) for f in range(3)]
        assert max(n) - min(n) <= 1
    assert folds.shuffle_split(spark.range(50).toDF("doc_id"), 0.2, 1).filter("is_test").count() == 10
    assert folds.kfold(spark.createDataFrame([], "doc_id long")).count() == 0


def test_scaling_of_a_rectangle():
    points = np.array([[0, 0], [4, 0], [0, 1], [4, 1.0]])
    centred = points - points.mean(axis=0)
    y = embed.scaled(points @ points.T)
    assert y @ y.T == pytest.approx(centred @ centred.T)
    with pytest.raises(ValueError, match="eigenvalues"):
        embed.scaled(points @ points.T, which="XX")


def test_tsne_keeps_groups_apart(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(15, 3)), rng.normal(size=(15, 3)) + 12])
    s = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 8)
    y, costs = embed.tsne_points(s, max_iter=500)
    assert abs(y.mean(axis=0)).max() < 1e-6 and costs[-1] < costs[4]
    d = np.linalg.norm(y[:, None] - y[None], axis=2)
    assert d[:15, :15].max() < d[:15, 15:].min() or np.median(d[:15, :15]) < np.median(d[:15, 15:])
    assert (embed.tsne_points(s, max_iter=30, init="kpca")[0] == embed.tsne_points(s, max_iter=30, init="kpca")[0]).all()


def test_stream(spark, tmp_path):
    docs = docs_of(spark, "a b", "b c", "d")
    docs.write.parquet(f"{tmp_path}/in")
    model = Tfidf(identify_bigrams=False).fit(docs)
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    q = stream_features(stream, model, f"{tmp_path}/out", f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    assert cells(spark.read.parquet(f"{tmp_path}/out")) == cells(model.transform(docs))


def test_every_query_but_the_numerical_ones_has_sql():
    assert catalog.QUERIES.keys() - catalog.ORACLES.keys() == {"classical_scaling", "tsne"}
    assert catalog.ORACLES.keys() <= catalog.QUERIES.keys()


@pytest.mark.parametrize("sim", ["jaccard", "simpson", "braun", "kulczynski", "dice", "otsuka", "sokal", "histint", "polynomial", "sigmoidal", "cosine", "angularsim", "angulardist"])
def test_blocks_rank_by_other_similarities(spark, sim):
    rng = np.random.default_rng(5)
    rows = [(i, f"t{t}", float(v)) for i in range(40) for t, v in zip(rng.choice(30, 8, replace=False), rng.random(8), strict=True)]
    features, docs = spark.createDataFrame(rows, "doc_id long, term string, value double"), spark.createDataFrame([(i,) for i in range(42)], "doc_id long")
    every = pairs.top_k(similarity.cross_similarity(features, docs, features, docs, sim), 4)
    found = pairs.nearest_by(features, docs, features, docs, sim, 4, block=11)
    key = lambda df: {(r.row_id, r["rank"], r.col_id): r.sim for r in df.collect()}
    a, b = key(every), key(found)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_counts_and_norms_within_rows_are_those_of_the_long_table(spark):
    docs = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, None), (4, "x"), (5, "a a a b")], "doc_id long, text string")
    assert {(r.doc_id, r.term): r.value for r in features_module.term_counts(docs).collect()} == {(1, "a"): 1, (1, "b"): 3, (1, "c"): 1, (4, "x"): 1, (5, "a"): 3, (5, "b"): 1}
    for norm in maps.NORMS:
        for n_all in (0, 7):
            long = maps.normalise(features_module.term_counts(docs), "doc_id", norm=norm, n_all=n_all)
            lists = features_module.long(maps.normalise_lists(features_module.term_lists(docs), norm=norm, n_all=n_all))
            assert {(r.doc_id, r.term, round(r.value, 9)) for r in long.collect()} == {(r.doc_id, r.term, round(r.value, 9)) for r in lists.collect()}


def test_phrases_in_several_passes(spark):
    docs = spark.createDataFrame([(1, "a b c d a b c"), (2, "c d"), (3, None)], "doc_id long, text string")
    bigrams = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("c", "d", 0.7), ("x", "y", 0.9), ("d", "a", 0.1)], "w1 string, w2 string, score double")
    every = {(r.doc_id, r.text) for r in phrases.replace_bigrams(docs, bigrams).collect()}
    assert every == {(r.doc_id, r.text) for r in phrases.replace_bigrams(docs, bigrams, a_pass=1).collect()} == {(r.doc_id, r.text) for r in phrases.replace_bigrams(docs, bigrams, a_pass=2).collect()}
    assert (1, "a_b_c_d_a_b_c") in every  # replaced as substrings


def test_folds_of_ids_of_any_type(spark):
    ids = spark.createDataFrame([(f"d{i:02d}",) for i in range(25)], "doc_id string").repartition(5)
    rows = folds.kfold(ids, 4).collect()
    assert {(r.fold, r.doc_id) for r in rows if r.is_test} == {(i % 4, f"d{i:02d}") for i in range(25)} and len(rows) == 100
    assert folds.kfold(ids.limit(0), 4).count() == 0


def test_scaling_in_more_dimensions(spark):
    x = np.random.default_rng(6).normal(size=(12, 3))
    k = x @ x.T
    sims = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(12) for j in range(12)], "row_id long, col_id long, sim double")
    y = np.array([[r.x1, r.x2, r.x3] for r in embed.classical_scaling(sims, dims=3).orderBy("doc_id").collect()])
    c = x - x.mean(axis=0)
    assert np.allclose(y @ y.T, c @ c.T)
    assert embed.tsne(sims, max_iter=10, dims=3).columns == ["doc_id", "x1", "x2", "x3"] and embed.classical_scaling(sims).columns == ["doc_id", "x", "y"]


def test_linear_classifiers(spark):
    rng = np.random.default_rng(7)
    cells = [(i, int(c), 1.0) for i in range(60) for c in {i % 3, *rng.integers(3, 9, 2)}]
    docs = spark.createDataFrame([(i,) for i in range(61)], "doc_id long")
    own = linear.vectors(spark.createDataFrame(cells, "doc_id long, col_idx long, value double"), 9, docs)
    labels = spark.createDataFrame([(i, i % 3) for i in range(40)], "doc_id long, category int")
    for method in ("logistic", "svm"):
        found = {r.doc_id: r.category for r in linear.classify(own, labels, own, method).collect()}
        assert len(found) == 61 and all(found[i] == i % 3 for i in range(60))
    with pytest.raises(ValueError, match="method"):
        linear.classify(own, labels, own, "tree")
