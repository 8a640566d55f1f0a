import numpy as np

from textloom.llm import neighbours as n


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in v], "clash", "clash", "clash", 1, "clash") for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "vec_id long, embedding array<float>, id string, v string, c string, own int, d string")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 32)), rng.normal(size=(20, 32))[rng.integers(20, size=300)] + 0.2 * rng.normal(size=(300, 32))])
    rows = n.nearest(frame(spark, x), k=5, block=300).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    true = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    found = {(r.vec_id, r.neighbour_id) for r in rows}
    assert len(rows) == 5 * len(x) and len(true & found) / len(true) > 0.9
    assert all(abs(r.similarity - s[r.vec_id, r.neighbour_id]) < 1e-5 for r in rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r.vec_id, r.rank)):
        by.setdefault(r.vec_id, []).append(r)
    assert all([r.rank for r in own] == [1, 2, 3, 4, 5] and all(a.similarity >= b.similarity for a, b in zip(own, own[1:], strict=False)) for own in by.values())


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(256, size=(400, 4), dtype=np.uint8)
    codes[200:] = codes[:200] ^ np.packbits(rng.random((200, 32)) < 0.1, axis=1)
    index = n.Index(np.zeros((400, 2), np.float32), codes, 32)
    assert 4 * len(n.probes(1)) < 256 < 4 * len(n.probes(3))  # lists and counts are both tried
    for t in range(4):
        far = np.bitwise_count(codes[:, None] ^ index.codes[None]).sum(axis=2)
        assert (index.within(codes, t) == (far < 4 * (t + 1))).all()


def test_queries_among_all_rows(spark):
    """A set of queries gets what it gets when all rows are queries, however the rows are dealt."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(200, 16)), rng.normal(size=(4, 16))[rng.integers(4, size=200)] + 0.05 * rng.normal(size=(200, 16))])
    rows = frame(spark, x)
    every = {(r.vec_id, r.rank): (r.neighbour_id, round(r.similarity, 5)) for r in n.nearest(rows, k=4).collect()}
    some = {(r.vec_id, r.rank): (r.neighbour_id, round(r.similarity, 5)) for r in n.nearest(rows, k=4, queries=rows.filter("vec_id % 50 = 0"), block=90).collect()}
    assert {i for i, _ in some} == set(range(0, 400, 50)) and len(some) == 4 * 8
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {(i, int(j)) for i in range(0, 400, 50) for j in np.argsort(-(u[i] @ u.T) + 9.0 * (np.arange(400) == i))[:4]}
    assert len(true & {(i, j) for (i, _), (j, _) in some.items()}) / len(true) > 0.9 and len(true & {(i, j) for (i, _), (j, _) in every.items()}) / len(true) > 0.9
    assert n.nearest(rows, queries=rows.limit(0)).count() == 0


def test_many_dimensions_and_string_ids(spark):
    rng = np.random.default_rng(7)
    for dim in (1536, 3072, 3):
        base = rng.normal(size=(12, dim))
        x = base[np.arange(60) % 12] + 0.1 * rng.normal(size=(60, dim))
        rows = spark.createDataFrame([(f"v{i:02d}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>")
        found = n.nearest(rows, k=4, queries=rows.filter("vec_id < 'v12'")).collect()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        true = {(f"v{i:02d}", f"v{j:02d}") for i in range(12) for j in np.argsort(-(u[i] @ u.T) + 9.0 * (np.arange(60) == i))[:4]}
        assert len(true & {(r.vec_id, r.neighbour_id) for r in found}) >= 0.9 * len(true) and len(found) == 48


def test_recall_of_the_query_on_the_given_table(spark):
    """The registered query against brute force over the whole table."""
    from textloom.llm.catalog import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    u, ids = x / np.linalg.norm(x, axis=1, keepdims=True), rows.vec_id.to_numpy()
    found = QUERIES["op7_neighbours"](spark, "/root/testdata/sf0.1").collect()
    asked = np.flatnonzero(ids % 50 == 0)
    true = {(int(ids[i]), int(ids[j])) for i in asked for j in np.argsort(-(u[i] @ u.T) + 9.0 * (np.arange(len(ids)) == i))[:10]}
    assert len(found) == 10 * len(asked) and len(true & {(r.vec_id, r.neighbour_id) for r in found}) / len(true) > 0.9


def test_radius_covers_all_but_the_given_share():
    from math import acos, comb, pi

    assert n.radius_needed(np.array([-1.0, 0.0, 1.0]), 4096).tolist()[::2] == [4096, 0]
    for s in (0.0, 0.5, 0.9):
        p, r = acos(s) / pi, int(n.radius_needed(np.array([s]), 64, 0.05)[0])
        beyond = lambda r: sum(comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(r + 1, 65))
        assert beyond(r) <= 0.051 and beyond(r - 1) > 0.045


def test_rotation_keeps_lengths():
    x = np.random.default_rng(3).normal(size=(200, 10))
    coder = n.fit(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert np.allclose(coder.rotation @ coder.rotation.T, np.eye(10))


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [1.0, None, 0.0]), (7, [float("nan"), 0.0, 1.0]), (8, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]), (9, [])]
    found = n.nearest(spark.createDataFrame(rows, schema)).collect()
    assert {(r.vec_id, r.rank, r.neighbour_id) for r in found} == {(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)}
    assert n.nearest(spark.createDataFrame([], schema)).count() == 0
    assert n.nearest(spark.createDataFrame(rows[:1], schema)).count() == 0
    same = n.nearest(spark.createDataFrame([(i, [1.0, 1.0]) for i in range(30)], schema), k=3).collect()
    assert {(r.vec_id, r.rank, r.neighbour_id) for r in same if r.vec_id == 1} == {(1, 1, 0), (1, 2, 2), (1, 3, 3)}
