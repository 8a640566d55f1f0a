import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import packing as p
from tests.llm.conftest import docs_frame


def brute(lengths, capacity, linear, quadratic):
    """Lowest cost of the sequences with room, one by one."""
    n = max(1, -(-sum(lengths) // capacity))
    cost, room, out = [0.0] * n, [capacity] * n, []
    for x in lengths:
        fits = [k for k in range(len(cost)) if room[k] >= x]
        if not fits:
            cost.append(0.0)
            room.append(capacity)
            fits = [len(cost) - 1]
        k = min(fits, key=lambda k: (cost[k], k))
        out.append(k)
        cost[k] += linear * x + quadratic * x * x
        room[k] -= x
    return out


@given(st.lists(st.one_of(st.integers(0, 50), st.sampled_from([0, 1, 17, 26, 50])), max_size=80), st.sampled_from([(1.0, 1 / 2048), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)]))
@settings(max_examples=200, deadline=None)
def test_against_brute_force(lengths, costs):
    lengths = sorted(lengths, reverse=True)
    expected = brute(lengths, 50, *costs)
    assert p.place(np.array(lengths, np.int64), 50, *costs).tolist() == expected
    different = sorted(set(lengths), reverse=True)
    first, seq, each = p.plan(different, [lengths.count(n) for n in different], 50, *costs)
    at = np.arange(len(lengths))
    step = np.searchsorted(first, at, side="right") - 1
    assert (seq[step] + (at - first[step]) // each[step]).tolist() == expected if lengths else not len(first)


def test_steps_do_not_follow_the_number_of_pieces():
    lengths = list(range(8192, 0, -7))
    few, many = (len(p.plan(lengths, [k] * len(lengths), 8192)[0]) for k in (100, 100_000))
    assert many < 1.2 * few


def test_everything_is_packed_as_by_brute_force(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 250, 400).tolist()
    docs = docs_frame(spark, [(i, " ".join(["w"] * n), "s") for i, n in enumerate(sizes)]).repartition(5)
    rows = p.pack(docs, capacity=100).collect()
    assert {i: sum(r.n_tokens for r in rows if r.doc_id == i) for i in range(400)} == dict(enumerate(sizes))
    assert all(r.first_token == r.piece * 100 and r.cost == p.LINEAR * r.n_tokens + p.QUADRATIC * r.n_tokens**2 for r in rows)
    rows.sort(key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
    assert [r.seq_id for r in rows] == brute([r.n_tokens for r in rows], 100, p.LINEAR, p.QUADRATIC)


def test_the_query_against_brute_force(spark):
    """The registered query, over a whole table."""
    from textloom.llm.catalog import QUERIES

    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    pieces = sorted((-min(n - k, p.CAPACITY), r.doc_id, k // p.CAPACITY) for r in texts for n in [len((r.text or "").split())] for k in range(0, max(n, 1), p.CAPACITY))
    rows = sorted(QUERIES["op8_packing"](spark, "/root/testdata/sf0.01").collect(), key=lambda r: (-r.n_tokens, r.doc_id, r.piece))
    assert [(-r.n_tokens, r.doc_id, r.piece) for r in rows] == pieces
    assert [r.seq_id for r in rows] == brute([-n for n, _, _ in pieces], p.CAPACITY, p.LINEAR, p.QUADRATIC)


def test_odd_rows(odd, none):
    rows = p.pack(odd).collect()
    assert sum(r.n_tokens for r in rows if r.doc_id == 3) == 30_000 and len([r for r in rows if r.doc_id == 3]) == 4
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2, 5)] == [0, 0, 0]
    assert [r.n_tokens for r in rows if r.doc_id == 4] == [2, 2] and sum(r.doc_id is None for r in rows) == 1
    assert p.pack(none).count() == 0
