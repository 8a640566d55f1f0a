import random

from textloom.llm import substring_dedup
from textloom.llm.arrow_text import word_list
from textloom.llm.substring_dedup import pack_ints, repeated_passages, unpack_ints
from tests.llm.conftest import docs_frame, words

import numpy as np


def covered(texts: dict[int, str], k: int) -> set[tuple[int, int]]:
    """Brute force: words in a run of k that a lower document, or the document itself, holds before."""
    first, out = {}, set()
    for i in sorted(texts):
        own = word_list(texts[i])
        for p in range(len(own) - k + 1):
            if first.setdefault(tuple(own[p : p + k]), (i, p)) < (i, p):
                out |= {(i, q) for q in range(p, p + k)}
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    shared = [words(rng, n) for n in (5, 8, 13, 40)]
    texts = {i: " ".join([words(rng, rng.randrange(30)), rng.choice(shared), words(rng, rng.randrange(9)), rng.choice(shared), "Same, Same. same same same same"]) for i in range(40)}
    found = repeated_passages(docs_frame(spark, [(i, t, "s") for i, t in texts.items()]), k=5).collect()
    lists = {i: word_list(t) for i, t in texts.items()}
    for r in found:
        assert r.n_words >= 5 and (r.source_doc_id, r.source_first_word) < (r.doc_id, r.first_word)
        assert lists[r.doc_id][r.first_word : r.first_word + r.n_words] == lists[r.source_doc_id][r.source_first_word : r.source_first_word + r.n_words]
    assert {(r.doc_id, p) for r in found for p in range(r.first_word, r.first_word + r.n_words)} == covered(texts, 5)


def test_finer_buckets_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    shared = [words(rng, n) for n in (12, 30)]
    docs = docs_frame(spark, [(i, f"{words(rng, 200)} {rng.choice(shared)} {words(rng, 9)}", "s") for i in range(30)])
    expected = set(repeated_passages(docs, k=10).collect())
    monkeypatch.setattr(substring_dedup, "BUCKET_EDGES", 100)
    monkeypatch.setattr(substring_dedup, "COARSE", 2)
    monkeypatch.setattr(substring_dedup, "PARTITIONS", 8)
    assert set(repeated_passages(docs, k=10).collect()) == expected and len(expected) == 28


def spans(rows):
    return sorted((r.doc_id, r.first_word, r.n_words, r.source_doc_id, r.source_first_word) for r in rows.collect())


def test_a_repeat_is_one_row_whatever_else_holds_parts_of_it(spark):
    rng = random.Random(6)
    for k in (60, 120):  # the part held earlier; above 2 K - 1 words it leaves a gap
        whole = words(rng, 300)
        part = " ".join(whole.split()[70 : 70 + k])
        docs = docs_frame(spark, [(2, whole, "s"), (3, whole, "s"), (1, part, "s")])
        assert spans(repeated_passages(docs)) == [(2, 70, k, 1, 0), (3, 0, 300, 2, 0)]


def test_gaps_that_differ_are_not_joined(spark):
    """Two passages around a third document's, where the source has other words."""
    rng = random.Random(7)
    a, b, x, y = words(rng, 60), words(rng, 60), words(rng, 70), words(rng, 70)
    docs = docs_frame(spark, [(1, x, "s"), (2, f"{a} {y} {b}", "s"), (3, f"{a} {x} {b}", "s")])
    assert spans(repeated_passages(docs)) == [(3, 0, 60, 2, 0), (3, 60, 70, 1, 0), (3, 130, 60, 2, 130)]


def test_repeats_within_a_document(spark):
    rng = random.Random(8)
    passage, line = words(rng, 55), words(rng, 7)
    docs = docs_frame(spark, [(1, f"{passage} {words(rng, 5)} {passage}", "s"), (2, " ".join([line] * 40), "s")])
    assert spans(repeated_passages(docs)) == [(1, 60, 55, 1, 0), (2, 7, 273, 2, 0)]


def test_ids_of_other_types(spark):
    rng = random.Random(9)
    passage = words(rng, 55)
    for kind, ids in (("string", ["b", "a"]), ("smallint", [2, 1])):
        docs = spark.createDataFrame([(ids[0], passage), (ids[1], passage + " more")], "x string, text string" if kind == "string" else "x int, text string").selectExpr(f"cast(x as {kind}) doc_id", "text")
        found = repeated_passages(docs)
        assert spans(found) == [(ids[0], 0, 55, ids[1], 0)] and dict(found.dtypes)["source_doc_id"] == kind


def test_verification_by_join_gives_the_same(spark, monkeypatch):
    rng = random.Random(4)
    shared = words(rng, 30)
    docs = docs_frame(spark, [(i, f"{words(rng, 9)} {shared} {words(rng, 9)}", "s") for i in range(12)])
    expected = set(repeated_passages(docs, k=10).collect())
    monkeypatch.setattr(substring_dedup, "BROADCAST_SPANS", -1)
    assert set(repeated_passages(docs, k=10).collect()) == expected and len(expected) == 11


def test_a_long_passage_is_one_row(spark):
    rng = random.Random(2)
    passage = words(rng, 70)
    rows = repeated_passages(docs_frame(spark, [(9, words(rng, 20) + " " + passage, "s"), (3, passage + " " + words(rng, 20), "s")])).collect()
    assert [(r.doc_id, r.first_word, r.n_words, r.source_doc_id, r.source_first_word) for r in rows] == [(9, 20, 70, 3, 0)]


def test_odd_rows(odd, none):
    assert repeated_passages(odd).count() == 0
    assert repeated_passages(odd, k=2).filter("doc_id = 7 and source_doc_id = 4 and n_words = 2").count() == 1
    assert repeated_passages(none).count() == 0


def test_packing_of_integers():
    for x in (np.array([], np.int64), np.array([5]), np.array([-(2**62), 2**62, 0, 1]), np.arange(1000) * 300):
        assert (unpack_ints(pack_ints(x), 0)[0] == x).all()
