import random

import numpy as np
import pytest

from textloom.llm import toxicity as t
from textloom.llm.arrow_text import flat
from tests.llm.conftest import docs_frame

import pyarrow as pa

CLEAN = "the garden was green and the river ran slowly past small stone houses where people talked about weather bread music and their children".split()
BAD = ["idiot", "scumbag", "moron"]


def sentence(rng: random.Random, n: int, extra: str = "") -> str:
    own = [rng.choice(CLEAN) for _ in range(n)]
    own.insert(rng.randrange(n), extra)
    return " ".join(own)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = [(i, sentence(rng, 30, rng.choice(BAD) if i % 4 == 0 else ""), "s") for i in range(240)]
    return docs_frame(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 240, 2)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(corpus):
    return t.fit(*corpus)


def test_held_out_accuracy(corpus, model):
    docs, labels = corpus
    found = {r.doc_id for r in t.find_toxic(docs, model).collect()}
    assert found == set(range(0, 240, 4))
    kept = t.drop_toxic(docs, model)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(range(240)) - found and kept.columns == docs.columns


@pytest.mark.parametrize("disguise", ["1d10t", "i.d.i.o.t", "i d i o t", "IDIOOOOT", "sc*u*m*b*a*g", "m0r0n", "$cumb@g", "i_d_i_o_t", "idi-ot", "iidiot", "id io t", "mooron", "scumb@g", "!d!0t", "m0ron!", "1d10t,", "sc.um.bag", "mörön", "id|ot"])
def test_disguises_are_undone(spark, model, disguise):
    rng = random.Random(8)
    rows = t.find_toxic(docs_frame(spark, [(1, sentence(rng, 12, disguise), "s"), (2, sentence(rng, 12), "s")]), model).collect()
    assert [(r.doc_id, r.n_restored > 0) for r in rows] == [(1, True)]


def test_the_best_path_is_the_best_of_all(model):
    """Viterbi against the enumeration of every path of the lattice."""
    from itertools import product

    lm = model.restorer.model

    def score(path) -> float:
        now, total = 0, 0.0
        for letters, cost in path:
            total += cost
            for x in letters:
                code = ord(x) - 96 if x != " " else 0
                if code or now:
                    total += lm[now, code]
                now = (now * t.A + code) % t.A**3 if code else 0
        return total

    for chunk in ("m0r0n", "1d1.0t", "b.r3ad"):
        best = max(product(*t.lattice(chunk), [(" ", 0.0)]), key=score)
        assert t.decode(chunk, lm) == "".join(letters for letters, _ in best).split()


def test_suspects_are_all_chunks_that_may_hold_a_cue():
    """Against every way to write the cue that the channel knows."""
    rng = random.Random(9)
    symbols: dict[str, list[str]] = {}
    for symbol, letters in t.LEET.items():
        for x in letters:
            symbols.setdefault(x, []).append(symbol)
    for _ in range(300):
        cue = rng.choice(["idiot", "scumbag", "assess", "little", "bomente"])
        written = "".join(rng.choice([x, x, *symbols.get(x, [])]) * rng.choice([1, 1, 1, 2, 3]) + rng.choice(["", "", "", rng.choice("._-*")]) for x in cue)
        text = f"of an {written} the end"
        starts, ends = t.suspects(*flat(pa.array([text])), np.array([t.skeleton(cue.encode())]))
        assert any(a <= 6 and b >= 6 + len(written.encode()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), written
    assert not len(t.suspects(*flat(pa.array(["of an idea the end"])), np.array([t.skeleton(b"idiot")]))[0])


def test_cues_are_counted_against_the_length():
    """One stray cue in a long text is no evidence, many are; both by the formula."""
    model = t.Model(t.Restorer(np.zeros((t.A**3, t.A))), *(lambda h: (h, np.array([4.0]), np.array([0.02]), np.array([0.1])))(list(t.features(*(lambda d, o: (d, o[:-1], o[1:]))(*flat(pa.array(["bomente"])))))[-1][1]), -2.0, np.array([t.skeleton(b"bomente")]))
    texts = ["bomente " + "word " * n for n in (9, 999)] + ["bomenteja " * 20 + "word " * 980, "word", ""]
    got = model.scores(*flat(pa.array(texts)))
    expected = [-2 + max(0, np.log(0.9 + 0.1 * np.exp(min(50, n * 4.0 - 0.02 * w)))) for n, w in ((1, 10), (1, 1000), (20, 1000))] + [-2, -2]
    assert np.allclose(got[0], expected) and got[1].tolist() == [1, 1, 1, 0, 0] and not got[2].any()


def test_letter_counts_do_not_cross_texts():
    counts = t.letter_counts(*flat(pa.array(["ab", "c"]))).reshape(t.A, t.A, t.A, t.A)
    assert counts[0, 0, 1, 2] == 1 and counts[0, 1, 2, 3] == 0 and counts[0, 0, 0, 3] == 1


def test_on_the_given_tables(spark):
    """Trained on the labels of even ids, tested on those of odd ids."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = {r.doc_id for r in t.find_toxic(docs, t.fit(docs, labels.filter("doc_id % 2 = 0"))).collect()}
    held = {r.doc_id: r.toxic for r in labels.filter("doc_id % 2 = 1").collect()}
    bad = [i for i, y in held.items() if y]
    assert np.mean([i in found for i in bad]) > 0.9
    assert np.mean([i in found for i, y in held.items() if not y]) < 0.01
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    for lang in ("en", "de", "fr", "es"):
        assert np.mean([i in found for i in bad if langs[i] == lang]) > 0.75, lang


def test_copies_of_a_text_count_once(spark):
    """A group of copies labelled toxic does not make all its words cues."""
    rng = random.Random(10)
    rows = [(i, sentence(rng, 30, rng.choice(BAD) if i % 4 == 0 else ""), "s") for i in range(120)] + [(1000 + i, "gardens idiot flowers parkland", "s") for i in range(40)]
    docs = docs_frame(spark, rows)
    model = t.fit(docs, spark.createDataFrame([(i, int(i % 4 == 0 or i > 999)) for i, _, _ in rows], "doc_id long, toxic int"))
    clean = docs_frame(spark, [(1, "gardens and flowers in the parkland", "s"), (2, "an idiot", "s")])
    assert [r.doc_id for r in t.find_toxic(clean, model).collect()] == [2]


def test_odd_rows(spark, odd, none, model):
    assert t.find_toxic(odd, model).count() == t.find_toxic(none, model).count() == 0
    assert t.drop_toxic(odd, model).count() == odd.count()
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    for docs, known in ((odd, labels), (none, labels), (odd, labels.limit(0)), (odd, labels.filter("toxic = 0"))):
        assert t.find_toxic(docs, t.fit(docs, known)).count() <= 1
