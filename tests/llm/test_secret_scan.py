import numpy as np
import pytest

from textloom.llm import secret_scan as s
from tests.llm.conftest import docs_frame

TOKEN = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.fixture(scope="module")
def model():
    return s.fit(s.findings(3000, seed=1))


def test_accuracy_on_findings_held_out(model):
    labelled = s.findings(800, seed=2)
    inside, around, kind, y, finding = s._examples(labelled)
    p = 1 / (1 + np.exp(-model.network.logits(inside, around, kind) / model.temperature))
    hit = p >= model.threshold[kind]
    assert hit[y > 0].mean() > 0.93
    assert y[hit].mean() > 0.85
    assert len(set(finding[y > 0])) > 0.98 * sum(x[3] for x in labelled)  # nearly every secret is a candidate


def test_gradients_are_those_of_the_loss():
    inside, around, kind, y, _ = (x[:12] for x in s._examples(s.findings(40, seed=3)))
    n = s.Network(1)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    loss = lambda: float(np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * n.forward(inside, around, kind)[0])))
    g = n.gradients(inside, around, kind, y)
    for name in ("e", "c1", "c2", "h", "bo"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = n.p[name][at]
        n.p[name][at] = old + 1e-5
        up = loss()
        n.p[name][at] = old - 1e-5
        down = loss()
        n.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-3


def test_offsets_and_every_secret_of_a_text(spark, model):
    text = f'Été ñu token = "{TOKEN}" und wieder api_key={TOKEN[::-1]} ende'
    rows = s.find_secrets(docs_frame(spark, [(1, text, "s"), (1, text, "s"), (2, "plain prose, nothing: else 12345", "s")]), model).collect()
    assert sorted({text[r.start : r.start + r.n_chars] for r in rows}) == sorted({TOKEN, TOKEN[::-1]})
    assert len(rows) == 4 and {r.doc_id for r in rows} == {1}


def test_long_candidates_are_covered_whole():
    who, first, last = s.windows_of(np.array([0, 10]), np.array([500, 30]))
    assert set(np.concatenate([np.arange(a, b) for a, b, w in zip(first, last, who, strict=True) if w == 0])) == set(range(500))
    assert (who == 1).sum() == 1 and last.max() == 500


def test_candidates_stay_in_their_text():
    raw = b"password=abcdefgh12" + b"34567890abcdefghijkl"
    starts, ends, _ = s.candidates(raw, np.frombuffer(raw, np.uint8), np.array([0, 19, len(raw)]))
    assert [(a, b) for a, b in zip(starts, ends, strict=True)] == [(9, 19), (19, len(raw))]


def test_secrets_in_urls_are_candidates():
    raw = b"at postgres://admin:hunter2x@db.example:5432/main, see redis://:p@sswords@h and https://a.example:8080/x?id=7&token=abcdef&password=letmein#top"
    starts, ends, kinds = s.candidates(raw, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == [b"hunter2x", b"p@sswords", b"abcdef", b"letmein"] and not kinds.any()


def test_candidates_do_not_depend_on_the_text_before():
    texts = [b"id:", b"password=hunter2", b"https://a.example", b":secret99", b"-----BEGIN ", b"PRIVATE KEY-----"]
    raw, offs = b"".join(texts), np.cumsum([0, *map(len, texts)])
    starts, ends, _ = s.candidates(raw, np.frombuffer(raw, np.uint8), offs)
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == [b"hunter2"]


def alone(text: str, model: s.Model) -> list[tuple[int, int, str, float]]:
    """Brute force: one text, one candidate and one window at a time, convolutions as loops over positions."""
    raw, p, found = text.encode(), model.network.p, []
    data, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])

    def peaks(symbols: list[int], filters: str, bias: str, real: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        rows, half = [], s.TAPS // 2
        for i in range(len(symbols)):
            x = [p["e"][symbols[j]] if 0 <= j < len(symbols) else np.zeros(s.EMBED) for j in range(i - half, i + half + 1)]
            rows.append(np.maximum(np.concatenate(x) @ p[filters] + p[bias], 0) * real[i])
        return np.max(rows, axis=0), np.sum(rows, axis=0) / max(1, sum(real))

    for a, b, kind in zip(*s.candidates(raw, data, offs), strict=True):
        best = -np.inf
        for first in range(a, max(a + 1, b - s.WINDOW // 2), s.WINDOW // 2):
            last = min(first + s.WINDOW, b)
            symbol = lambda i: int(s._SYMBOL[raw[i]]) if 0 <= i < len(raw) else 0
            inside = [symbol(i) if i < last else 0 for i in range(first, first + s.WINDOW)]
            around = [symbol(i) for i in (*range(first - s.CONTEXT, first), *range(last, last + s.CONTEXT))]
            top, mean = peaks(inside, "c1", "b1", [x > 0 for x in inside])
            f = np.concatenate([top, mean, peaks(around, "c2", "b2", [True] * len(around))[0], np.eye(len(s.KINDS))[kind]])
            best = max(best, float((np.maximum(f @ p["h"] + p["bh"], 0) @ p["o"] + p["bo"])[0]))
            if last == b:
                break
        q = 1 / (1 + np.exp(-best / model.temperature))
        if q >= model.threshold[kind]:
            found.append((a, b, s.KINDS[kind], q))
    whole = [x for x in found if not any(y is not x and y[0] <= x[0] and x[1] <= y[1] for y in found)]
    return [(len(raw[:a].decode()), len(raw[a:b].decode()), k, q) for a, b, k, q in whole]


def test_against_brute_force(spark, model):
    """Every row as if it stood alone, whatever the partitions."""
    labelled = s.findings(60, seed=9)
    texts = [x[0] for x in labelled] + ["my note:", f"token={TOKEN}", "x" * 200 + "1", f"https://bob:hunter2pw@host.example and {TOKEN * 3}", "é" * 50 + ": pin=123"]
    docs = docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    expected = {(i, *x[:3]): x[3] for i, t in enumerate(texts) for x in alone(t, model)}
    for parts in (1, 7):
        rows = s.find_secrets(docs.repartition(parts), model).collect()
        found = {(r.doc_id, r.start, r.n_chars, r.kind): r.probability for r in rows}
        assert found.keys() == expected.keys() and len(rows) == len(found) and len(found) > 25
        assert all(abs(found[k] - expected[k]) < 1e-4 for k in found)


def test_every_candidate_is_one():
    """Short and digit-only values, parts of URLs, and candidates within others."""
    for text, value in ((b"https://host/path?api_key=hunter2secret", b"hunter2secret"), (b"https://bob:hunter2pw@host.example", b"hunter2pw"), (b"pin: 1234", b"1234"), (b"key 123456789012345678901234 end", b"123456789012345678901234"), (b"pw=abc", b"abc"), (b"path=ab/c0ffee00c0ffee00c0ffee00c0ff,x", b"ab/c0ffee00c0ffee00c0ffee00c0ff")):
        starts, ends, _ = s.candidates(text, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert value in [text[a:b] for a, b in zip(starts, ends, strict=True)], text


def test_findings_of_one_label_are_an_error():
    for labelled in ([], [("token=abcdef123", 6, 15, 1)], [("no candidate", 0, 2, 1)]):
        with pytest.raises(ValueError, match="findings"):
            s.fit(labelled)


def test_outermost_spans():
    assert s.outermost(np.array([0, 0, 2, 5, 5, 9]), np.array([8, 4, 8, 9, 12, 12])).tolist() == [True, False, False, False, True, False]


def test_odd_rows(odd, none, model):
    assert s.find_secrets(none, model).count() == 0
    assert s.find_secrets(odd, model).filter("doc_id is null").count() == 0
