import random

import corpus_pipeline
import __spark_entry__
from textloom.llm import line_dedup, near_dedup, packing, token_counts, toxicity
from tests.llm import test_decontaminate, test_near_dedup, test_packing, test_tokens
from tests.llm.conftest import CLASHING, docs_frame, words


def test_every_decision_takes_effect(spark, tmp_path):
    rng = random.Random(11)
    item = words(rng, 20)
    rows, labels, gone = [], [], set()
    for i in range(300):
        text = words(rng, 60)
        if i % 5 == 0:
            text += f" you total scumbag{rng.choice(['', ' idiot'])} " + words(rng, 5)
            gone.add(i)
        elif i % 31 == 1:
            text = f"{text} {item} {words(rng, 9)}"
            gone.add(i)
        elif i % 31 == 2:
            text = next(t for j, t, _ in rows if j == i - 1 or j == 3 or j == 4).replace("\nCookie notice\n", " ") + " more words here"
        rows.append((i, f"{text}\nCookie notice\n", f"site{i % 4}"))
        labels.append((i, int(i % 5 == 0)))
    docs = docs_frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in now.collect()}
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
        after = {r.doc_id: r for r in now.collect()}
        dropped = before - after.keys()
        if name == "toxicity":
            assert dropped == {i for i in range(300) if i % 5 == 0}
        elif name == "line_dedup":
            assert not dropped and all("Cookie notice" not in r.text.split("\n") and r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            assert dropped and all(i % 31 in (1, 2) for i in dropped)
        else:
            assert dropped == {i for i in before if i % 31 == 1 or item in after.get(i, rows[i])[1]}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == after.keys()
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(now).collect()}
    assert all(sum(r.n_tokens for r in packed if r.doc_id == i) == counts[i] for i in after)


def test_copy_group_above_the_ratio_keeps_its_content(spark, tmp_path):
    rng = random.Random(12)
    copied = "\n".join(words(rng, 12) for _ in range(4))
    rows = [(i, "Cookie notice\n" + (copied + " " * (i % 2) if i % 3 == 0 else words(rng, 40)), "site") for i in range(60)]
    now = docs_frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
    assert {r.doc_id: r.text.strip() for r in now.collect()} == {i: t.removeprefix("Cookie notice\n").strip() for i, t, _ in rows if i % 3 or i == 0}


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    docs_frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def brute(rows: list[tuple], toxic: set, items: dict[int, str]) -> list[tuple]:
    """The pipeline over (doc_id, text, source) without Spark: toxic rows are given; every other stage is by its definition, all pairs and all windows."""
    rows = [r for r in rows if r[0] is None or r[0] not in toxic]
    # lines
    pages: dict = {}
    for _, text, host in rows:
        if host is not None:
            own = list(dict.fromkeys(x.strip(" ") for x in (text or "").split("\n")))
            pages.setdefault(host, set()).add(tuple(x for x in own if x))
    bad = {(h, x) for h, own in pages.items() for x in {x for p in own for x in p} if (n := sum(x in p for p in own)) >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * len(own)}
    rows = [(i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad), h) for i, t, h in rows]
    # near duplicates: components of all pairs
    own = sorted({(i, t) for i, t, _ in rows if i is not None and test_near_dedup.word_list(t)})
    root = {x: x for x in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(own):
        for b in own[:n]:
            same = test_near_dedup.word_list(a[1]) == test_near_dedup.word_list(b[1])
            if same or test_near_dedup.similarity(a[1].lower(), b[1].lower()) >= near_dedup.THRESHOLD:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept, seen = [], set()
    for i, t, h in rows:
        if (i, t) in root:
            if find((i, t)) != (i, t) or (i, t) in seen:
                continue
            seen.add((i, t))
        kept.append((i, t, h))
    # benchmark, tokens, sequences
    leaked = {n for n, _ in test_decontaminate.brute({n: t for n, (_, t, _) in enumerate(kept) if t}, items)}
    listed, byte_pieces = token_counts.vocabulary()
    pieces, unknown = dict(listed), token_counts.Segmenter(listed).unknown
    sized = [(i, test_tokens.brute((" " + t if t else "").replace(" ", token_counts.MARK), pieces, unknown, byte_pieces)[1]) for n, (i, t, _) in enumerate(kept) if n not in leaked]
    cut = sorted((-min(n - k, packing.CAPACITY), i is not None, i or 0, k // packing.CAPACITY) for i, n in sized for k in range(0, max(n, 1), packing.CAPACITY))
    seq = test_packing.brute([-n for n, *_ in cut], packing.CAPACITY, packing.LINEAR, packing.QUADRATIC)
    return sorted(str((i if known else None, piece, -n, s)) for (n, known, i, piece), s in zip(cut, seq, strict=True))


def test_against_brute_force(spark, tmp_path):
    """All stages together, with missing and empty texts, rows without id, repeated rows and ids, and clashing columns."""
    rng = random.Random(21)
    items = {j: words(rng, rng.choice([16, 24])) for j in range(3)}
    rows: list[tuple] = []
    for i in range(120):
        text = words(rng, rng.choice([0, 3, 40, 70]))
        if i % 11 == 3:
            text = f"{text} {items[i % 3]}"
        if i % 6 == 0:
            text += rng.choice([" you idiot ", " idiot scumbag "]) + words(rng, 9)
        if i % 7 == 5:
            text = rows[rng.randrange(len(rows))][1] or ""
        if i % 7 == 6:
            text = test_near_dedup.changed(rng, rows[-1][1], 1) if rows[-1][1] and len(rows[-1][1].split()) > 30 else text
        rows.append((i, rng.choice([text, f"Cookie notice\n{text}", f"{text}\n\n Cookie notice "]), rng.choice(["a", "a", "b", None])))
    rows += [(200, None, "a"), (201, "", "a"), (201, "", "a"), (7, rows[7][1], "b"), (8, words(rng, 30), "a"), (None, rows[9][1], "a"), (None, None, None)]
    folder = str(tmp_path)
    docs = docs_frame(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("idiot" in (t or ""))) for i, t, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stored = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id for r in toxicity.find_toxic(stored, toxicity.fit(stored, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    assert found == {i for i, y in labels if y}
    first = corpus_pipeline.STAGES[0][1](spark, stored, folder)
    assert first.columns == docs.columns and set(CLASHING) < set(first.columns)
    got = sorted(str((r.doc_id, r.piece, r.n_tokens, r.seq_id)) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == brute(rows, found, items) and 60 < len(got) < 110


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
