import random

import duckdb
import pytest

from textloom.llm import line_dedup as d
from tests.llm.conftest import docs_frame


def brute(rows, ratio, least):
    pages, seen = {}, {}
    for _, text, host in rows:
        if host is not None:
            pages[host] = pages.get(host, 0) + 1
            for line in {x.strip(" ") for x in (text or "").split("\n")} if text is not None else ():
                seen[host, line] = seen.get((host, line), 0) + 1
    bad = {k for k, n in seen.items() if k[1] and n >= least and n > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad)) for i, t, h in rows]


def test_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice(["Home", " Home ", "", "unique %d" % i, "Cookie notice", "seldom"]) for _ in range(rng.randrange(8))), rng.choice(["a", "b", "b", None])) for i in range(150)]
    docs = docs_frame(spark, rows)
    for ratio, least in ((0.2, 5), (0.6, 5), (0.0, 30)):
        assert sorted((r.doc_id, r.text) for r in d.dedup_lines(docs, ratio=ratio, min_pages=least).collect()) == sorted(brute(rows, ratio, least))


def test_query_and_sql_agree(spark):
    rows = [(i, f"menu\ntext {i}\n menu ", "h") for i in range(20)] + [(50, None, "h"), (51, "menu", None)]
    docs = docs_frame(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "source", "text").toArrow())
    found = sorted(map(str, (tuple(r) for r in d.dedup_lines(docs.select("doc_id", "source", "text"), counts=True).select("doc_id", "source", "text", "n_lines", "n_removed").collect() if r.doc_id < 50)))
    assert found == sorted(map(str, (r for r in con.execute(d.ORACLE).fetchall() if r[0] < 50)))


def test_small_hosts(spark):
    """A line on all pages of a small host goes, whatever their number; one on a single page stays."""
    docs = docs_frame(spark, [(i, f"menu\nonly here {i}", "small") for i in range(4)] + [(9, "menu\nalone", "tiny")])
    assert sorted((r.doc_id, r.text) for r in d.dedup_lines(docs).collect()) == [*((i, f"only here {i}") for i in range(4)), (9, "menu\nalone")]


def test_joined_lists_give_the_same(spark):
    rng = random.Random(10)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c %d" % rng.randrange(40)]) for _ in range(6)), rng.choice(["x", "x", "x", f"h{rng.randrange(20)}", None])) for i in range(300)]
    docs = docs_frame(spark, rows)
    found = d.dedup_lines(docs, broadcast_lines=0)
    assert "SortMergeJoin" in found._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.text) for r in found.collect()) == sorted((r.doc_id, r.text) for r in d.dedup_lines(docs).collect())


def test_names_that_clash(spark):
    names = ["__host", "__lines", "__old", "host_of_lines", "lines_of_host", "p", "line", "seen", "n_pages", "n_host", "odd `name"]
    docs = spark.createDataFrame([(i, f"menu\n{i}", "h", *range(len(names))) for i in range(5)], ["doc_id", "text", "source", *names])
    found = d.dedup_lines(docs, counts=True)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    assert [(r.text, r["__old"], r.n_lines, r.n_removed) for r in found.orderBy("doc_id").collect()] == [(str(i), 2, 2, 1) for i in range(5)]
    with pytest.raises(ValueError, match="n_removed"):
        d.dedup_lines(docs.withColumnRenamed("p", "n_removed"), counts=True)


def test_odd_rows(odd, none):
    """As by brute force; a line of the three pages that repeat it at a host of six goes, as it would at any host."""
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    found = d.dedup_lines(odd)
    assert found.columns == odd.columns and sorted(map(str, ((r.doc_id, r.text) for r in found.collect()))) == sorted(map(str, brute(rows, d.RATIO, d.MIN_PAGES)))
    once = odd.dropDuplicates(["text"])
    assert sorted(map(str, d.dedup_lines(once).collect())) == sorted(map(str, once.collect()))
    assert d.dedup_lines(none).count() == d.dedup_lines(none, counts=True).count() == 0
