"""Line dedup by site-relative frequency.

A line is boilerplate of a host when more than `ratio` of the host's pages contain it, and `min_pages` of them (a line of a
single page repeats nothing, however small the host). One aggregation counts pages by (host, line); a marker line in every page
counts the host's pages in the same pass. Lines are keyed by a 64-bit hash, so no text is shuffled for counting.
Per host, fewer than (lines of a page / ratio) lines can pass, so each host's list stays short. Up to BROADCAST_LINES lines the
lists are broadcast and the pages stay where they are; beyond, pages are joined with their host's list, which shuffles them once by host, and adaptive execution splits hot hosts.

Defined results: lines are compared without leading and trailing spaces; blank lines always stay. A
missing text stays missing. Very long texts are cut whole. A page without a host keeps all its lines. A repeated row counts as
another page, and so does a copy, unless copies is False: then pages of a host with the same different lines in the same order count as one,
so that no copy group makes its own lines boilerplate. A page whose lines all go keeps an empty text. Other columns pass through untouched, whatever their names;
counts adds n_lines and n_removed, and raises ValueError if a column has such a name. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.session import cut, quoted, unused

RATIO, MIN_PAGES = 0.08, 2
#: Boilerplate lines up to which the lists are sent to every executor (some 10 MB).
BROADCAST_LINES = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(host, line, n_pages, n_host): hashes of the lines that exceed the ratio."""
    blank = F.xxhash64(F.lit(""))
    seen = F.array_distinct(F.concat(F.array(blank), F.transform(F.coalesce(_lines(F.col(quoted(text))), F.array()), _key)))
    own = pages.filter(F.col(quoted(host)).isNotNull()).select(F.col(quoted(host)).alias("host"), seen.alias("seen"))
    own = own if copies else own.distinct()
    counts = own.select("host", F.explode("seen").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    counts = counts.filter((F.col("n_pages") >= min_pages) | (F.col("line") == blank))
    lines, hosts = counts.filter(F.col("line") != blank), counts.filter(F.col("line") == blank).select("host", F.col("n_pages").alias("n_host"))
    return lines.join(hosts, "host").filter(F.col("n_pages") > ratio * F.col("n_host")).select("host", "line", "n_pages", "n_host")


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False, copies: bool = True, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """pages with the boilerplate lines cut from the text; counts adds n_lines and n_removed."""
    clash = {"n_lines", "n_removed"} & {c.lower() for c in pages.columns}
    if counts and clash:
        raise ValueError(f"pages have columns {', '.join(sorted(clash))}, which counts would add")
    found = cut(boilerplate(pages, host, text, ratio, min_pages, copies))
    name, listed = unused(pages.columns, "host_of_lines", "lines_of_host")
    lists = found.groupBy(F.col("host").alias(name)).agg(F.collect_list("line").alias(listed))
    lists = F.broadcast(lists) if found.count() <= broadcast_lines else lists.hint("merge")
    both = pages.join(lists, F.col(quoted(host)) == F.col(name), "left")
    old, bad = F.col(quoted(text)), F.col(listed)
    new = F.when(bad.isNull(), old).otherwise(F.array_join(F.filter(_lines(old), lambda x: (F.trim(x) == "") | ~F.array_contains(bad, _key(x))), "\n"))
    n = lambda c: F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.size(_lines(c)))
    added = [n(old).alias("n_lines"), (n(old) - n(new)).alias("n_removed")] if counts else []
    return both.select(*[new.alias(c) if c == text else F.col(quoted(c)) for c in pages.columns], *added)


ORACLE = f"""
WITH l AS (SELECT doc_id, source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM documents WHERE source IS NOT NULL),
h AS (SELECT source, count(*) AS n_host FROM documents WHERE source IS NOT NULL GROUP BY source),
b AS (SELECT l.source, line FROM l JOIN h ON l.source = h.source WHERE line <> '' GROUP BY l.source, line, n_host HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * n_host),
s AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
r AS (SELECT doc_id, d.source, string_split(text, chr(10)) AS old,
  list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad, []), trim(x))) AS new
  FROM documents d LEFT JOIN s ON d.source = s.source)
SELECT doc_id, source, array_to_string(new, chr(10)) AS text,
  CASE WHEN array_to_string(old, '') = '' AND len(old) = 1 THEN 0 ELSE len(old) END::INTEGER AS n_lines,
  (CASE WHEN array_to_string(old, '') = '' AND len(old) = 1 THEN 0 ELSE len(old) END - CASE WHEN array_to_string(new, chr(10)) = '' THEN 0 ELSE len(new) END)::INTEGER AS n_removed
FROM r
"""
