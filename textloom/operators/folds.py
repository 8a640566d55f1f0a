"""Folds for cross-validation, by position in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import cut

#: Characters of the sort key by which rows are dealt to ranges.
PREFIX = 3


def positions(rows: DataFrame, key: list[str], part: list[Column], name: str = "idx") -> DataFrame:
    """rows with their position, from 0, in the order of (part, key).

    part is a coarse sort key that agrees with the order: rows are ranked within each part, and the parts' sizes are added up, so that no window spans the table.
    """
    names = [f"__part{i}" for i in range(len(part))]
    dealt = rows.select("*", *[c.alias(n) for c, n in zip(part, names, strict=True)])
    before = F.coalesce(F.sum("count").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy(*names).count().withColumn("__before", before).drop("count")
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(*key)) - 1
    return dealt.withColumn("__rank", rank).join(sizes, names).withColumn(name, (F.col("__rank") + F.col("__before")).cast("long")).drop("__rank", "__before", *names)


def ranked(rows: DataFrame, *keys: str, name: str = "idx") -> DataFrame:
    """rows with their position, from 0, in the order of keys of any type: sorted by ranges, and numbered by the sizes of the ranges."""
    at, part, size, before = "__at", "__part", "__size", "__before"
    placed = cut(rows.orderBy(*keys).withColumn(at, F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count(F.lit(1)).alias(size)).orderBy(part).collect()
    sums, total = [], 0
    for r in sizes:
        sums.append((r[part], total))
        total += r[size]
    starts = rows.sparkSession.createDataFrame(sums, f"{part} long, {before} long")
    own = placed.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(starts), part)
    return own.withColumn(name, F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, part, before)


def kfold(ids: DataFrame, k: int = 10, doc_id: str = "doc_id") -> DataFrame:
    """(fold, doc_id, is_test): the document at position i of the sorted ids (of any type) is tested in fold i % k and trained on in the others."""
    return _spread(ranked(ids.select(doc_id), doc_id), k, doc_id)


def _spread(placed: DataFrame, k: int, *columns: str) -> DataFrame:
    own = placed.withColumn("fold", F.explode(F.array([F.lit(i) for i in range(k)])))
    return own.select("fold", *columns, (F.pmod("idx", F.lit(k)) == F.col("fold")).alias("is_test"))


def balanced_kfold(labels: DataFrame, k: int = 10, seed: int = 0, doc_id: str = "doc_id", category: str = "category") -> DataFrame:
    """(fold, category, doc_id, is_test): kfold() over categories one after another, each in an order shuffled by the seed."""
    keyed = labels.select(category, doc_id, F.md5(F.concat(F.lit(f"{seed}:").cast("binary"), F.col(doc_id).cast("string").cast("binary"))).alias("__key"))
    placed = positions(keyed, ["__key", doc_id], [F.col(category), F.substring("__key", 1, PREFIX)])
    return _spread(placed, k, category, doc_id)


def shuffle_split(ids: DataFrame, share: float = 0.2, seed: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, is_test): the first floor(share * n) in an order shuffled by the seed are tested."""
    keyed = ids.select(doc_id, F.md5(F.concat(F.lit(f"{seed}:").cast("binary"), F.col(doc_id).cast("string").cast("binary"))).alias("__key"))
    placed = positions(keyed, ["__key", doc_id], [F.substring("__key", 1, PREFIX)])
    n = ids.agg(F.floor(F.count(F.lit(1)) * share).alias("n"))
    return placed.crossJoin(n).select(doc_id, (F.col("idx") < F.col("n")).alias("is_test"))
