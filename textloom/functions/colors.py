"""Palettes and colour indices."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def color(i: int, n: int) -> tuple[float, float, float]:
    """The i-th of n hues, from 0 to 1 in red, green and blue."""
    return colorsys.hsv_to_rgb(i / (n + 1.0), 1.0, 0.8)


def channels(i: Column, n: Column | int) -> tuple[Column, Column, Column]:
    """color() of a column, full saturation, value 0.8."""
    n = F.lit(n) if isinstance(n, int) else n
    h6 = 6.0 * (i / (n + 1.0))
    sextant, f = F.floor(h6), h6 - F.floor(h6)
    v, p, q, t = F.lit(0.8), F.lit(0.0), 0.8 * (1.0 - f), 0.8 * (1.0 - (1.0 - f))
    choose = lambda *xs: F.when(sextant % 6 == 0, xs[0]).when(sextant % 6 == 1, xs[1]).when(sextant % 6 == 2, xs[2]).when(sextant % 6 == 3, xs[3]).when(sextant % 6 == 4, xs[4]).otherwise(xs[5])
    return choose(v, q, p, p, t, v), choose(t, v, v, q, p, p), choose(p, p, t, v, v, q)


def palette(spark: SparkSession, n: int = 100) -> DataFrame:
    """(idx, r, g, b)"""
    r, g, b = channels(F.col("id").cast("double"), n)
    return spark.range(n).select(F.col("id").alias("idx"), r.alias("r"), g.alias("g"), b.alias("b"))


def rgb_text(i: Column, n: Column | int) -> Column:
    """rgb(r,g,b) in 0 to 255, cut to whole numbers."""
    return F.concat(F.lit("rgb("), F.concat_ws(",", *[F.floor(c * 255).cast("string") for c in channels(i.cast("double"), n)]), F.lit(")"))


def color_index(table: DataFrame, column: str, n: int = 100, name: str = "color_idx") -> DataFrame:
    """The first of n even steps from the lowest to the highest value that is not below the value."""
    ends = table.agg(F.min(column).cast("double").alias("__low"), F.max(column).cast("double").alias("__high"))
    step = (F.col("__high") - F.col("__low")) / (n - 1)
    near = F.ceil(F.try_divide(F.col(column) - F.col("__low"), step))
    # floating-point edges: one step lower or higher may be the first that reaches the value
    reached = lambda k: F.col("__low") + k * step >= F.col(column)
    k = F.when(reached(near - 1) & (near > 0), near - 1).when(reached(near) | (near >= n - 1), near).otherwise(near + 1)
    return table.crossJoin(ends).withColumn(name, F.when(F.col("__high") == F.col("__low"), F.lit(0)).otherwise(F.least(k, F.lit(n - 1))).cast("int")).drop("__low", "__high")


def color_rows(table: DataFrame, column: str, n: int = 100) -> DataFrame:
    """table with r, g, b by the value of the column."""
    r, g, b = channels(F.col("color_idx").cast("double"), n)
    return color_index(table, column, n).withColumns({"r": r, "g": g, "b": b}).drop("color_idx")
