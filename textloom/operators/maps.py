"""Operators on keyed maps, held as long tables or as MAP columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

NORMS = ("binary", "sum", "max", "length", "mean", "std")


def invert(table: DataFrame, key: str, value: str) -> DataFrame:
    """(value, keys): the keys of each value, sorted; a key that holds a value twice is listed twice."""
    return table.groupBy(value).agg(F.sort_array(F.collect_list(key)).alias("keys"))


def invert_lists(table: DataFrame, key: str, values: str) -> DataFrame:
    """invert() of a column of arrays, or of the keys of a column of maps."""
    kind = dict(table.dtypes)[values]
    each = F.map_keys(values) if kind.startswith("map") else F.col(values)
    return invert(table.select(key, F.explode(each).alias("value")), key, "value")


def transpose(table: DataFrame, row: str, entries: str) -> DataFrame:
    """(key, entries): a map of maps turned round, {row: {key: value}} to {key: {row: value}}."""
    cells = table.select(row, F.explode(entries).alias("key", "value"))
    return cells.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(row, "value")))).alias("entries"))


def select_keys(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed; keys that are missing or listed twice make no difference."""
    return table.join(ids.select(key), key, "left_semi")


def vector_to_map(vector: Column) -> Column:
    """{position: value}, from 0; zeros stay."""
    return F.map_from_arrays(F.sequence(F.lit(0), F.size(vector) - 1), vector)


def norm_size(value: Column, norm: str, over, n_all: int = 0) -> Column:
    """What a row's values are divided by; over: the aggregation (a window, or None in a grouping)."""
    agg = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n = F.greatest(F.lit(n_all), agg(F.count(value))).cast("double")
    total = agg(F.sum(value))
    if norm == "sum":
        return total
    if norm == "max":
        return agg(F.max(F.abs(value)))
    if norm == "length":
        return F.sqrt(agg(F.sum(value * value)))
    if norm == "mean":
        return total / n
    if norm == "std":
        missing = n - agg(F.count(value))
        mean = total / n
        spread = agg(F.var_pop(value)) * agg(F.count(value))
        own_mean = agg(F.avg(value))
        return F.sqrt((spread + agg(F.count(value)) * (own_mean - mean) * (own_mean - mean) + missing * mean * mean) / n)
    raise ValueError(f"unknown norm {norm!r}; known: {', '.join(NORMS)}")


def normalise(table: DataFrame, key: str, value: str = "value", norm: str = "max", n_all: int = 0) -> DataFrame:
    """value of each row divided by the norm over its key; a norm of 0 changes nothing.

    mean and std (of the population) count zeros up to n_all values.
    """
    if norm == "binary":
        return table.withColumn(value, F.lit(1.0))
    size = norm_size(F.col(value).cast("double"), norm, Window.partitionBy(key), n_all)
    return table.withColumn("__size", size).withColumn(value, F.when(F.col("__size") != 0, F.col(value) / F.col("__size")).otherwise(F.col(value).cast("double"))).drop("__size")


def fixed(c: Column) -> Column:
    """c, to be computed once a row: a generator, so that the optimiser doesn't write it into a function of array elements that uses it."""
    return F.explode(F.array(c))


def list_size(entries: Column, norm: str, n_all: int = 0) -> Column:
    """norm_size() within a row, of an array of (term, value)."""
    if norm not in NORMS:
        raise ValueError(f"unknown norm {norm!r}; known: {', '.join(NORMS)}")
    add = lambda f: F.aggregate(entries, F.lit(0.0), lambda a, x: a + f(x["value"]))
    n = F.nullif(F.greatest(F.lit(n_all), F.size(entries)).cast("double"), F.lit(0.0))
    if norm == "max":
        return F.aggregate(entries, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x["value"])))
    if norm == "length":
        return F.sqrt(add(lambda v: v * v))
    if norm == "std":
        # running count, mean and sum of squared distances from it
        start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

        def step(a: Column, x: Column) -> Column:
            d = x["value"] - a["m"]
            m = a["m"] + d / (a["n"] + 1.0)
            return F.struct((a["n"] + 1.0).alias("n"), m.alias("m"), (a["s"] + d * (x["value"] - m)).alias("s"))

        own = lambda a: F.sqrt((a["s"] + a["n"] * (1 - a["n"] / n) * a["m"] * a["m"]) / n)
        return F.aggregate(entries, start, step, own)
    return add(lambda v: v) if norm == "sum" else add(lambda v: v) / n


def normalise_lists(table: DataFrame, entries: str = "entries", norm: str = "max", n_all: int = 0) -> DataFrame:
    """normalise() of rows that hold all their values as an array of (term, value): nothing is shuffled."""
    if norm == "binary":
        return table.withColumn(entries, F.transform(entries, lambda x: F.struct(x["term"].alias("term"), F.lit(1.0).alias("value"))))
    sized = table.select("*", fixed(list_size(F.col(entries), norm, n_all)).alias("__size"))
    scaled = F.transform(entries, lambda x: F.struct(x["term"].alias("term"), F.when(F.col("__size") != 0, x["value"] / F.col("__size")).otherwise(x["value"]).alias("value")))
    return sized.withColumn(entries, scaled).drop("__size")


_MERGES = {"max": F.greatest, "min": F.least, "sum": lambda a, b: a + b, "mean": lambda a, b: (a + b) / 2}


def on_columns(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """f as an op of combine() that takes and returns Columns, so that no value leaves the engine."""
    f.on_columns = True
    return f


def combine(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value", op: str | Callable = "max", result: DataType | str = "double") -> DataFrame:
    """Full outer merge; values of shared keys go through op, which is a name or a function of a list of two numbers (or of two Columns, marked by on_columns())."""
    a, b = F.col("__a"), F.col("__b")
    if getattr(op, "on_columns", False):
        merge = op
    elif callable(op):

        @F.arrow_udf(result)
        def merge(x: pa.Array, y: pa.Array) -> pa.Array:  # in batches; an engine may evaluate it where a key is exclusive
            both = zip(x.to_pylist(), y.to_pylist(), strict=True)
            return pa.array([None if v is None or w is None else op([v, w]) for v, w in both], to_arrow_type(kind))

        kind = DataType.fromDDL(result) if isinstance(result, str) else result
    elif op in _MERGES:
        merge = _MERGES[op]
    else:
        raise ValueError(f"unknown op {op!r}; known: {', '.join(_MERGES)}")
    both = left.select(*keys, F.col(value).alias("__a")).join(right.select(*keys, F.col(value).alias("__b")), keys, "full")
    return both.select(*keys, F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge(a, b)).alias(value))
