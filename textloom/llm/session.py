"""What the operators need of the session beside textloom.session: tables, and names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.session import cut, shared_folder

__all__ = ["cut", "quoted", "shared_folder", "table", "unused"]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column has them."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
