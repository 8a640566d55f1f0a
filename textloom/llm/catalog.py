"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, line_dedup, near_dedup, neighbours, packing, secret_scan, substring_dedup, token_binary, token_counts, toxicity
from textloom.llm.session import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"), secret_scan.fit())


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.write_blocks(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.find_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id 50 divides; all rows are searched."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, queries=rows.filter("vec_id % 50 = 0"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_decontaminate, op4_token_binary, op5_token_counts, op6_toxicity, op7_neighbours, op8_packing, op9_near_dedup, op10_line_dedup)}
ORACLES = {"op10_line_dedup": line_dedup.ORACLE}
