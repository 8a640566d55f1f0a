"""The corpus pipeline: toxic documents go, boilerplate lines go, one of each group of near duplicates stays,
documents that hold benchmark items go, and the rest is packed into sequences.

Every stage takes what its predecessor wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, line_dedup, near_dedup, packing, token_counts, toxicity
from textloom.llm.session import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the toxic ones, by a model of these documents and the labels. Missing and empty texts stay, rows without id are judged like others, repeated rows alike."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the boilerplate lines of their source cut; the length of the text follows it, and a missing text has none.

    Copies of a document count as one page, as near_dedup comes later. All rows stay; a text may become empty.
    """
    cut = line_dedup.dedup_lines(docs, copies=False)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the lowest id. Texts without words, and rows without id, have no duplicates and stay."""
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item. Missing and empty texts hold none; an empty benchmark drops nothing."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs and their sequences, by token counts; a document without tokens is one piece of 0."""
    return packing.pack(token_counts.count_tokens(docs), tokens="n_tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]
#: Deobfuscation, signatures, fingerprints and greedy packing are not SQL; a test holds run() against a brute-force version of every stage but the toxicity model's fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written as Parquet to the shared folder and read again; only the last one's stays there."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/corpus-{uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            file = spark._jvm.org.apache.hadoop.fs.Path(before)
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)
        before = path
    return docs
