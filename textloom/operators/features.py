"""Texts to sparse tf-idf features, by a fitted model.

Features are long: (doc_id, term, value). Documents without terms have no rows there, so the table of documents goes beside it; they
count in the number of documents. Terms whose weight is 0 keep their rows. Ids of documents are unique.

A document's counts and their norms are made within its row. To fit, one row for each term and partition is shuffled; to transform, nothing:
workers look weights up by 64-bit hash in files that they map into memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import clean_text, tokens
from textloom.operators.blocks import Packed, save_weights, weighted, weighted_long
from textloom.operators.maps import fixed, normalise_lists
from textloom.operators.phrases import find_bigrams, replace_bigrams
from textloom.session import cut


def term_lists(clean: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, entries): each document's terms and counts, as an array of (term, value), from its sorted words."""
    words = F.array_sort(tokens(F.coalesce(F.col(text), F.lit(""))))
    rows = clean.select(F.col(doc_id).alias("doc_id"), fixed(words).alias("w"))
    starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i == 1) | (F.get("w", i - 1) != F.get("w", i - 2)))
    starts = F.when(F.size("w") > 0, F.concat(starts, F.array(F.size("w") + 1))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "w", fixed(starts).alias("at"))
    entries = F.zip_with(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda i, j: F.struct(F.get("w", i - 1).alias("term"), (j - i).cast("double").alias("value")))
    return rows.select("doc_id", entries.alias("entries"))


def long(lists: DataFrame) -> DataFrame:
    """(doc_id, term, value) of (doc_id, entries)."""
    return lists.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.term", "e.value")


def term_counts(clean: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return long(term_lists(clean, doc_id, text))


def idf_weights(features: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, weight) of features, one row for each document and term: ln(n_docs / df) over the largest of them; all 0 stays 0."""
    df = features.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("idf", F.log(F.lit(float(max(n_docs, 1))) / F.col("df")))
    top = raw.agg(F.max(F.abs("idf")).alias("top"))
    return raw.crossJoin(F.broadcast(top)).select("term", "df", F.when(F.col("top") != 0, F.col("idf") / F.col("top")).otherwise(F.col("idf")).alias("weight"))


def _hashes() -> Column:
    return F.transform("entries", lambda e: F.xxhash64(e["term"]))


@dataclass
class TfidfModel:
    """What fitting finds: phrases and weights. Both are tables, saved and read as Parquet."""

    params: Tfidf
    bigrams: DataFrame | None
    weights: DataFrame | None
    #: The weights as workers read them, once they have been needed.
    files: list[tuple[int, str]] | None = None

    def prepared(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        p = self.params
        clean = docs.select(F.col(doc_id).alias("doc_id"), clean_text(F.col(text), p.to_lower, p.norm_num).alias("text"))
        return clean if self.bigrams is None else replace_bigrams(clean, self.bigrams)

    def _lists(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        """(doc_id, entries), up to the weights: where there are any, their files are there as well and the last norm is not applied."""
        p = self.params
        lists = term_lists(self.prepared(docs, doc_id, text))
        if p.norm:
            lists = normalise_lists(lists, norm=p.norm)
        if self.weights is None:
            return normalise_lists(lists, norm=p.renorm) if p.renorm else lists
        if self.files is None:
            self.files = save_weights(self.weights)
        return lists

    def transform(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, term, value); terms that fitting did not see go."""
        lists = self._lists(docs, doc_id, text)
        if self.weights is None:
            return long(lists)
        table = lists.select("doc_id", F.col("entries.term").alias("names"), _hashes().alias("terms"), F.col("entries.value").alias("values"))
        return table.mapInArrow(weighted_long(self.files, self.params.renorm), f"doc_id {table.schema['doc_id'].dataType.simpleString()}, term string, value double")

    def packed(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Packed:
        """transform() with one row for each document, those without terms included, and terms as hashes."""
        table = self._lists(docs, doc_id, text).select("doc_id", _hashes().alias("terms"), F.col("entries.value").alias("values"))
        return Packed(table, None if self.weights is None else weighted(self.files, self.params.renorm))

    def save(self, path: str) -> None:
        for name in ("bigrams", "weights"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str, params: Tfidf) -> TfidfModel:
        return TfidfModel(params, spark.read.parquet(f"{path}/bigrams") if params.identify_bigrams else None, spark.read.parquet(f"{path}/weights") if params.weight else None)


@dataclass
class Tfidf:
    """Parameters; norms are names of maps.NORMS, or None for none."""

    norm: str | None = "max"
    weight: bool = True
    renorm: str | None = "length"
    identify_bigrams: bool = True
    to_lower: bool = True
    norm_num: bool = True
    bg_threshold: float = 0.1

    def fit(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_ids: DataFrame | None = None) -> TfidfModel:
        """Phrases and weights from the documents whose ids fit_ids lists, or from all."""
        own = docs if fit_ids is None else docs.join(fit_ids.select(doc_id), doc_id, "left_semi")
        model = TfidfModel(self, None, None)
        clean = model.prepared(own, doc_id, text)
        if self.identify_bigrams:
            clean = cut(clean)  # read for words, for pairs and for replacement
            model.bigrams = cut(find_bigrams(clean, threshold=self.bg_threshold))
            clean = replace_bigrams(clean, model.bigrams)
        if self.weight:
            model.weights = cut(idf_weights(term_counts(clean), own.select(doc_id).distinct().count()))
        return model


def feature_matrix(features: DataFrame, doc_ids: DataFrame | None = None, terms: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc_id, col_idx, value), (term, col_idx)): columns are the sorted terms of the documents, or those given; other terms go."""
    own = features if doc_ids is None else features.join(doc_ids.select("doc_id"), "doc_id", "left_semi")
    if terms is None:
        # ranks within ranges of terms, then offsets: no window over the whole vocabulary
        distinct = own.select("term").distinct()
        ranged = distinct.withColumn("part", F.substring("term", 1, 2))
        sizes = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rank = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
        vocabulary = ranged.withColumn("rank", rank).join(sizes, "part").select("term", (F.col("before") + F.col("rank")).cast("long").alias("col_idx"))
    else:
        vocabulary = own.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, col_idx long")
    return own.join(vocabulary, "term").select("doc_id", "col_idx", "value"), vocabulary
