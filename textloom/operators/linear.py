"""From long features to pyspark.ml: sparse vectors, and linear classifiers of many categories."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(cells: DataFrame, n_columns: int, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, features) of cells (doc_id, col_idx, value), as feature_matrix() gives them; documents of docs without cells get an empty vector."""

    @F.udf(VectorUDT())  # vectors of pyspark.ml have no Arrow form
    def sparse(entries):
        return SparseVector(n_columns, [(int(e.col_idx), float(e.value)) for e in entries])

    own = cells.groupBy("doc_id").agg(F.collect_list(F.struct("col_idx", "value")).alias("e"))
    if docs is not None:
        own = docs.select("doc_id").distinct().join(own, "doc_id", "left")
    return own.select("doc_id", sparse(F.coalesce("e", F.array().cast("array<struct<col_idx:bigint,value:double>>"))).alias("features"))


def classify(train: DataFrame, labels: DataFrame, test: DataFrame, method: str = "logistic", strength: float = 0.01, rounds: int = 100) -> DataFrame:
    """(doc_id, category): the categories (whole numbers from 0) that a model of train (doc_id, features) and labels (doc_id, category) gives to test; method: logistic or svm."""
    if method not in ("logistic", "svm"):
        raise ValueError(f"unknown method {method!r}; known: logistic, svm")
    rows = train.join(labels.select("doc_id", F.col("category").cast("double").alias("label")), "doc_id")
    model = LogisticRegression(regParam=strength, maxIter=rounds) if method == "logistic" else OneVsRest(classifier=LinearSVC(regParam=strength, maxIter=rounds))
    return model.fit(rows).transform(test).select("doc_id", F.col("prediction").cast("int").alias("category"))
