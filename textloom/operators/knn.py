"""Adaptive weighted nearest-neighbour classification, its labels and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.pairs import top_k


def category_sizes(labels: DataFrame, train_docs: DataFrame, k: int = 25, adapt: bool = True, alpha: int = 5) -> DataFrame:
    """(category, n, k_c): training documents of each category of labels, and how many neighbours its score looks at.

    adapt: k scaled by the category's share of the largest one, alpha at least, the category's size at most.
    """
    own = labels.join(train_docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    sizes = labels.select("category").distinct().join(own, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    if not adapt:
        return sizes.select("category", "n", F.lit(k).alias("k_c"))
    most = sizes.agg(F.max("n").alias("most"))
    share = F.coalesce(F.floor(F.try_divide(F.lit(float(k)) * F.col("n"), F.col("most"))), F.lit(0))
    return sizes.crossJoin(most).select("category", "n", F.least("n", F.greatest(F.lit(int(alpha)), share)).cast("int").alias("k_c"))


def knn_scores(neighbours: DataFrame, test_docs: DataFrame, labels: DataFrame, train_docs: DataFrame, k: int = 25, adapt: bool = True, alpha: int = 5, weight: bool = True) -> DataFrame:
    """(doc_id, category, score) of every test document and category.

    neighbours: (row_id, rank, col_id, sim), k at least for each row, as top_k() gives. labels: (doc_id, category), one row for each label.
    weight: the share of similarity that falls on the category, else the share of k_c. No similarity makes 0.
    """
    sizes = category_sizes(labels, train_docs, k, adapt, alpha)
    own = labels.select(F.col("doc_id").alias("col_id"), "category", F.lit(True).alias("has")).distinct()
    near = neighbours.filter(F.col("rank") <= k).join(F.broadcast(sizes.select("category", "k_c")), F.expr("rank <= k_c")).join(own, ["col_id", "category"], "left")
    sums = near.groupBy("row_id", "category").agg(F.sum(F.when(F.col("has"), F.col("sim"))).alias("inside"), F.sum("sim").alias("all"), F.count("has").alias("n"), F.max("k_c").alias("k_c"))
    score = F.try_divide("inside", "all") if weight else F.try_divide(F.col("n").cast("double"), F.col("k_c"))
    sums = sums.select(F.col("row_id").alias("doc_id"), "category", F.when((F.col("n") > 0) & (F.col("inside") != 0), score).alias("score"))
    grid = test_docs.select("doc_id").distinct().crossJoin(F.broadcast(sizes.select("category")))
    return grid.join(sums, ["doc_id", "category"], "left").select("doc_id", "category", F.coalesce("score", F.lit(0.0)).alias("score"))


def knn(sims: DataFrame, test_docs: DataFrame, labels: DataFrame, train_docs: DataFrame, k: int = 25, adapt: bool = True, alpha: int = 5, weight: bool = True) -> DataFrame:
    """knn_scores() from (row_id, col_id, sim) of test and training documents."""
    own = sims.join(train_docs.select(F.col("doc_id").alias("col_id")).distinct(), "col_id", "left_semi")
    return knn_scores(top_k(own, k, False), test_docs, labels, train_docs, k, adapt, alpha, weight)


def labels_max(scores: DataFrame) -> DataFrame:
    """(doc_id, category): the best one; ties go to the lowest category."""
    order = Window.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), "category")
    return scores.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("doc_id", "category")


def labels_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, categories): those that score at least the threshold, in order; the list may be empty."""
    found = scores.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.round("score", 9) >= threshold, F.col("category")))).alias("categories"))
    return found


def confusion(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(truth, predicted, n, share): share of the documents of that truth."""
    n = truth.select("doc_id", F.col("category").alias("truth")).join(predicted.select("doc_id", F.col("category").alias("predicted")), "doc_id").groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth")))


def f1(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(category, tp, fp, fn, precision, recall, f1) by category, and over all labels together with category null (micro average)."""
    key = ["doc_id", "category"]
    both = truth.select(*key, F.lit(1).alias("t")).join(predicted.select(*key, F.lit(1).alias("p")), key, "full")
    sums = both.groupBy("category").agg(F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    micro = sums.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    rows = sums.unionByName(micro.withColumn("category", F.lit(None).cast(sums.schema["category"].dataType)))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select("category", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
