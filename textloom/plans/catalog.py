"""Named queries over the tables of a folder, and their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import colors
from textloom.functions.text import clean_text, norm_whitespace, tokens
from textloom.operators import embed, folds, knn, maps, pairs, phrases, similarity
from textloom.operators.blocks import Packed
from textloom.operators.features import Tfidf, TfidfModel, feature_matrix, idf_weights, long, term_counts, term_lists
from textloom.plans import oracles
from textloom.session import cut, spread
from textloom.sources import viz

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.ORACLES
#: Single words; phrases have queries of their own.
WORDS = Tfidf(identify_bigrams=False)
DIGITS, MOST = 6, 1e12


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def cleaned(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", clean_text(F.col("text")).alias("text"))


def labels(spark: SparkSession, sf_dir: str, column: str = "quality") -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("category"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.least(F.col(c), F.lit(MOST)), DIGITS) for c in columns})


# Text


@query
def corpus_min_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than three words."""
    return documents(spark, sf_dir).filter(F.size(tokens(norm_whitespace(F.col("text")))) > 3)


@query
def norm_whitespace_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", norm_whitespace(F.col("text")).alias("text"))


@query
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(documents(spark, sf_dir))


@query
def clean_keep_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", clean_text(F.col("html"), to_lower=False, norm_num=False).alias("text"))


@query
def token_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(documents(spark, sf_dir)).select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


# Maps


@query
def invert_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.invert(labels(spark, sf_dir), "doc_id", "category").select("category", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query
def invert_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = cleaned(documents(spark, sf_dir)).select("doc_id", tokens(F.col("text")).alias("terms"))
    return maps.invert_lists(listed, "doc_id", "terms").select(F.col("value").alias("term"), F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))


@query
def transpose_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = term_lists(cleaned(documents(spark, sf_dir))).select("doc_id", F.map_from_entries("entries").alias("entries"))
    return maps.transpose(counts, "doc_id", "entries").select(F.col("key").alias("term"), F.explode("entries").alias("doc_id", "value"))


@query
def select_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.select_keys(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


@query
def vector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(maps.vector_to_map(F.col("embedding"))).alias("idx", "value"))
    return v.select("vec_id", "idx", F.round(F.col("value").cast("double"), DIGITS).alias("value"))


@query
def scale_by_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors over the largest part of all."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("idx", "value"))
    return v.crossJoin(v.agg(F.max("value").alias("most"))).select("vec_id", "idx", F.round(F.try_divide("value", "most"), DIGITS).alias("value"))


def _norm(norm: str, n_all: int) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lists = term_lists(cleaned(documents(spark, sf_dir)))
        return rounded(long(maps.normalise_lists(lists, norm=norm, n_all=n_all)), "value")

    run.__name__ = f"norm_{norm}" + ("_padded" if n_all else "")
    return run


for _name, _n in [*((n, 0) for n in maps.NORMS), ("mean", 500), ("std", 500)]:
    query(_norm(_name, _n))


def _combined(op: str | Callable, name: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = (term_counts(cleaned(t(spark, sf_dir))).groupBy("term").agg(F.sum("value").alias("value")) for t in (documents, items))
        return maps.combine(a, b, ["term"], op=op)

    run.__name__ = name
    return run


query(_combined("max", "combine_max"))
query(_combined("sum", "combine_sum"))
query(_combined(lambda pair: pair[0] - pair[1], "combine_function"))


# Phrases and features


@query
def bigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(phrases.bigram_scores(cut(cleaned(documents(spark, sf_dir)))), "score")


@query
def find_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(phrases.find_bigrams(cut(cleaned(documents(spark, sf_dir)))), "score")


@query
def replace_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(cleaned(documents(spark, sf_dir)))
    return phrases.replace_bigrams(docs, cut(phrases.find_bigrams(docs)))


@query
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(cleaned(documents(spark, sf_dir)))


@query
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cleaned(documents(spark, sf_dir))
    return rounded(idf_weights(term_counts(docs), docs.count()), "weight")


@query
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rounded(WORDS.fit(docs).transform(docs), "value")


@query
def tfidf_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defaults, phrases included."""
    docs = documents(spark, sf_dir)
    return rounded(Tfidf().fit(docs).transform(docs), "value")


@query
def tfidf_fit_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the documents with labels, applied to all."""
    docs = documents(spark, sf_dir)
    return rounded(WORDS.fit(docs, fit_ids=table(spark, sf_dir, "labels")).transform(docs), "value")


@query
def tf_sum_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rounded(Tfidf(norm="sum", weight=False, renorm=None, identify_bigrams=False).fit(docs).transform(docs), "value")


@query
def feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rounded(feature_matrix(cut(WORDS.fit(docs).transform(docs)))[0], "value")


# Similarities: items with items, documents with items


def _packed(spark: SparkSession, sf_dir: str) -> tuple[Packed, Packed]:
    docs = documents(spark, sf_dir)
    model = WORDS.fit(docs)
    return model.packed(docs), model.packed(items(spark, sf_dir))


def _self_sim(sim: str, normalize: bool = False) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = items(spark, sf_dir)
        packed = WORDS.fit(own).packed(own)
        return rounded(similarity.cross_packed(packed, packed, sim, normalize), "sim")

    run.__name__ = f"sim_{sim}" + "_normalized" * normalize
    return run


def _cross_sim(sim: str, normalize: bool = False) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(similarity.cross_packed(*_packed(spark, sf_dir), sim, normalize), "sim")

    run.__name__ = f"sim_map_{sim}" + "_normalized" * normalize
    return run


for _sim in similarity.NAMES:
    query(_self_sim(_sim))
    query(_cross_sim(_sim))
    if _sim != "angulardist":  # the distance of a document to itself is 0
        query(_self_sim(_sim, True))
        query(_cross_sim(_sim, True))


# Neighbours


@query
def top_k_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents most similar to each, by the cosine of tf-idf features."""
    docs = documents(spark, sf_dir)
    packed = WORDS.fit(docs).packed(docs)
    return rounded(pairs.nearest_packed(packed, packed, "linear", 10), "sim")


@query
def top_k_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five items most similar to each document by weighted Jaccard similarity."""
    return rounded(pairs.nearest_packed(*_packed(spark, sf_dir), "jaccard", 5, False), "sim")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[TfidfModel, DataFrame, DataFrame, DataFrame]:
    """The fitted model, documents without labels, documents with labels, labels."""
    docs, known = documents(spark, sf_dir), labels(spark, sf_dir)
    return WORDS.fit(docs), docs.join(known, "doc_id", "left_anti"), docs.join(known, "doc_id", "left_semi"), known


def _knn(adapt: bool, weight: bool) -> Callable:
    def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, test, train, known = _labelled(spark, sf_dir)
        near = pairs.nearest_packed(model.packed(test), model.packed(train), "linear", 25, False)
        return knn.knn_scores(near, test, known, train, 25, adapt, 5, weight)

    return scores


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The labels of labelled documents, and what the other labelled documents make of them."""
    model, _, train, known = _labelled(spark, sf_dir)
    packed = model.packed(train)
    near = pairs.nearest_packed(packed, packed, "linear", 25, True)
    return known.join(train, "doc_id", "left_semi"), knn.labels_max(knn.knn_scores(near, train, known, train))


@query
def knn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_knn(True, True)(spark, sf_dir), "score")


@query
def knn_scores_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same k for all categories, neighbours counted."""
    return rounded(_knn(False, False)(spark, sf_dir), "score")


@query
def knn_labels_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.labels_max(_knn(True, True)(spark, sf_dir))


@query
def knn_labels_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.labels_threshold(_knn(True, True)(spark, sf_dir), 0.4).select("doc_id", F.array_join(F.col("categories").cast("array<string>"), ",").alias("categories"))


@query
def knn_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.confusion(*_evaluated(spark, sf_dir)), "share")


@query
def knn_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(knn.f1(*_evaluated(spark, sf_dir)), "precision", "recall", "f1")


# Folds


@query
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.kfold(documents(spark, sf_dir))


@query
def balanced_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.balanced_kfold(labels(spark, sf_dir))


@query
def shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.shuffle_split(documents(spark, sf_dir))


# Dense vectors and embeddings


@query
def pairwise_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.pairwise_distance(table(spark, sf_dir, "embeddings")), "dist")


@query
def rbf_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.rbf_kernel(pairs.pairwise_distance(table(spark, sf_dir, "embeddings"))), "sim")


def _item_sims(spark: SparkSession, sf_dir: str, sim: str) -> DataFrame:
    own = items(spark, sf_dir)
    packed = WORDS.fit(own).packed(own)
    return similarity.cross_packed(packed, packed, sim)


@query
def double_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pairs.double_center(_item_sims(spark, sf_dir, "cosine")), "sim")


@query
def scaling_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot products of the coordinates by all eigenvectors: the centred similarities again, whatever the vectors' signs."""
    own = items(spark, sf_dir)
    n = own.select("doc_id").distinct().count()
    points = embed.classical_scaling(_item_sims(spark, sf_dir, "cosine"), dims=max(n, 3))
    listed = cut(points.select("doc_id", F.array(*[c for c in points.columns if c != "doc_id"]).alias("v")))
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return rounded(listed.toDF("row_id", "v").crossJoin(listed.toDF("col_id", "w")).select("row_id", "col_id", dot.alias("sim")), "sim")


def _affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.distance_to_affinity(_item_sims(spark, sf_dir, "angulardist").select("row_id", "col_id", F.col("sim").alias("dist")), perp=10.0)


@query
def distance_to_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _affinity(spark, sf_dir).withColumn("sim", F.round("sim", 9))


@query
def classical_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.classical_scaling(_item_sims(spark, sf_dir, "cosine"))


@query
def tsne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.project_2d(_affinity(spark, sf_dir))


# Presentation


@query
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(colors.palette(spark), "r", "g", "b")


@query
def color_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colors.color_index(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars")


@query
def color_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(colors.color_rows(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size"), "r", "g", "b")


def _coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x"), F.col("doc_id").cast("double").alias("y"))


@query
def viz_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(0, "poor"), (1, "good")], "category int, name string")
    return viz.viz_records(documents(spark, sf_dir), _coords(spark, sf_dir), labels(spark, sf_dir), names)


@query
def plot_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(viz.plot_spec(_coords(spark, sf_dir), labels(spark, sf_dir)), "r", "g", "b")
