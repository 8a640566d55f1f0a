"""Queries against their SQL on the smallest tables; a share of them, the driver runs all."""

import os

import duckdb
import pytest

from textloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = ["norm_whitespace_text", "clean", "clean_keep_case", "invert_terms", "norm_std_padded", "combine_max", "bigram_scores", "tfidf_phrases", "tfidf_fit_labelled", "feature_cells", "sim_gaussian", "sim_map_jenshan", "sim_map_linear_normalized", "top_k_similar", "knn_scores", "knn_f1", "balanced_kfold", "rbf_kernel", "color_rows", "viz_records", "plot_spec"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    found = catalog.QUERIES[name](spark, FOLDER)
    sql = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(found.columns) == sorted(names)
    assert plain(found.collect(), found.columns) == plain(sql.fetchall(), names)
