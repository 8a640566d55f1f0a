"""SQL of the queries, for DuckDB, written from the definitions: full unions of terms, all pairs, no blocks."""

from __future__ import annotations

EPS = "2.220446049250313e-16"
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ASCII = r"regexp_replace(strip_accents(coalesce({0}, '')), '[^\x00-\x7F]', '', 'g')"


def _clean(column: str, lower: bool = True, digits: bool = True) -> str:
    out = f"regexp_replace({_ASCII.format(column)}, 'https?://[^{_SPACE}]*', ' ', 'g')"
    out = f"lower({out})" if lower else out
    out = f"regexp_replace({out}, '[0-9]', '1', 'g')" if digits else out
    return f"trim(regexp_replace({out}, '[^A-Za-z0-9-]+', ' ', 'g'))"


def _tokens(column: str) -> str:
    return f"list_filter(string_split({column}, ' '), lambda x: x <> '')"


def _counts(name: str, source: str) -> str:
    """CTE name(doc_id, term, v) of counts in source(doc_id, text), clean."""
    return f"{name}_t AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM {source}), {name} AS (SELECT doc_id, term, count(*)::DOUBLE AS v FROM {name}_t GROUP BY doc_id, term)"


DOCS = f"d AS MATERIALIZED (SELECT doc_id, {_clean('text')} AS text FROM documents)"
ITEMS = f"b AS MATERIALIZED (SELECT item_id AS doc_id, {_clean('text')} AS text FROM benchmark)"
SIZE = {"binary": "1", "sum": "sum(v)", "max": "max(abs(v))", "length": "sqrt(sum(v * v))", "mean": "sum(v) / greatest(count(*), {n})", "std": "sqrt(sum(v * v) / greatest(count(*), {n}) - (sum(v) / greatest(count(*), {n})) ** 2)"}


def _norm(norm: str, n: int = 0) -> str:
    if norm == "binary":
        return f"WITH {DOCS}, {_counts('f', 'd')} SELECT doc_id, term, 1.0::DOUBLE AS value FROM f"
    return f"WITH {DOCS}, {_counts('f', 'd')}, s AS (SELECT doc_id, {SIZE[norm].format(n=n)} AS s FROM f GROUP BY doc_id) SELECT doc_id, term, round(CASE WHEN s <> 0 THEN v / s ELSE v END, 6) AS value FROM f JOIN s USING (doc_id)"


def _weights(name: str, counts: str, n: str) -> str:
    return f"{name}_r AS (SELECT term, count(*) AS df, ln({n}::DOUBLE / count(*)) AS idf FROM {counts} GROUP BY term), {name} AS MATERIALIZED (SELECT term, df, CASE WHEN (SELECT max(abs(idf)) FROM {name}_r) <> 0 THEN idf / (SELECT max(abs(idf)) FROM {name}_r) ELSE idf END AS w FROM {name}_r)"


def _weighted(name: str, counts: str, weights: str) -> str:
    """CTE name(doc_id, term, v): counts over their maximum, weighted, scaled to length 1."""
    return f"{name}_m AS (SELECT doc_id, max(v) AS m FROM {counts} GROUP BY doc_id), {name}_w AS (SELECT doc_id, term, v / m * w AS v FROM {counts} JOIN {name}_m USING (doc_id) JOIN {weights} USING (term)), {name}_l AS (SELECT doc_id, sqrt(sum(v * v)) AS l FROM {name}_w GROUP BY doc_id), {name} AS MATERIALIZED (SELECT doc_id, term, CASE WHEN l <> 0 THEN v / l ELSE v END AS v FROM {name}_w JOIN {name}_l USING (doc_id))"


_N = "(SELECT count(*) FROM d)"
TFIDF = f"{DOCS}, {_counts('f', 'd')}, {_weights('w', 'f', _N)}, {_weighted('x', 'f', 'w')}"
BOTH = f"{TFIDF}, {ITEMS}, {_counts('g', 'b')}, {_weighted('y', 'g', 'w')}"
OWN = f"{ITEMS}, {_counts('g', 'b')}, {_weights('w', 'g', '(SELECT count(*) FROM b)')}, {_weighted('y', 'g', 'w')}"
BIGRAMS = f"""w AS (SELECT {_tokens('text')} AS w FROM d), u AS (SELECT w AS term, count(*) AS n FROM (SELECT unnest(w) AS w FROM w) GROUP BY 1),
p AS (SELECT unnest(list_zip(w[1:len(w) - 1], w[2:len(w)])) AS p FROM w WHERE len(w) > 1), c AS (SELECT p[1] AS w1, p[2] AS w2, count(*)::DOUBLE AS freq FROM p GROUP BY 1, 2 HAVING count(*) > 2),
s AS MATERIALIZED (SELECT w1, w2, freq, freq / greatest(a.n, b.n) AS score FROM c JOIN u a ON a.term = w1 JOIN u b ON b.term = w2)"""
REPLACED = f"{DOCS}, {BIGRAMS}, l AS (SELECT list(w1 || ' ' || w2 ORDER BY score DESC, w1, w2) AS l FROM s WHERE score > 0.1), r AS MATERIALIZED (SELECT doc_id, list_reduce(list_prepend(text, l), lambda a, x: replace(a, x, replace(x, ' ', '_'))) AS text FROM d, l)"

_X = {
    "linear": ("sum(x * y)", "s"),
    "polynomial": ("sum(x * y)", "s * s"),
    "sigmoidal": ("sum(x * y)", "(exp(s) - exp(-s)) / (exp(s) + exp(-s))"),
    "histint": ("sum(least(x, y))", "s"),
    "gaussian": ("sum((x - y) ** 2)", "exp(-0.25 * s)"),
    "manhattan": ("sum(abs(x - y))", None),
    "sqeucl": ("sum((x - y) ** 2)", None),
    "minkowski": ("sum(abs(x - y) ** 3)", None),
    "canberra": ("sum(CASE WHEN x + y = 0 THEN 'nan'::DOUBLE ELSE abs(x - y) / (x + y) END)", None),
    "chisq": ("sum(CASE WHEN x + y = 0 THEN 'nan'::DOUBLE ELSE (x - y) ** 2 / (x + y) END)", None),
    "chebyshev": ("max(abs(x - y))", "1 - s"),
    "hellinger": ("sum((sqrt(x) - sqrt(y)) ** 2)", None),
    "jenshan": ("sum(CASE WHEN x = 0 THEN 0 ELSE x * ln(2 * x / (x + y)) END + CASE WHEN y = 0 THEN 0 ELSE y * ln(2 * y / (x + y)) END)", None),
    "simpson": ("sum(least(x, y))", "CASE WHEN least(p, q) = 0 THEN 0 ELSE s / least(p, q) END"),
    "braun": ("sum(least(x, y))", "CASE WHEN greatest(p, q) = 0 THEN 0 ELSE s / greatest(p, q) END"),
    "kulczynski": ("sum(least(x, y))", "CASE WHEN p = 0 OR q = 0 THEN 0 ELSE (s / p + s / q) / 2 END"),
    "jaccard": ("sum(least(x, y))", "CASE WHEN p + q - s = 0 THEN 0 ELSE s / (p + q - s) END"),
    "dice": ("sum(least(x, y))", "CASE WHEN p + q = 0 THEN 0 ELSE 2 * s / (p + q) END"),
    "otsuka": ("sum(least(x, y))", "CASE WHEN p = 0 OR q = 0 THEN 0 ELSE s / (sqrt(p) * sqrt(q)) END"),
    "sokal": ("sum(least(x, y))", "CASE WHEN 2 * p + 2 * q - 3 * s = 0 THEN 0 ELSE s / (2 * p + 2 * q - 3 * s) END"),
    "cosine": ("sum(x * y)", "s"),
    "angularsim": ("sum(x * y)", "1 - 2 * acos(greatest(0, least(1, s))) / pi()"),
    "angulardist": ("sum(x * y)", "2 * acos(greatest(0, least(1, s))) / pi()"),
}


def _union(x: str, xd: str, y: str, yd: str) -> str:
    """CTE sums(r, c, x, y): both values of every term of either document, for all pairs."""
    return f"""rows_ AS (SELECT DISTINCT doc_id AS r FROM {xd}), cols_ AS (SELECT DISTINCT doc_id AS c FROM {yd}),
u AS (SELECT r, c, i.v AS x, coalesce(j.v, 0) AS y FROM {x} i JOIN rows_ ON i.doc_id = r CROSS JOIN cols_ LEFT JOIN {y} j ON j.doc_id = c AND j.term = i.term
UNION ALL SELECT r, c, 0, j.v FROM {y} j JOIN cols_ ON j.doc_id = c CROSS JOIN rows_ LEFT JOIN {x} i ON i.doc_id = r AND i.term = j.term WHERE i.term IS NULL)"""


def _values(name: str, x: str, xd: str, y: str, yd: str) -> str:
    """CTE k(row_id, col_id, sim)"""
    total, last = _X[name]
    last = last or f"1 / ({EPS} + s)"
    empty = "NULL" if name == "chebyshev" else "0"
    return f"{_union(x, xd, y, yd)}, t AS (SELECT r, c, {total} AS s, sum(x) AS p, sum(y) AS q FROM u GROUP BY r, c), z AS (SELECT r, c, coalesce(s, {empty}) AS s, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM rows_ CROSS JOIN cols_ LEFT JOIN t USING (r, c)), k AS MATERIALIZED (SELECT r AS row_id, c AS col_id, {last} AS sim FROM z)"


def _sim(name: str) -> str:
    return f"WITH {OWN}, {_values(name, 'y', 'b', 'y', 'b')} SELECT row_id, col_id, round(least(sim, 1e12), 6) AS sim FROM k"


def _sim_map(name: str) -> str:
    return f"WITH {BOTH}, {_values(name, 'x', 'd', 'y', 'b')} SELECT row_id, col_id, round(least(sim, 1e12), 6) AS sim FROM k"


def _self(name: str, features: str, docs: str) -> str:
    total, last = _X[name]
    last = last or f"1 / ({EPS} + s)"
    empty = "NULL" if name == "chebyshev" else "0"
    sums = f"SELECT doc_id, {total} AS s, sum(x) AS p, sum(y) AS q FROM (SELECT doc_id, v AS x, v AS y FROM {features}) GROUP BY doc_id"
    return f"(SELECT doc_id, {last} AS own FROM (SELECT doc_id, coalesce(s, {empty}) AS s, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT DISTINCT doc_id FROM {docs}) LEFT JOIN ({sums}) USING (doc_id)))"


def _normalized(name: str, cross: bool) -> str:
    head = f"WITH {BOTH}, {_values(name, 'x', 'd', 'y', 'b')}" if cross else f"WITH {OWN}, {_values(name, 'y', 'b', 'y', 'b')}"
    part = "CASE WHEN i.own + j.own <> 0 THEN round(least(sim / ((i.own + j.own) / 2), 1e12), 6) END"
    return f"{head} SELECT row_id, col_id, {part} AS sim FROM k LEFT JOIN {_self(name, *('xd' if cross else 'yb'))} i ON i.doc_id = row_id LEFT JOIN {_self(name, 'y', 'b')} j ON j.doc_id = col_id"


def _affinity(perp: float, tol: float, rounds: int) -> str:
    """Bisection of each column's precision by recursion; the entropy of p / sum(p) follows from sums of p and of d * p."""
    error = f"log2(sum(exp(-dist * s))) + any_value(s) * sum(dist * exp(-dist * s)) / (sum(exp(-dist * s)) * ln(2)) - log2({perp})"
    return f"""WITH RECURSIVE {OWN}, {_values('angulardist', 'y', 'b', 'y', 'b')}, d AS MATERIALIZED (SELECT row_id, col_id, sim AS dist FROM k),
steps AS (SELECT 0 AS round, col_id, 1.0::DOUBLE AS s, 0.0::DOUBLE AS low, 250.0::DOUBLE AS high FROM d GROUP BY col_id
UNION ALL SELECT round + 1, col_id, CASE WHEN e > 0 THEN (s + high) / 2 ELSE (low + s) / 2 END, CASE WHEN e > 0 THEN s ELSE low END, CASE WHEN e > 0 THEN high ELSE s END
FROM (SELECT round, steps.col_id, any_value(s) AS s, any_value(low) AS low, any_value(high) AS high, {error} AS e FROM steps JOIN d ON d.col_id = steps.col_id AND row_id <> d.col_id WHERE round < {rounds} GROUP BY round, steps.col_id)),
errors AS (SELECT round, steps.col_id, any_value(s) AS s, {error} AS e FROM steps JOIN d ON d.col_id = steps.col_id AND row_id <> d.col_id GROUP BY round, steps.col_id),
ends AS (SELECT min(round) AS round FROM (SELECT round, sum(abs(e)) AS e FROM errors GROUP BY round) WHERE e <= {tol} OR round = {rounds}),
p AS (SELECT row_id, d.col_id, CASE WHEN row_id = d.col_id THEN 0 ELSE exp(-dist * s) END AS p FROM d JOIN errors ON errors.col_id = d.col_id WHERE round = (SELECT round FROM ends)),
q AS MATERIALIZED (SELECT row_id, col_id, CASE WHEN sum(p) OVER (PARTITION BY col_id) > 0 THEN p / sum(p) OVER (PARTITION BY col_id) ELSE 0 END AS q FROM p)
SELECT a.row_id, a.col_id, round((a.q + b.q) / (2 * (SELECT count(DISTINCT col_id) FROM q)), 9) AS sim FROM q a JOIN q b ON a.row_id = b.col_id AND a.col_id = b.row_id"""


def _dots(test: str, train: str, other: bool) -> str:
    """CTE n(row_id, col_id, sim, rank) of the 25 or k best dot products."""
    return f"""dots AS (SELECT i.doc_id AS r, j.doc_id AS c, sum(i.v * j.v) AS s FROM x i JOIN x j USING (term) WHERE i.doc_id IN (SELECT doc_id FROM {test}) AND j.doc_id IN (SELECT doc_id FROM {train}) GROUP BY 1, 2),
every AS (SELECT i.doc_id AS row_id, j.doc_id AS col_id, coalesce(s, 0) AS sim FROM {test} i CROSS JOIN {train} j LEFT JOIN dots ON r = i.doc_id AND c = j.doc_id {'WHERE i.doc_id <> j.doc_id' if other else ''}),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(sim, 9) DESC, col_id DESC) AS rank FROM every)"""


_KNOWN = f"{TFIDF}, lab AS (SELECT doc_id, quality AS category FROM labels), train AS (SELECT doc_id FROM d WHERE doc_id IN (SELECT doc_id FROM lab)), test AS (SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM lab)), nc AS (SELECT category, count(*) AS n FROM lab WHERE doc_id IN (SELECT doc_id FROM train) GROUP BY category)"


def _knn(test: str, adapt: bool, weight: bool) -> str:
    """CTE scores(doc_id, category, score)"""
    k = "least(n, greatest(5, floor(25.0 * n / (SELECT max(n) FROM nc))))" if adapt else "25"
    score = "inside / total" if weight else "m::DOUBLE / agg.k"
    return f"""{_dots(test, 'train', test == 'train')}, kc AS (SELECT category, {k} AS k FROM nc),
agg AS (SELECT row_id, kc.category, k, sum(sim) AS total, sum(CASE WHEN l.doc_id IS NOT NULL THEN sim END) AS inside, count(l.doc_id) AS m FROM n JOIN kc ON rank <= least(k, 25) LEFT JOIN lab l ON l.doc_id = col_id AND l.category = kc.category GROUP BY 1, 2, 3),
scores AS MATERIALIZED (SELECT t.doc_id, kc.category, coalesce(CASE WHEN m > 0 AND inside <> 0 THEN {score} END, 0) AS score FROM {test} t CROSS JOIN kc LEFT JOIN agg ON row_id = t.doc_id AND agg.category = kc.category),
best AS (SELECT doc_id, category FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, category) AS o FROM scores) WHERE o = 1)"""


_PAIR = "(SELECT i.vec_id AS row_id, j.vec_id AS col_id, sqrt(list_sum(list_transform(range(1, len(i.embedding) + 1), lambda k: (i.embedding[k]::DOUBLE - j.embedding[k]::DOUBLE) ** 2))) AS dist FROM embeddings i, embeddings j)"


def _hue(i: str, n: str) -> str:
    """Three columns of the colour i of n."""
    h = f"(6.0 * ({i} / ({n} + 1.0)))"
    f = f"({h} - floor({h}))"
    case = lambda *xs: "CASE floor(" + h + ") % 6 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(xs)) + " END"
    q, t = f"(0.8 * (1.0 - {f}))", f"(0.8 * {f})"
    return case("0.8", q, "0.0", "0.0", t, "0.8"), case(t, "0.8", "0.8", q, "0.0", "0.0"), case("0.0", "0.0", t, "0.8", "0.8", q)


def _index(column: str, n: int) -> str:
    """The colour index of a column between low and high."""
    return f"CASE WHEN low = high THEN 0 ELSE list_min(list_filter(range(0, {n}), lambda k: k = {n - 1} OR low + k * ((high - low) / {n - 1}) >= {column})) END"


def _ends(column: str, source: str) -> str:
    return f"(SELECT *, (SELECT min({column})::DOUBLE FROM {source}) AS low, (SELECT max({column})::DOUBLE FROM {source}) AS high FROM {source})"


def _rgb(i: str, n: str) -> str:
    return "'rgb(' || " + " || ',' || ".join(f"floor(({c}) * 255)::INTEGER::VARCHAR" for c in _hue(i, n)) + " || ')'"


def _combine(merge: str) -> str:
    a, b = ("(SELECT term, sum(v) AS v FROM " + f + " GROUP BY term)" for f in ("f", "g"))
    return f"WITH {DOCS}, {ITEMS}, {_counts('f', 'd')}, {_counts('g', 'b')} SELECT coalesce(a.term, b.term) AS term, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE {merge} END AS value FROM {a} a FULL JOIN {b} b ON a.term = b.term"


_FOLDS = "SELECT fold::INTEGER AS fold, {columns}, idx % {k} = fold AS is_test FROM ({placed}), range(0, {k}) r(fold)"
_R, _G, _B = (f"round({c}, 6)::DOUBLE" for c in _hue("i", "100"))
_PR, _PG, _PB = (f"round({c}, 6)::DOUBLE" for c in _hue("rank", "n"))

ORACLES: dict[str, str] = {
    "corpus_min_words": f"SELECT doc_id, text FROM documents WHERE len(list_filter(string_split(trim(regexp_replace(text, '[{_SPACE}]+', ' ', 'g')), ' '), lambda x: x <> '')) > 3",
    "norm_whitespace_text": f"SELECT doc_id, trim(regexp_replace(text, '[{_SPACE}]+', ' ', 'g')) AS text FROM documents",
    "clean": f"WITH {DOCS} SELECT doc_id, text FROM d",
    "clean_keep_case": f"SELECT page_id, {_clean('html', False, False)} AS text FROM pages",
    "token_list": f"WITH {DOCS}, t AS (SELECT doc_id, {_tokens('text')} AS t FROM d) SELECT doc_id, unnest(range(0, len(t)))::INTEGER AS pos, unnest(t) AS term FROM t",
    "invert_labels": "SELECT quality AS category, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS keys FROM labels GROUP BY quality",
    "invert_terms": f"WITH {DOCS}, t AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM d) SELECT term, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS keys FROM t GROUP BY term",
    "transpose_terms": f"WITH {DOCS}, {_counts('f', 'd')} SELECT term, doc_id, v AS value FROM f",
    "select_docs": "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "vector_map": "SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS idx, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings",
    "scale_by_max": "WITH v AS (SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS idx, unnest(embedding)::DOUBLE AS value FROM embeddings) SELECT vec_id, idx, round(value / (SELECT max(value) FROM v), 6) AS value FROM v",
    **{f"norm_{n}": _norm(n) for n in SIZE},
    "norm_mean_padded": _norm("mean", 500),
    "norm_std_padded": _norm("std", 500),
    "combine_max": _combine("greatest(a.v, b.v)"),
    "combine_sum": _combine("a.v + b.v"),
    "combine_function": _combine("a.v - b.v"),
    "bigram_scores": f"WITH {DOCS}, {BIGRAMS} SELECT w1, w2, freq, round(score, 6) AS score FROM s",
    "find_bigrams": f"WITH {DOCS}, {BIGRAMS} SELECT w1, w2, freq, round(score, 6) AS score FROM s WHERE score > 0.1",
    "replace_bigrams": f"WITH {REPLACED} SELECT doc_id, text FROM r",
    "term_freq": f"WITH {DOCS}, {_counts('f', 'd')} SELECT doc_id, term, v AS value FROM f",
    "idf": f"WITH {DOCS}, {_counts('f', 'd')}, {_weights('w', 'f', _N)} SELECT term, df, round(w, 6) AS weight FROM w",
    "tfidf": f"WITH {TFIDF} SELECT doc_id, term, round(v, 6) AS value FROM x",
    "tfidf_phrases": f"WITH {REPLACED}, {_counts('f', 'r')}, {_weights('iw', 'f', _N)}, {_weighted('x', 'f', 'iw')} SELECT doc_id, term, round(v, 6) AS value FROM x",
    "tfidf_fit_labelled": f"WITH {DOCS}, {_counts('f', 'd')}, fit AS (SELECT * FROM f WHERE doc_id IN (SELECT doc_id FROM labels)), {_weights('w', 'fit', '(SELECT count(*) FROM d WHERE doc_id IN (SELECT doc_id FROM labels))')}, {_weighted('x', 'f', 'w')} SELECT doc_id, term, round(v, 6) AS value FROM x",
    "tf_sum_unweighted": _norm("sum"),
    "feature_cells": f"WITH {TFIDF}, v AS (SELECT term, row_number() OVER (ORDER BY term COLLATE \"C\") - 1 AS col_idx FROM (SELECT DISTINCT term FROM x)) SELECT doc_id, col_idx, round(v, 6) AS value FROM x JOIN v USING (term)",
    **{f"sim_{n}": _sim(n) for n in _X},
    **{f"sim_map_{n}": _sim_map(n) for n in _X},
    **{f"sim_{n}_normalized": _normalized(n, False) for n in _X if n != "angulardist"},
    **{f"sim_map_{n}_normalized": _normalized(n, True) for n in _X if n != "angulardist"},
    "top_k_similar": f"WITH {TFIDF}, {_dots('d', 'd', True)} SELECT row_id, rank::INTEGER AS rank, col_id, round(sim, 6) AS sim FROM n WHERE rank <= 10",
    "top_k_map": f"WITH {BOTH}, {_values('jaccard', 'x', 'd', 'y', 'b')} SELECT row_id, rank::INTEGER AS rank, col_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(sim, 9) DESC, col_id DESC) AS rank FROM k) WHERE rank <= 5",
    "knn_scores": f"WITH {_KNOWN}, {_knn('test', True, True)} SELECT doc_id, category, round(score, 6) AS score FROM scores",
    "knn_scores_plain": f"WITH {_KNOWN}, {_knn('test', False, False)} SELECT doc_id, category, round(score, 6) AS score FROM scores",
    "knn_labels_max": f"WITH {_KNOWN}, {_knn('test', True, True)} SELECT doc_id, category FROM best",
    "knn_labels_threshold": f"WITH {_KNOWN}, {_knn('test', True, True)} SELECT doc_id, coalesce(string_agg(CASE WHEN round(score, 9) >= 0.4 THEN category::VARCHAR END, ',' ORDER BY category), '') AS categories FROM scores GROUP BY doc_id",
    "knn_confusion": f"WITH {_KNOWN}, {_knn('train', True, True)}, c AS (SELECT lab.category AS truth, best.category AS predicted, count(*) AS n FROM lab JOIN best USING (doc_id) GROUP BY 1, 2) SELECT truth, predicted, n, round(n / sum(n) OVER (PARTITION BY truth), 6)::DOUBLE AS share FROM c",
    "knn_f1": f"""WITH {_KNOWN}, {_knn('train', True, True)}, own AS (SELECT * FROM lab WHERE doc_id IN (SELECT doc_id FROM train)), j AS (SELECT coalesce(own.category, best.category) AS category, own.doc_id AS t, best.doc_id AS p FROM own FULL JOIN best ON own.doc_id = best.doc_id AND own.category = best.category),
c AS (SELECT category, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY category UNION ALL SELECT NULL, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL), count(*) FILTER (t IS NULL), count(*) FILTER (p IS NULL) FROM j)
SELECT category, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6)::DOUBLE AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6)::DOUBLE AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6)::DOUBLE AS f1 FROM c""",
    "kfold": _FOLDS.format(columns="doc_id", k=10, placed="SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents"),
    "balanced_kfold": _FOLDS.format(columns="category, doc_id", k=10, placed="SELECT quality AS category, doc_id, row_number() OVER (ORDER BY quality, md5('0:' || doc_id::VARCHAR), doc_id) - 1 AS idx FROM labels"),
    "shuffle_split": "SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id::VARCHAR), doc_id) - 1 < floor(count(*) OVER () * 0.2) AS is_test FROM documents",
    "pairwise_euclidean": f"SELECT row_id, col_id, round(dist, 6) AS dist FROM {_PAIR}",
    "rbf_kernel": f"WITH p AS MATERIALIZED (SELECT * FROM {_PAIR}) SELECT row_id, col_id, round(exp(-(1.0 / (SELECT quantile_cont(dist, 0.5) FROM p) ** 2) * dist * dist), 6) AS sim FROM p",
    "double_center": f"WITH {OWN}, {_values('cosine', 'y', 'b', 'y', 'b')} SELECT row_id, col_id, round(sim - avg(sim) OVER (PARTITION BY row_id) - avg(sim) OVER (PARTITION BY col_id) + avg(sim) OVER (), 6) AS sim FROM k",
    "scaling_gram": f"WITH {OWN}, {_values('cosine', 'y', 'b', 'y', 'b')} SELECT row_id, col_id, round(sim - avg(sim) OVER (PARTITION BY row_id) - avg(sim) OVER (PARTITION BY col_id) + avg(sim) OVER (), 6) AS sim FROM k",
    "distance_to_affinity": _affinity(10.0, 10e-4, 50),
    "palette": f"SELECT i AS idx, {_R} AS r, {_G} AS g, {_B} AS b FROM range(0, 100) t(i)",
    "color_index": f"SELECT doc_id, n_chars, ({_index('n_chars', 100)})::INTEGER AS color_idx FROM {_ends('n_chars', 'documents')}",
    "color_rows": f"SELECT p_partkey, p_size, {_R} AS r, {_G} AS g, {_B} AS b FROM (SELECT p_partkey, p_size, ({_index('p_size', 100)}) AS i FROM {_ends('p_size', 'part')})",
    "viz_records": f"SELECT doc_id AS id, n_chars::DOUBLE AS x, doc_id::DOUBLE AS y, doc_id::VARCHAR || ' (' || CASE quality WHEN 0 THEN 'poor' ELSE 'good' END || ')' AS title, text AS description, {_rgb('quality', '2')} AS color FROM documents JOIN labels USING (doc_id)",
    "plot_spec": f"WITH p AS (SELECT quality AS category, dense_rank() OVER (ORDER BY quality) - 1 AS rank, (SELECT count(DISTINCT quality) FROM labels) AS n, n_chars::DOUBLE AS x, doc_id::DOUBLE AS y FROM documents JOIN labels USING (doc_id)) SELECT rank::INTEGER AS series, category, 0.6::DOUBLE AS alpha, {_PR} AS r, {_PG} AS g, {_PB} AS b, x, y, (SELECT min(n_chars)::DOUBLE FROM documents) AS x_low, (SELECT max(n_chars)::DOUBLE FROM documents) AS x_high, (SELECT min(doc_id)::DOUBLE FROM documents) AS y_low, (SELECT max(doc_id)::DOUBLE FROM documents) AS y_high FROM p",
}
