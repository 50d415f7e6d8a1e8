"""Registered queries: whitening, correlation, top-k retrieval, leaves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from arbora.functions import vec as V
from arbora.operators import ann
from arbora.operators import topk as tk
from arbora.operators import whiten as wh
from arbora.operators.skew import dedupe_leaves
from arbora.plans import inputs as I
from arbora.plans.registry import E, LISTS, Q, query, r6, sql6, with_

# Means and mean products first, so that no row pair carries more than two dimensions.
_COV = """
mu AS (SELECT d, avg(v) AS mu FROM e GROUP BY d),
c AS (
  SELECT a.d AS i, b.d AS j, sum((a.v - m.mu) * (b.v - k.mu)) / (count(*) - 1) AS cov, min(m.mu) AS mean_i
  FROM e a JOIN e b USING (vec_id) JOIN mu m ON m.d = a.d JOIN mu k ON k.d = b.d GROUP BY a.d, b.d)"""
_CORR = _COV + """,
sd AS (SELECT i AS d, sqrt(cov + 1e-12) AS sd FROM c WHERE i = j),
r AS (SELECT c.i, c.j, greatest(-1.0, least(1.0, cov / p.sd / o.sd)) AS corr FROM c JOIN sd p ON p.d = c.i JOIN sd o ON o.d = c.j)"""


@query("cov_matrix", with_(E, _COV) + f" SELECT i, j, {sql6('mean_i', 'mean_i')}, {sql6('cov', 'cov')} FROM c")
def cov_matrix(spark, sf):
    return wh.cov_matrix(I.vectors(spark, sf)).select("i", "j", r6("mean_i"), r6("cov"))


@query("cov_matrix_far", with_(E, _COV) + f" SELECT i, j, {sql6('mean_i + 1e6', 'mean_i')}, {sql6('cov', 'cov')} FROM c")
def cov_matrix_far(spark, sf):
    """The same vectors a million away from the origin: the variances must not change."""
    far = I.vectors(spark, sf).select("doc_id", F.transform("vec", lambda x: x + F.lit(1e6)).alias("vec"))
    return wh.cov_matrix(far).select("i", "j", r6("mean_i"), r6("cov"))


def _moments_of(df):
    """Mean and covariance of a transformed table, rounded to four decimals."""
    mean, cov, n = wh.covariance(df)
    k = len(mean)
    rows = [(i + 1, j + 1, float(np.round(cov[i, j], 4) + 0.0)) for i in range(k) for j in range(k)]
    return df.sparkSession.createDataFrame(rows, "i bigint, j bigint, cov double")


_IDENTITY = """
    SELECT a.i AS i, b.j AS j, CASE WHEN a.i = b.j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cov
    FROM (SELECT unnest(range(1, max(len(embedding)) + 1)) AS i FROM embeddings) a,
         (SELECT unnest(range(1, max(len(embedding)) + 1)) AS j FROM embeddings) b"""

# The inverse square root of the covariance by coupled Newton iteration, as an independent way to the ZCA matrix.
def _inverse_root(steps: int = 18) -> str:  # noqa: E302
    parts = ["""
tr AS (SELECT sum(cov) AS s FROM c WHERE i = j),
y0 AS MATERIALIZED (SELECT i, j, (cov + CASE WHEN i = j THEN 1e-8 ELSE 0 END) / s AS a FROM c, tr),
z0 AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a FROM c)"""]
    product = "SELECT p.i, o.j, sum(p.a * o.a) AS a FROM {0} p JOIN {1} o ON p.j = o.i GROUP BY p.i, o.j"
    for k in range(steps):
        parts.append(f"""
t{k} AS MATERIALIZED (SELECT i, j, 0.5 * (CASE WHEN i = j THEN 3.0 ELSE 0.0 END - a) AS a FROM ({product.format(f'z{k}', f'y{k}')})),
y{k + 1} AS MATERIALIZED ({product.format(f'y{k}', f't{k}')}),
z{k + 1} AS MATERIALIZED ({product.format(f't{k}', f'z{k}')})""")
    parts.append(f"""
w AS MATERIALIZED (SELECT i, j, a / sqrt(s) AS w FROM z{steps}, tr)""")
    return ",".join(parts)


@query("zca_fit", with_(E, _COV, _inverse_root()) + " SELECT i, j, round(w, 4) + 0.0::DOUBLE AS w FROM w")
def zca_fit(spark, sf):
    model = wh.zca_fit(I.vectors(spark, sf))
    rows = V.dims(spark.createDataFrame(
        [(i + 1, row.tolist()) for i, row in enumerate(model.matrix)], "i bigint, r array<double>"), "r", "i")
    return rows.select("i", F.col("dim").alias("j"), (F.round("value", 4) + F.lit(0.0)).alias("w"))


@query("zca_transform", with_(E, _COV, _inverse_root()) + """
    SELECT vec_id AS doc_id, w.i AS dim, round(sum(w.w * (e.v - mu.mu)), 4) + 0.0::DOUBLE AS value
    FROM e JOIN mu ON mu.d = e.d JOIN w ON w.j = e.d GROUP BY vec_id, w.i""")
def zca_transform(spark, sf):
    v = I.vectors(spark, sf).select("doc_id", "vec")
    out = V.dims(wh.transform(wh.zca_fit(v), v), "vec", "doc_id")
    return out.select("doc_id", "dim", (F.round("value", 4) + F.lit(0.0)).alias("value"))


@query("pca_fit", with_(E, _COV) + """
    SELECT round(sum(cov), 6) AS total_variance, max(i) AS dims FROM c WHERE i = j""")
def pca_fit(spark, sf):
    """All components together explain the total variance."""
    v = I.vectors(spark, sf)
    model, share = wh.pca_fit(v, n_components=64)
    part, part_share = wh.pca_fit(v, n_components=0.96)
    assert part_share.sum() > 0.96 and part_share[:-1].sum() <= 0.96
    projected = wh.transform(model, v.select("doc_id", "vec"))
    var = V.dims(projected, "vec").groupBy("dim").agg(F.var_samp("value").alias("s"))
    return var.agg(F.round(F.sum("s"), 6).alias("total_variance"), F.max("dim").alias("dims"))


@query("pca_transform", _IDENTITY)
def pca_transform(spark, sf):
    v = I.vectors(spark, sf).select("doc_id", "vec")
    return _moments_of(wh.transform(wh.pca_whiten_fit(v, n_components=64), v))


@query("pca_zca_fit", with_(E, _COV, _inverse_root()) + " SELECT i, j, round(w, 4) + 0.0::DOUBLE AS w FROM w")
def pca_zca_fit(spark, sf):
    """With all components the low-rank form is the full one."""
    model = wh.pca_zca_fit(I.vectors(spark, sf), n_components=64)
    rows = V.dims(spark.createDataFrame(
        [(i + 1, row.tolist()) for i, row in enumerate(model.matrix)], "i bigint, r array<double>"), "r", "i")
    return rows.select("i", F.col("dim").alias("j"), (F.round("value", 4) + F.lit(0.0)).alias("w"))


@query("pca_zca_transform")
def pca_zca_transform(spark, sf):
    v = I.vectors(spark, sf).select("doc_id", "vec")
    out = wh.transform(wh.pca_zca_fit(v, n_components=0.96), v)
    return V.dims(out, "vec", "doc_id").select("doc_id", "dim", r6("value"))


@query("ica_fit", _IDENTITY)
def ica_fit(spark, sf):
    """Whatever rotation ICA finds, the output is white."""
    v = I.vectors(spark, sf).select("doc_id", "vec")
    return _moments_of(wh.transform(wh.ica_fit(v, n_components=64), v))


@query("ica_converged", "SELECT count(*) AS components, 0::BIGINT AS restless FROM (SELECT unnest(range(0, max(len(embedding)))) FROM embeddings)")
def ica_converged(spark, sf):
    """Only a rotation that one more step would leave alone passes: a rotation as such is white, but not at rest."""
    v = I.vectors(spark, sf).select("doc_id", "vec")
    turns = wh.ica_restlessness(wh.transform(wh.ica_fit(v, n_components=64), v))
    # Twice the squared angle at which the fit stops.
    return turns.agg(F.count("*").alias("components"), F.count(F.when(F.col("turn") > 4e-3, 1)).alias("restless"))


@query("ica_transform")
def ica_transform(spark, sf):
    v = I.vectors(spark, sf).select("doc_id", "vec")
    out = wh.transform(wh.ica_fit(v, n_components=0.96), v)
    return V.dims(out, "vec", "doc_id").select("doc_id", "dim", r6("value"))


@query("whiten_scope", """
    SELECT 'corpus and queries' AS scope, 2 * count(*) AS n FROM embeddings
    UNION ALL SELECT 'corpus', count(*) FROM embeddings""")
def whiten_scope(spark, sf):
    c = I.vectors(spark, sf)
    q = I.queries(spark, sf).select(F.col("qvec").alias("vec"))
    sized = lambda both, name: wh.whiten_scope(c, q, both).agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), "n")
    return sized(True, "corpus and queries").unionByName(sized(False, "corpus"))


@query("corr_matrix", with_(E, _CORR) + f" SELECT i, j, {sql6('corr', 'corr')} FROM r")
def corr_matrix(spark, sf):
    return wh.corr_matrix(I.vectors(spark, sf)).select("i", "j", r6("corr"))


@query("corr_stats", with_(E, _CORR) + f"""
    SELECT {sql6('avg(abs(corr))', 'mean_abs')}, {sql6('quantile_cont(abs(corr), 0.5)', 'median_abs')},
           {sql6('max(abs(corr))', 'max_abs')}, {sql6('stddev_pop(abs(corr))', 'std_abs')} FROM r WHERE i <> j""")
def corr_stats(spark, sf):
    s = wh.corr_stats(wh.corr_matrix(I.vectors(spark, sf)))
    return s.select(*[r6(c) for c in s.columns])


@query("corr_top_pairs", with_(E, _CORR) + f"""
    SELECT i, j, {sql6('corr', 'corr')} FROM r WHERE i < j ORDER BY abs(corr) DESC, i, j LIMIT 10""")
def corr_top_pairs(spark, sf):
    return wh.corr_top_pairs(wh.corr_matrix(I.vectors(spark, sf)), 10).select("i", "j", r6("corr"))


@query("permute_columns", with_(E, """
    src AS (
      SELECT d, v, row_number() OVER (
        PARTITION BY d ORDER BY substr(md5('0|' || vec_id || '|' || (d - 1)), 1, 15), vec_id) AS place FROM e),
    ids AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings)""") + f"""
    SELECT doc_id, d AS dim, {sql6('v', 'value')} FROM src JOIN ids USING (place)""")
def permute_columns(spark, sf):
    """Cell by cell: in every dimension the n-th id has the value that is n-th in hash order."""
    return V.dims(wh.permute_columns(I.vectors(spark, sf)), "vec", "doc_id").select("doc_id", "dim", r6("value"))


# ---- top-k ----------------------------------------------------------------------------------------------


def _topk_sql(score: str, order: str) -> str:
    return with_(E, LISTS, f"""
    p AS (SELECT a.doc_id AS qid, b.doc_id, {score} AS s FROM l a, l b),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) {order}, doc_id) AS rank FROM p QUALIFY rank <= 10)
    """) + f" SELECT qid, doc_id, {sql6('s', 'score')}, rank FROM r"


_COSINE = "list_inner_product(a.qvec, b.vec) / sqrt(list_inner_product(a.qvec, a.qvec)) / sqrt(list_inner_product(b.vec, b.vec))"


def _run_topk(fn, spark, sf):
    found = fn(I.queries(spark, sf), I.vectors(spark, sf), 10)
    return found.select("qid", "doc_id", r6("score"), "rank")


@query("topk_dot", _topk_sql("list_inner_product(a.qvec, b.vec)", "DESC"))
def topk_dot(spark, sf):
    return _run_topk(tk.topk_dot, spark, sf)


@query("topk_l2", _topk_sql(
    "list_inner_product(a.qvec, a.qvec) - 2 * list_inner_product(a.qvec, b.vec) + list_inner_product(b.vec, b.vec)", "ASC"))
def topk_l2(spark, sf):
    return _run_topk(tk.topk_l2, spark, sf)


@query("topk_cosine", _topk_sql(_COSINE, "DESC"))
def topk_cosine(spark, sf):
    return _run_topk(tk.topk_cosine, spark, sf)


@query("topk_ann")
def topk_ann(spark, sf):
    return _run_topk(ann.topk_ann, spark, sf)


@query("topk_ann_recall", "SELECT 10::BIGINT AS k, count(*) AS n_queries, true AS enough FROM embeddings")
def topk_ann_recall(spark, sf):
    """Whether the stored index finds nine tenths of the exact neighbours of all queries."""
    q, v = I.queries(spark, sf), I.vectors(spark, sf)
    exact = tk.topk_cosine(q, v, 10).select("qid", "doc_id")
    near = ann.topk_ann(q, v, 10).select("qid", "doc_id", F.lit(1).alias("hit"))
    met = exact.join(near, ["qid", "doc_id"], "left")
    return met.agg(F.lit(10).cast("bigint").alias("k"), F.count_distinct("qid").alias("n_queries"),
                   (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("topk_whitened", with_(E, _COV, _inverse_root(), """
    ql AS (SELECT vec_id AS qid, d, floor(v * 8) / 8.0::DOUBLE AS x FROM e),
    wc AS (SELECT vec_id AS doc_id, w.i AS d, sum(w.w * (e.v - mu.mu)) AS v FROM e JOIN mu ON mu.d = e.d JOIN w ON w.j = e.d GROUP BY ALL),
    wq AS (SELECT qid, w.i AS d, sum(w.w * (ql.x - mu.mu)) AS v FROM ql JOIN mu ON mu.d = ql.d JOIN w ON w.j = ql.d GROUP BY ALL),
    a AS (SELECT doc_id, list(v ORDER BY d) AS vec FROM wc GROUP BY doc_id),
    b AS (SELECT qid, list(v ORDER BY d) AS vec FROM wq GROUP BY qid)""") + """
    SELECT qid, doc_id, round(list_inner_product(a.vec, b.vec), 3) AS score,
           row_number() OVER (PARTITION BY qid ORDER BY round(list_inner_product(a.vec, b.vec), 9) DESC, doc_id) AS rank
    FROM a, b QUALIFY rank <= 10""")
def topk_whitened(spark, sf):
    v = I.vectors(spark, sf).select("doc_id", "vec")
    model = wh.zca_fit(v)
    q = wh.transform(model, I.queries(spark, sf).select("qid", "qvec"), "qvec")
    return tk.topk_dot(q, wh.transform(model, v), 10).select("qid", "doc_id", F.round("score", 3).alias("score"), "rank")


@query("id_to_text", with_(E, LISTS, """
    p AS (SELECT a.doc_id AS qid, b.doc_id, row_number() OVER (
            PARTITION BY a.doc_id ORDER BY round(list_inner_product(a.qvec, b.vec), 9) DESC, b.doc_id) AS rank
          FROM l a, l b QUALIFY rank <= 5)""") + """
    SELECT qid, rank, coalesce(text, 'vec ' || p.doc_id) AS text FROM p LEFT JOIN documents USING (doc_id)""")
def id_to_text(spark, sf):
    found = tk.topk_dot(I.queries(spark, sf), I.vectors(spark, sf), 5)
    return found.join(I.corpus(spark, sf).select("doc_id", "text"), "doc_id").select("qid", "rank", "text")


@query("dedupe_leaves", """
    WITH t AS (SELECT vec_id AS doc_id, embedding FROM embeddings
               UNION ALL SELECT vec_id + 1000000, embedding FROM embeddings),
    g AS (SELECT embedding, min(doc_id) AS leaf_id, count(*) AS n FROM t GROUP BY embedding)
    SELECT leaf_id, doc_id, n FROM t JOIN g USING (embedding)""")
def dedupe(spark, sf):
    v = I.vectors(spark, sf).select("doc_id", "vec")
    leaves, members = dedupe_leaves(v.unionByName(v.withColumn("doc_id", F.col("doc_id") + 1000000)))
    return members.join(leaves.select("leaf_id", F.col("count").alias("n")), "leaf_id").select("leaf_id", "doc_id", "n")


@query("label_exact_match", """
    WITH t AS (SELECT vec_id AS doc_id, embedding, label FROM embeddings
               UNION ALL SELECT vec_id + 1000000, embedding, label % 5 FROM embeddings),
    g AS (SELECT embedding, label, min(doc_id) AS leaf_id, count(*) AS n FROM t GROUP BY embedding, label)
    SELECT leaf_id, doc_id, n FROM t JOIN g USING (embedding, label)""")
def label_exact_match(spark, sf):
    v = I.vectors(spark, sf)
    both = v.unionByName(v.withColumn("doc_id", F.col("doc_id") + 1000000).withColumn("label", F.col("label") % 5))
    leaves, members = dedupe_leaves(both, "label")
    return members.join(leaves.select("leaf_id", F.col("count").alias("n")), "leaf_id").select("leaf_id", "doc_id", "n")
