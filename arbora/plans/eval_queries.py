"""Registered queries: evaluation and reports."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from arbora.operators import evaluate as ev
from arbora.operators import report as rep
from arbora.operators import topk as tk
from arbora.operators import tree_query as tq
from arbora.plans import benchmark as bm
from arbora.plans import inputs as I
from arbora.plans.registry import E, LISTS, ND, NV, PATHS, Q, lp, query, sql6, r6, with_
from arbora.plans.source_queries import METRIC_SQL, metric_rows
from arbora.session import materialize

TOP_K = 20


@query("eval_ks", """
    SELECT item_id, k FROM benchmark, (SELECT unnest([2, 3, 5, 10, 20, 50, 100]) AS k) WHERE k <= item_id""")
def eval_ks(spark, sf):
    """Cut-offs up to a different top_k per row."""
    ks = F.array(*[F.lit(k) for k in ev.EVAL_KS])
    return I.table(spark, sf, "benchmark").select("item_id", F.explode(ks).alias("k")).where("k <= item_id")


# Targets at known ranks: the query of row i looks for the text found at rank 1 + i % 30, or for none beyond 20.
_HITS = """
corpus AS (SELECT vec_id AS doc_id, coalesce(text, 'vec ' || vec_id) AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
p AS (SELECT a.doc_id AS qid, b.doc_id, row_number() OVER (
        PARTITION BY a.doc_id ORDER BY round(list_inner_product(a.qvec, b.vec), 9) DESC, b.doc_id) AS rank
      FROM l a, l b QUALIFY rank <= 20),
tg AS (SELECT p.qid, c.text AS target_text FROM p JOIN corpus c USING (doc_id) WHERE p.rank = 1 + p.qid % 30
       UNION ALL SELECT vec_id, 'nowhere' FROM embeddings WHERE 1 + vec_id % 30 > 20),
h AS (SELECT p.qid, p.rank, c.text = tg.target_text AS hit FROM p JOIN corpus c USING (doc_id) JOIN tg USING (qid)),
ks AS (SELECT unnest([2, 3, 5, 10, 20]) AS k),
per AS (
  SELECT tg.qid, k, least(k, max(rank)) AS n, count(*) FILTER (hit AND rank <= k) AS m, min(rank) FILTER (hit AND rank <= k) AS first
  FROM tg JOIN h USING (qid), ks GROUP BY tg.qid, k),
dsc AS (SELECT i, sum(1 / log2(i + 1)) OVER (ORDER BY i) AS dsum FROM (SELECT unnest(range(1, 21)) AS i)),
per2 AS (
  SELECT per.*, (SELECT count(*) FROM h WHERE h.qid = per.qid AND hit AND h.rank <= per.m) AS a,
         (SELECT dsum FROM dsc WHERE i = per.m) AS dm, (SELECT dsum FROM dsc WHERE i = per.n) AS dn,
         (SELECT sum(1 / log2(rank + 1)) FROM h WHERE h.qid = per.qid AND hit AND h.rank <= per.k) AS dcg FROM per)"""


def _setup(spark, sf):
    """Results of exact search, and targets placed at known ranks (or nowhere)."""
    found = tk.topk_dot(I.queries(spark, sf), I.vectors(spark, sf), TOP_K).select("qid", "doc_id", "rank")
    found = materialize(found, "found")
    corpus = I.corpus(spark, sf).select("doc_id", "text")
    inside = found.where(F.col("rank") == F.col("qid") % 30 + 1).join(corpus, "doc_id").select("qid", F.col("text").alias("target_text"))
    outside = I.queries(spark, sf).where(F.col("qid") % 30 + 1 > TOP_K).select("qid", F.lit("nowhere").alias("target_text"))
    queries = inside.unionByName(outside)
    return ev.mark_hits(found, queries, corpus), queries


@query("recall_mrr_at_k", with_(E, LISTS, _HITS) + """
    SELECT k, round(avg((m > 0)::INT), 4) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr, count(*) AS n_queries FROM per GROUP BY k""")
def recall_mrr_at_k(spark, sf):
    return ev.retrieval_metrics(*_setup(spark, sf), TOP_K).select("k", "recall", "mrr", "n_queries")


@query("ndcg_ref_at_k", with_(E, LISTS, _HITS) + f"""
    SELECT qid, k, {sql6('''CASE WHEN m = 0 THEN 0 ELSE (a * 1.0::DOUBLE / m * dm + CASE WHEN n > m THEN (m - a) * 1.0::DOUBLE / (n - m) * (dn - dm) ELSE 0 END) / dm END''', 'ndcg_ref')}
    FROM per2""")
def ndcg_ref_at_k(spark, sf):
    return ev.query_metrics(*_setup(spark, sf), TOP_K).select("qid", "k", r6("ndcg_ref"))


@query("ndcg_at_k", with_(E, LISTS, _HITS) + f" SELECT qid, k, {sql6('coalesce(dcg / dm, 0)', 'ndcg')} FROM per2")
def ndcg_at_k(spark, sf):
    return ev.query_metrics(*_setup(spark, sf), TOP_K).select("qid", "k", r6("ndcg"))


@query("latency_stats")
def latency_stats(spark, sf):
    """Time of one batch over all queries."""
    began = time.time()
    n = tk.topk_dot(I.queries(spark, sf), I.vectors(spark, sf), TOP_K).select("qid").distinct().count()
    cost = ev.latency_stats(time.time() - began, n)
    return spark.createDataFrame([(n, cost["total_s"], cost["avg_latency_ms"])], "n_queries bigint, total_s double, avg_latency_ms double")


_LEAF_SCORES = """
ps AS (SELECT lp.qid, p.leaf_id, sum(lp.lp) / 4 AS s FROM paths p JOIN lp USING (node_id) GROUP BY lp.qid, p.leaf_id)"""


@query("full_rank_eval", with_(E, Q, ND, NV, PATHS, lp("q", False), _LEAF_SCORES, """
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, leaf_id) AS rank FROM ps),
    t AS (SELECT * FROM r WHERE leaf_id = qid + 1000000)""") + f"""
    SELECT {sql6('avg((rank <= 10)::INT::DOUBLE)', 'recall_at_k')}, {sql6('avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END)', 'mrr_at_k')},
           {sql6('avg(s)', 'avg_true_score')}, {sql6('avg(rank)', 'avg_rank_pos')}, count(*) AS n_queries FROM t""")
def full_rank_eval(spark, sf):
    q = I.queries(spark, sf).select("qid", "qvec", (F.col("qid") + 1000000).alias("target_id"))
    out = ev.full_rank_eval(tq.tree_target_rank(I.fixed_tree(spark, sf), q), 10)
    return out.select(*[r6(c) for c in out.columns if c != "n_queries"], "n_queries")


@query("full_rank_positions", with_(E, Q, ND, NV, PATHS, lp("q", False), _LEAF_SCORES) + """
    SELECT qid, rank, n_items FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, leaf_id) AS rank, count(*) OVER (PARTITION BY qid) AS n_items FROM ps)
    WHERE leaf_id = qid + 1000000""")
def full_rank_positions(spark, sf):
    q = I.queries(spark, sf).select("qid", "qvec", (F.col("qid") + 1000000).alias("target_id"))
    return tq.tree_target_rank(I.fixed_tree(spark, sf), q).select("qid", "rank", "n_items")


@query("listwise_ce", with_(E, Q, ND, NV, PATHS, lp("q", False), _LEAF_SCORES, """
    tg AS (SELECT vec_id AS qid, 1000000 + vec_id AS target_id FROM embeddings)""") + f"""
    SELECT ps.qid, {sql6('ln(sum(exp(s / 0.5 - top))) + min(top) - min(CASE WHEN leaf_id = target_id THEN s / 0.5 END)', 'loss')}
    FROM ps JOIN tg USING (qid) JOIN (SELECT qid, max(s / 0.5) AS top FROM ps GROUP BY qid) USING (qid) GROUP BY ps.qid""")
def listwise_ce(spark, sf):
    """Every query, its own row as target, temperature one half."""
    q = I.queries(spark, sf).select("qid", "qvec", (F.col("qid") + 1000000).alias("target_id"))
    return tq.tree_listwise_ce(I.fixed_tree(spark, sf), q, 0.5).select("qid", r6("loss"))


@query("method_diff", with_(E, LISTS, """
    s AS (SELECT a.doc_id AS qid, b.doc_id, list_inner_product(a.qvec, b.vec) AS dot,
          list_inner_product(a.qvec, a.qvec) - 2 * list_inner_product(a.qvec, b.vec) + list_inner_product(b.vec, b.vec) AS l2 FROM l a, l b),
    x AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(dot, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 3),
    y AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(list_inner_product(b.vec, a.vec), 9) DESC, b.doc_id) AS rank
          FROM (SELECT doc_id AS qid, vec FROM l) a, l b QUALIFY rank <= 3),
    t AS (SELECT qid, doc_id FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(l2, 9), doc_id) AS rank FROM s) WHERE rank = 3)""") + """
    SELECT t.qid, (SELECT string_agg(doc_id, ',' ORDER BY rank) FROM x WHERE x.qid = t.qid) AS list_a,
           (SELECT string_agg(doc_id, ',' ORDER BY rank) FROM y WHERE y.qid = t.qid) AS list_b
    FROM t WHERE EXISTS (SELECT 1 FROM x WHERE x.qid = t.qid AND x.doc_id = t.doc_id)
      AND NOT EXISTS (SELECT 1 FROM y WHERE y.qid = t.qid AND y.doc_id = t.doc_id)""")
def method_diff(spark, sf):
    """Rounded against exact queries; the target is the third nearest by distance."""
    q, v = I.queries(spark, sf), I.vectors(spark, sf)
    a = tk.topk_dot(q, v, 3)
    b = tk.topk_dot(v.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec")), v, 3)
    t = tk.topk_l2(q, v, 3).where("rank = 3").select("qid", "doc_id")
    out = ev.method_diff(a, b, t, 3)
    shown = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    return out.select("qid", shown("list_a"), shown("list_b"))


@query("run_benchmark", """
    SELECT method, k, count(*) AS n_queries FROM embeddings, (SELECT unnest([2, 3, 5, 10]) AS k),
      (SELECT unnest(['dot', 'dot_white', 'l2', 'l2_white', 'ann', 'ann_white', 'bestfirst', 'bestfirst_white']) AS method)
    GROUP BY method, k""")
def run_benchmark(spark, sf):
    """Every method of the widest bundle answers every query; the scores themselves are in ``run_benchmark_metrics``."""
    m = bm.run_benchmark(I.corpus(spark, sf), I.asked(spark, sf), 10, "extra")
    return m.where("recall >= 0 and mrr <= recall and avg_latency_ms > 0").select("method", "k", "n_queries")


@query("run_benchmark_metrics")
def run_benchmark_metrics(spark, sf):
    m = bm.run_benchmark(I.corpus(spark, sf), I.asked(spark, sf), 10, "paths")
    return m.select("method", "k", "recall", "mrr", "ndcg_ref", "ndcg", "n_queries")


@query("run_subtree_report")
def run_subtree_report(spark, sf):
    metrics, subtrees = bm.run_subtree_report(I.corpus(spark, sf), I.asked(spark, sf), 10)
    shape = subtrees.groupBy("grandparent_id").agg(F.count("*").alias("leaves"), (F.max("batch") + 1).alias("batches"))
    return shape.select(F.col("grandparent_id").alias("part"), F.col("leaves").cast("double").alias("a"), F.col("batches").cast("double").alias("b")).unionByName(
        metrics.select(F.concat(F.lit("recall@"), "k").alias("part"), F.col("recall").alias("a"), F.col("mrr").alias("b")))


# ---- reports ---------------------------------------------------------------------------------------------

_MODELS = ["m0", "m1", "m2"]


def _sizes(spark, sf):
    """The corpus sizes in the metrics, as the table heading needs them (one per result file)."""
    return sorted(r[0] for r in metric_rows(spark, sf).select("corpus_size").distinct().collect())


def _unpivoted(table):
    columns = [c for c in table.columns if c != "method"]
    return table.unpivot("method", columns, "col", "value")


@query("metrics_pivot", with_(METRIC_SQL, """
    one AS (SELECT method, model, recall, mrr FROM m WHERE k = 10 QUALIFY row_number() OVER (PARTITION BY method, model ORDER BY file) = 1)""") + """
    SELECT method, model || '|recall' AS col, recall::VARCHAR AS value FROM one
    UNION ALL SELECT method, model || '|mrr', mrr::VARCHAR FROM one
    UNION ALL SELECT method, 'm9|' || metric, '--' FROM (SELECT DISTINCT method FROM m), (SELECT unnest(['recall', 'mrr']) AS metric)""")
def metrics_pivot(spark, sf):
    """First file per model; a model without results shows as missing."""
    from pyspark.sql import Window

    w = Window.partitionBy("method", "model", "k").orderBy("file")
    one = metric_rows(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1")
    return _unpivoted(rep.metrics_pivot(one, 10, [*_MODELS, "m9"], ("recall", "mrr")))


@query("metrics_by_corpus", with_(METRIC_SQL) + """
    SELECT method, corpus_size::VARCHAR || '|ndcg' AS col, ndcg::VARCHAR AS value FROM m WHERE k = 5
    QUALIFY row_number() OVER (PARTITION BY method, corpus_size ORDER BY model) = 1""")
def metrics_by_corpus(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("method", "model", "corpus_size", "k").orderBy("file")
    one = metric_rows(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1")
    return _unpivoted(rep.metrics_by_corpus(one, 5, _MODELS, _sizes(spark, sf), ("ndcg",)))


@query("scale_table", with_(METRIC_SQL, """
    one AS (SELECT method, corpus_size, recall FROM m WHERE model = 'm1' AND k = 5)""") + """
    SELECT t.method, s.corpus_size::VARCHAR || '|recall' AS col, coalesce(one.recall::VARCHAR, '--') AS value
    FROM (SELECT DISTINCT corpus_size FROM m WHERE corpus_size <> (SELECT min(corpus_size) FROM m)) s
    CROSS JOIN (SELECT DISTINCT method FROM one) t LEFT JOIN one ON one.method = t.method AND one.corpus_size = s.corpus_size""")
def scale_table(spark, sf):
    """Sizes the model was not run at show as missing; the smallest size is left out."""
    sizes = _sizes(spark, sf)
    return _unpivoted(rep.scale_table(metric_rows(spark, sf), 5, "m1", sizes, ("recall",), skip=(sizes[0],)))


@query("runtime_table", with_(METRIC_SQL) + """
    SELECT method, corpus_size::VARCHAR AS col, printf('%.2f', max_by(avg_latency_ms, file)) AS value FROM m GROUP BY method, corpus_size""")
def runtime_table(spark, sf):
    return _unpivoted(rep.runtime_table(metric_rows(spark, sf), ["dot", "best first"], _sizes(spark, sf)))
