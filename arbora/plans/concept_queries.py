"""Registered queries: concept statistics and the four building operations, on a fixed tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbora.functions import gauss as G
from arbora.functions import vec as V
from arbora.operators import tree as T
from arbora.plans import inputs as I
from arbora.plans.registry import E, LN_2PI, ND, NV, PV, Q, TOPO, ecg, info, kl, query, r6, sql6, with_

_LABEL_STATS = """
ls AS (SELECT label, d, count(*)::DOUBLE AS n, avg(v) AS mean, var_pop(v) * count(*) AS m2 FROM e GROUP BY label, d)"""


def _label_stats(spark, sf):
    return T.node_stats(I.vectors(spark, sf), "label")


_STATS_OUT = f"SELECT label, d AS dim, n AS count, {sql6('mean', 'mean')}, {sql6('m2', 'm2')} FROM ls"


def _stats_out(df):
    return V.pick_dims(df, ["mean", "m2"], "label", "count").select("label", "dim", "count", r6("mean"), r6("m2"))


@query("node_stats", with_(E, _LABEL_STATS) + _STATS_OUT)
def node_stats(spark, sf):
    return _stats_out(_label_stats(spark, sf))


@query("node_merge", with_(E, _LABEL_STATS) + _STATS_OUT)
def node_merge(spark, sf):
    """Statistics of many small groups, merged, equal those of the rows."""
    parts = V.moments(I.vectors(spark, sf).withColumn("part", F.col("doc_id") % 7), ["label", "part"])
    return _stats_out(T.node_merge(parts, "label"))


@query("node_var", with_(E, _LABEL_STATS) + f"""
    SELECT label, d AS dim, {sql6(f'm2 / n + {PV}', 'var')}, {sql6(f'greatest(m2 / n, {PV})', 'cutoff_var')} FROM ls""")
def node_var(spark, sf):
    s = _label_stats(spark, sf).select("label", G.variance("m2", "count").alias("var"),
                                       G.variance("m2", "count", acuity_cutoff=True).alias("cutoff_var"))
    return V.pick_dims(s, ["var", "cutoff_var"], "label").select("label", "dim", r6("var"), r6("cutoff_var"))


@query("node_std", with_(E, _LABEL_STATS) + f" SELECT label, d AS dim, {sql6(f'sqrt(m2 / n + {PV})', 'std')} FROM ls")
def node_std(spark, sf):
    s = _label_stats(spark, sf).select("label", G.std("m2", "count").alias("std"))
    return V.dims(s, "std", "label", out="std").select("label", "dim", r6("std"))


def _rows_with_stats(spark, sf):
    return I.queries(spark, sf).withColumnRenamed("qvec", "x").join(_label_stats(spark, sf), "label")


_ROWS = "rs AS (SELECT q.qid, q.d, q.x, ls.n, ls.mean, ls.m2 FROM q JOIN ls USING (label, d))"


@query("hyp_new", with_(E, Q) + f" SELECT qid, d AS dim, {sql6('x', 'mean')}, {sql6(PV + '::DOUBLE', 'var')} FROM q")
def hyp_new(spark, sf):
    s = I.queries(spark, sf).select("qid", F.col("qvec").alias("mean"), G.prior_variance_like("qvec").alias("var"))
    return V.pick_dims(s, ["mean", "var"], "qid").select("qid", "dim", r6("mean"), r6("var"))


@query("hyp_insert", with_(E, Q, _LABEL_STATS, _ROWS) + f"""
    SELECT qid, d AS dim, {sql6('mean + (x - mean) / (n + 1)', 'mean')},
           {sql6(f'(m2 + (x - mean) * (x - (mean + (x - mean) / (n + 1)))) / (n + 1) + {PV}', 'var')} FROM rs""")
def hyp_insert(spark, sf):
    s = _rows_with_stats(spark, sf).select(
        "qid", G.insert_mean("x", "mean", "count").alias("im"),
        G.variance(G.insert_m2("x", "mean", "m2", "count"), F.col("count") + 1).alias("var"))
    return V.pick_dims(s, ["im", "var"], "qid").select("qid", "dim", r6("im", "mean"), r6("var"))


_PAIR_ROWS = """
rs AS (
  SELECT q.qid, q.d, q.x, a.n + b.n AS n, (a.n * a.mean + b.n * b.mean) / (a.n + b.n) AS mean,
         a.m2 + b.m2 + (a.mean - b.mean) ** 2 * a.n * b.n / (a.n + b.n) AS m2
  FROM q JOIN ls a USING (label, d) JOIN ls b ON b.label = (q.label + 1) % 10 AND b.d = q.d)"""


def _pair_rows(spark, sf):
    nxt = _label_stats(spark, sf).select(F.pmod(F.col("label") - 1, F.lit(10)).alias("label"), F.col("count").alias("nb"),
                                         F.col("mean").alias("mb"), F.col("m2").alias("sb"))
    return _rows_with_stats(spark, sf).join(nxt, "label")


@query("hyp_merge", with_(E, Q, _LABEL_STATS, _PAIR_ROWS) + f"""
    SELECT qid, d AS dim, {sql6('mean + (x - mean) / (n + 1)', 'mean')},
           {sql6(f'(m2 + (x - mean) ** 2 * n / (n + 1)) / (n + 1) + {PV}', 'var')} FROM rs""")
def hyp_merge(spark, sf):
    s = _pair_rows(spark, sf).select(
        "qid", "x", (F.col("count") + F.col("nb")).alias("n"), G.merged_mean("mean", "count", "mb", "nb").alias("m"),
        G.merged_m2("mean", "m2", "count", "mb", "sb", "nb").alias("s"))
    s = s.select("qid", G.insert_mean("x", "m", "n").alias("im"), G.variance(G.insert_m2("x", "m", "s", "n"), F.col("n") + 1).alias("var"))
    return V.pick_dims(s, ["im", "var"], "qid").select("qid", "dim", r6("im", "mean"), r6("var"))


_LOGP = f"-0.5 * sum(ln(m2 / n + {PV}) + {LN_2PI} + (x - mean) ** 2 / (m2 / n + {PV}))"


@query("gauss_logprob", with_(E, Q, _LABEL_STATS, _ROWS) + f" SELECT qid, {sql6(_LOGP, 'log_prob')} FROM rs GROUP BY qid")
def gauss_logprob(spark, sf):
    s = _rows_with_stats(spark, sf).withColumn("var", G.variance("m2", "count"))
    return s.select("qid", r6(G.log_prob("x", "mean", "var"), "log_prob"))


@query("class_logpost", with_(E, Q, _LABEL_STATS, _ROWS) + f"""
    SELECT qid, {sql6(_LOGP + ' + ln(min(n)) - ln((SELECT count(*) FROM embeddings))', 'log_posterior')} FROM rs GROUP BY qid""")
def class_logpost(spark, sf):
    root = I.vectors(spark, sf).agg(F.count("*").alias("rn"), F.lit(0).alias("_one"))
    s = _rows_with_stats(spark, sf).withColumn("var", G.variance("m2", "count")).withColumn("_one", F.lit(0)).join(
        F.broadcast(root), "_one")
    return s.select("qid", r6(G.log_posterior("x", "mean", "var", "count", "rn"), "log_posterior"))


_CHILD = """
cp AS (SELECT t.node_id, t.parent_id, c.d, c.n AS cn, p.n AS pn, c.mean AS cm, c.var AS cv, p.mean AS pm, p.var AS pv
       FROM topo t JOIN nv c USING (node_id) JOIN nv p ON p.node_id = t.parent_id AND p.d = c.d)"""


def _score_query(kind: str, sql: str):
    @query(f"score_{kind}", with_(E, ND, NV, TOPO, _CHILD) + f" SELECT node_id, {sql6(sql, 'score')} FROM cp GROUP BY node_id")
    def run(spark, sf):
        """Every node against its parent; the share is taken out of the term again."""
        t = T.child_scores(I.fixed_tree(spark, sf).nodes, T.TreeParams(score=kind))
        return t.select("node_id", r6(F.col("term") * F.col("parent_count") / F.col("child_count"), "score"))

    return run


score_kl = _score_query("kl", kl("cm", "cv", "pm", "pv"))
score_info = _score_query("info", info("cv", "pv"))
score_ecg = _score_query("ecg", ecg("cv", "pv"))

_AFTER = f"(m2 + (x - mean) ** 2 * n / (n + 1)) / (n + 1) + {PV}"


def _after_sql(weight: str) -> str:
    return (f"SELECT qid, {sql6(f'{weight} * sum(ln({_AFTER}))', 'info')}, "
            f"{sql6(f'-sum(1 / (2 * sqrt(pi()) * sqrt({_AFTER})))', 'ecg')} FROM rs GROUP BY qid")


@query("score_insert", with_(E, Q, _LABEL_STATS, _ROWS) + _after_sql("0.25"))
def score_insert(spark, sf):
    return _rows_with_stats(spark, sf).select("qid", *[
        r6(G.score_after_insert("x", "mean", "m2", "count", kind), kind) for kind in ("info", "ecg")])


@query("score_merge", with_(E, Q, _LABEL_STATS, _PAIR_ROWS) + _after_sql("0.5"))
def score_merge(spark, sf):
    a, b = {"count": "count", "mean": "mean", "m2": "m2"}, {"count": "nb", "mean": "mb", "m2": "sb"}
    return _pair_rows(spark, sf).select("qid", *[r6(G.score_after_merge("x", a, b, kind), kind) for kind in ("info", "ecg")])


_CU = f"""
cu AS (SELECT c.node_id, min(c.n) / min(r.n) * {kl('c.mean', 'c.var', 'r.mean', 'r.var')} AS cu
       FROM nv c JOIN nv r ON r.node_id = 0 AND r.d = c.d GROUP BY c.node_id)"""


@query("category_utility", with_(E, ND, NV, _CU) + f" SELECT node_id, {sql6('cu', 'category_utility')} FROM cu")
def category_utility(spark, sf):
    return T.category_utility(I.fixed_tree(spark, sf).nodes).select("node_id", r6("category_utility"))


_TERMS = f"""
term AS (SELECT node_id, parent_id, min(cn) AS cn, min(pn) AS pn, min(cn) / min(pn) * {kl('cm', 'cv', 'pm', 'pv')} AS term
         FROM cp GROUP BY node_id, parent_id),
base AS (SELECT parent_id, sum(term) AS base, count(*) AS n FROM term GROUP BY parent_id)"""


@query("partition_utility", with_(E, ND, NV, TOPO, _CHILD, _TERMS) + f"""
    SELECT topo.node_id, coalesce(n, 0) AS n_children, {sql6('coalesce(base / n, 0)', 'partition_utility')}
    FROM topo LEFT JOIN base ON base.parent_id = topo.node_id""")
def partition_utility(spark, sf):
    return T.partition_utility(I.fixed_tree(spark, sf).nodes).select("node_id", "n_children", r6("partition_utility"))


# ---- operations -----------------------------------------------------------------------------------------

# Every query is placed at the root and at the node of its label.
_AT = """
at_ AS (SELECT vec_id * 2 AS row_id, 0::BIGINT AS host, vec_id AS qid FROM embeddings
        UNION ALL SELECT vec_id * 2 + 1, 1 + label::BIGINT, vec_id FROM embeddings),
rx AS (
  SELECT a.row_id, a.host, q.d, q.x, n.n AS pn, n.mean + (x - n.mean) / (n.n + 1) AS pm,
         (n.m2 + (x - n.mean) ** 2 * n.n / (n.n + 1)) / (n.n + 1) + {PV} AS pv
  FROM at_ a JOIN q USING (qid) JOIN nd n ON n.node_id = a.host AND n.d = q.d)""".replace("{PV}", PV)
_CT = f"""
cx AS (
  SELECT r.row_id, r.host, r.pn, r.pm, r.pv, c.node_id AS child_id, c.n AS cn, c.mean AS cm, c.var AS cv,
         c.mean + (r.x - c.mean) / (c.n + 1) AS im, (c.m2 + (r.x - c.mean) ** 2 * c.n / (c.n + 1)) / (c.n + 1) + {PV} AS iv
  FROM rx r JOIN topo t ON t.parent_id = r.host JOIN nv c ON c.node_id = t.node_id AND c.d = r.d),
ct AS (
  SELECT row_id, host, child_id, min(pn) AS pn, min(cn) AS cn, min(cn) / (min(pn) + 1) * {kl('cm', 'cv', 'pm', 'pv')} AS a,
         (min(cn) + 1) / (min(pn) + 1) * {kl('im', 'iv', 'pm', 'pv')} AS b
  FROM cx GROUP BY row_id, host, child_id),
rk AS (
  SELECT *, b - a AS gain, sum(a) OVER w AS base, count(*) OVER w AS n,
         row_number() OVER (PARTITION BY row_id ORDER BY round(b - a, 9) DESC, cn DESC, child_id) AS r
  FROM ct WINDOW w AS (PARTITION BY row_id)),
best AS (
  SELECT row_id, host, min(pn) AS pn, min(base) AS base, min(n) AS n, min(CASE WHEN r = 1 THEN child_id END) AS best1,
         min(CASE WHEN r = 2 THEN child_id END) AS best2, min(CASE WHEN r = 1 THEN gain END) AS gain1,
         min(CASE WHEN r = 2 THEN gain END) AS gain2, min(CASE WHEN r = 1 THEN a END) AS a1,
         min(CASE WHEN r = 1 THEN b END) AS b1, min(CASE WHEN r = 2 THEN a END) AS a2
  FROM rk GROUP BY row_id, host)"""
_OPS = f"""
nw AS (SELECT row_id, {kl('x', PV, 'pm', 'pv')} AS s FROM rx GROUP BY row_id),
mg0 AS (
  SELECT b.row_id, r.x, r.pm, r.pv, p.n + o.n AS n, (p.n * p.mean + o.n * o.mean) / (p.n + o.n) AS mean,
         p.m2 + o.m2 + (p.mean - o.mean) ** 2 * p.n * o.n / (p.n + o.n) AS m2
  FROM best b JOIN rx r USING (row_id) JOIN nd p ON p.node_id = b.best1 AND p.d = r.d JOIN nd o ON o.node_id = b.best2 AND o.d = r.d),
mg1 AS (SELECT *, mean + (x - mean) / (n + 1) AS im, {_AFTER} AS iv FROM mg0),
mg AS (SELECT row_id, min(n) AS nn, {kl('im', 'iv', 'pm', 'pv')} AS s FROM mg1 GROUP BY row_id),
gp AS (
  SELECT c.parent_id AS host, c.node_id AS child_id, g.node_id, min(gv.n) / min(tv.n) * {kl('gv.mean', 'gv.var', 'tv.mean', 'tv.var')} AS s
  FROM topo c JOIN topo g ON g.parent_id = c.node_id JOIN nv gv ON gv.node_id = g.node_id
  JOIN nv tv ON tv.node_id = c.parent_id AND tv.d = gv.d GROUP BY c.parent_id, c.node_id, g.node_id),
gs AS (SELECT host, child_id, sum(s) AS below, count(*) AS g FROM gp GROUP BY host, child_id),
sp AS (
  SELECT gs.host, gs.child_id, (base.base - term.term + gs.below) / (base.n - 1 + gs.g) AS pu_split
  FROM gs JOIN term ON term.node_id = gs.child_id JOIN base ON base.parent_id = gs.host),
ops AS (
  SELECT b.row_id, b.host, b.best1, b.best2, (base - a1 + b1) / n AS pu_best, (base + nw.s / (pn + 1)) / (n + 1) AS pu_new,
         CASE WHEN n > 2 THEN (base - a1 - a2 + (nn + 1) / (pn + 1) * mg.s) / (n - 1) END AS pu_merge, sp.pu_split
  FROM best b JOIN nw USING (row_id) LEFT JOIN mg USING (row_id) LEFT JOIN sp ON sp.host = b.host AND sp.child_id = b.best1)"""
_ALL_OPS = (E, Q, ND, NV, TOPO, _CHILD, _TERMS, _AT, _CT, _OPS)


def placed_rows(spark, sf, with_labels: bool = False):
    q = I.queries(spark, sf)
    extra = [F.col("label").alias("y")] if with_labels else []
    root = q.select((F.col("qid") * 2).alias("row_id"), F.lit(0).cast("bigint").alias("at"), F.col("qvec").alias("x"), *extra)
    own = q.select((F.col("qid") * 2 + 1).alias("row_id"), (F.col("label") + 1).cast("bigint").alias("at"), F.col("qvec").alias("x"), *extra)
    return root.unionByName(own)


@query("best_children", with_(*_ALL_OPS[:-1]) + f"""
    SELECT row_id, host, best1, best2, {sql6('gain1', 'gain1')}, {sql6('gain2', 'gain2')},
           {sql6('(base - a1 + b1) / n', 'pu_best')} FROM best""")
def best_children(spark, sf):
    out = T.best_children(placed_rows(spark, sf), I.stored_tree(spark, sf).nodes)
    return out.select("row_id", F.col("at").alias("host"), "best1", "best2", r6("gain1"), r6("gain2"), r6("pu_best"))


@query("pu_insert", with_(*_ALL_OPS[:-1]) + f" SELECT row_id, host, child_id, {sql6('(base - a + b) / n', 'pu')} FROM rk")
def pu_insert(spark, sf):
    return T.pu_insert(placed_rows(spark, sf), I.stored_tree(spark, sf).nodes).select("row_id", F.col("at").alias("host"), "child_id", r6("pu"))


def _pu_query(op: str):
    @query(f"pu_{op}", with_(*_ALL_OPS) + f" SELECT row_id, host, best1, {sql6(f'pu_{op}', 'pu')} FROM ops WHERE pu_{op} IS NOT NULL")
    def run(spark, sf):
        u = T.operation_utilities(placed_rows(spark, sf), I.stored_tree(spark, sf).nodes)
        return u.where(f"pu_{op} is not null").select("row_id", F.col("at").alias("host"), "best1", r6(f"pu_{op}", "pu"))

    return run


pu_new, pu_merge, pu_split = _pu_query("new"), _pu_query("merge"), _pu_query("split")


@query("best_operation", with_(*_ALL_OPS) + f""",
    o AS (SELECT row_id, host, best1, best2, 'best' AS operation, pu_best AS pu, 0 AS k FROM ops
          UNION ALL SELECT row_id, host, best1, best2, 'new', pu_new, 1 FROM ops
          UNION ALL SELECT row_id, host, best1, best2, 'merge', pu_merge, 2 FROM ops
          UNION ALL SELECT row_id, host, best1, best2, 'split', pu_split, 3 FROM ops)
    SELECT row_id, host, best1, best2, operation, {sql6('pu', 'pu')} FROM o WHERE pu IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(pu, 9) DESC, k) = 1""")
def best_operation(spark, sf):
    out = T.best_operation(placed_rows(spark, sf), I.stored_tree(spark, sf).nodes)
    return out.select("row_id", F.col("at").alias("host"), "best1", "best2", "operation", r6("pu"))


# ---- structural edits -------------------------------------------------------------------------------------

_BOTH = """
b AS (SELECT vec_id, label, d, v, vec_id % 2 AS half, 1000000 + vec_id AS leaf FROM e
      UNION ALL SELECT qid, label, d, x, qid % 2, 2000000 + qid FROM q)"""


def _edited_out(nodes):
    return nodes.select("node_id", "parent_id", "count", r6(V.total("mean"), "mean_sum"), r6(V.total("m2"), "m2_sum"))


def _edited_sql(source: str) -> str:
    """source: rows (node_id, parent_id, d, v)."""
    return f"""
    SELECT node_id, parent_id, min(n) AS count, {sql6('sum(mean)', 'mean_sum')}, {sql6('sum(m2)', 'm2_sum')}
    FROM (SELECT node_id, parent_id, d, count(*)::DOUBLE AS n, avg(v) AS mean, var_pop(v) * count(*) AS m2
          FROM ({source}) GROUP BY node_id, parent_id, d) GROUP BY node_id, parent_id"""


@query("op_new", with_(E, Q, _BOTH) + _edited_sql("""
    SELECT 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, d, v FROM b
    UNION ALL SELECT 1 + label, 0, d, v FROM b
    UNION ALL SELECT 100000 + 2 * label + half, 1 + label, d, v FROM b
    UNION ALL SELECT leaf, 100000 + 2 * label + half, d, v FROM b"""))
def op_new(spark, sf):
    """Every query becomes a leaf beside the vector it came from, and its ancestors take it in."""
    q = I.queries(spark, sf)
    half = F.lit(100000) + F.col("label") * 2 + F.col("qid") % 2
    rows = q.select((F.col("qid") + 2000000).alias("new_id"), half.alias("parent_id"), F.col("qvec").alias("x"), F.lit(1).alias("n"))
    up = q.select(F.explode(F.array(F.lit(0).cast("bigint"), (F.col("label") + 1).cast("bigint"), half)).alias("node_id"), "qvec")
    tree = T.add_to_ancestors(I.fixed_tree(spark, sf).nodes, T.node_stats(up, "node_id", "qvec"))
    return _edited_out(T.op_new(tree, rows))


@query("op_merge", with_(E) + _edited_sql("""
    SELECT 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, d, v FROM e
    UNION ALL SELECT 300000 + label // 2, 0, d, v FROM e
    UNION ALL SELECT 1 + label, 300000 + label // 2, d, v FROM e
    UNION ALL SELECT 100000 + 2 * label + vec_id % 2, 1 + label, d, v FROM e
    UNION ALL SELECT 1000000 + vec_id, 100000 + 2 * label + vec_id % 2, d, v FROM e"""))
def op_merge(spark, sf):
    """The label nodes are merged in neighbouring pairs."""
    tree = I.fixed_tree(spark, sf)
    pair = tree.nodes.where("depth = 1").groupBy(F.floor((F.col("node_id") - 1) / 2).alias("p")).agg(
        F.min("node_id").alias("best1"), F.max("node_id").alias("best2")).select(
        F.lit(0).cast("bigint").alias("at"), "best1", "best2", (F.col("p") + 300000).cast("bigint").alias("new_id"))
    return _edited_out(T.op_merge(tree.nodes, pair))


@query("op_split", with_(E) + _edited_sql("""
    SELECT 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, d, v FROM e
    UNION ALL SELECT 1 + label, 0, d, v FROM e
    UNION ALL SELECT 1000000 + vec_id, 1 + label, d, v FROM e"""))
def op_split(spark, sf):
    """The nodes between labels and leaves are dissolved."""
    tree = I.fixed_tree(spark, sf)
    return _edited_out(T.op_split(tree.nodes, tree.nodes.where("depth = 2").select("node_id")))


@query("op_fringe", with_(E, Q) + _edited_sql("""
    SELECT 0::BIGINT AS node_id, NULL::BIGINT AS parent_id, d, v FROM e
    UNION ALL SELECT 1 + label, 0, d, v FROM e
    UNION ALL SELECT 100000 + 2 * label + vec_id % 2, 1 + label, d, v FROM e
    UNION ALL SELECT 3000000 + vec_id, 100000 + 2 * label + vec_id % 2, d, v FROM e
    UNION ALL SELECT 3000000 + qid, 100000 + 2 * label + qid % 2, d, x FROM q
    UNION ALL SELECT 1000000 + vec_id, 3000000 + vec_id, d, v FROM e
    UNION ALL SELECT 2000000 + qid, 3000000 + qid, d, x FROM q"""))
def op_fringe(spark, sf):
    """Every leaf meets its query: both move under a new inner node (ancestors are left as they were)."""
    rows = I.queries(spark, sf).select(
        (F.col("qid") + 1000000).alias("leaf_id"), (F.col("qid") + 3000000).alias("inner_id"),
        (F.col("qid") + 2000000).alias("new_id"), F.col("qvec").alias("x"), F.lit(1).alias("n"))
    return _edited_out(T.op_fringe(I.fixed_tree(spark, sf).nodes, rows))
