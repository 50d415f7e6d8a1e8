"""Registered queries: building, growing, searching and describing concept trees."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from arbora.functions import vec as V
from arbora.operators import tree as T
from arbora.operators import tree_analytics as ta
from arbora.operators import tree_build as tb
from arbora.operators import tree_query as tq
from arbora.operators.restructure import improvable
from arbora.operators.tree import ConceptTree
from arbora.plans import inputs as I
from arbora.plans.concept_queries import _ALL_OPS, _AT, _CHILD, _CT, _CU, _OPS, _TERMS, placed_rows
from arbora.plans.registry import E, LN_2PI, ND, NV, PATHS, PV, Q, TOPO, kl, lp, query, r6, sql6, with_
from arbora.session import materialize, scratch_root
from arbora.streaming.append import TreeStore

K = 10


def _written(tree: ConceptTree) -> ConceptTree:
    """The tree with its tables written out, as checks read them many times."""
    return replace(tree, nodes=materialize(tree.nodes, "checked"), members=materialize(tree.members, "checked"))


# ---- building: what must hold for any correct tree over the rows, plus the exact root --------------------------


def invariants(tree: ConceptTree):
    """(fact, dim, value): exact root statistics, and counts of broken rules."""
    tree = _written(tree)
    nodes = tree.nodes
    root = V.pick_dims(nodes.where("parent_id is null"), ["mean", "m2"], "count")
    kids = T.node_merge(nodes.where("parent_id is not null").select("parent_id", "count", "mean", "m2"), "parent_id")
    own = nodes.where("not is_leaf").select(F.col("node_id").alias("parent_id"), F.col("count").alias("n"), F.col("mean").alias("m"), F.col("m2").alias("s"))
    near = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) < 1e-6), lambda x: x)
    broken = own.join(kids, "parent_id", "left").where(
        "count is null or abs(count - n) > 1e-6" ).select(F.lit("parents whose count is not the sum of their children").alias("fact"))
    moved = own.join(kids, "parent_id").where(~near("mean", "m") | ~near("m2", "s")).select(
        F.lit("parents whose statistics are not the merge of their children").alias("fact"))
    lonely = nodes.where("parent_id is not null").groupBy("parent_id").count().where("count = 1").join(
        nodes.where("parent_id is not null").select(F.col("node_id").alias("parent_id")), "parent_id").select(F.lit("inner nodes with one child").alias("fact"))
    held = tree.members.select(F.lit("documents").alias("fact"))
    unsound = ta.index_check(tree, tree.members.select("doc_id").distinct()).select(F.lit("broken index rows").alias("fact"))
    names = ["parents whose count is not the sum of their children", "parents whose statistics are not the merge of their children",
             "inner nodes with one child", "documents", "broken index rows"]
    counted = broken.unionByName(moved).unionByName(lonely).unionByName(held).unionByName(unsound).groupBy("fact").agg(F.count("*").alias("n"))
    # A fixed list of five names.
    listed = tree.members.sparkSession.createDataFrame([(n,) for n in names], "fact string").join(counted, "fact", "left").select(
        "fact", F.lit(0).cast("bigint").alias("dim"), F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("value"))
    stat = lambda c: root.select(F.lit(f"root {c}").alias("fact"), "dim", r6(c, "value"))
    return listed.unionByName(stat("count")).unionByName(stat("mean")).unionByName(stat("m2"))


def _invariants_sql(rows: str, weight: int = 1) -> str:
    """rows: relation (doc_id, d, v) of all rows below the root."""
    return f"""
    SELECT fact, 0::BIGINT AS dim, value FROM (VALUES
      ('parents whose count is not the sum of their children', 0.0::DOUBLE),
      ('parents whose statistics are not the merge of their children', 0.0::DOUBLE),
      ('inner nodes with one child', 0.0::DOUBLE), ('broken index rows', 0.0::DOUBLE)) t(fact, value)
    UNION ALL SELECT 'documents', 0, count(DISTINCT doc_id)::DOUBLE FROM {rows}
    UNION ALL SELECT 'root count', d, {weight} * count(*)::DOUBLE FROM {rows} GROUP BY d
    UNION ALL SELECT 'root mean', d, {sql6('avg(v)', 'm')} FROM {rows} GROUP BY d
    UNION ALL SELECT 'root m2', d, {sql6(f'{weight} * var_pop(v) * count(*)', 's')} FROM {rows} GROUP BY d"""


_ROWS = "rows_ AS (SELECT vec_id AS doc_id, d, v FROM e)"
_GROWN = "rows_ AS (SELECT vec_id AS doc_id, d, v FROM e UNION ALL SELECT qid + 1000000, d, x FROM q)"


_SETTLED = "parents that one merge or split would improve"


def settled(tree: ConceptTree):
    """The facts of ``invariants``, and how many parents could still be improved."""
    tree = _written(tree)
    left = improvable(tree.nodes, tree.params).agg(F.count("*").cast("double").alias("value"))
    return invariants(tree).unionByName(left.select(F.lit(_SETTLED).alias("fact"), F.lit(0).cast("bigint").alias("dim"), "value"))


@query("tree_build", with_(E, _ROWS) + _invariants_sql("rows_") + f" UNION ALL SELECT '{_SETTLED}', 0, 0.0::DOUBLE")
def tree_build(spark, sf):
    return settled(tb.build_tree(I.vectors(spark, sf).select("doc_id", "vec")))


@query("tree_build_greedy", with_(E, _ROWS) + _invariants_sql("rows_"))
def tree_build_greedy(spark, sf):
    return invariants(tb.build_tree(I.vectors(spark, sf).select("doc_id", "vec"), greedy=True))


def _new_rows(spark, sf):
    return I.queries(spark, sf).select((F.col("qid") + 1000000).alias("doc_id"), F.col("qvec").alias("vec"))


@query("tree_append", with_(E, Q, _GROWN) + _invariants_sql("rows_") + f" UNION ALL SELECT '{_SETTLED}', 0, 0.0::DOUBLE")
def tree_append(spark, sf):
    tree = tb.build_tree(I.vectors(spark, sf).select("doc_id", "vec"))
    return settled(tb.append_rows(tree, _new_rows(spark, sf), "1"))


@query("tree_append_stream", with_(E, Q, _GROWN) + _invariants_sql("rows_") + f" UNION ALL SELECT '{_SETTLED}', 0, 0.0::DOUBLE")
def tree_append_stream(spark, sf):
    """The same rows as two micro-batches of a file stream."""
    root = os.path.join(scratch_root(spark), f"stream-{uuid.uuid4().hex}")
    v = I.vectors(spark, sf).select("doc_id", "vec")
    v.coalesce(1).write.parquet(f"{root}/in/a")
    _new_rows(spark, sf).coalesce(1).write.parquet(f"{root}/in/b")
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    store = TreeStore(spark, f"{root}/tree")
    store.follow(stream, f"{root}/checkpoint").awaitTermination()
    return settled(store.load())


@query("tree_refit", with_(E, _ROWS) + _invariants_sql("rows_", 3).replace("('broken index rows', 0.0::DOUBLE)",
       "('broken index rows', (SELECT count(*) FROM embeddings)::DOUBLE)"))
def tree_refit(spark, sf):
    """Every row was seen three times, so each leaf counts three for its one document."""
    return invariants(tb.refit_tree(I.vectors(spark, sf).select("doc_id", "vec"), iterations=3))


# ---- searching a fixed tree ------------------------------------------------------------------------------


def _q(spark, sf):
    return I.queries(spark, sf).select("qid", "qvec")


def _leaf_row(found):
    return found.withColumn("doc_id", F.col("leaf_id") - 1000000)


@query("tree_topk_bestfirst", with_(E, Q, ND, NV, PATHS, lp("q"), """
    s AS (SELECT p.leaf_id, p.depth, lp.qid, round(lp.lp, 9) AS s FROM paths p JOIN lp USING (node_id) WHERE p.depth > 0),
    m AS (SELECT *, min(s) OVER (PARTITION BY qid, leaf_id ORDER BY depth ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM s),
    k AS (SELECT qid, leaf_id, list(s ORDER BY depth) AS key FROM m WHERE later IS NULL OR s < later GROUP BY qid, leaf_id)""") + f"""
    SELECT qid, leaf_id - 1000000 AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY key DESC, leaf_id) AS rank
    FROM k QUALIFY rank <= {K}""")
def tree_topk_bestfirst(spark, sf):
    tree = I.stored_tree(spark, sf)
    found = tq.tree_topk_bestfirst(tree, _q(spark, sf), K)
    return tq.expand_members(found, tree).select("qid", "doc_id", "rank")


_PATH_SCORE = """
ps AS (SELECT lp.qid, p.leaf_id, sum(lp.lp * {w}) / 4 AS s FROM paths p JOIN lp USING (node_id) GROUP BY lp.qid, p.leaf_id)"""


def _path_sql(weight: str) -> str:
    return with_(E, Q, ND, NV, PATHS, lp("q", False), _PATH_SCORE.format(w=weight)) + f"""
    SELECT qid, leaf_id - 1000000 AS doc_id, {sql6('s', 'score')},
           row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, leaf_id) AS rank FROM ps QUALIFY rank <= {K}"""


def _path_out(found):
    return _leaf_row(found).select("qid", "doc_id", r6("score"), "rank")


@query("tree_topk_path", _path_sql("1"))
def tree_topk_path(spark, sf):
    return _path_out(tq.tree_topk_path(I.stored_tree(spark, sf), _q(spark, sf), K))


@query("level_weights", _path_sql("(CASE depth WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE"))
def level_weights(spark, sf):
    """Given weights for the first two levels; the others weigh 1."""
    return _path_out(tq.tree_topk_path(I.stored_tree(spark, sf), _q(spark, sf), K, [0.5, 2.0]))


@query("weight_schedule", with_("s AS (SELECT unnest(range(0, 4)) AS level)", """
    w AS (
      SELECT 'constant' AS kind, level, 2.0::DOUBLE AS weight FROM s
      UNION ALL SELECT 'linear', level, 0.5::DOUBLE + (2.0::DOUBLE - 0.5) * level / 3 FROM s
      UNION ALL SELECT 'linear decrease', level, 2.0::DOUBLE + (0.5::DOUBLE - 2.0) * level / 3 FROM s
      UNION ALL SELECT 'quadratic', level, 1.0::DOUBLE / greatest(1, level * level) FROM s
      UNION ALL SELECT 'exponential', level, 0.5::DOUBLE ** level FROM s)""", PATHS) + f"""
    SELECT kind, leaf_id, depth, {sql6('weight / 4', 'weight')} FROM paths JOIN w ON w.level = paths.depth""")
def weight_schedule(spark, sf):
    """The path index of the tree under each schedule."""
    tree, out = I.fixed_tree(spark, sf), None
    for name, kind, kw in (("constant", "constant", {"value": 2.0}), ("linear", "linear", {"start": 0.5, "end": 2.0}),
                           ("linear decrease", "linear", {"start": 0.5, "end": 2.0, "direction": "decrease"}),
                           ("quadratic", "quadratic", {"start_n": 0}), ("exponential", "exponential", {"base": 0.5})):
        index = tq.path_index(tree, tq.weight_schedule(kind, 4, **kw)).select(
            F.lit(name).alias("kind"), "leaf_id", "depth", r6("weight"))
        out = index if out is None else out.unionByName(index)
    return out


@query("path_index", with_(PATHS) + " SELECT leaf_id, depth, node_id, 0.25::DOUBLE AS weight FROM paths")
def path_index(spark, sf):
    return tq.path_index(I.fixed_tree(spark, sf))


@query("tree_rank_scores", with_(E, Q, ND, NV, PATHS, lp("q", False), _PATH_SCORE.format(w="1")) + f"""
    SELECT qid, leaf_id - 1000000 AS doc_id, {sql6('s', 'score')} FROM ps""")
def tree_rank_scores(spark, sf):
    """Scores of all leaves for every query."""
    return _leaf_row(tq.tree_rank_scores(I.fixed_tree(spark, sf), _q(spark, sf))).select("qid", "doc_id", r6("score"))


@query("path_stats", with_(E, ND, NV, PATHS) + f"""
    SELECT leaf_id, depth, node_id, {sql6('sum(mean)', 'mean_sum')}, {sql6('sum(var)', 'var_sum')}
    FROM paths JOIN nv USING (node_id) GROUP BY leaf_id, depth, node_id""")
def path_stats(spark, sf):
    tree = I.fixed_tree(spark, sf)
    out = tq.path_stats(tree, tree.nodes.where("is_leaf").select(F.col("node_id").alias("leaf_id")))
    return out.select("leaf_id", "depth", "node_id", r6(V.total("mean"), "mean_sum"), r6(V.total("var"), "var_sum"))


@query("categorize_best", with_(E, Q, ND, NV, lp("q")) + f"""
    SELECT qid, node_id, {sql6('lp', 'score')} FROM lp
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(lp, 9) DESC, node_id) = 1""")
def categorize_best(spark, sf):
    return tq.categorize_best(I.fixed_tree(spark, sf), _q(spark, sf)).select("qid", "node_id", r6("score"))


def _descend_sql(score: str) -> str:
    """One ranked choice per level: the root, its best child, and so on."""
    step = """
l{d} AS (
  SELECT u.qid, t.node_id, {score} AS s FROM l{u} u JOIN topo t ON t.parent_id = u.node_id
  JOIN lp ON lp.qid = u.qid AND lp.node_id = t.node_id JOIN cnt ON cnt.node_id = t.node_id
  QUALIFY row_number() OVER (PARTITION BY u.qid ORDER BY round({score}, 9) DESC, t.node_id) = 1)"""
    return with_(E, Q, ND, NV, TOPO, lp("q"), """
cnt AS (SELECT node_id, min(n) AS n FROM nd GROUP BY node_id)""", """
l0 AS (SELECT qid, node_id, lp AS s FROM lp WHERE node_id = 0)""",
                 *[step.format(d=d, u=d - 1, score=score) for d in (1, 2, 3)])


@query("categorize_greedy", _descend_sql("lp.lp") + f"""
    , a AS (SELECT *, 0 AS d FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3),
    b AS (SELECT qid, node_id AS best_id, s FROM a QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, d) = 1)
    SELECT qid, l3.node_id AS leaf_id, {sql6('l3.s', 'leaf_score')}, best_id, {sql6('b.s', 'best_score')} FROM l3 JOIN b USING (qid)""")
def categorize_greedy(spark, sf):
    out = tq.categorize_greedy(I.stored_tree(spark, sf), _q(spark, sf))
    return out.select("qid", "leaf_id", r6("leaf_score"), "best_id", r6("best_score"))


@query("categorize_posterior", _descend_sql("(lp.lp + ln(cnt.n) - ln((SELECT count(*) FROM embeddings)))") + f"""
    SELECT qid, node_id AS leaf_id, {sql6('s', 'leaf_score')} FROM l3""")
def categorize_posterior(spark, sf):
    out = tq.categorize_greedy(I.stored_tree(spark, sf), _q(spark, sf), posterior=True)
    return out.select("qid", "leaf_id", r6("leaf_score"))


@query("basic_level", with_(E, ND, NV, PATHS, _CU) + f"""
    SELECT leaf_id, node_id AS basic_id, {sql6('cu', 'utility')} FROM paths JOIN cu USING (node_id)
    QUALIFY row_number() OVER (PARTITION BY leaf_id ORDER BY round(cu, 9) DESC, depth DESC) = 1""")
def basic_level(spark, sf):
    return tq.basic_level(I.stored_tree(spark, sf)).select("leaf_id", "basic_id", r6("utility"))


@query("best_level", with_(E, Q, ND, NV, PATHS, lp("q"), """
    cnt AS (SELECT node_id, min(n) AS n FROM nd GROUP BY node_id)""") + f"""
    SELECT qid AS row_id, node_id AS best_id, {sql6('lp + ln(n) - ln((SELECT count(*) FROM embeddings))', 'log_posterior')}
    FROM paths JOIN lp USING (node_id) JOIN cnt USING (node_id) WHERE leaf_id = qid + 1000000
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(lp + ln(n), 9) DESC, depth DESC) = 1""")
def best_level(spark, sf):
    rows = _q(spark, sf).select(F.col("qid").alias("row_id"), F.col("qvec").alias("x"), (F.col("qid") + 1000000).alias("leaf_id"))
    return tq.best_level(I.stored_tree(spark, sf), rows).select("row_id", "best_id", r6("log_posterior"))


@query("leaf_topk", with_(E, Q, f"""
    s AS (SELECT q.qid, e.vec_id AS doc_id, -0.5 * sum({LN_2PI} + ln(1e-8) + (q.x - e.v) ** 2 / 1e-8) AS s
          FROM q JOIN e ON e.d = q.d GROUP BY q.qid, e.vec_id)""") + f"""
    SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rank FROM s QUALIFY rank <= {K}""")
def leaf_topk(spark, sf):
    return _leaf_row(tq.leaf_topk(I.fixed_tree(spark, sf), _q(spark, sf), K)).select("qid", "doc_id", "rank")


@query("is_ancestor", with_(PATHS) + """,
    a AS (SELECT vec_id, 1 + (vec_id % 10) AS a, 1000000 + vec_id AS b FROM embeddings)
    SELECT a.a, a.b, EXISTS (SELECT 1 FROM paths WHERE leaf_id = a.b AND node_id = a.a) AS is_ancestor FROM a""")
def is_ancestor(spark, sf):
    """Each leaf against one of the label nodes."""
    pairs = I.vectors(spark, sf).select((F.col("doc_id") % 10 + 1).alias("a"), (F.col("doc_id") + 1000000).alias("b"))
    return tq.is_ancestor(I.fixed_tree(spark, sf), pairs)


# ---- labels ----------------------------------------------------------------------------------------------

_LC = """
lc AS (
  SELECT m.node_id, y.y, count(*) FILTER (m.label = y.y) + 1e-8::DOUBLE AS c
  FROM mem m, (SELECT unnest(range(0, 10)) AS y) y GROUP BY m.node_id, y.y),
lp_ AS (SELECT node_id, y, c / sum(c) OVER (PARTITION BY node_id) AS p, c FROM lc)"""


@query("label_counts", with_(E, ND, _LC) + f" SELECT node_id, y AS label, {sql6('c', 'count')}, {sql6('p', 'share')} FROM lp_")
def label_counts(spark, sf):
    rows = I.vectors(spark, sf).join(ta.ancestors(I.fixed_tree(spark, sf)), "doc_id")
    top = rows.agg(F.max("label")).first()[0]
    shares = T.label_counts(rows, "node_id", "label", 0 if top is None else int(top) + 1).select(
        "node_id", "lc", T.label_shares(F.col("lc")).alias("p"))
    return V.pick_dims(shares, ["lc", "p"], "node_id").select(
        "node_id", (F.col("dim") - 1).alias("label"), r6("lc", "count"), r6("p", "share"))


@query("label_counts_merged", with_(E, ND, _LC) + f" SELECT y AS label, {sql6('c', 'count')} FROM lc WHERE node_id = 0")
def label_counts_merged(spark, sf):
    """The counts of the root, merged from its children without counting the smoothing twice."""
    nodes = I.fixed_tree(spark, sf, with_labels=True).nodes.where("depth = 1").select("lc")
    alpha = T.LABEL_ALPHA
    cells = nodes.select(F.posexplode("lc").alias("label", "c")).groupBy("label").agg(
        (F.sum(F.col("c") - F.lit(alpha)) + F.lit(alpha)).alias("count"))
    return cells.select(F.col("label").cast("bigint").alias("label"), r6("count"))


# Each query carries the label of its row; every tenth label is unknown to the tree, and label 9 is withheld.
_Y = """
y AS (SELECT vec_id AS qid, CASE WHEN label = 9 THEN NULL WHEN label = 8 THEN -1 ELSE label END AS y,
             100000 + 2 * label + vec_id % 2 AS node_id FROM embeddings)"""


@query("label_logprob", with_(E, Q, ND, NV, lp("q"), _LC, _Y) + f"""
    SELECT y.qid AS row_id, {sql6('''lp.lp + CASE WHEN y.y IS NULL THEN 0
      WHEN y.y < 0 THEN ln(1e-8) - ln((SELECT sum(c) FROM lc WHERE lc.node_id = y.node_id) + 1e-8) ELSE ln(p) END''', 'log_prob')}
    FROM y JOIN lp ON lp.qid = y.qid AND lp.node_id = y.node_id LEFT JOIN lp_ ON lp_.node_id = y.node_id AND lp_.y = y.y""")
def label_logprob(spark, sf):
    rows = I.queries(spark, sf).select(
        F.col("qid").alias("row_id"), (F.lit(100000) + F.col("label") * 2 + F.col("qid") % 2).alias("node_id"), F.col("qvec").alias("x"),
        F.when(F.col("label") == 9, F.lit(None)).when(F.col("label") == 8, F.lit(-1)).otherwise(F.col("label")).alias("y"))
    return tq.label_log_prob(rows, I.fixed_tree(spark, sf, with_labels=True).nodes).select("row_id", r6("log_prob"))


_LABEL_TERM = {
    "kl": "sum(-c.p * ln(c.p)) - sum(-c.p * ln(r.p))",
    "info": "sum(-c.p * ln(c.p)) - sum(-r.p * ln(r.p))",
    "ecg": "sum(-c.p * c.p) - sum(-r.p * r.p)",
}


@query("label_score", with_(E, ND, NV, TOPO, _LC) + f"""
    SELECT t.node_id, {', '.join(sql6(s, k) for k, s in _LABEL_TERM.items())}
    FROM topo t JOIN lp_ c USING (node_id) JOIN lp_ r ON r.node_id = t.parent_id AND r.y = c.y GROUP BY t.node_id""")
def label_score(spark, sf):
    """What labels add to the score of every node against its parent."""
    from arbora.functions import gauss as G

    n = I.fixed_tree(spark, sf, with_labels=True).nodes.select("node_id", "parent_id", T.label_shares(F.col("lc")).alias("p"))
    up = n.select(F.col("node_id").alias("parent_id"), F.col("p").alias("r"))
    return n.join(up, "parent_id").select("node_id", *[r6(G.label_term("p", "r", k), k) for k in ("kl", "info", "ecg")])


_LABEL_CU = """
lr AS (SELECT c.node_id, sum(-c.p * ln(c.p)) - sum(-c.p * ln(r.p)) AS t FROM lp_ c JOIN lp_ r ON r.node_id = 0 AND r.y = c.y GROUP BY c.node_id),
lt AS (SELECT t.node_id, sum(-c.p * ln(c.p)) - sum(-c.p * ln(r.p)) AS t FROM topo t JOIN lp_ c USING (node_id)
       JOIN lp_ r ON r.node_id = t.parent_id AND r.y = c.y GROUP BY t.node_id),
cn AS (SELECT node_id, min(n) AS n FROM nd GROUP BY node_id)"""


@query("label_ops", with_(E, ND, NV, TOPO, _CHILD, _TERMS, _CU, _LC, _LABEL_CU) + f"""
    SELECT topo.node_id, {sql6('cu.cu + cn.n / r.n * lr.t', 'category_utility')}, {sql6('coalesce(b.pu, 0)', 'partition_utility')}
    FROM topo JOIN cu USING (node_id) JOIN lr USING (node_id) JOIN cn USING (node_id) JOIN cn r ON r.node_id = 0
    LEFT JOIN (SELECT parent_id, sum(term + cn / pn * lt.t) / count(*) AS pu FROM term JOIN lt USING (node_id) GROUP BY parent_id) b
      ON b.parent_id = topo.node_id""")
def label_ops(spark, sf):
    nodes = I.fixed_tree(spark, sf, with_labels=True).nodes
    cu, pu = T.category_utility(nodes), T.partition_utility(nodes)
    return cu.join(pu, "node_id").select("node_id", r6("category_utility"), r6("partition_utility"))


# Label counts of parent, child, merged pair and new child after the row's own label is added.
_LABEL_OPS = """
ya AS (SELECT a.row_id, a.at_ AS host, e.label AS y0 FROM at_ a JOIN embeddings e ON e.vec_id = a.qid),
lpar AS (SELECT ya.row_id, lc.y, (lc.c + (lc.y = ya.y0)::INT) AS c FROM ya JOIN lc ON lc.node_id = ya.host),
ppar AS (SELECT row_id, y, c / sum(c) OVER (PARTITION BY row_id) AS p FROM lpar),
lch AS (
  SELECT ya.row_id, t.node_id AS child_id, lc.y, lc.c, lc.c + (lc.y = ya.y0)::INT AS c1
  FROM ya JOIN topo t ON t.parent_id = ya.host JOIN lc ON lc.node_id = t.node_id),
pch AS (SELECT *, c / sum(c) OVER w AS p, c1 / sum(c1) OVER w AS p1 FROM lch WINDOW w AS (PARTITION BY row_id, child_id)),
lab AS (
  SELECT h.row_id, h.child_id, sum(-h.p * ln(h.p)) + sum(h.p * ln(r.p)) AS ta, sum(-h.p1 * ln(h.p1)) + sum(h.p1 * ln(r.p)) AS tb
  FROM pch h JOIN ppar r USING (row_id, y) GROUP BY h.row_id, h.child_id),
ct AS (
  SELECT g.row_id, g.host, g.child_id, g.pn, g.cn, g.a + g.cn / (g.pn + 1) * lab.ta AS a, g.b + (g.cn + 1) / (g.pn + 1) * lab.tb AS b
  FROM ct0 g JOIN lab USING (row_id, child_id))"""
_LABEL_BEST = _CT[_CT.index("\nrk AS"):]
_LABEL_NEW = """
lnw AS (
  SELECT row_id, sum(-p * ln(p)) + sum(p * ln(rp)) AS t FROM (
    SELECT ya.row_id, y.y, (1e-8::DOUBLE + (y.y = ya.y0)::INT) / (1 + 10 * 1e-8::DOUBLE) AS p, r.p AS rp
    FROM ya, (SELECT unnest(range(0, 10)) AS y) y, ppar r WHERE r.row_id = ya.row_id AND r.y = y.y) GROUP BY row_id),
lmg AS (
  SELECT row_id, sum(-p * ln(p)) + sum(p * ln(rp)) AS t FROM (
    SELECT b.row_id, c / sum(c) OVER (PARTITION BY b.row_id) AS p, rp FROM (
      SELECT b.row_id, u.y, u.c + o.c - 1e-8::DOUBLE + (u.y = ya.y0)::INT AS c, r.p AS rp
      FROM best b JOIN ya USING (row_id) JOIN lc u ON u.node_id = b.best1 JOIN lc o ON o.node_id = b.best2 AND o.y = u.y
      JOIN ppar r ON r.row_id = b.row_id AND r.y = u.y) b) GROUP BY row_id)"""


@query("label_best_operation", with_(
    E, Q, ND, NV, TOPO, _LC,
    _AT.replace("AS host, vec_id AS qid", "AS at_, vec_id AS qid").replace("a.host", "a.at_").replace("SELECT a.row_id, a.at_,", "SELECT a.row_id, a.at_ AS host,"),
    _CT[:_CT.index("\nrk AS")].rstrip().rstrip(",").replace("ct AS", "ct0 AS"), _LABEL_OPS, _LABEL_BEST, _LABEL_NEW, _OPS[:_OPS.index("gp AS")].rstrip().rstrip(",")) + f"""
    SELECT b.row_id, b.host, best1, best2, {sql6('gain1', 'gain1')}, {sql6('(base - a1 + b1) / n', 'pu_best')},
           {sql6('(base + (nw.s + lnw.t) / (pn + 1)) / (n + 1)', 'pu_new')},
           {sql6('CASE WHEN n > 2 THEN (base - a1 - a2 + (nn + 1) / (pn + 1) * (mg.s + lmg.t)) / (n - 1) END', 'pu_merge')}
    FROM best b JOIN nw USING (row_id) JOIN lnw USING (row_id) LEFT JOIN mg USING (row_id) LEFT JOIN lmg USING (row_id)""")
def label_best_operation(spark, sf):
    """The operation utilities with labels counted in."""
    u = T.operation_utilities(placed_rows(spark, sf, with_labels=True), I.stored_tree(spark, sf, with_labels=True).nodes)
    return u.select("row_id", F.col("at").alias("host"), "best1", "best2", r6("gain1"), r6("pu_best"), r6("pu_new"), r6("pu_merge"))


_POST = """
cnt AS (SELECT t.node_id, t.parent_id, min(n) AS n FROM topo t JOIN nd USING (node_id) GROUP BY t.node_id, t.parent_id),
u AS (SELECT lp.qid, c.node_id, c.parent_id, lp.lp, lp.lp + ln(c.n) - ln(p.n) AS u FROM lp JOIN cnt c USING (node_id) JOIN cnt p ON p.node_id = c.parent_id),
rel AS (SELECT *, u - (max(u) OVER w + ln(sum(exp(u - top)) OVER w)) AS rel
        FROM (SELECT *, max(u) OVER (PARTITION BY qid, parent_id) AS top FROM u) WINDOW w AS (PARTITION BY qid, parent_id)),
r1 AS (SELECT r.qid, r.node_id, r.rel AS ll, r.lp FROM rel r WHERE r.parent_id = 0),
r2 AS (SELECT r.qid, r.node_id, r.rel + r1.ll AS ll, r.lp FROM rel r JOIN r1 ON r1.qid = r.qid AND r1.node_id = r.parent_id),
r3 AS (SELECT r.qid, r.node_id, r.rel + r2.ll AS ll, r.lp FROM rel r JOIN r2 ON r2.qid = r.qid AND r2.node_id = r.parent_id),
post AS (SELECT qid, node_id, lp AS score FROM lp WHERE node_id = 0 UNION ALL SELECT qid, node_id, ll + lp FROM r1
         UNION ALL SELECT qid, node_id, ll + lp FROM r2 UNION ALL SELECT qid, node_id, ll + lp FROM r3)"""


@query("bestfirst_posterior", with_(E, Q, ND, NV, TOPO, PATHS, lp("q"), _POST, """
    s AS (SELECT p.leaf_id, p.depth, post.qid, round(post.score, 9) AS s FROM paths p JOIN post USING (node_id) WHERE p.depth > 0),
    m AS (SELECT *, min(s) OVER (PARTITION BY qid, leaf_id ORDER BY depth ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM s),
    k AS (SELECT qid, leaf_id, list(s ORDER BY depth) AS key FROM m WHERE later IS NULL OR s < later GROUP BY qid, leaf_id)""") + f"""
    SELECT qid, leaf_id - 1000000 AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY key DESC, leaf_id) AS rank
    FROM k QUALIFY rank <= {K}""")
def bestfirst_posterior(spark, sf):
    return _leaf_row(tq.bestfirst_posterior(I.stored_tree(spark, sf), _q(spark, sf), K)).select("qid", "doc_id", "rank")


@query("predict_label_probs", with_(E, Q, ND, NV, TOPO, lp("q"), _POST, _LC, """
    w AS (SELECT post.qid, l.y AS label, post.score + ln(l.p) AS w FROM post JOIN lp_ l USING (node_id)),
    x AS (SELECT qid, label, w, max(w) OVER (PARTITION BY qid) AS top FROM w)""") + f"""
    SELECT qid, label, {sql6('sum(exp(w - top)) / sum(sum(exp(w - top))) OVER (PARTITION BY qid)', 'prob')}
    FROM x GROUP BY qid, label""")
def predict_label_probs(spark, sf):
    out = tq.predict_label_probs(I.stored_tree(spark, sf, with_labels=True), _q(spark, sf))
    return out.select("qid", F.col("label").cast("bigint").alias("label"), r6("prob"))


@query("node_predict", with_(E, ND, _LC) + """
    SELECT node_id, y AS label FROM lp_ QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY p DESC, y) = 1""")
def node_predict(spark, sf):
    return tq.node_predict(I.fixed_tree(spark, sf, with_labels=True)).select("node_id", F.col("label").cast("bigint").alias("label"))


# ---- shape -----------------------------------------------------------------------------------------------


@query("leaf_count", "SELECT count(*) AS leaves FROM embeddings")
def leaf_count(spark, sf):
    return ta.leaf_count(I.fixed_tree(spark, sf).nodes)


@query("level_histogram", with_(TOPO) + " SELECT depth, count(*) AS n_nodes FROM topo GROUP BY depth")
def level_histogram(spark, sf):
    return ta.level_histogram(I.fixed_tree(spark, sf).nodes)


@query("children_histogram", with_(TOPO) + """
    SELECT n_children, count(*) AS n_parents FROM (SELECT parent_id, count(*) AS n_children FROM topo WHERE parent_id IS NOT NULL
    GROUP BY parent_id) GROUP BY n_children""")
def children_histogram(spark, sf):
    return ta.children_histogram(I.fixed_tree(spark, sf).nodes)


@query("node_depth", with_(TOPO) + " SELECT node_id, depth FROM topo")
def node_depth(spark, sf):
    return ta.node_depth(I.fixed_tree(spark, sf))


@query("num_concepts", "WITH RECURSIVE" + TOPO + """,
    up(node_id, below) AS (
      SELECT node_id, node_id FROM topo
      UNION ALL SELECT t.parent_id, up.below FROM up JOIN topo t ON t.node_id = up.node_id WHERE t.parent_id IS NOT NULL)
    SELECT node_id, count(*) AS concepts FROM up GROUP BY node_id""")
def num_concepts(spark, sf):
    return ta.num_concepts(I.fixed_tree(spark, sf))


@query("index_info", with_(TOPO, PATHS) + """
    SELECT (SELECT count(*) FROM topo) AS nodes, count(DISTINCT leaf_id) AS leaf_paths, count(*) AS entries, max(depth) + 1 AS max_depth FROM paths""")
def index_info(spark, sf):
    return ta.index_info(I.fixed_tree(spark, sf))


@query("corpus_size", "SELECT count(*) AS n_docs FROM embeddings")
def corpus_size(spark, sf):
    return ta.corpus_size(I.fixed_tree(spark, sf))


@query("index_check", """
    SELECT 'document without leaf' AS problem, doc_id::VARCHAR AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'member not in corpus', vec_id::VARCHAR FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def index_check(spark, sf):
    """The tree over the vectors, checked against the documents, which are not all in it."""
    return ta.index_check(I.fixed_tree(spark, sf), I.table(spark, sf, "documents").select("doc_id"))


@query("subtree_extract", """
    SELECT 1 + label::BIGINT AS grandparent_id, 100000 + 2 * label + vec_id % 2 AS parent_id, 1000000 + vec_id AS leaf_id,
           (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 4 AS batch FROM embeddings""")
def subtree_extract(spark, sf):
    return ta.subtree_extract(I.fixed_tree(spark, sf), 4)
