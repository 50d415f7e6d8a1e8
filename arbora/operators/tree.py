"""The concept tree as two tables, and set-based evaluation of the four building operations.

nodes(node_id, parent_id, depth, is_leaf, count, mean, m2[, lc]) – an adjacency table, parent_id null for the root;
members(leaf_id, doc_id) – which documents sit in which leaf. ``lc`` (optional) holds smoothed label counts, one
entry per label of a bounded vocabulary, and turns every score into its label-aware twin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions import gauss as G
from arbora.functions.vec import let, merge_moments, moments, total, zeros_like
from arbora.operators.skew import hot_parts, parted_join
from arbora.operators.topk import SCORE_DECIMALS
from arbora.session import materialize, spread

LABEL_ALPHA = 1e-8  # fixed value: smoothing of label counts
# In the order that decides between equal utilities.
OPERATIONS = ("best", "new", "merge", "split")


@dataclass(frozen=True)
class TreeParams:
    score: str = "kl"
    acuity_cutoff: bool = False
    prior_var: float = G.PRIOR_VAR
    alpha: float = LABEL_ALPHA

    def var(self, m2, n) -> Column:
        return G.variance(m2, n, self.acuity_cutoff, self.prior_var)


@dataclass(frozen=True)
class ConceptTree:
    nodes: DataFrame
    members: DataFrame
    depth: int  # levels below the root
    params: TreeParams = field(default_factory=TreeParams)
    version: str = "0"
    delta: Delta | None = None


@dataclass(frozen=True)
class Delta:
    """What the last batch changed: nodes (rows of the node table and ``gone``) and new members. ``reshaped`` says that
    subtrees moved up or down, so that stored depths have to be counted again."""

    nodes: DataFrame
    members: DataFrame
    reshaped: bool


def rounded(c) -> Column:
    """Scores are compared at a fixed resolution so that sums taken in another order do not reorder rows."""
    return F.round(c, SCORE_DECIMALS) + F.lit(0.0)


def label_shares(lc) -> Column:
    return let(lc, lambda c: let(total(c), lambda t: F.transform(c, lambda v: v / t)))


def add_label(lc, label) -> Column:
    """Counts after one more row with this label index (null: no label)."""
    return F.transform(lc, lambda v, i: v + F.when(i == label, 1.0).otherwise(0.0))


def merge_label_counts(a, b, alpha: float) -> Column:
    """Both sides carry alpha per label; keep it once."""
    return F.zip_with(a, b, lambda x, y: x + y - F.lit(alpha))


# ---- statistics ------------------------------------------------------------------------------------------


def node_stats(rows: DataFrame, key: str, vec: str = "vec", weight: str | None = None) -> DataFrame:
    return moments(rows, [key], vec, weight)


def node_merge(stats: DataFrame, key: str) -> DataFrame:
    return merge_moments(stats, [key])


def label_counts(rows: DataFrame, key: str, label: str, n_labels: int, alpha: float = LABEL_ALPHA) -> DataFrame:
    """(key, lc): smoothed counts per label index as an array; counts combine before the shuffle."""
    counts = [F.sum(F.when(F.col(label) == i, 1.0).otherwise(0.0)) + F.lit(alpha) for i in range(n_labels)]
    return rows.groupBy(key).agg(F.array(*counts).alias("lc"))


def category_utility(nodes: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """(node_id, category_utility) against the root, which is one row."""
    labelled = "lc" in nodes.columns
    root = nodes.where(F.col("parent_id").isNull()).select(
        F.col("count").alias("rn"), F.col("mean").alias("rm"), params.var("m2", "count").alias("rv"),
        *([F.col("lc").alias("rl")] if labelled else []), F.lit(0).alias("_one"))
    n = nodes.withColumn("var", params.var("m2", "count")).withColumn("_one", F.lit(0))
    s = G.score("mean", "var", "rm", "rv", params.score)
    if labelled:
        s = s + G.label_term(label_shares(F.col("lc")), label_shares(F.col("rl")), params.score)
    return n.join(F.broadcast(root), "_one").select(
        "node_id", "parent_id", (F.col("count") / F.col("rn") * s).alias("category_utility"))


def child_scores(nodes: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """Every non-root node against its parent: (parent_id, node_id, child_count, parent_count, share, term = share * score)."""
    labelled = "lc" in nodes.columns
    parent = nodes.where(~F.col("is_leaf")).select(
        F.col("node_id").alias("parent_id"), F.col("count").alias("pn"), F.col("mean").alias("pm"),
        params.var("m2", "count").alias("pv"), *([F.col("lc").alias("pl")] if labelled else []))
    child = nodes.where(F.col("parent_id").isNotNull()).withColumn("var", params.var("m2", "count"))
    s = G.score("mean", "var", "pm", "pv", params.score)
    if labelled:
        s = s + G.label_term(label_shares(F.col("lc")), label_shares(F.col("pl")), params.score)
    return child.join(parent, "parent_id").select(
        "parent_id", "node_id", "is_leaf", F.col("count").alias("child_count"), F.col("pn").alias("parent_count"),
        (F.col("count") / F.col("pn") * s).alias("term"))


def partition_utility(nodes: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """(node_id, n_children, partition_utility); 0 for leaves."""
    inner = child_scores(nodes, params).groupBy("parent_id").agg(
        F.sum("term").alias("s"), F.count("*").alias("n_children"))
    return nodes.select("node_id").join(inner.withColumnRenamed("parent_id", "node_id"), "node_id", "left").select(
        "node_id", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce(F.col("s") / F.col("n_children"), F.lit(0.0)).alias("partition_utility"))


# ---- the four operations ---------------------------------------------------------------------------------


def _child_terms(rows: DataFrame, nodes: DataFrame, params: TreeParams, parts: list[tuple] | None = None) -> DataFrame:
    """rows(row_id, at, x[, y]) x children of ``at``: the share-weighted score of each child without (a) and with
    (b) the row, both against the parent that already holds the row. Many rows may be at one node (``parts``, if known)."""
    parts = hot_parts(rows, ["at"]) if parts is None else parts
    labelled = "lc" in nodes.columns
    parent = nodes.where(~F.col("is_leaf")).select(
        F.col("node_id").alias("at"), F.col("count").alias("pn"), F.col("mean").alias("pm0"), F.col("m2").alias("ps0"),
        *([F.col("lc").alias("pl0")] if labelled else []))
    r = parted_join(spread(rows, "row_id"), parent, ["at"], parts, "row_id").select(
        *rows.columns, "pn", G.insert_mean("x", "pm0", "pn").alias("pm"),
        params.var(G.insert_m2("x", "pm0", "ps0", "pn"), F.col("pn") + 1).alias("pv"),
        *([label_shares(add_label(F.col("pl0"), F.col("y"))).alias("pl")] if labelled else []))
    child = nodes.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("at"), F.col("node_id").alias("child_id"), F.col("is_leaf").alias("child_is_leaf"),
        F.col("count").alias("cn"),
        F.col("mean").alias("cm"), F.col("m2").alias("cs"), params.var("m2", "count").alias("cv"),
        *([F.col("lc").alias("cl")] if labelled else []))
    t = parted_join(r, child, ["at"], parts, "row_id")
    t = t.withColumn("im", G.insert_mean("x", "cm", "cn")).withColumn(
        "iv", params.var(G.insert_m2("x", "cm", "cs", "cn"), F.col("cn") + 1))
    plain, with_row = G.score("cm", "cv", "pm", "pv", params.score), G.score("im", "iv", "pm", "pv", params.score)
    if labelled:
        plain = plain + G.label_term(label_shares(F.col("cl")), F.col("pl"), params.score)
        with_row = with_row + G.label_term(label_shares(add_label(F.col("cl"), F.col("y"))), F.col("pl"), params.score)
    out = t.select(
        "row_id", "at", "pn", "child_id", "child_is_leaf", "cn",
        (F.col("cn") / (F.col("pn") + 1) * plain).alias("a"),
        ((F.col("cn") + 1) / (F.col("pn") + 1) * with_row).alias("b"))
    return out.withColumn("gain", F.col("b") - F.col("a"))


def best_children(rows: DataFrame, nodes: DataFrame, params: TreeParams = TreeParams(),
                  parts: list[tuple] | None = None) -> DataFrame:
    """Per row the two children gaining most: by gain, then size, then smaller id.

    One row each: best ids, their terms, the sum over all children and the utility of inserting in the best.
    """
    terms = _child_terms(rows, nodes, params, parts)
    order = F.struct(rounded(F.col("gain")).alias("g"), F.col("cn").alias("c"))
    # Rows were spread by row_id, so window and sums run where the children were scored; fan-outs are bounded by
    # the builder.
    w = Window.partitionBy("row_id").orderBy(order.desc(), F.col("child_id").asc())
    ranked = terms.withColumn("r", F.row_number().over(w))
    pick = lambda i, c: F.max(F.when(F.col("r") == i, F.col(c)))
    return ranked.groupBy("row_id", "at", "pn").agg(
        F.sum("a").alias("base"), F.count("*").alias("n_children"),
        pick(1, "child_id").alias("best1"), pick(2, "child_id").alias("best2"),
        pick(1, "child_is_leaf").alias("best1_is_leaf"),
        pick(1, "gain").alias("gain1"), pick(2, "gain").alias("gain2"),
        pick(1, "a").alias("a1"), pick(1, "b").alias("b1"), pick(2, "a").alias("a2"),
    ).withColumn("pu_best", (F.col("base") - F.col("a1") + F.col("b1")) / F.col("n_children"))


def pu_insert(rows: DataFrame, nodes: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """(row_id, child_id, pu): utility of the partition if the row goes to each child in turn."""
    terms = _child_terms(rows, nodes, params)
    sums = terms.groupBy("row_id").agg(F.sum("a").alias("base"), F.count("*").alias("n"))
    return terms.join(sums, "row_id").select(
        "row_id", "at", "child_id", ((F.col("base") - F.col("a") + F.col("b")) / F.col("n")).alias("pu"))


def split_utilities(nodes: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """(at, child_id, pu_split): utility if a child with children is replaced by them; needs no row."""
    labelled = "lc" in nodes.columns
    direct = child_scores(nodes, params)
    sums = direct.groupBy("parent_id").agg(F.sum("term").alias("base"), F.count("*").alias("n"))
    extra = ["lc"] if labelled else []
    grand = nodes.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("child_id"), F.col("count").alias("gn"), F.col("mean").alias("gm"),
        params.var("m2", "count").alias("gv"), *[F.col(e).alias("gl") for e in extra])
    child = nodes.where(F.col("parent_id").isNotNull() & ~F.col("is_leaf")).select(
        F.col("node_id").alias("child_id"), F.col("parent_id").alias("at"))
    top = nodes.where(~F.col("is_leaf")).select(
        F.col("node_id").alias("at"), F.col("count").alias("tn"), F.col("mean").alias("tm"),
        params.var("m2", "count").alias("tv"), *[F.col(e).alias("tl") for e in extra])
    s = G.score("gm", "gv", "tm", "tv", params.score)
    if labelled:
        s = s + G.label_term(label_shares(F.col("gl")), label_shares(F.col("tl")), params.score)
    below = (
        grand.join(child, "child_id").join(top, "at")
        .groupBy("at", "child_id").agg(F.sum(F.col("gn") / F.col("tn") * s).alias("below"), F.count("*").alias("g"))
    )
    own = direct.select(F.col("node_id").alias("child_id"), "term")
    return (
        below.join(own, "child_id").join(sums.withColumnRenamed("parent_id", "at"), "at")
        .select("at", "child_id",
                ((F.col("base") - F.col("term") + F.col("below")) / (F.col("n") - 1 + F.col("g"))).alias("pu_split"))
    )


def best_or_new(rows: DataFrame, nodes: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """Per row: best1, best1_is_leaf and the utilities of best and new alone, which is all a walk down needs."""
    labelled = "lc" in nodes.columns
    parent = nodes.where(~F.col("is_leaf")).select(
        F.col("node_id").alias("at"), F.col("mean").alias("pm0"), F.col("m2").alias("ps0"), *([F.col("lc").alias("pl0")] if labelled else []))
    parts = hot_parts(rows, ["at"])
    j = best_children(rows, nodes, params, parts).join(rows.drop("at"), "row_id")
    j = parted_join(j, parent, ["at"], parts, "row_id")
    j = j.withColumn("pm", G.insert_mean("x", "pm0", "pn")).withColumn(
        "pv", params.var(G.insert_m2("x", "pm0", "ps0", "pn"), F.col("pn") + 1))
    s_new = G.score(F.col("x"), G.prior_variance_like("x", params.prior_var), F.col("pm"), F.col("pv"), params.score)
    if labelled:
        blank = F.transform("pl0", lambda v: F.lit(params.alpha))
        s_new = s_new + G.label_term(label_shares(add_label(blank, F.col("y"))), label_shares(add_label(F.col("pl0"), F.col("y"))), params.score)
    return j.select("row_id", "at", "best1", "best1_is_leaf", "pu_best", (
        (F.col("base") + F.lit(1.0) / (F.col("pn") + 1) * s_new) / (F.col("n_children") + 1)).alias("pu_new"))


def operation_utilities(rows: DataFrame, nodes: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """Per row: best1, best2 and the utilities of best / new / merge / split (null where the operation is not allowed)."""
    labelled = "lc" in nodes.columns
    at_parts = hot_parts(rows, ["at"])
    best = best_children(rows, nodes, params, at_parts)
    if at_parts:  # whoever crowds at a node crowds at its children
        best = materialize(best, "best")
    child_parts = [hot_parts(best, [f"best{p}"]) if at_parts else [] for p in (1, 2)]
    stat = lambda p: nodes.select(
        F.col("node_id").alias(f"best{p}"), F.col("count").alias(f"n{p}"), F.col("mean").alias(f"m{p}"),
        F.col("m2").alias(f"s{p}"), *([F.col("lc").alias(f"l{p}")] if labelled else []))
    parent = nodes.select(F.col("node_id").alias("at"), F.col("mean").alias("pm0"), F.col("m2").alias("ps0"),
                          *([F.col("lc").alias("pl0")] if labelled else []))
    j = parted_join(best.join(rows.drop("at"), "row_id"), parent, ["at"], at_parts, "row_id")
    j = parted_join(j, stat(1), ["best1"], child_parts[0], "row_id")
    j = parted_join(j, stat(2), ["best2"], child_parts[1], "row_id", "left")
    j = j.withColumn("pm", G.insert_mean("x", "pm0", "pn")).withColumn(
        "pv", params.var(G.insert_m2("x", "pm0", "ps0", "pn"), F.col("pn") + 1))
    j = j.withColumn("nn", F.col("n1") + F.col("n2")).withColumn("mm", G.merged_mean("m1", "n1", "m2", "n2"))
    j = j.withColumn("ms", G.merged_m2("m1", "s1", "n1", "m2", "s2", "n2"))
    s_new = G.score(F.col("x"), G.prior_variance_like("x", params.prior_var), F.col("pm"), F.col("pv"), params.score)
    s_merge = G.score(G.insert_mean("x", "mm", "nn"), params.var(G.insert_m2("x", "mm", "ms", "nn"), F.col("nn") + 1),
                      F.col("pm"), F.col("pv"), params.score)
    if labelled:
        j = j.withColumn("pl", label_shares(add_label(F.col("pl0"), F.col("y"))))
        blank = F.transform("pl0", lambda v: F.lit(params.alpha))
        s_new = s_new + G.label_term(label_shares(add_label(blank, F.col("y"))), F.col("pl"), params.score)
        both = add_label(merge_label_counts(F.col("l1"), F.col("l2"), params.alpha), F.col("y"))
        s_merge = s_merge + G.label_term(label_shares(both), F.col("pl"), params.score)
    j = j.withColumn("pu_new", (F.col("base") + F.lit(1.0) / (F.col("pn") + 1) * s_new) / (F.col("n_children") + 1))
    j = j.withColumn("pu_merge", F.when(
        (F.col("n_children") > 2) & F.col("best2").isNotNull(),
        (F.col("base") - F.col("a1") - F.col("a2") + (F.col("nn") + 1) / (F.col("pn") + 1) * s_merge)
        / (F.col("n_children") - 1)))
    splits = split_utilities(nodes, params).select("at", F.col("child_id").alias("best1"), "pu_split")
    return parted_join(j, splits, ["at", "best1"], hot_parts(best, ["at", "best1"]) if at_parts else [], "row_id", "left").select(
        "row_id", "at", "n_children", "best1", "best2", "best1_is_leaf", "gain1", "gain2",
        "pu_best", "pu_new", "pu_merge", "pu_split")


def best_operation(rows: DataFrame, nodes: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """(row_id, at, best1, best2, operation, pu): the operation with the highest utility; ties in the order of OPERATIONS."""
    u = operation_utilities(rows, nodes, params)
    options = F.array(*[
        F.struct(rounded(F.col(f"pu_{op}")).alias("pu"), F.lit(-i).alias("rank"), F.lit(op).alias("op"),
                 F.col(f"pu_{op}").alias("exact"))
        for i, op in enumerate(OPERATIONS)])
    top = F.array_max(F.filter(options, lambda o: o["pu"].isNotNull()))
    return u.withColumn("_t", top).select(
        "row_id", "at", "best1", "best2", "best1_is_leaf", F.col("_t.op").alias("operation"), F.col("_t.exact").alias("pu"))


# ---- structural edits on the adjacency table: every edit of a kind is applied at once ---------------------------


def _merged(parts: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Moments, and label counts if the parts have them, of all rows that share ``keys`` (the first one identifies)."""
    merged = merge_moments(parts.drop("lc"), keys)
    if "lc" not in parts.columns:
        return merged
    # Every part carries alpha once per label; the sum shall too.
    bare = array_to_vector(F.transform("lc", lambda c: c - F.lit(alpha)))
    summed = parts.groupBy(keys[0]).agg(vector_to_array(Summarizer.metrics("sum").summary(bare)["sum"]).alias("_lc"))
    return merged.join(summed, keys[0]).withColumn("lc", F.transform("_lc", lambda c: c + F.lit(alpha))).drop("_lc")


def _leaf_labels(rows: DataFrame, nodes: DataFrame, alpha: float) -> DataFrame:
    """rows with ``lc`` if the tree has labels: alpha per label and the row's count at its label ``y`` (null: none)."""
    if "lc" not in nodes.columns:
        return rows
    n_labels = nodes.agg(F.max(F.size("lc"))).first()[0] or 0
    y = F.col("y") if "y" in rows.columns else F.lit(None)
    counts = F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: F.lit(alpha) + F.when(
        i == y, F.col("n").cast("double")).otherwise(0.0)) if n_labels else F.array().cast("array<double>")
    return rows.withColumn("lc", counts)


def _leaf_rows(rows: DataFrame, nodes: DataFrame, alpha: float) -> DataFrame:
    """rows(new_id, parent_id, depth, x, n[, y]) as leaf node rows."""
    return _leaf_labels(rows, nodes, alpha).select(
        "new_id", "parent_id", "depth", F.lit(True).alias("is_leaf"), F.col("n").cast("double").alias("count"),
        F.col("x").alias("mean"), zeros_like("x").alias("m2"), *[c for c in nodes.columns if c == "lc"]
    ).withColumnRenamed("new_id", "node_id")


def op_new(nodes: DataFrame, rows: DataFrame, alpha: float = LABEL_ALPHA) -> DataFrame:
    """Attach rows(new_id, parent_id, x, n[, y]) as leaves; statistics of ancestors are the caller's
    (``add_to_ancestors``). In a tree with label counts ``y`` is the row's label index."""
    depth = nodes.select(F.col("node_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"))
    return nodes.unionByName(_leaf_rows(rows.join(depth, "parent_id"), nodes, alpha))


def op_merge(nodes: DataFrame, pairs: DataFrame, alpha: float = LABEL_ALPHA) -> DataFrame:
    """pairs(at, best1, best2, new_id): both children move under a new node holding their merged statistics.

    ``depth`` below is stale afterwards (see ``refresh_depth``).
    """
    moved = pairs.select("new_id", "at", F.explode(F.array("best1", "best2")).alias("node_id"))
    sums = ["count", "mean", "m2", *[c for c in nodes.columns if c == "lc"]]
    parts = nodes.join(moved, "node_id").select("new_id", "at", "depth", *sums)
    fresh = _merged(parts, ["new_id", "at", "depth"], alpha).select(
        F.col("new_id").alias("node_id"), F.col("at").alias("parent_id"), "depth", F.lit(False).alias("is_leaf"), *sums)
    kept = nodes.join(moved.select("node_id", F.col("new_id").alias("_p")), "node_id", "left").withColumn(
        "parent_id", F.coalesce("_p", "parent_id")).drop("_p")
    return kept.unionByName(fresh)


def op_split(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """gone(node_id): drop these inner nodes and promote their children. No two may be parent and child."""
    lifted = nodes.join(gone, "node_id").select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("_up"))
    kept = nodes.join(gone, "node_id", "left_anti").join(lifted, "parent_id", "left")
    return kept.withColumn("parent_id", F.coalesce("_up", "parent_id")).select(*nodes.columns)


def op_fringe(nodes: DataFrame, rows: DataFrame, alpha: float = LABEL_ALPHA) -> DataFrame:
    """rows(leaf_id, inner_id, new_id, x, n[, y]): put an inner node above each leaf that meets another vector.

    The inner node takes the leaf's place and holds the leaf and all its new rows.
    """
    inner_ids = rows.select("leaf_id", "inner_id").distinct()
    sums = ["count", "mean", "m2", *[c for c in nodes.columns if c == "lc"]]
    old = nodes.join(inner_ids, nodes.node_id == inner_ids.leaf_id)
    parts = old.select("inner_id", "parent_id", "depth", *sums)
    new_parts = _leaf_labels(rows, nodes, alpha).join(old.select("inner_id", "parent_id", "depth"), "inner_id").withColumns(
        {"count": F.col("n").cast("double"), "mean": F.col("x"), "m2": zeros_like("x")}).select(
        "inner_id", "parent_id", "depth", *sums)
    inner = _merged(parts.unionByName(new_parts), ["inner_id", "parent_id", "depth"], alpha).select(
        F.col("inner_id").alias("node_id"), "parent_id", "depth", F.lit(False).alias("is_leaf"), *sums)
    pushed = (
        nodes.join(inner_ids.withColumnRenamed("leaf_id", "node_id"), "node_id", "left")
        .withColumn("depth", F.col("depth") + F.when(F.col("inner_id").isNotNull(), 1).otherwise(0))
        .withColumn("parent_id", F.coalesce("inner_id", "parent_id")).select(*nodes.columns)
    )
    depth = inner.select(F.col("node_id").alias("inner_id"), (F.col("depth") + 1).alias("depth"))
    leaves = _leaf_rows(rows.join(depth, "inner_id").withColumn("parent_id", F.col("inner_id")), nodes, alpha)
    return pushed.unionByName(inner).unionByName(leaves)


def add_to_ancestors(nodes: DataFrame, added: DataFrame, alpha: float = LABEL_ALPHA) -> DataFrame:
    """added(node_id, count, mean, m2[, lc]): merge these sums into the nodes named. A tree with label counts keeps
    them; ``lc`` of the added sums carries alpha per label like any other."""
    keys = ["node_id", "parent_id", "depth", "is_leaf"]
    labelled = "lc" in nodes.columns
    sums = ["count", "mean", "m2", *["lc"] * labelled]
    if labelled and "lc" not in added.columns:
        blank = nodes.select("node_id", F.transform("lc", lambda c: F.lit(alpha)).alias("lc"))
        added = added.join(blank, "node_id")
    extra = nodes.select(*keys).join(added, "node_id").select(*keys, *sums)
    touched = _merged(
        nodes.join(added.select("node_id"), "node_id", "left_semi").select(*keys, *sums).unionByName(extra), keys, alpha)
    return nodes.join(added.select("node_id"), "node_id", "left_anti").select(*keys, *sums).unionByName(
        touched.select(*keys, *sums))
