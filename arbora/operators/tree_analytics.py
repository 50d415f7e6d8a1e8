"""Shape of a concept tree and consistency of its index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.skew import prefix_sums
from arbora.operators.tree import ConceptTree
from arbora.operators.tree_query import leaf_paths, top_down


def leaf_count(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    return nodes.select("node_id").join(parents, "node_id", "left_anti").agg(F.count("*").alias("leaves"))


def level_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count("*").alias("n_nodes"))


def children_histogram(nodes: DataFrame) -> DataFrame:
    fan = nodes.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n_children"))
    return fan.groupBy("n_children").agg(F.count("*").alias("n_parents"))


def _node_paths(tree: ConceptTree) -> DataFrame:
    slim = tree.nodes.select("node_id", "parent_id", "depth", "is_leaf")
    return top_down(tree, slim, {"path": F.array("node_id")}, {"path": lambda up: F.concat(F.col(up), F.array("node_id"))})


def node_depth(tree: ConceptTree) -> DataFrame:
    """(node_id, depth) found by walking the adjacency, with 0 for the root."""
    return _node_paths(tree).select("node_id", (F.size("path") - 1).alias("depth"))


def num_concepts(tree: ConceptTree) -> DataFrame:
    """(node_id, concepts): nodes of the subtree below and including each node; counts combine before the shuffle."""
    return _node_paths(tree).select(F.explode("path").alias("node_id")).groupBy("node_id").agg(
        F.count("*").alias("concepts"))


def index_info(tree: ConceptTree) -> DataFrame:
    n = tree.nodes.agg(F.count("*").alias("nodes"), F.lit(0).alias("_one"))
    p = leaf_paths(tree).agg(F.count("*").alias("leaf_paths"), F.sum(F.size("path")).alias("entries"),
                             F.max(F.size("path")).alias("max_depth"), F.lit(0).alias("_one"))
    return n.join(p, "_one").select("nodes", "leaf_paths", "entries", F.col("max_depth").cast("bigint").alias("max_depth"))


def corpus_size(tree: ConceptTree) -> DataFrame:
    return tree.members.agg(F.count("*").alias("n_docs"))


def index_check(tree: ConceptTree, corpus: DataFrame) -> DataFrame:
    """corpus(doc_id) -> (problem, id): one row per violation, none for a sound index."""
    paths = leaf_paths(tree)
    held = tree.members.groupBy("leaf_id").agg(F.count("*").cast("double").alias("held"))
    counts = tree.nodes.where("is_leaf").select(F.col("node_id").alias("leaf_id"), "count")
    twice = tree.members.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    text = lambda c: F.col(c).cast("string").alias("id")
    return (
        corpus.join(tree.members.select("doc_id").distinct(), "doc_id", "left_anti")
        .select(F.lit("document without leaf").alias("problem"), text("doc_id"))
        .unionByName(tree.members.join(paths, "leaf_id", "left_anti")
                     .select(F.lit("member of a leaf without path").alias("problem"), text("doc_id")))
        .unionByName(tree.members.join(corpus, "doc_id", "left_anti")
                     .select(F.lit("member not in corpus").alias("problem"), text("doc_id")))
        .unionByName(twice.select(F.lit("document in several leaves").alias("problem"), text("doc_id")))
        .unionByName(counts.join(held, "leaf_id", "left").where("coalesce(held, 0) <> count")
                     .select(F.lit("leaf count differs from members").alias("problem"), text("leaf_id")))
    )


def subtree_extract(tree: ConceptTree, num_leaves: int = 4) -> DataFrame:
    """(grandparent_id, parent_id, leaf_id, batch): nodes with labelled leaves two levels down, leaves in batches.

    The numbering inside a grandparent is a prefix sum, so one that holds most leaves is still spread out.
    """
    held = tree.members.select("leaf_id").distinct()
    leaf = tree.nodes.where("is_leaf").select(F.col("node_id").alias("leaf_id"), "parent_id").join(held, "leaf_id", "left_semi")
    parent = tree.nodes.select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("grandparent_id")).where(
        "grandparent_id is not null")
    rows = leaf.join(parent, "parent_id")
    if dict(rows.dtypes)["leaf_id"] == "string":
        rows = rows.withColumn("_ord", F.xxhash64("leaf_id"))
    else:
        rows = rows.withColumn("_ord", F.col("leaf_id").cast("bigint"))
    numbered = prefix_sums(rows.withColumn("_c", F.lit(1)), "_ord", {"before": "_c"}, keys=["grandparent_id"])
    return numbered.select("grandparent_id", "parent_id", "leaf_id",
                           F.floor(F.col("before") / F.lit(num_leaves)).cast("bigint").alias("batch"))


def ancestors(tree: ConceptTree) -> DataFrame:
    """(doc_id, node_id): every document with its leaf and all nodes above it."""
    paths = leaf_paths(tree).select("leaf_id", F.explode("path").alias("node_id"))
    return tree.members.join(paths, "leaf_id").select("doc_id", "node_id")
