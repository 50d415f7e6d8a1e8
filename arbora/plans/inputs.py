"""The given tables as operator inputs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.vec import moments, zeros_like
from arbora.operators.tree import ConceptTree, TreeParams
from arbora.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, vec, label)"""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector rounded down to eighths, as a query for its own row: (qid, qvec, label)."""
    return vectors(spark, sf_dir).select(
        F.col("doc_id").alias("qid"), F.transform("vec", lambda v: F.floor(v * 8) / F.lit(8.0)).alias("qvec"), "label")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, vec): vectors with the text of the document of the same id, or a made-up name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return vectors(spark, sf_dir).join(docs, "doc_id", "left").select(
        "doc_id", F.coalesce("text", F.concat(F.lit("vec "), F.col("doc_id").cast("string"))).alias("text"), "vec")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, target_text, qvec): every query, looking for the text of its own row."""
    texts = corpus(spark, sf_dir).select(F.col("doc_id").alias("qid"), F.col("text").alias("target_text"))
    return queries(spark, sf_dir).select("qid", "qvec").join(texts, "qid")


def stored_tree(spark: SparkSession, sf_dir: str, with_labels: bool = False) -> ConceptTree:
    """``fixed_tree`` written out first, for queries that read its nodes several times."""
    tree = fixed_tree(spark, sf_dir, with_labels)
    return replace(tree, nodes=materialize(tree.nodes, "tree"))


def fixed_tree(spark: SparkSession, sf_dir: str, with_labels: bool = False, params: TreeParams = TreeParams()) -> ConceptTree:
    """root 0 -> label (1 + label) -> label and parity of the id (100000 + 2 label + parity) -> leaf (1000000 + id)."""
    v = vectors(spark, sf_dir).withColumn("label_id", (F.col("label") + 1).cast("bigint")).withColumn(
        "half_id", F.lit(100000) + F.col("label") * 2 + F.col("doc_id") % 2).withColumn(
        "leaf_id", F.col("doc_id") + 1000000)
    # The vocabulary is what the table has: labels are numbered from 0.
    top = v.agg(F.max("label")).first()[0] if with_labels else None
    n_labels = 0 if top is None else int(top) + 1
    up = F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("depth")),
        F.struct(F.col("label_id").alias("node_id"), F.lit(0).cast("bigint").alias("parent_id"), F.lit(1).alias("depth")),
        F.struct(F.col("half_id").alias("node_id"), F.col("label_id").alias("parent_id"), F.lit(2).alias("depth"))))
    counts = {"lc": F.array(*[F.sum(F.when(F.col("label") == i, 1.0).otherwise(0.0)) + F.lit(params.alpha)
                              for i in range(n_labels)])} if with_labels else {}
    inner = moments(v.select("vec", "label", up.alias("n")).select("vec", "label", "n.*"),
                    ["node_id", "parent_id", "depth"], extra=counts).withColumn("is_leaf", F.lit(False))
    leaves = v.select(F.col("leaf_id").alias("node_id"), F.col("half_id").alias("parent_id"), F.lit(3).alias("depth"),
                      F.lit(True).alias("is_leaf"), F.lit(1.0).alias("count"), F.col("vec").alias("mean"),
                      zeros_like("vec").alias("m2"), *([F.array(*[
                          F.when(F.col("label") == i, 1.0).otherwise(0.0) + F.lit(params.alpha) for i in range(n_labels)
                      ]).alias("lc")] if with_labels else []))
    order = ["node_id", "parent_id", "depth", "is_leaf", "count", "mean", "m2"] + (["lc"] if with_labels else [])
    nodes = inner.select(*order).unionByName(leaves.select(*order))
    return ConceptTree(nodes, v.select("leaf_id", "doc_id"), 3, params)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the turn after it: (pair_id, question1, question2, label), label 1 if an assistant answers.

    The next turn is found by an equality join on (conv_id, turn), which no long conversation can skew.
    """
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("r2"), F.col("text").alias("t2"))
    return c.where("role = 'user'").join(nxt, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
        F.col("text").alias("question1"), F.coalesce("t2", F.lit("")).alias("question2"),
        F.when(F.col("r2") == "assistant", 1).otherwise(0).alias("label"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbouring documents as one nested example; passages of good quality count as selected."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    grouped = d.groupBy(F.floor(F.col("doc_id") / 10).cast("bigint").alias("ex_id")).agg(F.sort_array(F.collect_list(
        F.struct("doc_id", "text", F.when(F.col("quality") == 1, 1).otherwise(0).alias("sel")))).alias("p"))
    return grouped.select("ex_id", F.concat(F.lit("query "), F.col("ex_id").cast("string")).alias("query"), F.struct(
        F.transform("p", lambda x: x["text"]).alias("passage_text"),
        F.transform("p", lambda x: x["sel"]).alias("is_selected")).alias("passages"))


def graded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled document with its successor; similarity 5 * quality - toxic."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("sentence2"))
    return d.join(nxt, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("pair_id"), F.col("text").alias("sentence1"), "sentence2",
        (F.col("quality") * 5.0 - F.col("toxic") * F.col("quality")).alias("similarity_score"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document as a token: (doc_id, pos, mask, hidden)."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return words.select("doc_id", "pos", F.when(F.length("word") > 2, 1).otherwise(0).alias("mask"), F.array(
        F.length("word").cast("double"), (F.col("pos") % 7).cast("double"),
        F.length(F.regexp_replace("word", "[aeiou]", "")).cast("double")).alias("hidden"))
