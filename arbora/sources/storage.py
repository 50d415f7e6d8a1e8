"""Run ids, stored embeddings, sentences, models, metrics and trees."""

from __future__ import annotations

import json
import os
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from arbora.operators.tree import ConceptTree, TreeParams
from arbora.operators.whiten import LinearModel

RUN_ID_LIMIT = 100  # fixed value: longer parameter strings end in a hash

NODE_SCHEMA = "node_id string, parent_id string, depth int, is_leaf boolean, count double, mean array<double>, m2 array<double>"


def run_id(params: DataFrame, names: list[str]) -> DataFrame:
    """Add ``run_id`` to rows holding model_name, dataset, split, subset_size, target_size, top_k and other ``names``.

    The sorted "name=value" list, without separators if short, else the base parameters and eight digits of its md5.
    """
    value: Callable[[str], Column] = lambda n: (
        F.replace(F.col(n), F.lit("/"), F.lit("-")) if n == "model_name" else F.col(n).cast("string"))
    listed = F.concat_ws("_", *[F.concat(F.lit(f"{n}="), value(n)) for n in sorted(names)])
    base = F.concat(value("model_name"), F.lit("_"), F.col("dataset"), F.lit("_"), F.col("split"), F.lit("_c"),
                    value("subset_size"), F.lit("_t"), value("target_size"), F.lit("_k"), value("top_k"))
    short = F.replace(F.replace(listed, F.lit("="), F.lit("")), F.lit("/"), F.lit("-"))
    return params.withColumn("run_id", F.when(
        F.length(listed) > RUN_ID_LIMIT, F.concat(base, F.lit("_"), F.substring(F.md5(listed), 1, 8))).otherwise(short))


def load_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def cache_or_compute(spark: SparkSession, root: str, run: str, make: Callable[[], DataFrame], compute: bool = False) -> DataFrame:
    """Reuse the table stored for a run id unless ``compute``; otherwise make, store and read it."""
    path = os.path.join(root, f"run_id={run}")
    stored = None if compute else load_embeddings(spark, path)
    if stored is None:
        make().write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
    return stored


def save_sentences(docs: DataFrame, path: str) -> None:
    """Parquet rows, so texts may hold newlines."""
    docs.write.mode("overwrite").parquet(path)


def save_model(model: LinearModel, spark: SparkSession, path: str) -> None:
    model.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> LinearModel:
    return LinearModel.from_frame(spark.read.parquet(path))


def save_metrics(metrics: DataFrame, path: str) -> None:
    """Append rows carrying ``run_id``."""
    metrics.write.mode("append").partitionBy("run_id").parquet(path)


def _params_row(tree: ConceptTree) -> dict:
    p = tree.params
    return {"score": p.score, "acuity_cutoff": p.acuity_cutoff, "prior_var": p.prior_var, "alpha": p.alpha,
            "depth": tree.depth, "version": tree.version}


def save_tree(tree: ConceptTree, path: str) -> None:
    tree.nodes.write.mode("overwrite").parquet(os.path.join(path, "nodes"))
    tree.members.write.mode("overwrite").parquet(os.path.join(path, "members"))
    spark = tree.nodes.sparkSession
    spark.createDataFrame([_params_row(tree)]).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "params"))


def load_tree(spark: SparkSession, path: str) -> ConceptTree:
    row = spark.read.parquet(os.path.join(path, "params")).first()
    params = TreeParams(row["score"], row["acuity_cutoff"], row["prior_var"], row["alpha"])
    return ConceptTree(spark.read.parquet(os.path.join(path, "nodes")), spark.read.parquet(os.path.join(path, "members")),
                       row["depth"], params, row["version"])


# ---- JSON ------------------------------------------------------------------------------------------------


def tree_json_lines(tree: ConceptTree) -> DataFrame:
    """(kind, json): one line per node and one per member, which suits trees of any size."""
    nodes = tree.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(
        F.col("node_id").cast("string").alias("node_id"), F.col("parent_id").cast("string").alias("parent_id"),
        "depth", "is_leaf", "count", "mean", F.col("m2").alias("meanSq"))).alias("json"))
    members = tree.members.select(F.lit("member").alias("kind"), F.to_json(F.struct(
        F.col("leaf_id").cast("string").alias("leaf_id"), F.col("doc_id").alias("sentence_id"))).alias("json"))
    return nodes.unionByName(members)


def tree_from_json_lines(lines: DataFrame, depth: int, params: TreeParams = TreeParams()) -> ConceptTree:
    n = lines.where("kind = 'node'").select(F.from_json(
        "json", NODE_SCHEMA.replace("m2 ", "meanSq ")).alias("n")).select("n.*").withColumnRenamed("meanSq", "m2")
    m = lines.where("kind = 'member'").select(F.from_json("json", "leaf_id string, sentence_id bigint").alias("m")).select(
        "m.leaf_id", F.col("m.sentence_id").alias("doc_id"))
    return ConceptTree(n, m, depth, params)


def tree_nested_json(tree: ConceptTree, max_nodes: int = 100_000) -> DataFrame:
    """One nested document {params, root: {count, mean, meanSq, sentence_id, children}} in a single row.

    A nested document is one value, so this is only for trees of a checked size; use ``tree_json_lines`` beyond.
    """
    if tree.nodes.limit(max_nodes + 1).count() > max_nodes or tree.members.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError("tree too large for one nested document; use tree_json_lines")
    held = tree.members.groupBy(F.col("leaf_id").alias("node_id")).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    rows = tree.nodes.join(held, "node_id", "left").select(
        "node_id", "parent_id", "depth", F.regexp_replace(F.to_json(F.struct(
            "count", "mean", F.col("m2").alias("meanSq"),
            F.coalesce("ids", F.array().cast("array<bigint>")).alias("sentence_id"))), r"\}$", "").alias("head"))
    below = None
    for d in range(tree.depth, -1, -1):
        here = rows.where(F.col("depth") == d)
        if below is not None:
            kids = below.groupBy(F.col("parent_id").alias("node_id")).agg(
                F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("node_id", "json"))), lambda x: x["json"])).alias("kids"))
            here = here.join(kids, "node_id", "left")
        else:
            here = here.withColumn("kids", F.lit(None).cast("string"))
        below = here.select("node_id", "parent_id", F.concat(
            "head", F.lit(',"children":['), F.coalesce("kids", F.lit("")), F.lit("]}")).alias("json"))
    head = json.dumps({"params": _params_row(tree)})[:-1]
    return below.select(F.concat(F.lit(head + ', "root": '), F.col("json"), F.lit("}")).alias("json"))


def _node_type(levels: int) -> T.StructType:
    fields = [T.StructField("count", T.DoubleType()), T.StructField("mean", T.ArrayType(T.DoubleType())),
              T.StructField("meanSq", T.ArrayType(T.DoubleType())), T.StructField("sentence_id", T.ArrayType(T.LongType()))]
    if levels > 0:
        fields.append(T.StructField("children", T.ArrayType(_node_type(levels - 1))))
    return T.StructType(fields)


def tree_from_nested_json(docs: DataFrame, depth: int) -> ConceptTree:
    """docs(json) as written by ``tree_nested_json`` -> tree; ids are child positions, "r", "r.0", "r.0.2"…"""
    param_type = T.StructType.fromDDL("score string, acuity_cutoff boolean, prior_var double, alpha double, version string")
    schema = T.StructType([T.StructField("params", param_type), T.StructField("root", _node_type(depth))])
    parsed = docs.select(F.from_json("json", schema).alias("d"))
    p = parsed.select("d.params.*").first()
    level = parsed.select(F.lit("r").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("d.root").alias("n"))
    rows = None
    for d in range(depth + 1):
        kids = F.size("n.children") if d < depth else F.lit(0)
        here = level.select("node_id", "parent_id", F.lit(d).alias("depth"), (F.coalesce(kids, F.lit(0)) <= 0).alias("is_leaf"),
                            "n.count", "n.mean", F.col("n.meanSq").alias("m2"), F.col("n.sentence_id").alias("ids"))
        rows = here if rows is None else rows.unionByName(here)
        if d < depth:
            level = level.select("node_id", F.posexplode("n.children").alias("i", "c")).select(
                F.concat_ws(".", "node_id", F.col("i").cast("string")).alias("node_id"), F.col("node_id").alias("parent_id"), F.col("c").alias("n"))
    members = rows.select(F.col("node_id").alias("leaf_id"), F.explode("ids").alias("doc_id"))
    params = TreeParams(p["score"], p["acuity_cutoff"], p["prior_var"], p["alpha"])
    return ConceptTree(rows.drop("ids"), members, depth, params, p["version"] or "0")


# ---- experiment grid ----------------------------------------------------------------------------------------


def read_experiment_grid(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(name, dataset, config, options): one row per experiment, its options laid over the defaults."""
    options = "map<string,string>"
    schema = (f"experiments array<struct<name:string,dataset:string,config:string,slurm_options:{options}>>, "
              f"default_slurm_options {options}")
    raw = spark.read.schema(schema).json(path, multiLine=True)
    rows = raw.select(F.explode("experiments").alias("e"), "default_slurm_options")
    empty = F.create_map().cast(options)
    own, default = F.coalesce("e.slurm_options", empty), F.coalesce("default_slurm_options", empty)
    merged = F.map_concat(F.map_filter(default, lambda k, _: ~F.map_contains_key(own, k)), own)
    out = rows.select("e.name", "e.dataset", "e.config", merged.alias("options"))
    return out if names is None else out.where(F.col("name").isin(names))
