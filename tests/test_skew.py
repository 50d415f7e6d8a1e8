"""Operators that must hold when one key owns much of the table."""

import hashlib

import pytest
from pyspark.sql import functions as F

from arbora.operators import skew, tree


def test_hot_split_join(spark):
    n = 30_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 2)
    out = skew.hot_split_join(rows, keyed, ["k"], "n", n)
    assert out.count() == n
    assert out.where("w <> k * 2").count() == 0
    assert out.where("k = 0").count() == n // 3


@pytest.mark.parametrize("n", [0, 1, 37, 5000, 9999, 10_000, 20_000])
def test_first_by_hash(spark, n):
    df = spark.range(10_000).withColumn("h", F.md5(F.col("id").cast("string")))
    got = {r["id"] for r in skew.first_by_hash(df, n, "h").select("id").collect()}
    order = sorted(range(10_000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert got == set(order[:n])


def test_prefix_sums(spark):
    ids = [i * i for i in range(2000)]
    rows = spark.createDataFrame([(i, n % 3, n % 7) for n, i in enumerate(ids)], "id bigint, k int, v int").repartition(8)
    got = {r["id"]: r["s"] for r in skew.prefix_sums(rows, "id", {"s": "v"}, buckets=16).collect()}
    total, want = 0, {}
    for n, i in enumerate(ids):
        want[i] = total
        total += n % 7
    assert got == want
    per_key = {r["id"]: r["s"] for r in skew.prefix_sums(rows, "id", {"s": "v"}, keys=["k"], buckets=16).collect()}
    sums, want = [0, 0, 0], {}
    for n, i in enumerate(ids):
        want[i] = sums[n % 3]
        sums[n % 3] += n % 7
    assert per_key == want


def test_dedupe_with_a_crowd_of_copies(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(0.5), F.lit(-0.0))).when(
        F.col("id") % 3 == 1, F.array(F.lit(1.0), F.col("id") * 1.0)).otherwise(F.array(F.lit(2.0), F.floor(F.col("id") / 30) * 1.0)).alias("vec"))
    leaves, members = skew.dedupe_leaves(rows)
    assert members.count() == 9000 and members.select("doc_id").distinct().count() == 9000
    assert leaves.agg(F.sum("count")).first()[0] == 9000
    assert leaves.orderBy(F.col("count").desc()).first()["count"] == 3000
    wrong = members.join(rows, "doc_id").join(leaves.select("leaf_id", F.col("vec").alias("v")), "leaf_id").where(
        F.exists(F.zip_with("v", "vec", lambda a, b: a != b), lambda x: x))
    assert wrong.count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_parted_join(spark, how, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_PART", 100)
    k = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id"))
    rows = spark.range(3000).select("id", k.cast("long").alias("k"))
    # Keys with several partners, with none, and null.
    other = spark.range(2000).select((F.col("id") % 1900).alias("k"), "id").withColumnRenamed("id", "w").unionByName(
        spark.sql("select cast(null as long) as k, -1L as w"))
    parts = skew.hot_parts(rows, ["k"])
    assert parts == [(0, 10)]
    got = skew.parted_join(rows, other, ["k"], parts, "id", how)
    assert sorted(got.collect(), key=str) == sorted(rows.join(other, ["k"], how).collect(), key=str)


def test_rows_at_one_node_are_scored_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_PART", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        zero = F.array(F.lit(0.0), F.lit(0.0))
        nodes = spark.range(4).select(
            F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent_id"),
            (F.col("id") > 0).cast("int").alias("depth"), (F.col("id") > 0).alias("is_leaf"),
            F.when(F.col("id") > 0, 1.0).otherwise(3.0).alias("count"),
            F.array(F.col("id").cast("double"), F.lit(1.0)).alias("mean"), zero.alias("m2"))
        rows = spark.range(1000).select(F.col("id").alias("row_id"), F.lit(0).cast("long").alias("at"),
                                        F.array(F.col("id") / 100.0, F.lit(0.0)).alias("x"))
        per_task = tree._child_terms(rows, nodes, tree.TreeParams()).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in per_task) == 3000
        assert max(r["count"] for r in per_task) < 1500
        found = tree.operation_utilities(rows, nodes).collect()
        assert len(found) == 1000
        monkeypatch.setattr(skew, "ROWS_PER_PART", 10_000)
        plain = tree.operation_utilities(rows, nodes).collect()
        assert sorted(found) == sorted(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
