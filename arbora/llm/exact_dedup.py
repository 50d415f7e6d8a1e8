"""Exact deduplication by sorting contents.

Rows are range-partitioned at sampled splitters and sorted inside their partition (Spark's external sort), so
equal texts lie side by side; neighbours are compared in full. The sort key is (first characters, 64-bit hash,
text, id): the splitters are drawn from the short part of it and the id, so the sample stays small for very long
texts, and a text that owns a third of all rows is spread over many partitions. Runs that touch the edge of a
partition are joined by their SHA-256 with the pieces in other partitions; there are only a few per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import narrow, register, table
from arbora.session import materialize

PREFIX = 24
RUNS = "id long, keep long, size long, head boolean, edge boolean, sha binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition. Rows of a run differ in ``id`` only."""
    schema = pa.schema([("id", pa.int64()), ("keep", pa.int64()), ("size", pa.int64()), ("head", pa.bool_()),
                        ("edge", pa.bool_()), ("sha", pa.binary())])
    waiting: list[tuple] = []  # runs that share the last hash seen: they may touch the end of the partition
    out: list[list] = [[] for _ in schema]
    first_key = last_key = text = None
    ids: list = []

    def put(run, edge):
        members, sha = run
        for i, member in enumerate(members):
            for column, value in zip(out, (member, members[0], len(members), i == 0, edge, sha)):
                column.append(value)

    def close():
        if ids:
            waiting.append((list(ids), hashlib.sha256(text.encode()).digest()))
            ids.clear()

    def flush(edge):
        for run in waiting:
            put(run, edge)
        waiting.clear()

    for batch in batches:
        keys, hashes = batch.column("prefix").to_pylist(), batch.column("hash").to_pylist()
        for key, new, row_id in zip(zip(keys, hashes), batch.column("text").to_pylist(), batch.column("id").to_pylist()):
            if key != last_key:
                close()
                flush(edge=last_key == first_key)
                first_key, last_key = first_key if last_key else key, key
                text = new
            elif new != text:
                close()
                text = new
            ids.append(row_id)
        if len(out[0]) >= 20_000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            out = [[] for _ in schema]
    close()
    flush(edge=True)
    if out[0]:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None,
                keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    ``normalise``: a function of a string column, none by default. ``keep``: which id of a group stays,
    "smallest" or "largest". A null text counts as empty, a null id as the last choice. Rows equal in id and text
    are a group too; exactly one of them is kept. An empty table gives no rows; other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    rows = narrow(docs, id=docs[id_col].cast("long"), text=text)
    rows = rows.select(F.substring("text", 1, PREFIX).alias("prefix"), F.xxhash64("text").alias("hash"), "text", "id")
    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The splitters differ between attempts of one plan, so what depends on them is computed once and written.
    runs = materialize(
        rows.repartitionByRange(n, "prefix", "hash", order)
        .sortWithinPartitions("prefix", "hash", "text", order)
        .mapInArrow(_scan, RUNS), "runs")
    best = F.min("keep") if keep == "smallest" else F.max("keep")
    # A few rows per partition, whatever the input is: at most the runs that share the first or last hash of one.
    cut = runs.where("edge and head").groupBy("sha").agg(best.alias("_keep"), F.sum("size").alias("_size"))
    joined = runs.where("edge").join(F.broadcast(cut), "sha")
    # The kept row is the head of the piece that holds the winner; if equal rows head several pieces, one of them.
    tie = materialize(
        joined.where("head and keep <=> _keep").groupBy("sha").agg(F.count("*").alias("_heads")).where("_heads > 1"),
        "ties")
    inner = runs.where("not edge").select(
        "id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("head").alias("kept"), "sha")
    won = F.col("head") & F.col("keep").eqNullSafe(F.col("_keep"))
    outer = joined.join(F.broadcast(tie), "sha", "left").select(
        "id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), won.alias("kept"), "sha", "_heads")
    plain = outer.where("_heads is null or not kept").drop("_heads")
    again = outer.where("_heads is not null and kept").drop("_heads")
    # At most one row per partition here: equal rows of one id at the edges of several partitions.
    again = again.withColumn("kept", F.row_number().over(Window.partitionBy("sha").orderBy("id")) == 1)
    return inner.unionByName(plain).unionByName(again).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were. A row without id stays only if no row
    of its group has one; of rows equal in id and text any one stays."""
    result = exact_dedup(docs, id_col, text_col, keep=keep).where("kept")
    kept = result.select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    sha = F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)
    left = docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["_kept_id"]) & (sha == kept["_kept_sha"]),
                     "left_semi")
    ids = docs.select(id_col)
    if ids.count() == ids.distinct().count():
        return left
    # The whole row travels as one value, so no column of it can clash.
    rows = left.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("sha"),
                       F.struct("*").alias("row"))
    return rows.dropDuplicates(["id", "sha"]).select("row.*")


@register("op10_exact_dedup", """
    with t as (select doc_id, coalesce(text, '') as text from documents)
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
           doc_id = max(doc_id) over g as kept, sha256(text) as text_sha256
    from t window g as (partition by text)""")
def op10_exact_dedup(spark, sf_dir):
    """Every document with the largest id among its exact copies."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
