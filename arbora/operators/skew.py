"""Joins and sums that hold when one key owns a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is hot from this share of all rows on, so there are never more than 1 / HOT_SHARE hot keys
# and the hot side of a split join has a proven bound.
HOT_SHARE = 0.001
# Ranges of a running sum: about so many rows each, as long as their totals stay a small table.
ROWS_PER_RANGE = 50_000
MAX_RANGES = 8192
# Rows of a hot key that meet their partners in one place.
ROWS_PER_PART = 1024


def hot_split_join(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, total: int,
                   n_keys: int | None = None) -> DataFrame:
    """Inner join of ``rows`` (``total`` of them) with ``keyed`` (one row per key, ``size`` = rows holding the key).

    Hot keys are broadcast and joined where the rows lie; all other keys are joined by a shuffle. With no more
    keys than there can be hot ones (``n_keys``, if known), the shuffle is left out.
    """
    if min(total, n_keys if n_keys is not None else total) <= 1 / HOT_SHARE:
        return rows.join(F.broadcast(keyed), keys)
    limit = float(total) * HOT_SHARE
    hot = keyed.where(F.col(size) >= limit)
    hot_keys = hot.select(*keys)
    cold = keyed.where(F.col(size) < limit)
    hot_rows = rows.join(F.broadcast(hot), keys)
    cold_rows = rows.join(F.broadcast(hot_keys), keys, "left_anti").join(cold, keys)
    return hot_rows.unionByName(cold_rows)


def hot_parts(rows: DataFrame, keys: list[str], per_part: int | None = None) -> list[tuple]:
    """(…keys, parts): into how many parts of about ``per_part`` rows (by default ``ROWS_PER_PART``) to cut the keys that own a large share of ``rows``.

    At most 1 / HOT_SHARE keys come to the driver, and none while no key has more rows than one part.
    """
    per_part = per_part or ROWS_PER_PART
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    for key in keys:
        sizes = sizes.where(F.col(key).isNotNull())
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    large = sizes.where(F.col("_n") > per_part)  # there are few of them, hence the single partition
    hot = large.withColumn("_all", F.sum("_n").over(whole)).where(F.col("_n") >= F.col("_all") * HOT_SHARE)
    return [(*r[:-1], -(-r[-1] // per_part)) for r in hot.select(*keys, "_n").collect()]


def parted_join(rows: DataFrame, other: DataFrame, keys: list[str], parts: list[tuple], by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other`` on ``keys``, however many rows a key has.

    The rows of the keys in ``parts`` (see ``hot_parts``) are dealt over that many parts by a hash of ``by``, and their
    partners in ``other`` are repeated once per part. Null keys, which meet nothing, are dealt evenly too.
    """
    if not parts:
        return rows.join(other, keys, how)
    spark = rows.sparkSession
    hot = F.broadcast(spark.createDataFrame(parts, T.StructType([
        *(T.StructField(k, rows.schema[k].dataType) for k in keys), T.StructField("_parts", T.LongType())])))
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    n = F.when(known, F.coalesce("_parts", F.lit(1))).otherwise(F.lit(1 / HOT_SHARE).cast("long"))
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), n)).drop("_parts")
    repeated = other.join(hot, keys, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [*keys, "_part"], how).drop("_part")


def prefix_sums(df: DataFrame, order: str, sums: dict[str, str], keys: list[str] | None = None,
                buckets: int | None = None) -> DataFrame:
    """Add, per entry, the running sum of ``sums[name]`` over all rows before this one in ``order`` (unique bigint),
    over the whole table or per ``keys``.

    A window over the whole table, or over a key holding much of it, would run in one task. Here the order is cut
    at approximate quantiles, the sums run inside each range, and the totals of the ranges before (at most
    ``buckets`` rows per key) are added. The number of ranges follows the number of rows.
    """
    keys = keys or []
    buckets = buckets or min(MAX_RANGES, max(16, df.count() // ROWS_PER_RANGE))
    cuts = df.select(
        F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10000).alias("c")).first()["c"]
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    cut = df.withColumn("_b", F.size(F.filter(bounds, lambda c: c < F.col(order))))
    totals = cut.groupBy(*keys, "_b").agg(*[F.sum(expr).alias(f"_t_{name}") for name, expr in sums.items()])
    # Bounded by the number of buckets, hence one partition is enough.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(offsets if keys else F.broadcast(offsets), [*keys, "_b"])
    for name, expr in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(expr).over(inside), F.lit(0)) + F.col(f"_o_{name}"))
    return out.drop("_b", *[f"_o_{n}" for n in sums])


def first_by_hash(df: DataFrame, n: int, hash_col: str) -> DataFrame:
    """Exactly the ``n`` rows with the smallest ``hash_col`` (unique hex string), without a global sort.

    The hash is uniform: a histogram over its first four digits finds the digit group where the n-th row
    falls; groups before it are kept whole and only that one group is ranked.
    """
    digits = F.substring(hash_col, 1, 4)
    histogram = df.groupBy(digits.alias("_g")).agg(F.count("*").alias("_n"))
    # At most 65536 groups, hence the single partition.
    upto = Window.partitionBy(F.lit(0)).orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    groups = (
        histogram.withColumn("_end", F.sum("_n").over(upto))
        .where(F.col("_end") - F.col("_n") < n)
        .select("_g", (F.lit(n) - (F.col("_end") - F.col("_n"))).alias("_room"), "_n")
    )
    kept = df.withColumn("_g", digits).join(F.broadcast(groups), "_g")
    whole = kept.where(F.col("_n") <= F.col("_room"))
    edge = kept.where(F.col("_n") > F.col("_room")).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_g").orderBy(hash_col))).where("_rn <= _room").drop("_rn")
    return whole.unionByName(edge).drop("_g", "_room", "_n")


def dedupe_leaves(vectors: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    """Group identical vectors (with ``extra`` columns also equal) into leaves.

    vectors(doc_id, vec) -> leaves(leaf_id, vec, count, …extra), members(leaf_id, doc_id).
    Members stay in long form: a leaf may hold a third of all rows and is never collected into one value.
    """
    # NaN-free doubles hash by value; adding 0.0 folds -0.0 into 0.0.
    v = vectors.withColumn("vec", F.transform(F.col("vec").cast("array<double>"), lambda x: x + F.lit(0.0)))
    leaves = v.groupBy("vec", *extra).agg(F.min("doc_id").alias("leaf_id"), F.count("*").alias("count"))
    # Copies share a fingerprint; leaves sharing one by chance are told apart by comparing the vectors.
    mark = F.xxhash64("vec", *extra).alias("_h")
    singles = leaves.where("count = 1").select("leaf_id", F.col("leaf_id").alias("doc_id"))
    copied = leaves.where("count > 1").select(mark, "leaf_id", F.col("vec").alias("_v"), "count",
                                              *[F.col(e).alias(f"_{e}") for e in extra])
    rows = v.select("doc_id", mark, "vec", *extra)
    n = v.count()
    sized = copied.withColumn("_size", F.col("count"))
    same = F.col("vec") == F.col("_v")
    for e in extra:
        same = same & F.col(e).eqNullSafe(F.col(f"_{e}"))
    members = hot_split_join(rows, sized, ["_h"], "_size", n).where(same).select("leaf_id", "doc_id")
    return leaves.select("leaf_id", "vec", "count", *extra), singles.unionByName(members)
