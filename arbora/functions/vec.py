"""Vector expressions over ``array<double>`` columns (no Python in the data path)."""

from __future__ import annotations

from typing import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c: str | Column) -> Column:
    return as_col(c).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` (a lambda would evaluate it per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(c: str | Column) -> Column:
    return F.aggregate(as_col(c), F.lit(0.0), lambda s, v: s + v)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(as_col(a), as_col(b), lambda x, y: x * y))


def norm(a: str | Column) -> Column:
    return F.sqrt(total(F.transform(as_col(a), lambda x: x * x)))


def l2_normalize(a: str | Column) -> Column:
    """x / |x|; a zero vector stays zero."""
    return let(as_col(a), lambda v: let(norm(v), lambda n: F.transform(
        v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def add(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(as_col(a), as_col(b), lambda x, y: x + y)


def scale(a: str | Column, s: Column) -> Column:
    return F.transform(as_col(a), lambda x: x * s)


def zeros_like(a: str | Column) -> Column:
    return F.transform(as_col(a), lambda x: F.lit(0.0))


def dims(df: DataFrame, vec: str, *keys: str, out: str = "value") -> DataFrame:
    """One row per dimension: (keys…, dim, value), dim counted from 1."""
    return df.select(*keys, F.posexplode(vec).alias("p", out)).select(
        *keys, (F.col("p") + 1).cast("bigint").alias("dim"), out
    )


def pick_dims(df: DataFrame, vecs: list[str], *keys: str) -> DataFrame:
    """Several arrays side by side, one row per dimension."""
    zipped = F.arrays_zip(*[F.col(v) for v in vecs])
    return df.select(*keys, F.posexplode(zipped).alias("p", "z")).select(
        *keys, (F.col("p") + 1).cast("bigint").alias("dim"), *[F.col("z")[v].alias(v) for v in vecs]
    )


def widest_dims(m2: str | Column, n: int) -> Column:
    """The ``n`` dimensions of largest spread, ties to the smaller index."""
    pairs = F.transform(as_col(m2), lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs), 1, n), lambda p: p["i"])


def moments(df: DataFrame, keys: list[str], vec: str = "vec", weight: str | None = None,
            extra: dict[str, Column] | None = None) -> DataFrame:
    """(keys…, count, mean, m2, …extra aggregates) by partial + final aggregation; m2 is the sum of squared deviations.

    Every map task sends one small buffer per key, so a key holding most rows is no bottleneck.
    """
    v = array_to_vector(F.col(vec))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    # The library's variance divides by W - W2/W (W, W2: sums of weights and squared weights); undo that.
    grouped = df.groupBy(*keys).agg(
        F.sum(w).alias("count"),
        F.sum(w * w).alias("_w2"),
        Summarizer.metrics("mean", "variance").summary(v, w).alias("_s"),
        *[c.alias(name) for name, c in (extra or {}).items()],
    )
    back = F.col("count") - F.col("_w2") / F.col("count")
    return grouped.select(
        *keys,
        *(extra or {}),
        "count",
        vector_to_array("_s.mean").alias("mean"),
        F.transform(vector_to_array("_s.variance"), lambda x: x * back).alias("m2"),
    )


def merge_moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """N-way merge of (count, mean, m2) rows per key, again with map-side combination."""
    c = F.col("count").cast("double")
    between = Summarizer.metrics("mean", "variance").summary(array_to_vector(F.col("mean")), c)
    within = Summarizer.metrics("sum").summary(array_to_vector(F.col("m2")))
    back = F.col("count") - F.col("_w2") / F.col("count")
    return (
        df.groupBy(*keys)
        .agg(F.sum(c).alias("count"), F.sum(c * c).alias("_w2"), between.alias("_b"), within.alias("_w"))
        .select(
            *keys,
            "count",
            vector_to_array("_b.mean").alias("mean"),
            F.zip_with(vector_to_array("_w.sum"), vector_to_array("_b.variance"), lambda s, v: s + v * back).alias("m2"),
        )
    )
