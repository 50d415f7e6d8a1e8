"""Whitening and correlation: one distributed pass for the moments, D x D algebra on the driver, one pass to apply.

Only D x D matrices (D = vector length) ever reach the driver.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from arbora.functions.vec import doubles
from arbora.operators.skew import ROWS_PER_RANGE, prefix_sums
from arbora.operators.topk import matrix
from arbora.session import materialize

WHITEN_EPS = 1e-8  # fixed value

_PARTIAL = "i int, n double, total double, row array<double>"


def _gram_rows(df: DataFrame, transform=None) -> DataFrame:
    """Per task and dimension i: row count, sum of x_i, and row i of the sum of x xT.

    ``transform`` may give (left, extra, right) for x: then the sum of extra, and of left rightT.
    """
    out = to_arrow_schema(df.sparkSession.createDataFrame([], _PARTIAL).schema)

    def partial(batches):
        n, s, g = 0, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column(0))
            left, extra, right = (x, x, x) if transform is None else transform(x)
            s = extra.sum(axis=0) if s is None else s + extra.sum(axis=0)
            g = left.T @ right if g is None else g + left.T @ right
            n += len(x)
        if g is not None:
            d = len(g)
            rows = pa.ListArray.from_arrays(
                pa.array(np.arange(0, d * g.shape[1] + 1, g.shape[1], dtype=np.int32)), pa.array(g.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, float(n))), pa.array(s),
                 rows.cast(out.field(3).type)], schema=out)

    return df.mapInArrow(partial, _PARTIAL)


def _sum_gram(parts: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return parts.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        Summarizer.metrics("sum").summary(array_to_vector("row")).alias("_s"),
    ).select("i", "n", "total", vector_to_array("_s.sum").alias("row"))


def _centred(vectors: DataFrame, vec: str) -> tuple[DataFrame, np.ndarray | None]:
    """The vectors minus their mean, and that mean (D numbers on the driver; None for an empty table).

    Sums of squares far from the origin leave no digits for the variance, hence a pass for the mean comes first.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    x = vectors.select(doubles(vec).alias("vec"))
    mean = x.agg(Summarizer.mean(array_to_vector("vec")).alias("m")).first()["m"] if not x.isEmpty() else None
    if mean is None:
        return x, None
    center = mean.toArray()
    at = F.array(*[F.lit(float(v)) for v in center]) if len(center) <= 64 else F.from_json(
        F.lit("[" + ",".join(repr(float(v)) for v in center) + "]"), "array<double>")
    return x.select(F.zip_with("vec", at, lambda a, b: a - b).alias("vec")), center


def covariance(vectors: DataFrame, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, sample covariance, n); D rows of D numbers come to the driver."""
    x, center = _centred(vectors, vec)
    rows = _sum_gram(_gram_rows(x)).toPandas().sort_values("i")
    n = float(rows["n"].iloc[0])
    rest = rows["total"].to_numpy() / n  # what rounding has left of the mean
    gram = np.stack(rows["row"].to_numpy())
    cov = (gram - n * np.outer(rest, rest)) / (n - 1)
    return center + rest, (cov + cov.T) / 2, n


def cov_matrix(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, j, mean_i, cov), dimensions counted from 1; stays distributed."""
    x, center = _centred(vectors, vec)
    g = _sum_gram(_gram_rows(x))
    # D rows, so the mean vector is a bounded broadcast.
    means = g.select(F.col("i").alias("j"), (F.col("total") / F.col("n")).alias("rest_j"))
    cells = g.select("i", "n", (F.col("total") / F.col("n")).alias("rest_i"), F.posexplode("row").alias("j", "g"))
    base = vectors.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in enumerate(center if center is not None else [])], "i int, center double")
    return cells.join(F.broadcast(means), "j").join(F.broadcast(base), "i").select(
        (F.col("i") + 1).cast("bigint").alias("i"), (F.col("j") + 1).cast("bigint").alias("j"),
        (F.col("center") + F.col("rest_i")).alias("mean_i"),
        ((F.col("g") - F.col("n") * F.col("rest_i") * F.col("rest_j")) / (F.col("n") - 1)).alias("cov"))


def corr_matrix(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, j, corr) with sd = sqrt(variance + 1e-12), clipped to [-1, 1]."""
    c = cov_matrix(vectors, vec)
    # D diagonal rows: bounded broadcast.
    sd = c.where("i = j").select(F.col("i").alias("k"), F.sqrt(F.col("cov") + F.lit(1e-12)).alias("sd"))
    return (
        c.join(F.broadcast(sd.withColumnRenamed("k", "i").withColumnRenamed("sd", "sd_i")), "i")
        .join(F.broadcast(sd.withColumnRenamed("k", "j").withColumnRenamed("sd", "sd_j")), "j")
        .select("i", "j", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.col("sd_i") / F.col("sd_j")))
                .alias("corr"))
    )


def corr_stats(corr: DataFrame) -> DataFrame:
    a = F.abs("corr")
    return corr.where("i <> j").agg(
        F.avg(a).alias("mean_abs"), F.percentile(a, 0.5).alias("median_abs"), F.max(a).alias("max_abs"),
        F.stddev_pop(a).alias("std_abs"))


def corr_top_pairs(corr: DataFrame, k: int = 10) -> DataFrame:
    return corr.where("i < j").orderBy(F.abs("corr").desc(), "i", "j").limit(k)


def permute_columns(vectors: DataFrame, id_col: str = "doc_id", vec: str = "vec", seed: str = "0",
                    share_rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Shuffle every dimension on its own over all rows: (doc_id, vec). Ids must be unique integers.

    The n-th id takes, in dimension d, the value that comes n-th in the order of md5(seed|id|d). The hash is uniform,
    so equal shares of its range hold about equally many cells: a cell's place is its place in its share plus the
    cells in the shares before, and no dimension is ever in one task.
    """
    shares = max(1, vectors.count() // share_rows)
    cells = vectors.select(F.col(id_col).cast("bigint").alias("doc_id"), F.posexplode(doubles(vec)).alias("d", "value"))
    mark = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("d").cast("string")))
    hashed = F.conv(F.substring(mark, 1, 15), 16, 10).cast("bigint")
    cells = cells.withColumn("h", hashed).withColumn("b", F.floor(F.col("h") / F.lit(2.0**60) * F.lit(shares)))
    before = Window.partitionBy("d").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("d", "b").agg(F.count("*").alias("n")).select(
        "d", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    inside = Window.partitionBy("d", "b").orderBy("h", "doc_id")
    placed = cells.join(starts, ["d", "b"]).select(
        "d", "value", (F.col("at") + F.row_number().over(inside) - F.lit(1)).alias("place"))
    rows = placed.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("d", "value"))).alias("z"))
    ids = prefix_sums(vectors.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lit(1).alias("one")), "doc_id", {"place": "one"})
    return ids.join(rows, "place").select("doc_id", F.transform("z", lambda z: z["value"]).alias("vec"))


@dataclass(frozen=True)
class LinearModel:
    """y = (x - mean) . matrix^T, matrix is D_out x D_in."""

    kind: str
    mean: np.ndarray
    matrix: np.ndarray
    eps: float = WHITEN_EPS
    converged: bool = True  # of iterative fits

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.kind, self.mean.tolist(), self.matrix.tolist(), float(self.eps), bool(self.converged))],
            "kind string, mean array<double>, matrix array<array<double>>, eps double, converged boolean")

    @staticmethod
    def from_frame(df: DataFrame) -> "LinearModel":
        row = df.first()
        return LinearModel(row["kind"], np.array(row["mean"]), np.array([list(r) for r in row["matrix"]]), row["eps"],
                           row["converged"])


def transform(model: LinearModel, df: DataFrame, vec: str = "vec") -> DataFrame:
    """Replace ``vec`` by the model's output; all other columns pass through."""
    others = [c for c in df.columns if c != vec]
    src = df.select(*others, doubles(vec).alias(vec))
    shared = df.sparkSession.sparkContext.broadcast((model.mean, model.matrix.T.copy()))
    out = to_arrow_schema(src.schema)

    def apply(batches):
        mean, m = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = (matrix(batch.column(batch.num_columns - 1)) - mean) @ m
            offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(y.reshape(-1))).cast(out.field(len(others)).type)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(others))] + [lists], schema=out)

    return src.mapInArrow(apply, src.schema)


def _spectrum(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues descending and eigenvectors as rows, each with its largest loading positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, rows = np.maximum(values[order], 0.0), vectors[:, order].T
    peak = np.abs(rows).argmax(axis=1)
    return values, rows * np.sign(rows[np.arange(len(rows)), peak])[:, None]


def zca_fit(vectors: DataFrame, vec: str = "vec", eps: float = WHITEN_EPS) -> LinearModel:
    mean, cov, _ = covariance(vectors, vec)
    values, rows = _spectrum(cov)
    return LinearModel("zca", mean, (rows.T / np.sqrt(values + eps)) @ rows, eps)


def _pca(vectors: DataFrame, vec: str, n_components: int | float):
    mean, cov, _ = covariance(vectors, vec)
    values, rows = _spectrum(cov)
    if isinstance(n_components, float) and 0 < n_components < 1:
        share = np.cumsum(values) / values.sum()
        keep = int(np.searchsorted(share, n_components, side="right")) + 1
    else:
        keep = int(n_components)
    keep = min(keep, len(values))
    return mean, values[:keep], rows[:keep], values


def pca_fit(vectors: DataFrame, vec: str = "vec", n_components: int | float = 256) -> tuple[LinearModel, np.ndarray]:
    """Plain components (by count or by explained share) and the share each explains."""
    mean, values, rows, everything = _pca(vectors, vec, n_components)
    return LinearModel("pca", mean, rows, 0.0), values / everything.sum()


def pca_whiten_fit(vectors: DataFrame, vec: str = "vec", n_components: int | float = 256,
                   eps: float = WHITEN_EPS) -> LinearModel:
    mean, values, rows, _ = _pca(vectors, vec, n_components)
    return LinearModel("pca_whiten", mean, rows / np.sqrt(values + eps)[:, None], eps)


def pca_zca_fit(vectors: DataFrame, vec: str = "vec", n_components: int | float = 256,
                eps: float = WHITEN_EPS) -> LinearModel:
    """Low-rank whitening turned back into the input space: the output keeps D dimensions."""
    mean, values, rows, _ = _pca(vectors, vec, n_components)
    return LinearModel("pca_zca", mean, (rows.T / np.sqrt(values + eps)) @ rows, eps)


def _decorrelate(w: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(w @ w.T)
    return (vectors / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T @ w


class _Mixer:
    """Anderson acceleration of a fixed-point iteration: the next point is the combination of the last images whose
    combined step is smallest."""

    def __init__(self, memory: int = 8):
        self.memory, self.images, self.steps, self.best = memory, [], [], np.inf

    def next(self, point: np.ndarray, image: np.ndarray) -> np.ndarray:
        step = (image - point).ravel()
        size = float(np.linalg.norm(step))
        if size > 2 * self.best:  # the combination led away: go on from here without the past
            self.images, self.steps = [], []
        self.best = min(self.best, size)
        self.images = [*self.images, image.ravel()][-self.memory:]
        self.steps = [*self.steps, step][-self.memory:]
        if len(self.steps) < 2:
            return image
        turns = np.diff(np.stack(self.steps), axis=0).T
        share = np.linalg.lstsq(turns, step, rcond=1e-8)[0]
        return (image.ravel() - np.diff(np.stack(self.images), axis=0).T @ share).reshape(image.shape)


def _unmix(z: DataFrame, w: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, int]:
    """A fixed point may be a saddle: two sources halved between two components. There the contrast (with the sign
    ``kind`` of each component) is convex along the rotation of the pair; such pairs are turned by 45 degrees.
    Returns the new rotation and the number of pairs turned."""
    shared = z.sparkSession.sparkContext.broadcast(w)

    def curvature_terms(x):
        y = x @ shared.value.T
        g = np.tanh(y)
        return 1.0 - g * g, g * y, y * y

    rows = _sum_gram(_gram_rows(z, curvature_terms)).toPandas().sort_values("i")
    shared.unpersist()
    n = rows["n"].to_numpy()
    half = kind[:, None] * (np.stack(rows["row"].to_numpy()) / n[:, None] - (rows["total"].to_numpy() / n)[:, None])
    curvature = np.tril(half + half.T, -1)
    w, free, turned = w.copy(), set(range(len(w))), 0
    for a, b in sorted(zip(*np.nonzero(curvature > 1e-4)), key=lambda pair: -curvature[pair]):
        if {a, b} <= free:
            free -= {a, b}
            w[a], w[b] = (w[a] + w[b]) / np.sqrt(2.0), (w[a] - w[b]) / np.sqrt(2.0)
            turned += 1
    return w, turned


def ica_fit(vectors: DataFrame, vec: str = "vec", n_components: int | float = 256, max_iter: int = 5000,
            tol: float = 1e-3, seed: int = 0, eps: float = WHITEN_EPS) -> LinearModel:
    """Symmetric fixed-point ICA (tanh) on whitened components, one Spark pass per iteration.

    Iterations are combined (``_Mixer``), which reaches a fixed point in a fraction of the passes; one that is a saddle
    is left again (``_unmix``). The model says whether the tolerance was reached; a warning is given if not. The start is seeded. Components are put in a
    fixed order and sign (by kurtosis, largest loading positive), because the method itself leaves both open.
    """
    white = pca_whiten_fit(vectors, vec, n_components, eps)
    z = materialize(transform(white, vectors.select(doubles(vec).alias("vec"))), "ica")
    d = len(white.matrix)
    w = _decorrelate(np.random.default_rng(seed).standard_normal((d, d)))
    mixer, converged = _Mixer(), False
    for _ in range(max_iter):
        shared = z.sparkSession.sparkContext.broadcast(w)

        def tanh_terms(x):
            g = np.tanh(x @ shared.value.T)
            return g, 1.0 - g * g, x

        rows = _sum_gram(_gram_rows(z, tanh_terms)).toPandas().sort_values("i")
        n = rows["n"].to_numpy()
        fresh = _decorrelate(np.stack(rows["row"].to_numpy()) / n[:, None] - (rows["total"].to_numpy() / n)[:, None] * w)
        turned = np.einsum("ij,ij->i", fresh, w)
        shared.unpersist()
        if np.abs(np.abs(turned) - 1.0).max() < tol:
            means = np.stack(rows["row"].to_numpy()) / n[:, None]
            kind = np.sign(np.einsum("ij,ij->i", means, w) - rows["total"].to_numpy() / n)
            w, mixed = _unmix(z, fresh, kind)
            converged = not mixed
            if converged:
                break
            mixer = _Mixer()
            continue
        w = _decorrelate(mixer.next(w, fresh * np.where(turned < 0, -1.0, 1.0)[:, None]))
    if not converged:
        warnings.warn(f"ICA did not reach {tol} in {max_iter} passes", stacklevel=2)
    w_shared = z.sparkSession.sparkContext.broadcast(w)

    def fourth_powers(x):
        s = x @ w_shared.value.T
        return s, s**4, x

    tails = _sum_gram(_gram_rows(z, fourth_powers)).toPandas().sort_values("i")
    order = np.argsort(-(tails["total"] / tails["n"]).to_numpy(), kind="stable")
    w = w[order]
    peak = np.abs(w).argmax(axis=1)
    w = w * np.sign(w[np.arange(d), peak])[:, None]
    return LinearModel("ica", white.mean, w @ white.matrix, eps, converged)


def whiten_scope(corpus: DataFrame, queries: DataFrame, with_queries: bool) -> DataFrame:
    """Rows a whitening model is fitted on: corpus and queries (passages) or the corpus alone (pairs)."""
    c = corpus.select("vec")
    return c.unionByName(queries.select("vec")) if with_queries else c


def ica_restlessness(sources: DataFrame, vec: str = "vec") -> DataFrame:
    """(component, turn): squared angle by which one more fixed-point step would turn each component.

    With M = E[tanh(y) yT] − diag(E[1 − tanh²(y)]) and s the signs of its diagonal, M[i,j]·s[j] is symmetric at a fixed
    point; its difference over |M[i,i]| + |M[j,j]| is the angle between components i and j that is still to go.
    """
    def terms(x):
        g = np.tanh(x)
        return g, 1.0 - g * g, x

    m = _sum_gram(_gram_rows(sources.select(doubles(vec).alias("vec")), terms)).select(
        "i", F.transform("row", lambda v: v / F.col("n")).alias("row"), (F.col("total") / F.col("n")).alias("slope"))
    cells = m.select("i", "slope", F.posexplode("row").alias("j", "v")).withColumn(
        "v", F.col("v") - F.when(F.col("i") == F.col("j"), F.col("slope")).otherwise(0.0))
    # D rows: a bounded broadcast.
    own = cells.where("i = j").select(F.col("i").alias("k"), F.col("v").alias("own"))
    pairs = cells.alias("a").join(cells.alias("b"), (F.col("a.i") == F.col("b.j")) & (F.col("a.j") == F.col("b.i"))).select(
        F.col("a.i").alias("i"), F.col("a.j").alias("j"), F.col("a.v").alias("there"), F.col("b.v").alias("back"))
    for end in "ij":
        pairs = pairs.join(F.broadcast(own.select(F.col("k").alias(end), F.col("own").alias(f"own_{end}"))), end)
    gap = F.col("there") * F.signum("own_j") - F.col("back") * F.signum("own_i")
    angle = gap / (F.abs("own_i") + F.abs("own_j"))
    return pairs.groupBy(F.col("i").alias("component")).agg(F.sum(angle * angle).alias("turn"))
