"""Text to vectors: a registry of encoders, and pooling of token states."""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.vec import l2_normalize

Encoder = Callable[[DataFrame], DataFrame]
_ENCODERS: dict[str, Encoder] = {}
#: Words are told apart by as many numbers.
TERMS = 1 << 18
#: Token states of up to so many numbers are summed as plain columns.
COLUMNS = 64


def register_encoder(name: str, encoder: Encoder) -> None:
    """encoder(df with ``text``) -> the same rows with ``vec array<double>``. Use a pandas UDF or mapInArrow for models."""
    _ENCODERS[name] = encoder


def encode(docs: DataFrame, encoder: str = "hashing", prefix: str = "") -> DataFrame:
    """Add ``vec`` to docs(…, text); ``prefix`` is put before each text for encoders trained with one."""
    if encoder not in _ENCODERS:
        raise ValueError(f"unknown encoder: {encoder}; registered: {sorted(_ENCODERS)}")
    source = docs.withColumn("_text", F.col("text")).withColumn("text", F.concat(F.lit(prefix), F.coalesce("text", F.lit(""))))
    out = _ENCODERS[encoder](source)
    return out.withColumn("text", F.col("_text")).drop("_text")


def encode_dual(queries: DataFrame, passages: DataFrame, query_encoder: str, passage_encoder: str):
    """Separate encoders for the two sides."""
    return encode(queries, query_encoder), encode(passages, passage_encoder)


def _terms(text) -> Column:
    """Lower-cased words of the whole text as term numbers below TERMS; a null text has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: (
        F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % F.lit(TERMS)).cast("int"))


def term_idf(corpus: DataFrame) -> np.ndarray:
    """ln((1 + rows) / (1 + rows with the term)) + 1 of every term over corpus(text).

    One aggregation, combined before its shuffle; at most TERMS numbers come to the driver, whatever the corpus.
    """
    n = corpus.count()
    held = np.zeros(TERMS)
    counts = corpus.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("t")).groupBy("t").count().toPandas()
    held[counts["t"].to_numpy()] = counts["count"].to_numpy()
    return np.log((1.0 + n) / (1.0 + held)) + 1.0


def hashing_encoder(dim: int = 256, idf: np.ndarray | None = None) -> Encoder:
    """Signed feature hashing of the words of whole texts, unit length: term t adds ± ln(1 + its count) times its
    ``idf`` (from ``term_idf``; 1 without) to bucket t mod dim, the sign being that of (t div dim) mod 2.

    Words become numbers in the JVM, counts and sums are array operations over a batch of rows: no shuffle, and the
    weights are a table of fixed size. A text without words is the zero vector.
    """

    def apply(docs: DataFrame) -> DataFrame:
        weights = docs.sparkSession.sparkContext.broadcast(idf) if idf is not None else None

        @F.arrow_udf("array<double>")
        def buckets(terms: pa.Array) -> pa.Array:
            parts = []
            for start in range(0, len(terms), 256):
                part = terms.slice(start, 256)
                ends = np.cumsum(part.value_lengths().to_numpy())
                owner = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
                key, count = np.unique(owner * TERMS + part.flatten().to_numpy().astype(np.int64), return_counts=True)
                row, term = key // TERMS, key % TERMS
                value = np.log1p(count) * (weights.value[term] if weights is not None else 1.0)
                value = np.where(term // dim % 2 == 0, value, -value)
                sums = np.bincount(row * dim + term % dim, value, len(part) * dim)
                parts.append(pa.ListArray.from_arrays(np.arange(0, len(sums) + 1, dim, dtype=np.int32), pa.array(sums)))
            return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

        return docs.withColumn("vec", l2_normalize(buckets(_terms(F.col("text")))))

    return apply


register_encoder("hashing", hashing_encoder())


def pool_cls(tokens: DataFrame) -> DataFrame:
    """tokens(doc_id, pos, mask, hidden) -> (doc_id, vec): the first token's state."""
    return tokens.where("pos = 0").select("doc_id", F.col("hidden").alias("vec"))


def pool_mean(tokens: DataFrame, use_mask: bool = True) -> DataFrame:
    """Masked mean of the token states: sum(h * mask) / max(sum(mask), 1e-9). Sums combine before the shuffle.

    Short states are summed as columns, long ones as vectors; states must have one length, else the query fails.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    w = F.col("mask").cast("double") if use_mask else F.lit(1.0)
    some = tokens.select(F.size("hidden").alias("n")).first()
    width = some["n"] if some else 0
    if 0 < width <= COLUMNS:
        cells = [F.sum(F.col("hidden")[i].cast("double") * F.col("w")).alias(f"s{i}") for i in range(width)]
        sums = tokens.select("doc_id", w.alias("w"), "hidden").groupBy("doc_id").agg(
            *cells, F.max(F.size("hidden")).alias("n"), F.greatest(F.sum("w"), F.lit(1e-9)).alias("w"))
        means = F.array(*[F.col(f"s{i}") / F.col("w") for i in range(width)])
        return sums.select("doc_id", F.when(F.col("n") == width, means).otherwise(
            F.raise_error(F.lit("token states differ in length")).cast("array<double>")).alias("vec"))
    weighed = tokens.select("doc_id", w.alias("w"), array_to_vector(
        F.transform("hidden", lambda h: h.cast("double") * w)).alias("h"))
    # One shuffle of one vector per task and document.
    sums = weighed.groupBy("doc_id").agg(
        vector_to_array(Summarizer.metrics("sum").summary(F.col("h"))["sum"]).alias("s"),
        F.greatest(F.sum("w"), F.lit(1e-9)).alias("w"))
    return sums.select("doc_id", F.transform("s", lambda v: v / F.col("w")).alias("vec"))


def check_dim(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a vector of length ``dim``, rows to encode again)."""
    good = F.col("vec").isNotNull() & (F.size("vec") == dim)
    return vectors.where(good), vectors.where(~good)
