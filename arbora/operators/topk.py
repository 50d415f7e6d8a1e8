"""Exact top-k of a linear score between query vectors and item vectors.

Every retrieval score of the engine (inner product, cosine, squared L2, path-weighted Gaussian, leaf
likelihood) is linear in a feature vector of the query, so one block operator serves them all:

* few queries (size checked): the query block is broadcast and the items are scanned where they lie;
* many queries: both sides are written once as rows of bounded blocks, and Spark's nested loop brings all pairs of
  blocks together. It reads the blocks again instead of moving a copy of each side per block of the other.

A task keeps only the k best of its block per query, so pairs are scored but never emitted, and a final
ranked window merges k rows per block. Scores are compared at 1e-9, ties go to the smaller id.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arbora.functions.vec import dot, doubles, l2_normalize
from arbora.session import SMALL_TABLE_BYTES, materialize, take_small

SCORE_DECIMALS = 9
QUERY_BLOCK = 4096
ITEM_BLOCK = 32768  # items, and queries, that meet in one task
SCAN_QUERIES = 4096  # at most so many queries are broadcast and meet the items where they lie
GRID_CELLS = 32  # small tables have about so many pairs of blocks, of at least LEAST_QUERIES queries
LEAST_QUERIES = 512
CELLS_AT_ONCE = 1_000_000  # scores held in memory by one task at a time
ITEM_TILE, PILOT = 8192, 1024  # items scored at a time, and of them those that tell which scores are too small
PAIR_QUERIES, PAIR_ITEMS = 512, 8192  # a block whose pairs are all listed
BLOCK_BYTES = 8 << 20  # vectors of one block


def matrix(column) -> np.ndarray:
    """Arrow list column of equal-length lists as a 2-D float64 array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def ids_of(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def best_in_block(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best columns by (rounded score desc, id asc): ids and scores, best first."""
    by_id = np.argsort(ids, kind="stable")
    ids, scores = ids[by_id], scores[:, by_id]
    worst_first = -np.round(scores, SCORE_DECIMALS)
    if scores.shape[1] > k:
        cols = np.argpartition(worst_first, k - 1, axis=1)[:, :k]
        threshold = np.take_along_axis(worst_first, cols, axis=1).max(axis=1, keepdims=True)
        tied = np.flatnonzero((worst_first <= threshold).sum(axis=1) > k)
        if len(tied):
            cols[tied] = np.argsort(worst_first[tied], axis=1, kind="stable")[:, :k]
        cols.sort(axis=1)
    else:
        cols = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    order = np.argsort(np.take_along_axis(worst_first, cols, axis=1), axis=1, kind="stable")
    cols = np.take_along_axis(cols, order, axis=1)
    return ids[cols], np.take_along_axis(scores, cols, axis=1)


def _best_of_many(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``best_in_block`` for many columns: only scores that reach the k-th best of the first columns are ordered."""
    n = max(k, PILOT)
    if scores.shape[1] <= 2 * n or np.isnan(scores.max()):
        return best_in_block(scores, ids, k)
    least = np.partition(scores[:, :n], n - k, axis=1)[:, n - k]
    row, col = np.nonzero(scores >= _floor(least)[:, None])
    values = scores[row, col]
    order = np.lexsort((ids[col], -np.round(values, SCORE_DECIMALS), row))
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    return ids[col[order]].reshape(-1, k), values[order].reshape(-1, k)


def _best_scores(q: np.ndarray, ids: np.ndarray, coef: np.ndarray, const: np.ndarray, k: int, best=None) -> tuple[np.ndarray, np.ndarray]:
    """Per query the k best of these items and of those found before (``best``), in tiles of a bounded number of scores.

    Once k items are known, single precision tells which others may reach the k-th; those are scored in double precision.
    """
    found = []
    rough = _Rough(q, coef, const)
    for c in _chunks(len(q), min(len(ids), ITEM_TILE)):
        have = None if best is None else (best[0][c], best[1][c])
        first = min(PILOT, ITEM_TILE) if best is None else 0
        for lo, hi in itertools.pairwise([0, *range(first or ITEM_TILE, len(ids), ITEM_TILE), len(ids)]):
            t = slice(lo, hi)
            near = None if have is None or have[1].shape[1] < k else rough.reaching(c, t, _floor(have[1][:, k - 1]))
            if near is None:
                new = _best_of_many(_block_scores(q[c], coef[t], const[t]), ids[t], k)
                have = new if have is None else _merge_best(*have, *new, k)
            elif len(near[0]):
                row, col = near
                exact = np.einsum("ij,ij->i", q[c][row], coef[t][col]) + const[t][col]
                have = _merge_few(*have, row, ids[t][col], exact, k)
        found.append(have)
    return tuple(np.concatenate(x) for x in zip(*found))


def _floor(least: np.ndarray) -> np.ndarray:
    """Below this a score is smaller than ``least`` after rounding: alike scores are less than one last unit apart."""
    return least - 2 * 10.0**-SCORE_DECIMALS - np.abs(least) * 1e-15


class _Rough:
    """Scores in single precision, with a bound of their error."""

    def __init__(self, q: np.ndarray, coef: np.ndarray, const: np.ndarray):
        length = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x))
        self.q_length, self.length, self.size = length(q), length(coef), np.abs(const)
        most = self.q_length.max(initial=0) * self.length.max(initial=0) + self.size.max(initial=0)
        # Beyond single precision's range, or with unknown numbers, there is no bound.
        self.use = bool(most < 1e30) and max(self.q_length.max(initial=0), self.length.max(initial=0)) < 1e30
        if self.use:
            self.q, self.coef, self.const = (x.astype(np.float32) for x in (q, coef, const))

    def reaching(self, c: slice, t: slice, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs of this tile that may reach ``floor``; None if they are many, or there is no bound."""
        if not self.use or not np.isfinite(floor).all():
            return None
        scores = self.q[c] @ self.coef[t].T
        if self.size.any():
            scores += self.const[t]
        # Twice the usual bound of a rounded dot product, whatever the order of its sums.
        off = (self.q.shape[1] + 8) * 2.0**-23 * (self.q_length[c] * self.length[t].max() + self.size[t].max())
        least = np.nextafter((floor - off).astype(np.float32), np.float32(-np.inf))
        at = np.flatnonzero(scores >= least[:, None])
        if len(at) > scores.size // 16:
            self.use = False
            return None
        return at // scores.shape[1], at % scores.shape[1]


def _merge_best(ids_a, scores_a, ids_b, scores_b, k):
    ids, scores = np.concatenate([ids_a, ids_b], axis=1), np.concatenate([scores_a, scores_b], axis=1)
    order = np.lexsort((ids, -np.round(scores, SCORE_DECIMALS)), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _merge_few(ids, scores, row, new_ids, new_scores, k):
    """``_merge_best`` where only some pairs (``row``, id, score) are new."""
    some = np.unique(row)
    width = ids.shape[1]
    place = np.concatenate([np.repeat(np.arange(len(some)), width), np.searchsorted(some, row)])
    all_ids, all_scores = np.concatenate([ids[some].ravel(), new_ids]), np.concatenate([scores[some].ravel(), new_scores])
    order = np.lexsort((all_ids, -np.round(all_scores, SCORE_DECIMALS), place))
    order = order[np.arange(len(order)) - np.searchsorted(place[order], place[order]) < k]
    ids, scores = ids.copy(), scores.copy()
    ids[some], scores[some] = all_ids[order].reshape(-1, k), all_scores[order].reshape(-1, k)
    return ids, scores


def _block_scores(q: np.ndarray, coef: np.ndarray, const: np.ndarray) -> np.ndarray:
    return q @ coef.T + const


def _chunks(n_queries: int, n_items: int):
    step = max(1, CELLS_AT_ONCE // max(1, n_items))
    for lo in range(0, n_queries, step):
        yield slice(lo, min(n_queries, lo + step))


def _emit(qids: pa.Array, ids: np.ndarray, scores: np.ndarray, schema: pa.Schema):
    n_q, width = ids.shape
    columns = [
        qids.take(pa.array(np.repeat(np.arange(n_q), width))),
        pa.array(ids.reshape(-1)).cast(schema.field(1).type),
        pa.array(scores.reshape(-1)),
    ]
    return pa.Table.from_arrays([c.cast(schema.field(i).type) for i, c in enumerate(columns)], schema=schema)


def topk_linear(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    broadcast_bytes: int = SMALL_TABLE_BYTES,
) -> DataFrame:
    """queries(qid, qvec) x items(item_id, coef[, const]) -> (qid, item_id, score, rank).

    score = qvec . coef + const; rank counts from 1.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if "const" not in items.columns:
        items = items.withColumn("const", F.lit(0.0))
    items = items.select("item_id", doubles("coef").alias("coef"), F.col("const").cast("double").alias("const"))
    queries = queries.select("qid", doubles("qvec").alias("qvec"))
    probe = queries.limit(1).toArrow()
    if probe.num_rows == 0:
        return _rank(queries.select("qid", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
                                    F.lit(0.0).alias("score")), k)
    width = len(probe.column("qvec")[0])
    # Items are read in as many tasks as their files give, so only few queries are worth a scan.
    small = take_small(queries, max(1, min(SCAN_QUERIES, broadcast_bytes // (8 * width))))
    if small is not None:
        parts = _scan_with_query_block(small, queries, items, k)
    else:
        parts = _grid(queries, items, k)
    return _rank(parts, k)


def _rank(parts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.round("score", SCORE_DECIMALS).desc(), F.col("item_id").asc())
    return parts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def _schema(queries: DataFrame, items: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("qid", queries.schema["qid"].dataType),
        T.StructField("item_id", items.schema["item_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _scan_with_query_block(small: pa.Table, queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    schema = _schema(queries, items)
    block = items.sparkSession.sparkContext.broadcast(
        (small.column("qid").combine_chunks(), matrix(small.column("qvec")))
    )
    out = to_arrow_schema(schema)

    def scan(batches):
        qids, q = block.value
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, coef = ids_of(batch.column(0)), matrix(batch.column(1))
            const = batch.column(2).to_numpy(zero_copy_only=False)
            new = _best_scores(q, ids, coef, const, k)
            best = new if best is None else _merge_best(*best, *new, k)
        if best is not None:
            yield from _emit(qids, *best, out).to_batches()

    return items.mapInArrow(scan, schema)


def block_topk(query_blocks: DataFrame, item_blocks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Top-k inside every block; both inputs carry the block ``keys``. -> (qid, item_id, score) parts."""
    schema = _schema(query_blocks, item_blocks)
    out = to_arrow_schema(schema)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return out.empty_table()
        q, coef = matrix(left.column("qvec")), matrix(right.column("coef"))
        ids = ids_of(right.column("item_id"))
        const = right.column("const").combine_chunks().to_numpy(zero_copy_only=False)
        best = _best_scores(q, ids, coef, const, k)
        return _emit(left.column("qid").combine_chunks(), *best, out)

    left = query_blocks.select(*keys, "qid", "qvec").groupBy(*keys)
    right = item_blocks.select(*keys, "item_id", "coef", "const").groupBy(*keys)
    return left.cogroup(right).applyInArrow(cell, schema)


def _packed(rows: DataFrame, vector: str, blocks: int) -> DataFrame:
    """Rows as about ``blocks`` blocks, written once: other columns as arrays, the vectors as one run of doubles, a number.

    Rows are dealt out evenly, so block sizes depend neither on ids nor on what the vectors hold.
    """
    others = [f for f in rows.schema if f.name != vector]
    schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in others] + [T.StructField(vector, T.BinaryType())])
    out = to_arrow_schema(schema)

    def pack(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = matrix(batch.column(vector))
            step = max(1, BLOCK_BYTES // max(1, 8 * vectors.shape[1]))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ends = pa.array([0, part.num_rows], pa.int32())
                columns = [pa.ListArray.from_arrays(ends, part.column(f.name)).cast(out.field(f.name).type) for f in others]
                columns.append(pa.array([vectors[lo:lo + step].tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    packed = rows.repartition(max(1, blocks)).mapInArrow(pack, schema)
    return materialize(packed.withColumn(f"{vector}_block", F.monotonically_increasing_id()), "blocks")


def crossed_blocks(queries: DataFrame, items: DataFrame, query_block: int | None = None, item_block: int | None = None) -> DataFrame:
    """Every block of queries beside every block of items, one row per pair of blocks; the rows of a block of queries follow
    each other. A task holds the blocks of items that one part of their file holds."""
    rows = queries.count()
    n_i = max(1, math.ceil(items.count() / (item_block or ITEM_BLOCK)))
    n_q = math.ceil(rows / (query_block or ITEM_BLOCK))
    n_q = max(n_q, min(math.ceil(rows / LEAST_QUERIES), math.ceil(GRID_CELLS / n_i)))
    return _packed(queries, "qvec", n_q).crossJoin(_packed(items, "coef", n_i).hint("shuffle_replicate_nl"))


def _unpacked(batches):
    """Of each row of ``crossed_blocks``: its columns by name, arrays as Arrow arrays and vectors as matrices."""
    for batch in batches:
        for row in range(batch.num_rows):
            cell = {name: batch.column(name)[row] for name in batch.schema.names}
            for name, first in (("qvec", "qid"), ("coef", "item_id")):
                cell[name] = np.frombuffer(cell[name].as_buffer(), np.float64).reshape(len(cell[first].values), -1)
            yield {name: v.values if isinstance(v, pa.ListScalar) else v for name, v in cell.items()}


def _grid(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    schema = _schema(queries, items)
    out = to_arrow_schema(schema)

    def scan(batches):
        number = qids = best = None
        for cell in _unpacked(batches):
            if number != cell["qvec_block"].as_py():
                if best is not None:
                    yield from _emit(qids, *best, out).to_batches()
                number, qids, best = cell["qvec_block"].as_py(), cell["qid"], None
            best = _best_scores(cell["qvec"], ids_of(cell["item_id"]), cell["coef"],
                                cell["const"].to_numpy(zero_copy_only=False), k, best)
        if best is not None:
            yield from _emit(qids, *best, out).to_batches()

    return crossed_blocks(queries, items).mapInArrow(scan, schema)


def rank_of_target(queries: DataFrame, items: DataFrame) -> DataFrame:
    """queries(qid, qvec, target_id, target_score) -> (qid, rank, n_items): place of the target among all items.

    Each block only reports how many of its items come first; no scores leave it.
    """
    if "const" not in items.columns:
        items = items.withColumn("const", F.lit(0.0))
    queries = queries.select("qid", "qvec", "target_id", "target_score").withColumn("qvec", doubles("qvec"))
    items = items.select("item_id", doubles("coef").alias("coef"), F.col("const").cast("double").alias("const"))
    schema = T.StructType([queries.schema["qid"], T.StructField("ahead", T.LongType()), T.StructField("seen", T.LongType())])
    out = to_arrow_schema(schema)

    def scan(batches):
        for cell in _unpacked(batches):
            q, coef, ids = cell["qvec"], cell["coef"], ids_of(cell["item_id"])
            const = cell["const"].to_numpy(zero_copy_only=False)
            want, at = ids_of(cell["target_id"]), np.round(ids_of(cell["target_score"]), SCORE_DECIMALS)
            ahead = [
                ((s := np.round(_block_scores(q[c], coef, const), SCORE_DECIMALS)) > at[c, None]).sum(axis=1)
                + ((s == at[c, None]) & (ids[None, :] < want[c, None])).sum(axis=1)
                for c in _chunks(len(q), len(ids))
            ]
            yield pa.RecordBatch.from_arrays(
                [cell["qid"], pa.array(np.concatenate(ahead).astype(np.int64)),
                 pa.array(np.full(len(q), len(ids), dtype=np.int64))], schema=out)

    parts = crossed_blocks(queries, items).mapInArrow(scan, schema)
    return parts.groupBy("qid").agg((F.sum("ahead") + 1).alias("rank"), F.sum("seen").alias("n_items"))


def pair_scores(queries: DataFrame, items: DataFrame, broadcast_bytes: int = SMALL_TABLE_BYTES) -> DataFrame:
    """(qid, item_id, score) for every pair, however many queries: beyond a broadcast both sides meet in pairs of blocks."""
    if "const" not in items.columns:
        items = items.withColumn("const", F.lit(0.0))
    items = items.select("item_id", doubles("coef").alias("coef"), F.col("const").cast("double").alias("const"))
    queries = queries.select("qid", doubles("qvec").alias("qvec"))
    small = take_small(queries, 4096)
    if small is not None and small.nbytes <= broadcast_bytes:
        return _scan_all(small, queries, items)
    schema = _schema(queries, items)
    out = to_arrow_schema(schema)

    def scan(batches):
        for cell in _unpacked(batches):
            q, coef, ids = cell["qvec"], cell["coef"], ids_of(cell["item_id"])
            const = cell["const"].to_numpy(zero_copy_only=False)
            for c in _chunks(len(q), len(ids)):
                s = _block_scores(q[c], coef, const)
                yield from _emit(cell["qid"][c], np.broadcast_to(ids, s.shape), s, out).to_batches()

    return crossed_blocks(queries, items, PAIR_QUERIES, PAIR_ITEMS).mapInArrow(scan, schema)


def log_sum_exp_scores(queries: DataFrame, items: DataFrame, temperature: float = 1.0,
                       broadcast_bytes: int = SMALL_TABLE_BYTES) -> DataFrame:
    """(qid, lse): log of the sum of exp(score / temperature) over all items.

    Each task or block reports one row per query, its largest score and the sum of the others relative to it, and such rows are
    merged; no scores leave a block.
    """
    if "const" not in items.columns:
        items = items.withColumn("const", F.lit(0.0))
    items = items.select("item_id", doubles("coef").alias("coef"), F.col("const").cast("double").alias("const"))
    queries = queries.select("qid", doubles("qvec").alias("qvec"))
    schema = T.StructType([queries.schema["qid"], T.StructField("top", T.DoubleType()), T.StructField("z", T.DoubleType())])
    out = to_arrow_schema(schema)

    def reduced(q, coef, const):
        parts = []
        for c in _chunks(len(q), len(coef)):
            s = _block_scores(q[c], coef, const) / temperature
            top = s.max(axis=1)
            parts.append((top, np.exp(s - top[:, None]).sum(axis=1)))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def meet(batches):
        for cell in _unpacked(batches):
            top, z = reduced(cell["qvec"], cell["coef"], cell["const"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([cell["qid"], pa.array(top), pa.array(z)], schema=out)

    probe = queries.limit(1).toArrow()
    width = len(probe.column("qvec")[0]) if probe.num_rows else 1
    small = take_small(queries, max(1, min(SCAN_QUERIES, broadcast_bytes // (8 * width))))
    if small is not None:
        block = items.sparkSession.sparkContext.broadcast((small.column("qid").combine_chunks(), matrix(small.column("qvec"))))

        def scan(batches):
            qids, q = block.value
            for batch in batches:
                if batch.num_rows and len(q):
                    top, z = reduced(q, matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([qids, pa.array(top), pa.array(z)], schema=out)

        parts = items.mapInArrow(scan, schema)
    else:
        parts = crossed_blocks(queries, items).mapInArrow(meet, schema)
    most = F.max("top").over(Window.partitionBy("qid"))
    return parts.withColumn("m", most).groupBy("qid", "m").agg(
        F.sum(F.col("z") * F.exp(F.col("top") - F.col("m"))).alias("s")).select("qid", (F.log("s") + F.col("m")).alias("lse"))


def _scan_all(small: pa.Table, queries: DataFrame, items: DataFrame) -> DataFrame:
    schema = _schema(queries, items)
    out = to_arrow_schema(schema)
    if small.num_rows == 0:
        return items.sparkSession.createDataFrame([], schema)
    block = items.sparkSession.sparkContext.broadcast(
        (small.column("qid").combine_chunks(), matrix(small.column("qvec"))))

    def scan(batches):
        qids, q = block.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, coef = ids_of(batch.column(0)), matrix(batch.column(1))
            const = batch.column(2).to_numpy(zero_copy_only=False)
            for c in _chunks(len(q), len(ids)):
                s = _block_scores(q[c], coef, const)
                yield from _emit(qids[c], np.broadcast_to(ids, s.shape), s, out).to_batches()

    return items.mapInArrow(scan, schema)


# ---- the public similarities ---------------------------------------------------------------------------


def topk_dot(queries: DataFrame, corpus: DataFrame, k: int, **kw) -> DataFrame:
    """queries(qid, qvec), corpus(doc_id, vec) -> (qid, doc_id, score, rank) by inner product."""
    items = corpus.select(F.col("doc_id").alias("item_id"), F.col("vec").alias("coef"))
    return topk_linear(queries, items, k, **kw).withColumnRenamed("item_id", "doc_id")


def topk_cosine(queries: DataFrame, corpus: DataFrame, k: int, **kw) -> DataFrame:
    unit_q = queries.withColumn("qvec", l2_normalize(doubles("qvec")))
    return topk_dot(unit_q, corpus.withColumn("vec", l2_normalize(doubles("vec"))), k, **kw)


def topk_l2(queries: DataFrame, corpus: DataFrame, k: int, **kw) -> DataFrame:
    """Ascending squared distance; ``score`` is that distance.

    -|q - x|^2 + |q|^2 = 2 q.x - |x|^2 is linear in q, and |q|^2 changes no ranking of its own query.
    """
    items = corpus.select(
        F.col("doc_id").alias("item_id"),
        F.transform(doubles("vec"), lambda x: x * 2.0).alias("coef"),
        (-dot(doubles("vec"), doubles("vec"))).alias("const"),
    )
    lengths = queries.select("qid", dot(doubles("qvec"), doubles("qvec")).alias("_qq"))
    found = topk_linear(queries, items, k, **kw).withColumnRenamed("item_id", "doc_id")
    return found.join(lengths, "qid").select(
        "qid", "doc_id", F.greatest(F.col("_qq") - F.col("score"), F.lit(0.0)).alias("score"), "rank")
