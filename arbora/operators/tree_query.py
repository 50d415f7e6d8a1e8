"""Queries over a concept tree: path index, retrieval, categorisation, label prediction."""

from __future__ import annotations

import math
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arbora.functions import gauss as G
from arbora.functions.vec import doubles, dot, let, total
from arbora.operators.skew import hot_parts
from arbora.operators.topk import (
    BLOCK_BYTES,
    CELLS_AT_ONCE,
    GRID_CELLS,
    ITEM_BLOCK,
    LEAST_QUERIES,
    QUERY_BLOCK,
    SCORE_DECIMALS,
    _chunks,
    _floor,
    _packed,
    ids_of,
    log_sum_exp_scores,
    matrix,
    pair_scores,
    rank_of_target,
    topk_linear,
)
from arbora.operators.tree import ConceptTree, TreeParams, category_utility, label_shares, rounded
from arbora.session import SMALL_TABLE_BYTES, materialize, spread

LEAF_BLOCK = 1024
PATH_BLOCK = 4096  # leaves whose paths, and forms of the nodes on them, stand in one row
TOP_NODES = 32  # nodes that bound a block of leaves from afar
CHILD_BLOCK = 8192  # rows, and children, of one node that are compared in one place
ROWS_OF_CELL = 1 << 20  # rows that one cell of siblings and queries gives back
LAZY_LEVELS = 3  # deeper trees write each level out, so that no level is computed again

# Default weights per level; levels beyond the list weigh 1.
DEFAULT_LEVEL_WEIGHTS = [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]


# ---- level weights ---------------------------------------------------------------------------------------


def weight_schedule(kind: str, max_depth: int = 10, **kw) -> list[float]:
    """Weights per level: constant(value), linear(start, end, direction), quadratic(start_n), exponential(base)."""
    ends = [kw.get("start", 1.0), kw.get("end", 1.0)]
    if kw.get("direction", "increase") == "decrease":
        ends.reverse()
    level = np.arange(max_depth, dtype=float)
    table = {
        "constant": np.full(max_depth, kw.get("value", 1.0), dtype=float),
        "linear": np.linspace(*ends, max_depth) if max_depth > 1 else np.full(max_depth, float(ends[0])),
        "quadratic": np.maximum(1.0, (level + kw.get("start_n", 1)) ** 2) ** -1,
        "exponential": float(kw.get("base", 0.5)) ** level,
    }
    if kind not in table:
        raise ValueError(f"unknown weight schedule: {kind}")
    return table[kind].tolist()


def level_weight(depth: Column, weights: list[float] | None) -> Column:
    listed = F.array(*[F.lit(float(w)) for w in (DEFAULT_LEVEL_WEIGHTS if weights is None else weights)])
    return F.coalesce(F.get(listed, depth), F.lit(1.0))


# ---- walks from the root down ------------------------------------------------------------------------------


def top_down(tree: ConceptTree, nodes: DataFrame, start: dict[str, Column], step: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Carry state from parents to children, one join per level; every node appears once.

    ``start`` gives the root's state; ``step[name](prev)`` the child's, where ``prev`` names the parent's value.
    """
    names = list(start)
    level = nodes.where(F.col("parent_id").isNull()).select("*", *[c.alias(n) for n, c in start.items()])
    levels = [level]
    for d in range(1, tree.depth + 1):
        above = level.where(~F.col("is_leaf")).select(
            F.col("node_id").alias("parent_id"), *[F.col(n).alias(f"_up_{n}") for n in names])
        joined = nodes.where(F.col("depth") == d).join(above, "parent_id")
        level = joined.select(*[F.col(c) for c in nodes.columns], *[step[n](f"_up_{n}").alias(n) for n in names])
        if tree.depth > LAZY_LEVELS and d < tree.depth:
            level = materialize(level, f"level{d}")
        levels.append(level)
    out = levels[0]
    for other in levels[1:]:
        out = out.unionByName(other)
    return out


def leaf_paths(tree: ConceptTree) -> DataFrame:
    """(leaf_id, path): node ids from the root to the leaf."""
    slim = tree.nodes.select("node_id", "parent_id", "depth", "is_leaf")
    walked = top_down(tree, slim, {"path": F.array("node_id")},
                      {"path": lambda up: F.concat(F.col(up), F.array("node_id"))})
    return walked.where("is_leaf").select(F.col("node_id").alias("leaf_id"), "path")


def path_index(tree: ConceptTree, weights: list[float] | None = None) -> DataFrame:
    """(leaf_id, depth, node_id, weight): weight = level weight / path length."""
    p = leaf_paths(tree)
    return p.select("leaf_id", F.size("path").alias("n"), F.posexplode("path").alias("depth", "node_id")).select(
        "leaf_id", "depth", "node_id", (level_weight(F.col("depth"), weights) / F.col("n")).alias("weight"))


def path_stats(tree: ConceptTree, leaves: DataFrame) -> DataFrame:
    """leaves(leaf_id) -> (leaf_id, depth, node_id, mean, var) along each path."""
    n = tree.nodes.select("node_id", "mean", tree.params.var("m2", "count").alias("var"))
    return path_index(tree).join(leaves.select("leaf_id").distinct(), "leaf_id", "left_semi").join(n, "node_id").select(
        "leaf_id", "depth", "node_id", "mean", "var")


# ---- Gaussian log-likelihood as a linear form in [x^2, x] -----------------------------------------------------


def linear_terms(mean, var, with_2pi: bool) -> tuple[Column, Column]:
    """(coef, const) with log p(x) = [x^2, x] . coef + const."""
    coef = F.concat(F.transform(var, lambda v: F.lit(-0.5) / v), F.zip_with(mean, var, lambda m, v: m / v))
    body = F.aggregate(F.zip_with(mean, var, lambda m, v: m * m / v + F.log(v)), F.lit(0.0), lambda s, a: s + a)
    if with_2pi:
        body = body + F.size(var) * F.lit(G.LN_2PI)
    return coef, body * F.lit(-0.5)


def gauss_features(queries: DataFrame) -> DataFrame:
    """queries(qid, qvec) with qvec replaced by [x^2, x]."""
    x = doubles("qvec")
    return queries.withColumn("qvec", F.concat(F.transform(x, lambda a: a * a), x))


def node_items(tree: ConceptTree, with_2pi: bool = True, prior: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes as items of a linear score; ``prior`` adds ln(count / root count)."""
    n = (nodes if nodes is not None else tree.nodes).withColumn("var", tree.params.var("m2", "count"))
    coef, const = linear_terms(F.col("mean"), F.col("var"), with_2pi)
    if prior:
        # One root row.
        root = tree.nodes.where(F.col("parent_id").isNull()).select(F.col("count").alias("_rn"), F.lit(0).alias("_one"))
        n = n.withColumn("_one", F.lit(0)).join(F.broadcast(root), "_one")
        const = const + F.log("count") - F.log("_rn")
    return n.select(F.col("node_id").alias("item_id"), coef.alias("coef"), const.alias("const"))


def path_items(tree: ConceptTree, weights: list[float] | None = None) -> DataFrame:
    """Leaves as items whose linear score is the weighted sum of node log-likelihoods along the path.

    The sum over a path of linear forms is one linear form, so it is folded once, from the root down; a query
    then costs one inner product per leaf however deep the tree is.
    """
    n = tree.nodes.withColumn("var", tree.params.var("m2", "count"))
    coef, const = linear_terms(F.col("mean"), F.col("var"), False)
    w = level_weight(F.col("depth"), weights)
    n = n.select("node_id", "parent_id", "depth", "is_leaf", 
                 let(w, lambda f: F.transform(coef, lambda c: c * f)).alias("own"), (const * w).alias("own_const"))
    folded = top_down(tree, n, {"coef": F.col("own"), "const": F.col("own_const")}, {
        "coef": lambda up: F.zip_with(F.col(up), F.col("own"), lambda a, b: a + b),
        "const": lambda up: F.col(up) + F.col("own_const"),
    })
    length = F.col("depth") + 1
    return folded.where("is_leaf").select(
        F.col("node_id").alias("item_id"), F.transform("coef", lambda c: c / length).alias("coef"),
        (F.col("const") / length).alias("const"))


def tree_topk_path(tree: ConceptTree, queries: DataFrame, k: int, weights: list[float] | None = None,
                   index: DataFrame | None = None) -> DataFrame:
    """(qid, leaf_id, score, rank): best leaves by path-weighted likelihood. ``index`` reuses stored path_items."""
    items = index if index is not None else path_items(tree, weights)
    return topk_linear(gauss_features(queries), items, k).withColumnRenamed("item_id", "leaf_id")


def tree_rank_scores(tree: ConceptTree, queries: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """(qid, leaf_id, score) for every leaf: rows = queries x leaves."""
    return pair_scores(gauss_features(queries), path_items(tree, weights)).withColumnRenamed("item_id", "leaf_id")


def tree_target_rank(tree: ConceptTree, queries: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """queries(qid, qvec, target_id = leaf) -> (qid, true_score, rank, n_items) of the target among all leaves."""
    items = materialize(path_items(tree, weights), "path_items")
    q = gauss_features(queries)
    own = items.select(F.col("item_id").alias("target_id"), "coef", "const")
    scored = q.join(own, "target_id").select(
        "qid", "qvec", "target_id", rounded(dot("qvec", "coef") + F.col("const")).alias("target_score"))
    ranks = rank_of_target(scored, items)
    return scored.select("qid", F.col("target_score").alias("true_score")).join(ranks, "qid")


def tree_listwise_ce(tree: ConceptTree, queries: DataFrame, temperature: float = 1.0,
                     weights: list[float] | None = None) -> DataFrame:
    """queries(qid, qvec, target_id = leaf) -> (qid, loss): logsumexp of all leaves' path scores / T, less the target's."""
    items = materialize(path_items(tree, weights), "path_items")
    q = gauss_features(queries)
    own = items.select(F.col("item_id").alias("target_id"), "coef", "const")
    true = q.join(own, "target_id").select("qid", ((dot("qvec", "coef") + F.col("const")) / F.lit(temperature)).alias("t"))
    return true.join(log_sum_exp_scores(q, items, temperature), "qid").select("qid", (F.col("lse") - F.col("t")).alias("loss"))


def expand_members(found: DataFrame, tree: ConceptTree) -> DataFrame:
    """All documents of each leaf found; a crowded leaf is split over tasks by the adaptive join."""
    return found.join(tree.members, "leaf_id")


# ---- best-first search without a heap ---------------------------------------------------------------------------


def _leaf_blocks(tree: ConceptTree, leaves: int = LEAF_BLOCK) -> tuple[DataFrame, int]:
    """(block, leaf_id, path) with blocks of about ``leaves`` leaves that lie next to each other in the tree; how many."""
    paths = leaf_paths(tree).select("leaf_id", F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))).alias("path"))
    if tree.depth <= LAZY_LEVELS:
        paths = materialize(paths, "paths")
    blocks = -(-paths.count() // leaves)
    if blocks <= 1:
        return paths.withColumn("block", F.lit(0)), 1
    key = F.concat_ws("/", F.transform("path", lambda p: F.lpad(p.cast("string"), 24, " ")))
    ranged = paths.withColumn("_k", key).repartitionByRange(blocks, "_k")
    return materialize(ranged.select("leaf_id", "path", F.spark_partition_id().alias("block")), "leaf_blocks"), blocks


def _packed_leaves(tree: ConceptTree) -> tuple[DataFrame, int]:
    """(block, leaf_id, steps, depth, coef, const): a row per block of leaves, with the linear forms of all nodes on their paths
    and, per leaf, the places of its nodes there (-1 beyond its end); how many rows."""
    first = tree.nodes.select(F.size("mean").alias("n")).where("n > 0").first()
    per_block = min(PATH_BLOCK, max(LEAF_BLOCK // 4, BLOCK_BYTES // (16 * first[0]))) if first else PATH_BLOCK
    leaves, blocks = _leaf_blocks(tree, per_block)
    stats = tree.nodes.withColumn("var", tree.params.var("m2", "count"))
    coef, const = linear_terms(F.col("mean"), F.col("var"), True)
    above = leaves.select(F.col("block").alias("of"), F.explode("path").alias("node_id")).distinct().join(
        stats.select("node_id", coef.alias("coef"), const.alias("const")), "node_id")
    schema = T.StructType([
        T.StructField("block", T.IntegerType()), T.StructField("leaf_id", T.ArrayType(tree.nodes.schema["node_id"].dataType)),
        T.StructField("steps", T.BinaryType()), T.StructField("depth", T.IntegerType()),
        T.StructField("forms", T.BinaryType()), T.StructField("const", T.BinaryType())])
    out = to_arrow_schema(schema)

    def pack(leaf: pa.Table, node: pa.Table) -> pa.Table:
        leaf = leaf.filter(leaf.column("leaf_id").is_valid()).combine_chunks()
        if leaf.num_rows == 0 or node.num_rows == 0:
            return out.empty_table()
        node_ids = ids_of(node.column("node_id"))
        order = np.argsort(node_ids, kind="stable")
        paths = leaf.column("path").combine_chunks()
        lengths = np.diff(paths.offsets.to_numpy())
        inside = np.arange(lengths.max())[None, :] < lengths[:, None]
        steps = np.full(inside.shape, -1, dtype=np.int32)
        steps[inside] = np.searchsorted(node_ids[order], ids_of(paths.flatten()))
        ids = leaf.column("leaf_id").combine_chunks()
        const = node.column("const").combine_chunks().to_numpy(zero_copy_only=False).astype(float)[order]
        return pa.Table.from_arrays([
            pa.array([leaf.column("block")[0].as_py()], pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(out.field(1).type),
            pa.array([steps.tobytes()], pa.binary()), pa.array([steps.shape[1]], pa.int32()),
            pa.array([_rows_or_nan(node.column("coef"))[order].tobytes()], pa.binary()),
            pa.array([const.tobytes()], pa.binary())], schema=out)

    packed = leaves.select("block", "leaf_id", "path").groupBy("block").cogroup(above.groupBy("of")).applyInArrow(pack, schema)
    return materialize(packed, "paths"), blocks


class _Leaves:
    """Leaves next to each other in the tree. ``bound`` and ``near`` tell for queries what a best-first search could find here."""

    def __init__(self, ids: np.ndarray, steps: np.ndarray, coef: np.ndarray, const: np.ndarray):
        """steps: the nodes of each leaf's path, the leaf itself last, then -1; leaves sorted by path."""
        self.ids, self.length = ids, (steps >= 0).sum(axis=1)
        last, at = self.length - 1, np.arange(len(ids))
        leaf = steps[at, last]
        up = steps[:, :-1].copy()
        up[np.arange(up.shape[1])[None, :] >= last[:, None]] = -1
        inner, local = np.unique(up, return_inverse=True)
        local = local.reshape(up.shape)
        if len(inner) and inner[0] < 0:
            inner, local = inner[1:], local - 1
        self.coef, self.const = coef[np.concatenate([inner, leaf])], const[np.concatenate([inner, leaf])]
        self.n = len(inner)  # the nodes above; -1 stands for none of them, beyond which nothing is known
        self.levels = []
        for d in range(local.shape[1]):
            nodes, where = np.unique(local[:, d], return_index=True)
            nodes, where = nodes[nodes >= 0], where[nodes >= 0]
            self.levels.append((nodes, local[where, d - 1] if d else np.full(len(nodes), self.n)))
        self.parent = np.where(last > 0, local[at, np.maximum(last - 1, 0)], self.n) if local.shape[1] else np.full(len(ids), self.n)
        # The last step is the leaf's own score, which stands behind those of the nodes above.
        self.steps = np.full(steps.shape, -1)
        self.steps[:, :-1] = np.where(up >= 0, local, -1)
        self.steps[at, last] = self.n + at
        self.parents = np.unique(self.parent)
        starts = np.flatnonzero(np.concatenate([[True], self.parent[1:] != self.parent[:-1]]))
        self.families = list(zip(starts, np.append(starts[1:], len(ids))))
        # A few nodes that stand above all leaves bound them from afar.
        self.tops, self.depth = np.array([self.n]), 0
        for d in range(local.shape[1]):
            reach = np.minimum(d, last - 1)
            tops = np.unique(np.where(reach >= 0, local[at, np.maximum(reach, 0)], self.n))
            if len(tops) > TOP_NODES:
                break
            self.tops, self.depth = tops, d + 1
        self.seen = np.unique(np.concatenate([np.array([], dtype=int), *(n for n, _ in self.levels[:self.depth])])).astype(int)

    def scores(self, x2: np.ndarray, which) -> np.ndarray:
        s = np.round(x2 @ self.coef[which].T + self.const[which], SCORE_DECIMALS)
        s[np.isnan(s)] = -np.inf
        return s

    def weakest(self, s: np.ndarray, depth: int | None = None) -> np.ndarray:
        """s: scores of the nodes above -> the smallest on the way to each, and one more column that bounds nothing."""
        w = np.full((len(s), self.n + 1), np.inf)
        for nodes, above in self.levels[:depth]:
            w[:, nodes] = np.minimum(w[:, above], s[:, nodes])
        return w

    def bound(self, x2: np.ndarray) -> np.ndarray:
        """Per query: no leaf here has a larger weakest step."""
        out = np.empty(len(x2))
        for c in _chunks(len(x2), self.n + 1):
            s = np.empty((c.stop - c.start, self.n))
            s[:, self.seen] = self.scores(x2[c], self.seen)
            out[c] = self.weakest(s, self.depth)[:, self.tops].max(axis=1)
        return out

    def near(self, x2: np.ndarray, best: np.ndarray, k: int):
        """best: the k largest weakest steps known per query (-inf: none), brought up to date. -> rows, leaves, keys: those
        that can be among the first k, at most k per query."""
        for c in _chunks(len(x2), self.n + len(self.ids)):
            above = self.scores(x2[c], slice(0, self.n))
            way = self.weakest(above)
            some = np.flatnonzero(way[:, self.parents].max(axis=1) >= _floor(best[c].min(axis=1)))
            if not len(some):
                continue
            row = np.arange(c.start, c.stop)[some]
            s = np.hstack([above[some], self.scores(x2[row], slice(self.n, None))])
            own = s[:, self.n:]
            weakest = np.minimum(way[some][:, self.parent], own)
            top = weakest if weakest.shape[1] <= k else np.partition(weakest, weakest.shape[1] - k, axis=1)[:, -k:]
            both = np.hstack([best[row], top])
            best[row] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            mask = (weakest >= _floor(best[row].min(axis=1))[:, None]) & (weakest > -np.inf)
            # Sisters come in the order of their own scores, so k of them are enough.
            for lo, hi in self.families:
                if hi - lo > k:
                    hit = np.flatnonzero(mask[:, lo:hi].sum(axis=1) > k)
                    if len(hit):
                        first = np.argpartition(-own[hit, lo:hi], k - 1, axis=1)[:, :k]
                        least = np.take_along_axis(own[hit, lo:hi], first, axis=1).min(axis=1, keepdims=True)
                        part = own[hit, lo:hi] >= least
                        tied = np.flatnonzero(part.sum(axis=1) > k)
                        if len(tied):  # the smaller ids stand first
                            first = np.argsort(-own[hit[tied], lo:hi], axis=1, kind="stable")[:, :k]
                            part[tied] = False
                            part[tied[:, None], first] = True
                        mask[hit, lo:hi] &= part
            at, leaf = np.nonzero(mask)
            inside = self.steps[leaf] >= 0
            path = np.where(inside, s[at[:, None], self.steps[leaf]], np.inf)
            after = np.full(path.shape, np.inf)
            after[:, :-1] = np.minimum.accumulate(path[:, :0:-1], axis=1)[:, ::-1]
            kept = (path < after) & inside
            packed = np.take_along_axis(np.where(kept, path, -np.inf), np.argsort(~kept, axis=1, kind="stable"), axis=1)
            order = _first_keys(at, packed, self.ids[leaf], k)
            yield row[at[order]], self.ids[leaf[order]], packed[order]


def _first_keys(row: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k of each row by (key desc, id), rows in turn."""
    order = np.lexsort((ids, *(-keys[:, d] for d in range(keys.shape[1] - 1, -1, -1)), row))
    turn = row[order]
    return order[np.arange(len(turn)) - np.searchsorted(turn, turn) < k]


class _BestFirst:
    """The first k leaves of a block of queries among the leaves shown so far."""

    def __init__(self, qids: pa.Array, x: np.ndarray, k: int):
        self.qids, self.x2, self.k = qids, np.hstack([x * x, x]), k
        self.best = np.full((len(x), k), -np.inf)
        self.found: list = []

    def show(self, parts: list[_Leaves]) -> None:
        """Each query looks first where a leaf may have the largest weakest step, then wherever one may beat what it has."""
        bounds = np.stack([p.bound(self.x2) for p in parts], axis=1)
        first = bounds.argmax(axis=1)
        for turn in (0, 1):
            for i, part in enumerate(parts):
                rows = np.flatnonzero((first == i) if turn == 0 else (first != i) & (bounds[:, i] >= _floor(self.best.min(axis=1))))
                if not len(rows):
                    continue
                best = self.best[rows]
                for row, ids, keys in part.near(self.x2[rows], best, self.k):
                    self.found.append((rows[row], ids, keys))
                self.best[rows] = best
                if sum(len(f[0]) for f in self.found) > max(CELLS_AT_ONCE, 4 * self.best.size):
                    self.found = [self.first()]

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = max(f[2].shape[1] for f in self.found)
        row, ids = (np.concatenate([f[i] for f in self.found]) for i in (0, 1))
        keys = np.concatenate([np.pad(f[2], ((0, 0), (0, width - f[2].shape[1])), constant_values=-np.inf) for f in self.found])
        order = _first_keys(row, keys, ids, self.k)
        return row[order], ids[order], keys[order]


def tree_topk_bestfirst(tree: ConceptTree, queries: DataFrame, k: int) -> DataFrame:
    """(qid, leaf_id, key, rank): the first k leaves a best-first search by log-likelihood would reach.

    A leaf's turn is decided by the suffix minima of the scores on its path (root left out): ordering leaves by
    that list, descending, is the order in which a max-heap search pops them. No leaf comes before its weakest step, so
    the nodes above a block of leaves bound them all, and a query looks only into blocks that can beat the k leaves it has.
    Blocks of queries and leaves are written once and meet in Spark's nested loop.
    """
    leaves, blocks = _packed_leaves(tree)
    q = queries.select("qid", doubles("qvec").alias("qvec")).where("qvec is not null")
    rows = q.count()
    n_q = max(math.ceil(rows / QUERY_BLOCK), min(math.ceil(rows / LEAST_QUERIES), math.ceil(GRID_CELLS / max(1, blocks))))
    id_type = tree.nodes.schema["node_id"].dataType
    schema = T.StructType([q.schema["qid"], T.StructField("leaf_id", id_type),
                           T.StructField("key", T.ArrayType(T.DoubleType()))])
    out = to_arrow_schema(schema)

    def parts_of(cell: dict) -> list[_Leaves]:
        ids = ids_of(cell["leaf_id"].values)
        steps = np.frombuffer(cell["steps"].as_buffer(), np.int32).reshape(len(ids), cell["depth"].as_py())
        const = np.frombuffer(cell["const"].as_buffer(), np.float64)
        coef = np.frombuffer(cell["forms"].as_buffer(), np.float64).reshape(len(const), -1)
        order = np.lexsort((ids, *(steps[:, d] for d in range(steps.shape[1] - 1, -1, -1))))
        ids, steps = ids[order], steps[order]
        return [_Leaves(ids[lo:lo + LEAF_BLOCK], steps[lo:lo + LEAF_BLOCK], coef, const) for lo in range(0, len(ids), LEAF_BLOCK)]

    def rows_of(search: _BestFirst):
        if not search.found:
            return
        row, ids, keys = search.first()
        real = np.isfinite(keys)
        offsets = pa.array(np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32))
        yield from pa.Table.from_arrays([
            search.qids.take(pa.array(row)), pa.array(ids).cast(out.field(1).type),
            pa.ListArray.from_arrays(offsets, pa.array(keys[real])).cast(out.field(2).type)], schema=out).to_batches()

    def scan(batches):
        number = search = None
        known: dict = {}
        waiting, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {name: batch.column(name)[i] for name in batch.schema.names}
                if number != cell["qvec_block"].as_py():
                    if search is not None:
                        if waiting:
                            search.show(waiting)
                        yield from rows_of(search)
                    qids = cell["qid"].values
                    x = np.frombuffer(cell["qvec"].as_buffer(), np.float64).reshape(len(qids), -1)
                    number, search, waiting, held = cell["qvec_block"].as_py(), _BestFirst(qids, x, k), [], 0
                block = cell["block"].as_py()
                parts = known.get(block) or parts_of(cell)
                size = sum(p.coef.nbytes for p in parts)
                if block not in known and size + sum(p.coef.nbytes for v in known.values() for p in v) <= SMALL_TABLE_BYTES:
                    known[block] = parts
                if waiting and held + size > SMALL_TABLE_BYTES:
                    search.show(waiting)
                    waiting, held = [], 0
                waiting, held = waiting + parts, held + size
        if search is not None:
            if waiting:
                search.show(waiting)
            yield from rows_of(search)

    pairs = _packed(q, "qvec", max(1, n_q)).crossJoin(leaves.hint("shuffle_replicate_nl"))
    w = Window.partitionBy("qid").orderBy(F.col("key").desc(), F.col("leaf_id").asc())
    return pairs.mapInArrow(scan, schema).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


# ---- categorisation ------------------------------------------------------------------------------------------


def _rows_or_nan(column) -> np.ndarray:
    """``matrix`` with rows of NaN for null lists."""
    if not column.null_count:
        return matrix(column)
    there = column.is_valid()
    known = matrix(column.filter(there))
    out = np.full((len(column), known.shape[1]), np.nan)
    out[there.to_numpy(zero_copy_only=False) if isinstance(there, pa.Array) else there.to_numpy()] = known
    return out


def _best_of_children(cur: DataFrame, child: DataFrame, posterior: bool) -> DataFrame:
    """cur(qid, x, rn, node_id, best_id, best_score), child(node_id, c_id, c_leaf, cn, cm, cv) ->
    (qid, best_id, best_score, c_id, c_leaf, s): the best child for each row, one per block of children.

    Rows and children meet in cells by node. A node with many rows or many children is cut into parts of ``CHILD_BLOCK``, so a
    cell stays small whatever node the rows are at. Children of unknown score come first, as in an ascending sort.
    """
    spark, parts = cur.sparkSession, {}
    child = child.join(cur.select("node_id").distinct(), "node_id", "left_semi")
    for i, side in enumerate((cur, child)):
        for node, n in hot_parts(side, ["node_id"], CHILD_BLOCK):
            parts.setdefault(node, [1, 1])[i] = n
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("node_id"), F.lit(max(width, -(-cur.count() // CHILD_BLOCK))))
    hot = F.broadcast(spark.createDataFrame([(k, *v) for k, v in parts.items()], T.StructType([
        T.StructField("node_id", cur.schema["node_id"].dataType), T.StructField("_q", T.LongType()), T.StructField("_c", T.LongType())])))
    own = lambda by, n: F.pmod(F.xxhash64(by), F.coalesce(n, F.lit(1)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1))
    left = cur.select("qid", "x", "rn", "node_id", "best_id", "best_score").join(hot, "node_id", "left").withColumn(
        "qb", own("qid", F.col("_q"))).withColumn("cb", each(F.col("_c"))).withColumn("bucket", bucket).drop("_q", "_c")
    right = child.join(hot, "node_id", "left").withColumn("cb", own("c_id", F.col("_c"))).withColumn(
        "qb", each(F.col("_q"))).withColumn("bucket", bucket).drop("_q", "_c")
    schema = T.StructType([*(left.schema[c] for c in ("qid", "best_id", "best_score")),
                           *(right.schema[c] for c in ("c_id", "c_leaf")), T.StructField("s", T.DoubleType())])
    out = to_arrow_schema(schema)

    def cell(rows: pa.Table, kids: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or kids.num_rows == 0:
            return out.empty_table()
        rows, kids = rows.combine_chunks(), kids.combine_chunks()
        at, below, kid_ids = ids_of(rows.column("node_id")), ids_of(kids.column("node_id")), ids_of(kids.column("c_id"))
        x, mean, var = (_rows_or_nan(c.combine_chunks()) for c in (rows.column("x"), kids.column("cm"), kids.column("cv")))
        if not x.size or not mean.size or not var.size:  # nothing but nulls
            x, mean, var = np.full((len(at), 1), np.nan), np.full((len(below), 1), np.nan), np.full((len(below), 1), np.nan)
        x = np.hstack([x * x, x])
        coef = np.hstack([-0.5 / var, mean / var])
        const = -0.5 * ((mean * mean / var + np.log(var)).sum(axis=1) + var.shape[1] * G.LN_2PI)
        share = np.zeros(len(at))
        if posterior:
            const = const + np.log(kids.column("cn").to_numpy())
            share = np.log(rows.column("rn").to_numpy().astype(float))
        by_node = np.lexsort((kid_ids, below))
        below = below[by_node]
        row, kid, score = [], [], []
        for node in np.unique(at):
            mine = np.flatnonzero(at == node)
            ours = by_node[np.searchsorted(below, node, side="left"):np.searchsorted(below, node, side="right")]
            if not len(ours):
                continue
            step = max(1, CELLS_AT_ONCE // 4 // len(ours))
            for lo in range(0, len(mine), step):
                some = mine[lo:lo + step]
                s = x[some] @ coef[ours].T + const[ours] - share[some, None]
                key = np.round(s, SCORE_DECIMALS)
                key[np.isnan(key)] = np.inf  # the first of them wins
                best = key.argmax(axis=1)
                row.append(some)
                kid.append(ours[best])
                score.append(s[np.arange(len(some)), best])
        if not row:
            return out.empty_table()
        row, kid, score = (np.concatenate(v) for v in (row, kid, score))
        picked = [*(rows.column(c).take(pa.array(row)) for c in ("qid", "best_id", "best_score")),
                  *(kids.column(c).take(pa.array(kid)) for c in ("c_id", "c_leaf")), pa.array(score, mask=np.isnan(score))]
        return pa.Table.from_arrays([c.cast(out.field(i).type) for i, c in enumerate(picked)], schema=out)

    keys = ["bucket", "qb", "cb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def categorize_best(tree: ConceptTree, queries: DataFrame, prior: bool = False) -> DataFrame:
    """(qid, node_id, score): the most likely concept of the whole tree."""
    found = topk_linear(gauss_features(queries), node_items(tree, prior=prior), 1)
    return found.select("qid", F.col("item_id").alias("node_id"), "score")


def categorize_greedy(tree: ConceptTree, queries: DataFrame, posterior: bool = False) -> DataFrame:
    """(qid, leaf_id, leaf_score, best_id, best_score): descend to the best child on every level.

    ``best`` is the best concept met on the way (root included); with ``posterior`` children are compared by
    log p(x | c) + log p(c).
    """
    nodes = tree.nodes.select("node_id", "parent_id", "is_leaf", "count", "mean",
                              tree.params.var("m2", "count").alias("var"))
    x = spread(queries.select("qid", doubles("qvec").alias("x")), "qid")
    root = nodes.where(F.col("parent_id").isNull()).select(
        "node_id", "is_leaf", F.col("count").alias("rn"), F.col("mean").alias("rm"), F.col("var").alias("rv"),
        F.lit(0).alias("_one"))
    cur = x.withColumn("_one", F.lit(0)).join(F.broadcast(root), "_one").select(
        "qid", "x", "rn", "node_id", "is_leaf", G.log_prob("x", "rm", "rv").alias("score"))
    cur = cur.withColumn("best_id", F.col("node_id")).withColumn("best_score", F.col("score"))
    child = nodes.select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("c_id"),
                         F.col("is_leaf").alias("c_leaf"), F.col("count").alias("cn"), F.col("mean").alias("cm"),
                         F.col("var").alias("cv")).where(F.col("node_id").isNotNull())
    done = None
    for d in range(tree.depth):
        at_leaf = cur.where("is_leaf")
        done = at_leaf if done is None else done.unionByName(at_leaf)
        # One child per query and block of children is left.
        step = _best_of_children(cur.where(~F.col("is_leaf")), child, posterior).groupBy("qid").agg(
            F.min_by(F.struct("c_id", "c_leaf", "s"), F.struct(-rounded(F.col("s")), F.col("c_id"))).alias("t"),
            F.any_value("best_id").alias("best_id"), F.any_value("best_score").alias("best_score"))
        cur = step.join(x, "qid").join(F.broadcast(root.select("rn")), F.lit(True)) if posterior else step.join(
            x, "qid").withColumn("rn", F.lit(None).cast("double"))
        cur = cur.select("qid", "x", "rn", F.col("t.c_id").alias("node_id"), F.col("t.c_leaf").alias("is_leaf"),
                         F.col("t.s").alias("score"), "best_id", "best_score")
        better = rounded(F.col("score")) > rounded(F.col("best_score"))
        cur = cur.withColumn("best_id", F.when(better, F.col("node_id")).otherwise(F.col("best_id"))).withColumn(
            "best_score", F.when(better, F.col("score")).otherwise(F.col("best_score")))
        if d + 1 < tree.depth:
            cur = materialize(cur, f"descend{d}")
    last = cur.select(*cur.columns)
    out = last if done is None else done.select(*last.columns).unionByName(last)
    return out.select("qid", F.col("node_id").alias("leaf_id"), F.col("score").alias("leaf_score"), "best_id", "best_score")


def basic_level(tree: ConceptTree) -> DataFrame:
    """(leaf_id, basic_id, utility): ancestor-or-self with the highest category utility; ties go to the deeper one."""
    cu = category_utility(tree.nodes, tree.params).select("node_id", F.col("category_utility").alias("cu"))
    n = tree.nodes.select("node_id", "parent_id", "depth", "is_leaf").join(cu, "node_id")
    here = F.struct(F.col("cu").alias("u"), F.col("node_id").alias("id"))
    walked = top_down(tree, n, {"best": here}, {
        "best": lambda up: F.when(rounded(F.col("cu")) >= rounded(F.col(up)["u"]), here).otherwise(F.col(up))})
    return walked.where("is_leaf").select(
        F.col("node_id").alias("leaf_id"), F.col("best.id").alias("basic_id"), F.col("best.u").alias("utility"))


def best_level(tree: ConceptTree, rows: DataFrame) -> DataFrame:
    """rows(row_id, x, leaf_id) -> (row_id, best_id, log_posterior): best ancestor-or-self for x; ties to the deeper."""
    root = tree.nodes.where(F.col("parent_id").isNull()).select(F.col("count").alias("rn"), F.lit(0).alias("_one"))
    n = tree.nodes.select("node_id", "count", "mean", tree.params.var("m2", "count").alias("var"))
    up = rows.join(leaf_paths(tree), "leaf_id").select(
        "row_id", "x", F.posexplode("path").alias("depth", "node_id"))
    scored = up.join(n, "node_id").withColumn("_one", F.lit(0)).join(F.broadcast(root), "_one").select(
        "row_id", "node_id", "depth", G.log_posterior("x", "mean", "var", "count", "rn").alias("s"))
    best = F.max_by(F.struct("node_id", "s"), F.struct(rounded(F.col("s")), F.col("depth")))
    return scored.groupBy("row_id").agg(best.alias("b")).select(
        "row_id", F.col("b.node_id").alias("best_id"), F.col("b.s").alias("log_posterior"))


def leaf_topk(tree: ConceptTree, queries: DataFrame, k: int) -> DataFrame:
    """Leaves alone by likelihood, with variance max(m2 / n, 1e-8)."""
    leaves = tree.nodes.where("is_leaf").withColumn("var", G.variance("m2", "count", True, 1e-8))
    coef, const = linear_terms(F.col("mean"), F.col("var"), True)
    items = leaves.select(F.col("node_id").alias("item_id"), coef.alias("coef"), const.alias("const"))
    return topk_linear(gauss_features(queries), items, k).withColumnRenamed("item_id", "leaf_id")


def is_ancestor(tree: ConceptTree, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> (a, b, is_ancestor): whether a is b or above it."""
    slim = tree.nodes.select("node_id", "parent_id", "depth", "is_leaf")
    up = top_down(tree, slim, {"path": F.array("node_id")}, {"path": lambda p: F.concat(F.col(p), F.array("node_id"))})
    return pairs.join(up.select(F.col("node_id").alias("b"), "path"), "b", "left").select(
        "a", "b", F.coalesce(F.array_contains("path", F.col("a")), F.lit(False)).alias("is_ancestor"))


# ---- label-aware queries -----------------------------------------------------------------------------------


def log_sum_exp(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Stable log(sum(exp(value))) per key in two combining aggregations."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_top"))
    return df.join(top, keys).groupBy(*keys, "_top").agg(
        F.sum(F.exp(F.col(value) - F.col("_top"))).alias("_s")).select(
        *keys, (F.log("_s") + F.col("_top")).alias(out))


def posterior_scores(tree: ConceptTree, queries: DataFrame) -> DataFrame:
    """(qid, node_id, parent_id, depth, is_leaf, score): log p(c | x) down the path plus log p(x | c).

    p(c | x) is normalised among siblings. Rows = queries x nodes.
    """
    lp = pair_scores(gauss_features(queries), node_items(tree)).withColumnRenamed("item_id", "node_id")
    slim = tree.nodes.select("node_id", "parent_id", "depth", "is_leaf", "count")
    parents = slim.select(F.col("node_id").alias("parent_id"), F.col("count").alias("pn"))
    s = lp.join(slim.join(parents, "parent_id", "left"), "node_id").withColumn(
        "u", F.col("score") + F.log("count") - F.log("pn"))
    norm = log_sum_exp(s.where(F.col("parent_id").isNotNull()), ["qid", "parent_id"], "u", "norm")
    s = s.join(norm, ["qid", "parent_id"], "left").select(
        "qid", "node_id", "parent_id", "depth", "is_leaf", F.col("score").alias("lp"),
        (F.col("u") - F.col("norm")).alias("rel"))
    s = materialize(s, "posterior")
    level = s.where("depth = 0").select("*", F.lit(0.0).alias("ll"))
    levels = [level]
    for d in range(1, tree.depth + 1):
        up = level.select("qid", F.col("node_id").alias("parent_id"), F.col("ll").alias("up"))
        level = s.where(F.col("depth") == d).join(up, ["qid", "parent_id"]).select(
            *s.columns, (F.col("rel") + F.col("up")).alias("ll"))
        if tree.depth > LAZY_LEVELS:
            level = materialize(level, f"posterior{d}")
        levels.append(level)
    out = levels[0]
    for other in levels[1:]:
        out = out.unionByName(other)
    return out.select("qid", "node_id", "parent_id", "depth", "is_leaf", "lp", "ll",
                      (F.col("lp") + F.col("ll")).alias("score"))


def _has_keys(df: DataFrame, key: str) -> bool:
    """Whether ``key`` is there in every row, and another one in each."""
    n = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    return n["n"] == n["d"]


def _leaf_masses(score: np.ndarray, starts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and family: the largest score, and the sums of exp(score - largest) times each label's share."""
    ends = np.append(starts[1:], score.shape[1])
    top = np.maximum.reduceat(score, starts, axis=1)
    e = np.exp(score - np.repeat(np.where(np.isneginf(top), 0.0, top), ends - starts, axis=1))
    if len(starts) <= GRID_CELLS:
        return top, np.stack([e[:, lo:hi] @ share[lo:hi] for lo, hi in zip(starts, ends)], axis=1)
    return top, np.stack([np.add.reduceat(e * share[:, i], starts, axis=1) for i in range(share.shape[1])], axis=2)


def _first_leaves(score: np.ndarray, starts: np.ndarray, is_leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores of the leaves that can be among the first k of their family whatever is added to all
    of its scores before they are rounded. The columns of a family are in the order of their ids."""
    score = np.where(is_leaf, np.round(score, SCORE_DECIMALS + 3), -np.inf)
    rows, cols = [], []
    ends = np.append(starts[1:], score.shape[1])
    for lo, hi in zip(starts[ends - starts > k], ends[ends - starts > k]):
        part = score[:, lo:hi]
        bar = np.partition(part, hi - lo - k, axis=1)[:, hi - lo - k] - 2 * 10.0**-SCORE_DECIMALS
        row, col = np.nonzero((part >= bar[:, None]) & is_leaf[lo:hi])
        order = np.lexsort((col, -part[row, col], row))
        row, col = row[order], col[order]
        value = part[row, col]
        # Of equal scores only the k smallest ids can be needed.
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])]))
        place = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
        rows.append(row[place < k])
        cols.append(lo + col[place < k])
    few = np.flatnonzero(np.repeat(ends - starts <= k, ends - starts) & is_leaf)
    rows.append(np.repeat(np.arange(len(score)), len(few)))
    cols.append(np.tile(few, len(score)))
    row, col = np.concatenate(rows), np.concatenate(cols)
    return row, col, score[row, col]


def _families(tree: ConceptTree, queries: DataFrame, n_labels: int = 0, k: int = 0) -> DataFrame:
    """What the children of a node tell about it: rows (qid, parent_id, top, z), the largest log(p(x | c) p(c | parent))
    and the sum of the others relative to it; several rows for a crowded node.

    With ``n_labels`` also (leaf_top, mass): the same of log(p(x | c)^2 p(c | parent)) over the leaves, times their label
    shares. With ``k`` also rows (qid, parent_id, leaf_id, w) of the leaves that can be among the first k of a node by
    that score. Children and queries meet in cells by parent; the scores of all pairs never leave them.
    """
    slim = tree.nodes.where(F.col("node_id").isNotNull())
    above = slim.select(F.col("node_id").alias("parent_id"), F.col("count").alias("pn"))
    kids = slim.join(above, "parent_id").withColumn("var", tree.params.var("m2", "count"))
    coef, const = linear_terms(F.col("mean"), F.col("var"), True)
    labels = F.lit(list(range(n_labels))) if n_labels else F.array().cast("array<int>")
    share = let(label_shares(F.col("lc")), lambda p: F.transform(labels, lambda i: F.coalesce(F.get(p, i), F.lit(0.0)))) if (
        n_labels) else F.array().cast("array<double>")
    kids = materialize(kids.select("node_id", "parent_id", "is_leaf", coef.alias("coef"), const.alias("const"),
                                   (F.log("count") - F.log("pn")).alias("prior"), share.alias("share")), "children")
    q = gauss_features(queries.select("qid", "qvec"))
    q = q.select("qid", doubles("qvec").alias("qvec"))

    rows = q.count()
    size = kids.groupBy("parent_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_leaf"), 1)).alias("l")).agg(
        F.sum("n").alias("n"), F.sum(1 + F.least("l", F.lit(k))).alias("out")).first()
    least = math.ceil(math.sqrt(rows * (size["out"] or 0) / ROWS_OF_CELL))
    n_i = max(1, least, math.ceil((size["n"] or 0) / ITEM_BLOCK))
    n_q = max(1, least, math.ceil(rows / ITEM_BLOCK), min(math.ceil(rows / LEAST_QUERIES), math.ceil(GRID_CELLS / n_i)))
    hot = F.broadcast(kids.sparkSession.createDataFrame(hot_parts(kids, ["parent_id"], CHILD_BLOCK), T.StructType([
        kids.schema["parent_id"], T.StructField("_parts", T.LongType())])))
    part = F.pmod(F.xxhash64("node_id"), F.coalesce("_parts", F.lit(1)))
    right = kids.join(hot, "parent_id", "left").withColumn("ib", F.pmod(F.xxhash64("parent_id", part), F.lit(n_i))).withColumn(
        "qb", F.explode(F.expr(f"sequence(0L, {n_q - 1}L)"))).drop("_parts")
    left = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(n_q))).withColumn(
        "ib", F.explode(F.expr(f"sequence(0L, {n_i - 1}L)")))
    node = kids.schema["node_id"].dataType
    schema = T.StructType([q.schema["qid"], kids.schema["parent_id"], T.StructField("top", T.DoubleType()), T.StructField("z", T.DoubleType()),
                           *([T.StructField("leaf_top", T.DoubleType()), T.StructField("mass", T.ArrayType(T.DoubleType()))] if n_labels else []),
                           *([T.StructField("leaf_id", node), T.StructField("w", T.DoubleType())] if k else [])])
    out = to_arrow_schema(schema)

    def cell(asked: pa.Table, children: pa.Table) -> pa.Table:
        if asked.num_rows == 0 or children.num_rows == 0:
            return out.empty_table()
        ids, parents = ids_of(children.column("node_id")), ids_of(children.column("parent_id"))
        order = np.lexsort((ids, parents))
        children, parents = children.take(pa.array(order)).combine_chunks(), parents[order]
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.append(starts, len(parents)))
        family, leaf_ids = children.column("parent_id").combine_chunks(), children.column("node_id").combine_chunks()
        is_leaf = children.column("is_leaf").to_numpy().astype(bool)
        coef, x = matrix(children.column("coef")), matrix(asked.column("qvec"))
        const, prior = children.column("const").to_numpy(), children.column("prior").to_numpy()
        share = matrix(children.column("share")) if n_labels else None
        qids, found = asked.column("qid").combine_chunks(), []

        def add(row, parent, **columns):
            have = {"qid": qids.take(pa.array(row)), "parent_id": family.take(pa.array(parent)), **columns}
            found.append(pa.Table.from_arrays([have[f.name].cast(f.type) if f.name in have else pa.nulls(len(row), f.type)
                                               for f in out], schema=out))

        for c in _chunks(len(x), len(parents)):
            lp = x[c] @ coef.T + const
            u = lp + prior
            top = np.maximum.reduceat(u, starts, axis=1)
            z = np.add.reduceat(np.exp(u - np.repeat(top, sizes, axis=1)), starts, axis=1)
            row = np.repeat(np.arange(c.start, c.stop), len(starts))
            more = {}
            if n_labels:
                best, mass = _leaf_masses(np.where(is_leaf, lp + u, -np.inf), starts, share)
                best = best.ravel()
                more = {"leaf_top": pa.array(best, mask=np.isneginf(best)), "mass": pa.ListArray.from_arrays(
                    pa.array(np.arange(0, mass.size + 1, n_labels).astype(np.int32)), pa.array(mass.ravel()))}
            add(row, np.tile(starts, c.stop - c.start), top=pa.array(top.ravel()), z=pa.array(z.ravel()), **more)
            if k:
                row, col, w = _first_leaves(lp + u, starts, is_leaf, k)
                add(c.start + row, col, leaf_id=leaf_ids.take(pa.array(col)), w=pa.array(w))
        return pa.concat_tables(found)

    return materialize(left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInArrow(cell, schema), "families")


def _inner_posterior(tree: ConceptTree, queries: DataFrame, families: DataFrame) -> DataFrame:
    """(qid, node_id, score, path, down) of the nodes that are no leaves, and of the root: posterior score, the rounded
    scores from below the root to the node, and what is added to a child's log(p(x | c) p(c | node)) for its log p(c | x)."""
    inner = tree.nodes.where(F.col("node_id").isNotNull() & (~F.col("is_leaf") | (F.col("depth") == 0)))
    above = tree.nodes.select(F.col("node_id").alias("parent_id"), F.col("count").alias("pn"))
    slim = inner.select("node_id", "parent_id", "depth", "count").join(above, "parent_id", "left")
    most = F.max("top").over(Window.partitionBy("qid", "parent_id"))
    norm = families.where("top is not null").select("qid", "parent_id", "top", "z").withColumn("m", most).groupBy("qid", "parent_id", "m").agg(
        F.sum(F.col("z") * F.exp(F.col("top") - F.col("m"))).alias("s")).select(
        "qid", F.col("parent_id").alias("node_id"), (F.log("s") + F.col("m")).alias("norm"))
    lp = pair_scores(gauss_features(queries), node_items(tree, nodes=inner)).withColumnRenamed("item_id", "node_id")
    s = materialize(lp.join(slim, "node_id").join(norm, ["qid", "node_id"], "left").select(
        "qid", "node_id", "parent_id", "depth", "norm", F.col("score").alias("lp"),
        (F.col("score") + F.log("count") - F.log("pn")).alias("u")), "inner")
    level = s.where("depth = 0").select("qid", "node_id", F.col("lp").alias("score"), F.array().cast("array<double>").alias("path"),
                                        (-F.col("norm")).alias("down"))
    out = level
    for d in range(1, tree.depth):
        up = level.select("qid", F.col("node_id").alias("parent_id"), F.col("path").alias("up"), F.col("down").alias("ll"))
        own = F.col("lp") + F.col("u") + F.col("ll")
        level = s.where(F.col("depth") == d).join(up, ["qid", "parent_id"]).select(
            "qid", "node_id", own.alias("score"), F.concat("up", F.array(rounded(own))).alias("path"),
            (F.col("u") + F.col("ll") - F.col("norm")).alias("down"))
        if tree.depth > LAZY_LEVELS:
            level = materialize(level, f"inner{d}")
        out = out.unionByName(level)
    return out


def bestfirst_posterior(tree: ConceptTree, queries: DataFrame, k: int) -> DataFrame:
    """(qid, leaf_id, rank): best-first order under the posterior score, by suffix minima along the path.

    Sisters come in the order of their own scores, so k leaves of each node are enough. Rows = queries x (inner nodes and
    those leaves); where ids of nodes or queries repeat or are missing, all pairs are listed.
    """
    if _has_keys(tree.nodes, "node_id") and _has_keys(queries, "qid"):
        met = _families(tree, queries, k=k)
        up = _inner_posterior(tree, queries, met).select("qid", F.col("node_id").alias("parent_id"), "path", "down")
        leaves = met.where("leaf_id is not null").select("qid", "parent_id", F.col("leaf_id").alias("node_id"), "w").join(
            up, ["qid", "parent_id"]).select("qid", "node_id", F.concat("path", F.array(rounded(F.col("w") + F.col("down")))).alias("p"))
    else:
        leaves = _all_leaf_paths(tree, queries)
    last = F.size("p") - 1
    key = F.filter("p", lambda x, i: (i == last) | (x < F.array_min(F.slice("p", i + 2, F.size("p")))))
    w = Window.partitionBy("qid").orderBy(F.col("key").desc(), F.col("node_id").asc())
    return leaves.withColumn("key", key).withColumn("rank", F.row_number().over(w).cast("bigint")).where(
        F.col("rank") <= k).select("qid", F.col("node_id").alias("leaf_id"), "key", "rank")


def _all_leaf_paths(tree: ConceptTree, queries: DataFrame) -> DataFrame:
    """(qid, node_id, p) for every query and leaf: the rounded posterior scores from below the root to the leaf."""
    s = posterior_scores(tree, queries).select("qid", "node_id", "parent_id", "depth", "is_leaf",
                                               rounded(F.col("score")).alias("score"))
    level = s.where("depth = 0").select("qid", "node_id", "is_leaf", F.array().cast("array<double>").alias("p"))
    leaves = level.where("false")
    for d in range(1, tree.depth + 1):
        up = level.where(~F.col("is_leaf")).select("qid", F.col("node_id").alias("parent_id"), F.col("p").alias("up"))
        level = s.where(F.col("depth") == d).join(up, ["qid", "parent_id"]).select(
            "qid", "node_id", "is_leaf", F.concat("up", F.array("score")).alias("p"))
        leaves = leaves.unionByName(level.where("is_leaf"))
    return leaves.select("qid", "node_id", "p")


def label_log_prob(rows: DataFrame, nodes: DataFrame, params: TreeParams = TreeParams()) -> DataFrame:
    """rows(row_id, node_id, x, y) -> (row_id, log_prob) with the label's log share added.

    y is an index into the vocabulary, -1 for a label never seen, null for no label.
    """
    n = nodes.select("node_id", "mean", params.var("m2", "count").alias("var"), "lc")
    t = F.aggregate("lc", F.lit(0.0), lambda s, v: s + v)
    share = (
        F.when(F.col("y").isNull(), F.lit(0.0))
        .when(F.col("y") < 0, F.log(F.lit(params.alpha)) - F.log(t + F.lit(params.alpha)))
        .otherwise(F.log(F.get("lc", F.col("y"))) - F.log(t))
    )
    return rows.join(n, "node_id").select("row_id", "node_id", (G.log_prob("x", "mean", "var") + share).alias("log_prob"))


def predict_label_probs(tree: ConceptTree, queries: DataFrame) -> DataFrame:
    """(qid, label, prob): over all nodes, exp(posterior score) times the node's label shares, normalised.

    Leaves are summed up by parent before a score leaves its cell, so rows = queries x inner nodes; where ids of nodes or
    queries repeat or are missing, all pairs are listed.
    """
    n_labels = tree.nodes.agg(F.max(F.size("lc"))).first()[0] or 0
    if n_labels < 1:
        return queries.select("qid", F.lit(0).alias("label"), F.lit(1.0).alias("prob")).limit(0)
    shares = tree.nodes.select("node_id", label_shares(F.col("lc")).alias("p"))
    if _has_keys(tree.nodes, "node_id") and _has_keys(queries, "qid"):
        met = _families(tree, queries, n_labels=n_labels)
        inner = materialize(_inner_posterior(tree, queries, met), "posterior")
        below = met.where("leaf_top is not null").select("qid", F.col("parent_id").alias("node_id"), "leaf_top", F.col("mass").alias("p"))
        s = inner.select("qid", "node_id", "score").join(shares, "node_id").select("qid", "score", "p").unionByName(
            below.join(inner.select("qid", "node_id", "down"), ["qid", "node_id"]).select(
                "qid", (F.col("leaf_top") + F.col("down")).alias("score"), "p"))
    else:
        s = posterior_scores(tree, queries).select("qid", "node_id", "score").join(shares, "node_id")
    w = s.withColumn("top", F.max("score").over(Window.partitionBy("qid")))
    # One sum per label and query, combined before the shuffle; rows are not multiplied by labels.
    mass = F.exp(F.col("score") - F.col("top"))
    sums = w.groupBy("qid").agg(F.array(*[F.sum(mass * F.get("p", F.lit(i))) for i in range(n_labels)]).alias("m"))
    return sums.select("qid", total("m").alias("z"), F.posexplode("m").alias("label", "l")).select(
        "qid", "label", (F.col("l") / F.col("z")).alias("prob"))


def node_predict(tree: ConceptTree, sample_seed: str | None = None) -> DataFrame:
    """(node_id, label): the most frequent label of each node, or one drawn by a hash when ``sample_seed`` is given."""
    c = tree.nodes.select("node_id", F.posexplode(label_shares(F.col("lc"))).alias("label", "p"))
    if sample_seed is None:
        return c.groupBy("node_id").agg(F.min_by("label", F.struct(-F.col("p"), F.col("label"))).alias("label"))
    digest = F.md5(F.concat_ws("|", F.lit(sample_seed), F.col("node_id").cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    upto = Window.partitionBy("node_id").orderBy("label")
    reached = c.withColumn("upto", F.sum("p").over(upto)).withColumn("u", u).where(F.col("upto") > F.col("u"))
    return reached.groupBy("node_id").agg(F.min("label").alias("label"))
