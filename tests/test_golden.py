"""Small results known in advance: the insertion trace, path scores, nDCG values."""

import math

import pytest
from pyspark.sql import functions as F

from arbora.functions import gauss as G
from arbora.operators import evaluate as ev
from arbora.operators import tree as T
from arbora.operators import tree_query as tq
from arbora.session import materialize

NODES = "node_id bigint, parent_id bigint, depth int, is_leaf boolean, count double, mean array<double>, m2 array<double>"


def test_prior_variance():
    assert G.PRIOR_VAR == pytest.approx(1 / (2 * math.pi * math.e), abs=1e-15)
    assert G.PRIOR_VAR == pytest.approx(0.05854983152431917, abs=1e-15)


class Inserter:
    """Inserts one value at a time with the set-based operators; only for checking their decisions."""

    def __init__(self, spark):
        self.spark, self.next_id, self.ids, self.log = spark, 100, {}, []
        self.nodes = None

    def fresh(self):
        self.next_id += 1
        return self.next_id

    def keep(self, nodes):
        self.nodes = materialize(nodes.select("node_id", "parent_id", "depth", "is_leaf", "count", "mean", "m2"))

    def take_in(self, node, x):
        added = self.spark.createDataFrame([(node, 1.0, [x], [0.0])], "node_id bigint, count double, mean array<double>, m2 array<double>")
        self.keep(T.add_to_ancestors(self.nodes, added))

    def insert(self, doc, x):
        steps = []
        if self.nodes is None:
            leaf = self.fresh()
            self.keep(self.spark.createDataFrame([(leaf, None, 0, True, 1.0, [x], [0.0])], NODES))
            self.ids[leaf] = [doc]
            return steps
        at = self.nodes.where("parent_id is null").first()["node_id"]
        while True:
            node = self.nodes.where(F.col("node_id") == at).first()
            if node["is_leaf"]:
                if node["mean"] == [x] and node["m2"] == [0.0]:
                    self.take_in(at, x)
                    self.ids[at].append(doc)
                else:
                    inner, leaf = self.fresh(), self.fresh()
                    rows = self.spark.createDataFrame([(at, inner, leaf, [x], 1)], "leaf_id bigint, inner_id bigint, new_id bigint, x array<double>, n int")
                    self.keep(T.op_fringe(self.nodes, rows))
                    self.ids[leaf] = [doc]
                return steps
            row = self.spark.createDataFrame([(0, at, [x])], "row_id int, at bigint, x array<double>")
            choice = T.best_operation(row, self.nodes).first()
            steps.append((choice["operation"], round(choice["pu"], 6)))
            if choice["operation"] == "split":
                self.keep(T.op_split(self.nodes, self.spark.createDataFrame([(choice["best1"],)], "node_id bigint")))
                continue
            self.take_in(at, x)
            if choice["operation"] == "best":
                at = choice["best1"]
            elif choice["operation"] == "merge":
                new = self.fresh()
                pair = self.spark.createDataFrame([(at, choice["best1"], choice["best2"], new)], "at bigint, best1 bigint, best2 bigint, new_id bigint")
                self.keep(T.op_merge(self.nodes, pair))
                at = new
            else:
                leaf = self.fresh()
                new = self.spark.createDataFrame([(leaf, at, [x], 1)], "new_id bigint, parent_id bigint, x array<double>, n int")
                self.keep(T.op_new(self.nodes, new))
                self.ids[leaf] = [doc]
                return steps


def test_insertion_trace(spark):
    ins = Inserter(spark)
    steps = [ins.insert(i, x) for i, x in enumerate([0.0, 10.0, 0.5, 10.5, 5.0, 0.0])]
    assert steps == [
        [], [], [("best", 1.352213)], [("best", 1.333815)],
        [("split", 0.949737), ("merge", 0.716765), ("new", 0.74498)],
        [("split", 0.693624), ("merge", 0.880679), ("best", 0.166811)],
    ]
    final = {r["node_id"]: r for r in ins.nodes.collect()}
    shape = sorted((r["count"], round(r["mean"][0], 6), round(r["m2"][0], 6)) for r in final.values())
    assert shape == sorted([(6, 4.333333, 122.833333), (2, 10.25, 0.125), (1, 10.0, 0.0), (1, 10.5, 0.0), (1, 5.0, 0.0),
                            (3, 0.166667, 0.166667), (2, 0.0, 0.0), (1, 0.5, 0.0)])
    leaves = {tuple(v): final[k]["mean"][0] for k, v in ins.ids.items()}
    assert leaves == {(0, 5): 0.0, (1,): 10.0, (2,): 0.5, (3,): 10.5, (4,): 5.0}


def test_path_scores(spark):
    rows = [(0, None, 0, False, 6.0, [13 / 3], [122.0 + 5 / 6]), (1, 0, 1, False, 2.0, [10.25], [0.125]), (2, 1, 2, True, 1.0, [10.0], [0.0]),
            (3, 1, 2, True, 1.0, [10.5], [0.0]), (4, 0, 1, True, 1.0, [5.0], [0.0]), (5, 0, 1, False, 3.0, [1 / 6], [1 / 6]),
            (6, 5, 2, True, 2.0, [0.0], [0.0]), (7, 5, 2, True, 1.0, [0.5], [0.0])]
    tree = T.ConceptTree(spark.createDataFrame(rows, NODES), spark.createDataFrame([(6, 0)], "leaf_id bigint, doc_id bigint"), 2)
    q = spark.createDataFrame([(1, [0.2])], "qid bigint, qvec array<double>")
    got = [(r["leaf_id"], round(r["score"], 6)) for r in tq.tree_topk_path(tree, q, 5).orderBy("rank").collect()]
    assert got == [(6, 0.076922), (7, -0.065407), (4, -98.631785), (2, -412.267427), (3, -440.875536)]


@pytest.mark.parametrize("hits,n,want", [
    ([1], 10, 1.0), ([2], 2, 0.630930), ([3], 3, 0.565465), ([2], 5, 0.487115), ([9], 10, 0.393729), ([20], 20, 0.317909),
    ([50], 50, 0.242811), ([1, 3], 5, 0.769280), ([2, 3], 5, 0.769280), ([3, 4], 5, 0.538560), ([], 5, 0.0),
])
def test_reference_ndcg(spark, hits, n, want):
    rows = spark.createDataFrame([(1, i, i in hits) for i in range(1, n + 1)], "qid int, rank int, hit boolean")
    got = ev.query_metrics(rows, spark.createDataFrame([(1,)], "qid int"), n).where(F.col("k") == n).first()
    assert got["ndcg_ref"] == pytest.approx(want, abs=1e-6)


def test_queries_without_results_count(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False)], "qid int, rank int, hit boolean")
    got = ev.retrieval_metrics(rows, spark.createDataFrame([(1,), (2,)], "qid int"), 5).where("k = 2").first()
    assert (got["recall"], got["mrr"], got["n_queries"]) == (0.5, 0.5, 2)


@pytest.mark.parametrize("kind,kw,want", [
    ("constant", {"value": 2.0}, [2, 2, 2, 2]), ("linear", {"start": 1.0, "end": 4.0}, [1, 2, 3, 4]),
    ("linear", {"start": 1.0, "end": 4.0, "direction": "decrease"}, [4, 3, 2, 1]),
    ("quadratic", {}, [1, 1 / 4, 1 / 9, 1 / 16]), ("quadratic", {"start_n": 0}, [1, 1, 1 / 4, 1 / 9]),
    ("exponential", {}, [1, 0.5, 0.25, 0.125]),
])
def test_weight_schedules(kind, kw, want):
    assert tq.weight_schedule(kind, 4, **kw) == pytest.approx(want)
    with pytest.raises(ValueError):
        tq.weight_schedule("cubic", 4)
