"""Concept trees: search against a heap, growth, storage, odd data."""

import heapq
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions.gauss import PRIOR_VAR
from arbora.operators import tree_analytics as ta
from arbora.operators import tree_query as tq
from arbora.operators import subtree
from arbora.operators import tree_build as tb
from arbora.operators.restructure import improvable, restructure
from arbora.operators.tree import ConceptTree, TreeParams, partition_utility
from arbora.operators.tree_build import append_rows, build_tree
from arbora.plans import tree_queries
from arbora.session import materialize
from arbora.sources import storage as st
from arbora.streaming import append
from arbora.streaming.append import TreeStore


def vectors(spark, x, start=0):
    return spark.createDataFrame([(start + i, row.tolist()) for i, row in enumerate(x)], "doc_id bigint, vec array<double>")


def clusters(n, d=6, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((6, d))[rng.integers(0, 6, n)] * 2 + rng.standard_normal((n, d)) * 0.3


def check(tree, n):
    facts = {(r["fact"], r["dim"]): r["value"] for r in tree_queries.invariants(tree).collect()}
    assert facts[("documents", 0)] == n
    for rule in ("parents whose count is not the sum of their children", "parents whose statistics are not the merge of their children",
                 "inner nodes with one child", "broken index rows"):
        assert facts[(rule, 0)] == 0, rule


@pytest.fixture(scope="module")
def built(spark):
    x = clusters(150)
    return x, build_tree(vectors(spark, x))


def test_build(built):
    check(built[1], 150)
    assert improvable(built[1].nodes, built[1].params).count() == 0


@pytest.mark.parametrize("score, size", [("kl", 60), ("info", 1024), ("ecg", 1024)])
def test_nothing_is_left_to_improve(spark, score, size, monkeypatch):
    """Small subtrees, so that upper levels and rounds run as joins; or all of it inside one task."""
    x = np.concatenate([clusters(130, seed=6), np.repeat(clusters(3, seed=8), 6, axis=0) + np.arange(18)[:, None] * 1e-3])
    monkeypatch.setattr(subtree, "SUBTREE", size)
    tree = build_tree(vectors(spark, x), TreeParams(score=score))
    check(tree, 148)
    assert improvable(tree.nodes, tree.params).count() == 0


def test_restructuring_raises_every_utility(spark):
    """A tree that is wrong on purpose: pairs across clusters. The root must end better than it began."""
    x = np.array([[0.0], [10.0], [0.1], [10.1], [0.2], [10.2], [0.3], [10.3]])
    rows = [("r", None, 0, False, x)] + [(f"p{i}", "r", 1, False, x[2 * i:2 * i + 2]) for i in range(4)]
    rows += [(f"L{i}", f"p{i // 2}", 2, True, x[i:i + 1]) for i in range(8)]
    nodes = spark.createDataFrame(
        [(n, p, d, leaf, float(len(v)), v.mean(axis=0).tolist(), ((v - v.mean(axis=0)) ** 2).sum(axis=0).tolist()) for n, p, d, leaf, v in rows],
        "node_id string, parent_id string, depth int, is_leaf boolean, count double, mean array<double>, m2 array<double>")
    params = TreeParams()
    utility = lambda n: {r[0]: r[1] for r in partition_utility(n, params).select("node_id", "partition_utility").collect()}
    before, after_nodes = utility(nodes)["r"], restructure(nodes, params)
    assert improvable(nodes, params).count() > 0 and improvable(after_nodes, params).count() == 0
    assert utility(after_nodes)["r"] > before
    means = {round(r[0][0]) for r in after_nodes.where("parent_id = 'r'").select("mean").collect()}
    assert means == {0, 10}


def test_the_last_rounds_write_few_tables(spark, monkeypatch):
    """A few waiting parents take no tables per round, and the tree is the one that rounds over all edges give."""
    from arbora.operators import restructure as rs

    rng = np.random.default_rng(11)
    x = rng.standard_normal((24, 3)) + rng.integers(0, 4, (24, 1)) * 5.0
    rows = [("r", None, 0, False, x)] + [(f"p{i}", "r", 1, False, x[8 * i:8 * i + 8]) for i in range(3)]
    rows += [(f"q{i}", f"p{i // 2}", 2, False, x[4 * i:4 * i + 4]) for i in range(6)]
    rows += [(f"L{i}", f"q{i // 4}", 3, True, x[i:i + 1]) for i in range(24)]
    nodes = spark.createDataFrame(
        [(n, p, d, leaf, float(len(v)), v.mean(axis=0).tolist(), ((v - v.mean(axis=0)) ** 2).sum(axis=0).tolist()) for n, p, d, leaf, v in rows],
        "node_id string, parent_id string, depth int, is_leaf boolean, count double, mean array<double>, m2 array<double>")
    written, write = [], rs.materialize
    monkeypatch.setattr(rs, "materialize", lambda df, name="t": written.append(name) or write(df, name))
    found, tables = {}, {}
    for few in (0, rs.FEW):
        monkeypatch.setattr(rs, "FEW", few)
        written.clear()
        found[few] = sorted(map(repr, rs.restructure(nodes, TreeParams(), max_rounds=5).collect()))
        tables[few] = len(written)
    assert found[0] == found[few] and tables[0] > 10
    assert tables[few] <= 6


def heap_order(nodes, x, k):
    """Best-first search with a heap, as the yardstick."""
    kids = {}
    for r in nodes:
        kids.setdefault(r["parent_id"], []).append(r)

    def score(r):
        var = np.array(r["m2"]) / r["count"] + PRIOR_VAR
        return round(float(-0.5 * (np.log(var) + math.log(2 * math.pi) + (x - np.array(r["mean"])) ** 2 / var).sum()), 9)

    heap, found = [(0.0, "", kids[None][0])], []
    while heap and len(found) < k:
        _, _, node = heapq.heappop(heap)
        if node["is_leaf"]:
            found.append(node["node_id"])
        for c in kids.get(node["node_id"], []):
            heapq.heappush(heap, (-score(c), c["node_id"], c))
    return found


@pytest.mark.parametrize("blocks", ["one", "many"])
def test_bestfirst_equals_heap_search(spark, built, blocks, monkeypatch):
    x, tree = built
    if blocks == "many":
        monkeypatch.setattr(tq, "LEAF_BLOCK", 20)
        monkeypatch.setattr(tq, "QUERY_BLOCK", 5)
    q = x[:12] + np.random.default_rng(5).standard_normal((12, x.shape[1])) * 0.5
    queries = vectors(spark, q).select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    got = {}
    for r in tq.tree_topk_bestfirst(tree, queries, 15).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["leaf_id"])
    nodes = tree.nodes.collect()
    for i in range(12):
        assert got[i] == heap_order(nodes, q[i], 15)


def test_bestfirst_looks_only_where_a_leaf_can_win(spark, built, monkeypatch):
    """Queries are not copied to every block of leaves, most blocks are not scored, and the order is the heap's."""
    x, tree = built
    monkeypatch.setattr(tq, "LEAF_BLOCK", 8)
    monkeypatch.setattr(tq, "PATH_BLOCK", 40)
    queries = vectors(spark, x[:10] + 0.02).select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    found = tq.tree_topk_bestfirst(tree, queries, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "Generate" not in plan
    nodes = tree.nodes.collect()
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["leaf_id"])
    assert all(got[i] == heap_order(nodes, x[i] + 0.02, 4) for i in range(10))

    # Two far clusters below the root: a query beside one never scores the leaves of the other.
    coef, const = np.repeat([[-8.0, 0.0], [-8.0, 160.0], [-9.0, 0.0], [-9.0, 180.0]], [1, 1, 5, 5], axis=0), np.repeat([0.0, -800, 0, -900], [1, 1, 5, 5])
    parts = [tq._Leaves(np.arange(5) + 5 * i, np.array([[i, 2 + 5 * i + j] for j in range(5)]), coef, const) for i in (0, 1)]
    search, scored = tq._BestFirst(None, np.array([[0.1], [9.9], [0.2]]), 2), []
    monkeypatch.setattr(tq._Leaves, "near", lambda self, x2, *a, near=tq._Leaves.near: scored.append(len(x2)) or near(self, x2, *a))
    search.show(parts)
    assert scored == [2, 1]
    assert search.first()[0].tolist() == [0, 0, 1, 1, 2, 2] and search.first()[1].tolist() == [0, 1, 5, 6, 0, 1]


def test_path_scores_equal_sums_over_the_path(spark, built):
    x, tree = built
    queries = vectors(spark, x[:3] + 0.1).select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    weights = [0.5, 2.0, 1.5]
    got = {(r["qid"], r["leaf_id"]): r["score"] for r in tq.tree_rank_scores(tree, queries, weights).collect()}
    nodes = {r["node_id"]: r for r in tree.nodes.collect()}
    for leaf in [n for n in nodes.values() if n["is_leaf"]]:
        path, node = [], leaf
        while node is not None:
            path.insert(0, node)
            node = nodes.get(node["parent_id"])
        for i in range(3):
            s = 0.0
            for depth, n in enumerate(path):
                var = np.array(n["m2"]) / n["count"] + PRIOR_VAR
                w = weights[depth] if depth < len(weights) else 1.0
                s += w / len(path) * -0.5 * (np.log(var) + (x[i] + 0.1 - np.array(n["mean"])) ** 2 / var).sum()
            assert got[(i, leaf["node_id"])] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_one_level_tree_ranks_like_leaf_likelihood(spark):
    x = clusters(60, seed=4)
    tree = build_tree(vectors(spark, x), greedy=True)
    check(tree, 60)
    assert tree.depth == 1
    q = vectors(spark, x[:5] + 0.2).select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    path = [(r["qid"], r["leaf_id"]) for r in tq.tree_topk_path(tree, q, 10).orderBy("qid", "rank").collect()]
    leaf = [(r["qid"], r["leaf_id"]) for r in tq.leaf_topk(tree, q, 10).orderBy("qid", "rank").collect()]
    assert path == leaf


def test_append_in_batches(spark, built):
    x, tree = built
    more = np.concatenate([x[:20], clusters(60, seed=9), np.repeat(x[3:4] + 0.01, 50, axis=0) + np.arange(50)[:, None] * 1e-4])
    grown = append_rows(tree, vectors(spark, more, 1000), "1")
    grown = replace(grown, nodes=materialize(grown.nodes), members=materialize(grown.members))
    check(grown, 150 + len(more))
    again = append_rows(grown, vectors(spark, clusters(30, seed=11), 5000), "2")
    check(again, 150 + len(more) + 30)
    same = {r["doc_id"]: r["leaf_id"] for r in grown.members.collect()}
    assert all(same[1000 + i] == same[i] for i in range(20))  # copies join the leaf they equal


@pytest.mark.parametrize("score, cutoff", [("kl", False), ("info", True)])
def test_descent_of_subtrees_equals_that_by_levels(spark, score, cutoff, monkeypatch):
    """Upper nodes at hand and whole subtrees below them, crowded ones in parts: the places that a join per level finds."""
    monkeypatch.setattr(subtree, "SUBTREE", 25)
    monkeypatch.setattr(tb, "ROWS_AT_TOP", 5)
    tree = build_tree(vectors(spark, clusters(120, seed=21)), TreeParams(score=score, acuity_cutoff=cutoff))
    rows = vectors(spark, np.concatenate([clusters(60, seed=22), clusters(20, seed=21)])).select(
        F.col("doc_id").alias("row_id"), F.col("vec").alias("x"))
    places = lambda df: sorted(map(tuple, df.select("row_id", "at", "action").collect()))
    got = places(tb.descend(tree, rows))
    assert len(got) == 80 and got == places(tb._descend_levels(tree, rows))
    assert {action for *_, action in got} == {"new", "fringe"}
    if score == "kl":
        monkeypatch.setattr(tb, "SMALL_TABLE_BYTES", 0)  # too many upper nodes for every task
        monkeypatch.setattr(tb, "_descend_levels", lambda tree, rows: "by levels")
        assert tb.descend(tree, rows) == "by levels"


def test_append_takes_no_tables_per_level_or_round(spark, monkeypatch):
    """Rows walk down, and subtrees are improved, inside tasks; the tree is settled and does not depend on the order of rows."""
    from arbora.operators import restructure as rs

    monkeypatch.setattr(subtree, "SUBTREE", 60)
    tree = build_tree(vectors(spark, clusters(120, seed=31)))
    written, listed = [], []
    for module in (tb, rs):
        monkeypatch.setattr(module, "materialize", lambda df, name="t", write=module.materialize: written.append(name) or write(df, name))

    def rounds(nodes, params, start):
        listed.extend(r[0] for r in nodes.join(start, "node_id").select("count").collect())
        return rs.restructure_changes(nodes, params, start)

    monkeypatch.setattr(tb, "restructure_changes", rounds)
    monkeypatch.setattr(rs, "FEW", 0)
    new = vectors(spark, clusters(90, seed=32), 1000)
    grown = append_rows(tree, new, "1")
    grown = replace(grown, nodes=materialize(grown.nodes), members=materialize(grown.members))
    check(grown, 210)
    assert improvable(grown.nodes, grown.params).count() == 0
    assert sum(n.startswith("walk") and n != "walked" for n in written) == 1
    assert listed and min(listed) > 60  # rounds begin with the nodes that no task holds whole
    again = append_rows(tree, new.orderBy(F.col("doc_id").desc()), "1")
    shape = lambda t: sorted(map(tuple, t.nodes.select("node_id", "parent_id").collect()), key=str)
    assert shape(again) == shape(grown)


@pytest.mark.parametrize("shape", ["line", "outlier", "near copies", "two"])
def test_odd_data(spark, shape):
    x = {
        "line": np.arange(100.0)[:, None] ** 3,
        "outlier": np.concatenate([np.zeros((40, 3)) + np.arange(40)[:, None] * 1e-13, np.full((1, 3), 1e9)]),
        "near copies": 1.0 + np.arange(50)[:, None] * np.spacing(1.0),
        "two": np.array([[0.0], [1.0]]),
    }[shape]
    tree = build_tree(vectors(spark, x))
    assert tree.members.count() == len(x)
    assert ta.index_check(tree, vectors(spark, x).select("doc_id")).count() == 0
    assert tree.depth <= 21


def test_storage_round_trips(spark, built, tmp_path):
    tree = built[1]
    facts = sorted((r["count"], tuple(r["mean"])) for r in tree.nodes.collect())
    st.save_tree(tree, str(tmp_path / "t"))
    back = st.load_tree(spark, str(tmp_path / "t"))
    assert back.depth == tree.depth and sorted((r["count"], tuple(r["mean"])) for r in back.nodes.collect()) == facts
    docs = st.tree_nested_json(tree)
    nested = st.tree_from_nested_json(docs, tree.depth)
    assert sorted((r["count"], tuple(r["mean"])) for r in nested.nodes.collect()) == facts
    assert {r["doc_id"] for r in nested.members.collect()} == set(range(150))
    assert nested.nodes.groupBy("depth").count().collect().sort() == tree.nodes.groupBy("depth").count().collect().sort()
    with pytest.raises(ValueError):
        st.tree_nested_json(tree, max_nodes=10)


def test_store_skips_a_batch_seen_before(spark, tmp_path):
    store = TreeStore(spark, str(tmp_path / "store"))
    assert store.latest() is None
    store.append(vectors(spark, clusters(30)), 0)
    store.append(vectors(spark, clusters(10, seed=2), 100), 1)
    store.append(vectors(spark, clusters(10, seed=2), 100), 1)
    assert store.latest() == 1
    check(store.load(), 40)


def test_store_writes_what_a_batch_changes(spark, tmp_path, monkeypatch):
    """Small batches leave deltas that read back as the whole tree; when these are worth it, a new base is written."""
    monkeypatch.setattr(append, "COMPACT_SHARE", 2.0)
    store = TreeStore(spark, str(tmp_path / "store"))
    x = clusters(60, d=3, seed=12)
    store.append(vectors(spark, x), 0)
    store.append(vectors(spark, np.concatenate([x[:2], x[5:7] + 0.05]), 1000), 1)
    log = store.log()
    assert [r["kind"] for r in log] == ["base", "delta"] and log[1]["n_nodes"] < 0.5 * log[0]["n_nodes"]
    tree = store.load()
    check(tree, 64)
    assert improvable(tree.nodes, tree.params).count() == 0
    homes = {r["doc_id"]: r["leaf_id"] for r in tree.members.collect()}
    assert homes[1000] == homes[0] and homes[1001] == homes[1]
    monkeypatch.setattr(append, "COMPACT_SHARE", 0.0)
    store.append(vectors(spark, x[40:42] - 0.04, 2000), 2)
    assert store.log()[-1]["kind"] == "base"
    check(store.load(), 66)


def test_label_counts_survive_every_edit(spark):
    """Counts per label after each of the four operations, against plain addition."""
    from arbora.operators import tree as tr

    alpha = 1e-8
    nodes = spark.createDataFrame(
        [("r", None, 0, False, 4.0, [0.5], [1.0], [3.0, 1.0]), ("a", "r", 1, True, 1.0, [0.0], [0.0], [1.0, 0.0]),
         ("b", "r", 1, False, 2.0, [0.5], [0.5], [1.0, 1.0]), ("c", "r", 1, True, 1.0, [1.0], [0.0], [1.0, 0.0]),
         ("d", "b", 2, True, 1.0, [0.0], [0.0], [0.0, 1.0]), ("e", "b", 2, True, 1.0, [1.0], [0.0], [1.0, 0.0])],
        "node_id string, parent_id string, depth int, is_leaf boolean, count double, mean array<double>, m2 array<double>,"
        " lc array<double>").withColumn("lc", F.transform("lc", lambda c: c + F.lit(alpha)))

    def labels(df):
        assert df.columns == nodes.columns
        return {r["node_id"]: [round(v, 6) for v in r["lc"]] for r in df.collect()}

    new = spark.createDataFrame([("n", "b", [0.2], 3, 1), ("m", "r", [0.3], 2, None)],
                                "new_id string, parent_id string, x array<double>, n int, y int")
    got = labels(tr.op_new(nodes, new))
    assert got["n"] == [0.0, 3.0] and got["m"] == [0.0, 0.0] and got["r"] == [3.0, 1.0]
    merged = tr.op_merge(nodes, spark.createDataFrame([("r", "a", "b", "x")], "at string, best1 string, best2 string, new_id string"))
    assert labels(merged)["x"] == [2.0, 1.0]
    split = tr.op_split(nodes, spark.createDataFrame([("b",)], "node_id string"))
    assert "b" not in labels(split) and labels(split)["d"] == [0.0, 1.0]
    fringe = tr.op_fringe(nodes, spark.createDataFrame(
        [("a", "i", "n1", [2.0], 1, 1), ("a", "i", "n2", [3.0], 2, 0)],
        "leaf_id string, inner_id string, new_id string, x array<double>, n int, y int"))
    got = labels(fringe)
    assert got["i"] == [3.0, 1.0] and got["n1"] == [0.0, 1.0] and got["n2"] == [2.0, 0.0] and got["a"] == [1.0, 0.0]
    added = spark.createDataFrame([("r", 2.0, [0.1], [0.0], [2.0 + alpha, alpha])],
                                  "node_id string, count double, mean array<double>, m2 array<double>, lc array<double>")
    assert labels(tr.add_to_ancestors(nodes, added))["r"] == [5.0, 1.0]
    assert labels(tr.add_to_ancestors(nodes, added.drop("lc")))["r"] == [3.0, 1.0]


@pytest.mark.parametrize("posterior", [False, True])
def test_descent_in_blocks(spark, posterior, monkeypatch):
    """The best child of each row, whatever nodes and how many children meet in a cell; unknown scores come first."""
    monkeypatch.setattr(tq, "CHILD_BLOCK", 7)
    rng = np.random.default_rng(5)
    mean = {i: rng.normal(size=3) for i in range(1, 61)}
    rows = [(0, None, 0, False, 60.0, [0.0] * 3, [60.0] * 3)] + [
        (i, 0 if i <= 4 else 1 + i % 4, 1 if i <= 4 else 2, i > 4, 14.0 if i <= 4 else 1.0, mean[i].tolist(), [0.0] * 3)
        for i in mean]
    rows.append((99, 2, 2, True, 1.0, None, None))
    tree = ConceptTree(spark.createDataFrame(rows, "node_id long, parent_id long, depth int, is_leaf boolean, count double, "
                                               "mean array<double>, m2 array<double>"), None, 2)
    x = rng.normal(size=(40, 3))
    asked = [(i, v.tolist()) for i, v in enumerate(x)]
    q = spark.createDataFrame(asked, "qid long, qvec array<double>")
    found = {r["qid"]: r for r in tq.categorize_greedy(tree, q, posterior=posterior).collect()}
    var = PRIOR_VAR
    for i, v in asked:
        at = 0
        for _ in range(2):
            kids = [r for r in rows if r[1] == at]
            if any(r[5] is None for r in kids):
                at = 99
                break
            score = lambda r: round(-0.5 * sum((a - b) ** 2 / var for a, b in zip(v, r[5])) + posterior * np.log(r[4]), 9)
            at = min(kids, key=lambda r: (-score(r), r[0]))[0]
        assert found[i]["leaf_id"] == at
        assert (found[i]["leaf_score"] is None) == (at == 99)
    assert len(found) == 40


@pytest.mark.parametrize("blocks", [False, True])
def test_posterior_by_families(spark, blocks, monkeypatch):
    """Order and label shares as from all pairs of query and node, which are not listed: families of one to 150 children,
    leaves on three levels, copies."""
    if blocks:
        for name, value in (("CHILD_BLOCK", 40), ("ITEM_BLOCK", 50), ("ROWS_OF_CELL", 300), ("LEAST_QUERIES", 4)):
            monkeypatch.setattr(tq, name, value)
    rng = np.random.default_rng(8)
    spec = [("r", None, 0, False)] + [(f"i{i}", "r", 1, False) for i in range(4)] + [("l", "r", 1, True), ("i5", "i1", 2, False)]
    spec += [(f"a{i:03}", "i0", 2, True) for i in range(150)] + [(f"b{i}", "i1", 2, True) for i in range(3)]
    spec += [(f"c{i}", "i5", 3, True) for i in range(12)] + [("d", "i2", 2, True)] + [(f"e{i}", "i3", 2, True) for i in range(10)]
    rows = []
    for n, (node, parent, depth, leaf) in enumerate(spec):
        copy = node[0] == "a" and n % 3 == 0
        mean = [0.5, 0.25, -0.5] if copy else rng.normal(size=3).tolist()
        lc = np.eye(3)[n % 3] + 1e-8 if leaf else rng.random(3) + 0.1
        rows.append((node, parent, depth, leaf, 1.0 if leaf else float(rng.integers(5, 60)), mean,
                     [0.0] * 3 if leaf else rng.random(3).tolist(), lc.tolist()))
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string, depth int, is_leaf boolean, count double, "
                                        "mean array<double>, m2 array<double>, lc array<double>")
    tree = ConceptTree(nodes, None, 3)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.floor(rng.normal(size=(17, 3)) * 8) / 8)], "qid long, qvec array<double>")
    rank = lambda: {(r["qid"], r["rank"]): r["leaf_id"] for r in tq.bestfirst_posterior(tree, q, 7).collect()}
    prob = lambda: {(r["qid"], r["label"]): r["prob"] for r in tq.predict_label_probs(tree, q).collect()}
    with monkeypatch.context() as all_pairs:
        all_pairs.setattr(tq, "_has_keys", lambda df, key: False)
        ranks, probs = rank(), prob()

    def listed(*args):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(tq, "posterior_scores", listed)
    assert len(ranks) == 17 * 7 and rank() == ranks
    assert len(probs) == 17 * 3 and prob() == pytest.approx(probs, abs=1e-9)
