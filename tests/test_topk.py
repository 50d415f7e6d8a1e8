"""Top-k against brute force, on both ways of running it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import ann
from arbora.operators import topk as tk


def frame(spark, ids, x, id_name, vec_name):
    kind = "string" if isinstance(ids[0], str) else "bigint"
    return spark.createDataFrame([(i, row.tolist()) for i, row in zip(ids, x)], f"{id_name} {kind}, {vec_name} array<double>").repartition(4)


def brute(scores, ids, k):
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -np.round(scores, 9)), axis=1)[:, :k]
    return np.asarray(ids)[order]


def ranked(df):
    rows = df.orderBy("qid", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r["qid"], []).append(r["doc_id"])
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12))
    x[100:200] = x[7]  # a third of all rows are copies of one
    return np.round(rng.standard_normal((40, 12)), 1), x


@pytest.mark.parametrize("ways", ["broadcast", "grid"])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_dot(spark, data, ways, k, monkeypatch):
    q, x = data
    monkeypatch.setattr(tk, "ITEM_BLOCK", 64)
    monkeypatch.setattr(tk, "QUERY_BLOCK", 16)
    found = tk.topk_dot(frame(spark, list(range(40)), q, "qid", "qvec"), frame(spark, list(range(300)), x, "doc_id", "vec"), k,
                        **({"broadcast_bytes": 1} if ways == "grid" else {}))
    want = brute(q @ x.T, np.arange(300), k)
    got = ranked(found)
    assert len(got) == 40
    assert all(got[i] == want[i].tolist() for i in range(40))


def test_string_ids(spark, data):
    q, x = data
    ids = [f"d{i}" for i in range(300)]
    got = ranked(tk.topk_dot(frame(spark, list(range(40)), q, "qid", "qvec"), frame(spark, ids, x, "doc_id", "vec"), 5))
    want = brute(q @ x.T, np.array(ids), 5)
    assert all(got[i] == want[i].tolist() for i in range(40))


def test_l2_and_cosine(spark, data):
    q, x = data
    qf, xf = frame(spark, list(range(40)), q, "qid", "qvec"), frame(spark, list(range(300)), x, "doc_id", "vec")
    dist = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert all(g == w.tolist() for g, w in zip(ranked(tk.topk_l2(qf, xf, 9)).values(), brute(-dist, np.arange(300), 9)))
    cos = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    assert all(g == w.tolist() for g, w in zip(ranked(tk.topk_cosine(qf, xf, 9)).values(), brute(cos, np.arange(300), 9)))


def test_rank_of_target(spark, data, monkeypatch):
    q, x = data
    monkeypatch.setattr(tk, "ITEM_BLOCK", 64)
    target = np.arange(40) * 5
    scores = q @ x.T
    rows = [(i, q[i].tolist(), int(t), float(scores[i, t])) for i, t in enumerate(target)]
    queries = spark.createDataFrame(rows, "qid bigint, qvec array<double>, target_id bigint, target_score double")
    got = {r["qid"]: r["rank"] for r in tk.rank_of_target(queries, frame(spark, list(range(300)), x, "item_id", "coef")).collect()}
    order = brute(scores, np.arange(300), 300)
    assert got == {i: order[i].tolist().index(t) + 1 for i, t in enumerate(target)}


@pytest.mark.parametrize("ways", ["broadcast", "grid"])
def test_ann_finds_most(spark, data, ways, monkeypatch):
    q, x = data
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)  # the crowd of copies fills several blocks
    monkeypatch.setattr(tk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    few = {"broadcast_bytes": 1} if ways == "grid" else {}
    qf, xf = frame(spark, list(range(40)), q, "qid", "qvec"), frame(spark, list(range(300)), x, "doc_id", "vec")
    exact = ranked(tk.topk_cosine(qf, xf, 10))
    index = ann.fit_ann(xf, qf)
    near = ranked(ann.search_ann(index, qf, 10, **few))
    assert sum(len(set(exact[i]) & set(near[i])) for i in exact) >= 0.9 * 400
    assert index.recall >= 0.9 and index.n_probe < index.cells.count()
    assert ranked(ann.search_ann(index, qf, 10, n_probe=10_000, **few)) == exact  # looking into all cells is exact
    with pytest.raises(ValueError):
        ann.search_ann(index, qf, 11)


def test_ann_indexes_every_row_and_reads_few(spark, data):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((40, 8))[rng.integers(0, 40, 3000)] * 3 + rng.standard_normal((3000, 8))
    xf = frame(spark, [f"d{i:04}" for i in range(3000)], x, "doc_id", "vec")
    index = ann.fit_ann(xf, k=5)
    assert sorted(r[0] for r in index.blocks.select(F.explode("ids")).collect()) == [f"d{i:04}" for i in range(3000)]
    q = frame(spark, list(range(50)), x[:50] + 0.1, "qid", "qvec")
    found, exact = ranked(ann.search_ann(index, q, 5)), ranked(tk.topk_cosine(q, xf, 5))
    assert sum(len(set(exact[i]) & set(found[i])) for i in exact) >= 0.9 * 250
    plan = ann.search_ann(index, q.limit(1), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shelf" in plan or "shelf#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert index.n_probe < 0.6 * index.cells.count()


def test_empty_queries(spark, data):
    xf = frame(spark, list(range(300)), data[1], "doc_id", "vec")
    none = spark.createDataFrame([], "qid bigint, qvec array<double>")
    assert tk.topk_dot(none, xf, 3).count() == 0


def test_pair_scores_of_many_queries(spark):
    """More queries than are ever broadcast: every pair still has its score."""
    q = spark.range(5000).select(F.col("id").alias("qid"), F.array(F.col("id").cast("double")).alias("qvec"))
    got = tk.pair_scores(q, spark.createDataFrame([(1, [1.0]), (2, [-2.0])], "item_id bigint, coef array<double>"))
    row = got.agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.count_distinct("qid").alias("q")).first()
    assert (row["n"], row["s"], row["q"]) == (10_000, -sum(range(5000)), 5000)



@pytest.mark.parametrize("n", [40, 5000])
def test_pair_scores_takes_any_number_of_queries(spark, data, n, monkeypatch):
    monkeypatch.setattr(tk, "PAIR_ITEMS", 2)
    x = data[1][:5]
    q = np.round(np.random.default_rng(4).standard_normal((n, 12)), 1)
    got = tk.pair_scores(frame(spark, list(range(n)), q, "qid", "qvec"), frame(spark, list(range(5)), x, "item_id", "coef")).collect()
    want = q @ x.T
    assert len(got) == len({(r.qid, r.item_id) for r in got}) == n * 5
    assert all(abs(r.score - want[r.qid, r.item_id]) < 1e-9 for r in got)
    everywhere = tk.pair_scores(frame(spark, list(range(40)), q[:40], "qid", "qvec"), frame(spark, list(range(5)), x, "item_id", "coef"), 1)
    assert everywhere.count() == 200


def test_tree_operators_refuse_no_number_of_queries(spark):
    from arbora.operators import tree_build as tb, tree_query as tq

    rows = spark.createDataFrame([(i, [float(i % 3), float(i)]) for i in range(6)], "doc_id bigint, vec array<double>")
    tree = tb.build_tree(rows, restructure=0)
    queries = spark.range(4200).select(F.col("id").alias("qid"), F.array(F.col("id") / 1000.0, F.lit(1.0)).alias("qvec"))
    assert tq.tree_rank_scores(tree, queries).count() == 4200 * 6
    assert tq.posterior_scores(tree, queries).count() == 4200 * tree.nodes.count()


@pytest.mark.parametrize("ways", ["broadcast", "grid"])
def test_log_sum_exp(spark, data, ways, monkeypatch):
    q, x = data
    monkeypatch.setattr(tk, "ITEM_BLOCK", 64)
    monkeypatch.setattr(tk, "QUERY_BLOCK", 16)
    items = frame(spark, list(range(300)), x * 40, "item_id", "coef")  # large enough to overflow a plain sum
    got = {r["qid"]: r["lse"] for r in tk.log_sum_exp_scores(
        frame(spark, list(range(40)), q, "qid", "qvec"), items, 0.5, **({"broadcast_bytes": 1} if ways == "grid" else {})).collect()}
    s = q @ (x * 40).T / 0.5
    top = s.max(axis=1)
    want = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    assert len(got) == 40 and all(got[i] == pytest.approx(want[i], rel=1e-12) for i in range(40))


def test_tiles_agree_with_whole_blocks(monkeypatch):
    """Ties, repeated ids and unknown scores, in tiles with few scores at a time."""
    monkeypatch.setattr(tk, "ITEM_TILE", 64)
    monkeypatch.setattr(tk, "PILOT", 8)
    monkeypatch.setattr(tk, "CELLS_AT_ONCE", 500)
    held, score = [], tk._block_scores

    def scores(*parts):
        held.append(score(*parts))
        return held[-1]

    monkeypatch.setattr(tk, "_block_scores", scores)
    rng = np.random.default_rng(3)
    q, coef = rng.integers(-2, 3, (23, 4)).astype(float), rng.integers(-2, 3, (301, 4)).astype(float)
    const, ids = rng.integers(0, 2, 301) * 1e-10, rng.permutation(301) // 2
    for case in (const, np.where(np.arange(301) == 70, np.nan, const)):
        for k in (1, 5, 40):
            held.clear()
            got = tk._best_scores(q, ids, coef, case, k)
            assert max(h.size for h in held) <= 500
            want = tk.best_in_block(score(q, coef, case), ids, k)
            assert np.array_equal(got[0], want[0])
            assert np.allclose(got[1], want[1], atol=1e-9, equal_nan=True)


def test_probed_cells_leave_in_bounded_parts():
    """Rows with their vectors, once per cell found, stay within the bound on numbers held."""
    for n_cells, width, dims in ((320, 100, 64), (784, 784, 64), (100, 1, 1), (100, 20, 1)):
        assert ann._rows_at_once(n_cells, width, dims) * max(n_cells, width * dims) <= ann.CELLS_AT_ONCE
    assert ann._rows_at_once(2_000_000, 1, 1) == 1


@pytest.mark.parametrize("way", ["pairs", "topk", "rank", "sums"])
def test_blocks_meet_without_moving_copies(spark, data, way, monkeypatch):
    """Beyond a broadcast no row is shuffled once per block of the other side; ids may repeat."""
    for name in ("ITEM_BLOCK", "PAIR_ITEMS"):
        monkeypatch.setattr(tk, name, 50)
    q, x = data
    queries = frame(spark, [i // 2 for i in range(40)], q, "qid", "qvec")
    items = frame(spark, list(range(300)), x, "item_id", "coef")
    s = q @ x.T
    if way == "pairs":
        got = tk.pair_scores(queries, items, 1)
        assert got.count() == 40 * 300
        assert got.agg(F.sum("score")).first()[0] == pytest.approx(s.sum())
    elif way == "topk":
        got = tk.topk_linear(queries, items, 7, 1)
    elif way == "rank":
        asked = spark.createDataFrame([(i, q[i].tolist(), 3, float(s[i, 3])) for i in range(40)],
                                      "qid bigint, qvec array<double>, target_id bigint, target_score double")
        got = tk.rank_of_target(asked, items)
    else:
        got = tk.log_sum_exp_scores(queries, items, 1.0, 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "Generate" not in plan


def test_continued_search_agrees(monkeypatch):
    """Blocks one after the other, filtered in single precision, give what one block gives: ties, constants, large numbers."""
    rng = np.random.default_rng(8)
    for scale, offset in ((1.0, 0.0), (1e-9, 0.0), (1.0, 1e6), (1e25, 0.0), (1e200, 0.0)):
        q, x = rng.standard_normal((30, 12)) * scale, np.round(rng.standard_normal((900, 12)), 1)
        x[300:600], const = x[:300], np.round(rng.standard_normal(900)) + offset
        ids, best = rng.permutation(900), None
        for lo in range(0, 900, 200):
            t = slice(lo, lo + 200)
            best = tk._best_scores(q, ids[t], x[t], const[t], 6, best)
        s = np.einsum("ij,kj->ik", q, x) + const
        want = np.array([np.lexsort((ids, -np.round(row, 9)))[:6] for row in s])
        assert np.allclose(best[1], np.take_along_axis(s, want, axis=1), rtol=1e-12, atol=1e-12)
        if scale == 1.0:
            assert (best[0] == ids[want]).all()
