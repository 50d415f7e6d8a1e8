"""Sources, reports, encoders and the session."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arbora import session as se
from arbora.operators import encode as enc
from arbora.operators import report as rep
from arbora.plans import benchmark as bm
from arbora.sources import datasets as ds

RESULT = """
--- Metrics for Exact ---
Avg Latency: 12.5 ms with total time 0.75 seconds
+-----+--------+--------+--------+
|  k  | Recall |  MRR   |  nDCG  |
+-----+--------+--------+--------+
| @2  | 0.125  | 0.1    | 0.11   |
| @10 | 0.875  | 0.4375 | 0.55   |
+-----+--------+--------+--------+

--- Metrics for Tree Fast ---
+-----+--------+--------+--------+
|  k  | Recall |  MRR   |  nDCG  |
+-----+--------+--------+--------+
| @2  | 0.5    | 0.25   | 0.125  |
+-----+--------+--------+--------+
"""


def test_result_files(spark, tmp_path):
    (tmp_path / "benchmark_some-model_validation_x_c600_t60_k20_ab12.txt").write_text(RESULT)
    got = {(r["method"], r["k"]): r for r in rep.read_metrics_text(spark, str(tmp_path)).collect()}
    assert set(got) == {("Exact", 2), ("Exact", 10), ("Tree Fast", 2)}
    row = got[("Exact", 10)]
    assert (row["model"], row["corpus_size"], row["avg_latency_ms"], row["total_s"]) == ("some-model", 600, 12.5, 0.75)
    assert (row["recall"], row["mrr"], row["ndcg"]) == (0.875, 0.4375, 0.55)
    assert got[("Tree Fast", 2)]["avg_latency_ms"] is None


def examples(spark, positives, size=4):
    rows = [(i, f"q{i}", ([f"p{i}.{j}" for j in range(size)], [0, 1 if i in positives else 0, 0, 0])) for i in range(50)]
    return spark.createDataFrame(rows, "ex_id bigint, query string, passages struct<passage_text array<string>, is_selected array<int>>")


def taken(spark, positives, subset, target):
    got = ds.src_passages(examples(spark, positives), subset, target).collect()
    return ({r["text"] for r in got if r["role"] == "corpus"},
            {(r["text"], r["target_text"]) for r in got if r["role"] == "query"})


def passages_of(*examples_):
    return {f"p{i}.{j}" for i in examples_ for j in range(4)}


def test_passages_of_targets_come_first_and_filler_completes(spark):
    corpus, asked = taken(spark, {1, 3, 5}, 20, 2)
    assert asked == {("q1", "p1.1"), ("q3", "p3.1")}
    assert passages_of(1, 3) <= corpus and len(corpus) == 20
    # 0, 2, 4, 5, … are filler: the targets' own passages never fill the corpus beyond their share
    assert len(corpus - passages_of(1, 3)) == 12


def test_passages_stop_where_the_corpus_is_full(spark):
    """Every example is positive: two targets make eight passages, more than the six asked for, so the third ends it."""
    corpus, asked = taken(spark, set(range(50)), 6, 2)
    assert corpus == passages_of(0, 1) and len(asked) == 2


def test_passages_without_any_target(spark):
    corpus, asked = taken(spark, set(), 25, 5)
    assert asked == set() and len(corpus) == 25 and corpus <= passages_of(*range(50))


def test_passages_use_all_examples_if_the_corpus_never_fills(spark):
    corpus, asked = taken(spark, {7}, 10_000, 5)
    assert corpus == passages_of(*range(50)) and asked == {("q7", "p7.1")}


def test_unpivot_falls_back_to_a_text_column(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, None)], "id bigint, x double, body string")
    assert {(r["field"], r["text"]) for r in ds.src_unpivot_fields(df, "id", ["question1"]).collect()} == {("body", "a"), ("body", "")}
    assert ds.src_unpivot_fields(df, "id", ["body"], max_samples=1).count() == 1
    with pytest.raises(ValueError):
        ds.src_unpivot_fields(df.select("id", "x"), "id", ["question1"])


def test_encoders(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "A, b; C!"), (3, None), (4, "x\ny")], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in enc.encode(docs).collect()}
    assert out[1]["vec"] == out[2]["vec"] and out[4]["text"] == "x\ny" and out[3]["text"] is None
    assert enc.encode(docs, prefix="query: ").where("doc_id = 1").first()["vec"] != out[1]["vec"]
    with pytest.raises(ValueError):
        enc.encode(docs, "no such encoder")
    assert not any(out[3]["vec"]) and sum(v * v for v in out[1]["vec"]) == pytest.approx(1)
    assert min(out[1]["vec"] + out[4]["vec"]) < 0 < max(out[1]["vec"] + out[4]["vec"])


@pytest.mark.parametrize("width", [3, 100])
def test_mean_pooling_by_either_way(spark, width):
    rng = random.Random(width)
    rows = [(i % 7, rng.randint(0, 1), [rng.random() for _ in range(width)]) for i in range(60)] + [(9, 0, [1.0] * width)]
    got = {r["doc_id"]: r["vec"] for r in enc.pool_mean(spark.createDataFrame(
        rows, "doc_id bigint, mask int, hidden array<double>")).collect()}
    assert set(got) == {*range(7), 9} and got[9] == [0.0] * width
    for i in range(7):
        used = [h for d, m, h in rows if d == i and m]
        assert got[i] == pytest.approx([sum(c) / len(used) for c in zip(*used)])
    uneven = spark.createDataFrame(rows + [(1, 1, [0.0] * (width + 1))], "doc_id bigint, mask int, hidden array<double>")
    with pytest.raises(Exception):
        enc.pool_mean(uneven.coalesce(1)).collect()


def test_document_frequencies_weigh_words(spark):
    """A word that every text holds counts less than one that a single text holds."""
    docs = spark.createDataFrame([(i, f"common rare{i}") for i in range(20)] + [(20, None)], "doc_id bigint, text string")
    idf = enc.term_idf(docs)
    enc.register_encoder("weighted", enc.hashing_encoder(dim=1 << 18, idf=idf))
    vec = enc.encode(docs, "weighted").where("doc_id = 1").first()["vec"]
    low, high = sorted(abs(v) for v in vec if v)
    assert high / low == pytest.approx((math.log(22 / 2) + 1) / (math.log(22 / 21) + 1))


def test_rows_are_encoded_alike_wherever_they_stand(spark):
    """More rows than are summed at a time, with texts without words among them; vectors leave as Arrow arrays."""
    texts = [None if i % 7 == 0 else "" if i % 11 == 0 else f"word{i % 50} and word{i % 50}" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    coded = enc.encode(docs)
    found = {r["doc_id"]: r["vec"] for r in coded.collect()}
    assert len(found) == 700 and {len(v) for v in found.values()} == {256}
    by_text = {}
    for i, text in enumerate(texts):
        assert by_text.setdefault(text or "", found[i]) == found[i]
    assert not any(by_text[""]) and len({tuple(v) for v in by_text.values()}) > 40
    assert "], 250" in coded._jdf.queryExecution().executedPlan().toString()  # the number of Arrow functions


def test_unmasked_mean(spark):
    t = spark.createDataFrame([(1, 0, 1, [1.0, 2.0]), (1, 1, 0, [3.0, 6.0]), (2, 0, 0, [5.0, 5.0])], "doc_id int, pos int, mask int, hidden array<double>")
    masked = {r["doc_id"]: r["vec"] for r in enc.pool_mean(t).collect()}
    assert masked == {1: [1.0, 2.0], 2: [0.0, 0.0]}
    assert {r["doc_id"]: r["vec"] for r in enc.pool_mean(t, use_mask=False).collect()}[1] == [2.0, 4.0]


def test_crowded_leaf_gives_whole_top_k(spark):
    members = spark.range(1000).select(F.lit("L0").alias("leaf_id"), F.col("id").alias("doc_id")).union(
        spark.createDataFrame([("L1", 5000)], "leaf_id string, doc_id bigint"))
    found = spark.createDataFrame([(1, "L1", 1), (1, "L0", 2)], "qid int, leaf_id string, rank bigint")

    class Tree:
        pass

    tree = Tree()
    tree.members = members
    got = [(r["doc_id"], r["rank"]) for r in bm.leaves_to_docs(found, tree, 4).orderBy("rank").collect()]
    assert got == [(5000, 1), (0, 2), (1, 3), (2, 4)]


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class FakeContext:
    def __init__(self, master, conf):
        self.master, self.conf = master, conf

    def getConf(self):
        return Conf(self.conf)

    def getCheckpointDir(self):
        return None


class FakeSession:
    def __init__(self, master="spark://host", session_conf=(), context_conf=()):
        self.conf, self.sparkContext = Conf(session_conf), FakeContext(master, dict(context_conf))


def test_scratch_folder_comes_from_the_session(spark):
    setting = {"spark.checkpoint.dir": "/shared/ckpt"}
    assert se.scratch_root(FakeSession(session_conf=setting)) == "/shared/ckpt"
    assert se.scratch_root(FakeSession(context_conf=setting)) == "/shared/ckpt"
    with pytest.raises(RuntimeError):  # never a machine-local folder on a cluster
        se.scratch_root(FakeSession())
    assert se.scratch_root(spark) == se.scratch_root(spark)


def test_take_small(spark):
    assert se.take_small(spark.range(10), 9) is None
    assert se.take_small(spark.range(10), 10).num_rows == 10
