"""Registered queries: scans, sources, sinks, encoding."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from arbora.functions import vec as V
from arbora.operators import encode as enc
from arbora.operators import report as rep
from arbora.operators import whiten as wh
from arbora.operators.topk import topk_dot
from arbora.plans import inputs as I
from arbora.plans.registry import E, Q, TOPO, query, r6, sql6, with_
from arbora.session import scratch_root
from arbora.sources import datasets as ds
from arbora.sources import storage as st


def _scratch(spark, name: str) -> str:
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


_PAIRS = """
p AS (
  SELECT u.conv_id::VARCHAR || '-' || u.turn::VARCHAR AS pair_id, u.text AS question1, coalesce(n.text, '') AS question2,
         CASE WHEN n.role = 'assistant' THEN 1 ELSE 0 END AS label
  FROM conversations u LEFT JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1
  WHERE u.role = 'user')"""


@query("src_pairs", with_(_PAIRS) + """,
    s AS (SELECT *, row_number() OVER (ORDER BY md5(pair_id || '0')) AS rn FROM p WHERE label = 1 QUALIFY rn <= 250),
    f AS (SELECT *, row_number() OVER (ORDER BY md5(pair_id || '0')) AS rn FROM p WHERE label <> 1
          QUALIFY rn <= 250 - (SELECT count(*) FROM s))
    SELECT 'corpus' AS role, pair_id AS doc_id, question2 AS text, NULL::VARCHAR AS target_text
    FROM (SELECT * FROM s UNION ALL SELECT * FROM f)
    UNION ALL SELECT 'query', pair_id, question1, question2 FROM s WHERE rn <= 100""")
def src_pairs(spark, sf):
    return ds.src_pairs(I.pairs(spark, sf), 250, 100)


_EXAMPLES = """
d AS (
  SELECT doc_id // 10 AS ex_id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1 AS pos, text,
         CASE WHEN quality = 1 THEN 1 ELSE 0 END AS sel
  FROM documents LEFT JOIN labels USING (doc_id)),
ex AS (SELECT ex_id, count(*) AS size, max(sel) AS positive FROM d GROUP BY ex_id),
a AS (SELECT *, coalesce(sum(positive) OVER (ORDER BY ex_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM ex),
b AS (SELECT *, CASE WHEN positive = 1 AND pb < 30 THEN 1 ELSE 0 END AS taken FROM a),
c AS (SELECT *, coalesce(sum(taken * size) OVER (ORDER BY ex_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb FROM b),
seen AS (SELECT * FROM c WHERE ex_id < coalesce((SELECT min(ex_id) FROM c WHERE taken = 0 AND cb >= 400), 1e18)),
ps AS (SELECT s.ex_id, s.taken, d.pos, d.text, d.sel, s.ex_id::VARCHAR || ':' || d.pos::VARCHAR AS doc_id FROM seen s JOIN d USING (ex_id))"""


@query("src_passages", with_(_EXAMPLES) + """
    SELECT 'corpus' AS role, doc_id, text, NULL::VARCHAR AS target_text FROM ps WHERE taken = 1
    UNION ALL
    SELECT 'corpus', doc_id, text, NULL FROM (
      SELECT doc_id, text FROM ps WHERE taken = 0
      QUALIFY row_number() OVER (ORDER BY md5(doc_id || '0')) <= 400 - (SELECT sum(taken * size) FROM seen))
    UNION ALL
    SELECT 'query', ex_id::VARCHAR, 'query ' || ex_id::VARCHAR, text FROM ps WHERE taken = 1 AND sel = 1
    QUALIFY row_number() OVER (PARTITION BY ex_id ORDER BY pos) = 1""")
def src_passages(spark, sf):
    return ds.src_passages(I.examples(spark, sf), 400, 30)


@query("src_graded_pairs", """
    WITH p AS (
      SELECT d.doc_id AS pair_id, d.text AS s1, n.text AS s2, (quality * 5.0::DOUBLE - toxic * quality) / 5.0::DOUBLE AS score
      FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1 JOIN labels l ON l.doc_id = d.doc_id)
    SELECT pair_id, 1 AS side, s1 AS text, score FROM p WHERE score >= 0.5
    UNION ALL SELECT pair_id, 2, s2, score FROM p WHERE score >= 0.5""")
def src_graded_pairs(spark, sf):
    return ds.src_graded_pairs(I.graded_pairs(spark, sf), 0.5)


@query("src_union_splits", """
    SELECT doc_id, quality, 'labels' AS split FROM labels
    UNION ALL SELECT doc_id, n_chars::INT, 'documents' FROM documents
    UNION ALL SELECT item_id, length(text)::INT, 'benchmark' FROM benchmark""")
def src_union_splits(spark, sf):
    return ds.src_union_splits({
        "labels": I.table(spark, sf, "labels").select("doc_id", "quality"),
        "documents": I.table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("int").alias("quality")),
        "benchmark": I.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").alias("quality")),
    })


@query("src_unpivot_fields", with_(_PAIRS) + """,
    n AS (SELECT pair_id, question1, CASE WHEN label = 1 THEN question2 END AS question2 FROM p)
    SELECT pair_id AS id, 'question1' AS field, coalesce(question1, '') AS text FROM n
    UNION ALL SELECT pair_id, 'question2', coalesce(question2, '') FROM n""")
def src_unpivot_fields(spark, sf):
    rows = I.pairs(spark, sf).withColumn("question2", F.when(F.col("label") == 1, F.col("question2")))
    return ds.src_unpivot_fields(rows, "pair_id", ["question1", "question2", "missing"])


@query("src_sentences", """
    WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS parts FROM documents),
    u AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS sent_id, trim(unnest(parts), ' ') AS text FROM s)
    SELECT doc_id, sent_id, text FROM u WHERE text <> ''""")
def src_sentences(spark, sf):
    return ds.src_sentences(I.table(spark, sf, "documents"))


@query("src_embeddings", with_(E) + f" SELECT vec_id AS doc_id, d AS dim, {sql6('v', 'value')} FROM e")
def src_embeddings(spark, sf):
    found = st.load_embeddings(spark, f"{sf}/embeddings.parquet")
    missing = st.load_embeddings(spark, f"{sf}/no_such_table.parquet")
    assert missing is None
    rows = found.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return V.dims(rows, "vec", "doc_id").select("doc_id", "dim", r6("value"))


@query("cache_or_compute", with_(E) + f"""
    SELECT vec_id AS doc_id, count(*) AS dims, {sql6('sum(v)', 'total')} FROM e GROUP BY vec_id""")
def cache_or_compute(spark, sf):
    root = _scratch(spark, "cache")
    make = lambda: I.vectors(spark, sf).select("doc_id", "vec")
    st.cache_or_compute(spark, root, "a", make)

    def never():
        raise AssertionError("a stored table must be reused")

    kept = st.cache_or_compute(spark, root, "a", never)
    return kept.select("doc_id", F.size("vec").cast("bigint").alias("dims"), r6(V.total("vec"), "total"))


@query("run_id", """
    WITH p AS (
      SELECT doc_id, 'org/' || lang || '-model' AS model_name, lang || repeat('-long', (doc_id % 8)::INT) AS dataset,
             source AS split, n_chars AS subset_size, doc_id AS target_size, 10 AS top_k FROM documents),
    s AS (
      SELECT *, 'dataset=' || dataset || '_model_name=' || replace(model_name, '/', '-') || '_split=' || split ||
             '_subset_size=' || subset_size || '_target_size=' || target_size || '_top_k=' || top_k AS listed FROM p)
    SELECT doc_id, CASE WHEN length(listed) > 100
      THEN replace(model_name, '/', '-') || '_' || dataset || '_' || split || '_c' || subset_size || '_t' || target_size || '_k' || top_k
           || '_' || substr(md5(listed), 1, 8)
      ELSE replace(replace(listed, '=', ''), '/', '-') END AS run_id FROM s""")
def run_id(spark, sf):
    p = I.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("org/"), "lang", F.lit("-model")).alias("model_name"),
        F.concat("lang", F.expr("repeat('-long', int(doc_id % 8))")).alias("dataset"), F.col("source").alias("split"),
        F.col("n_chars").alias("subset_size"), F.col("doc_id").alias("target_size"), F.lit(10).alias("top_k"))
    names = ["model_name", "dataset", "split", "subset_size", "target_size", "top_k"]
    return st.run_id(p, names).select("doc_id", "run_id")


@query("sink_sentences", "SELECT doc_id, text FROM documents")
def sink_sentences(spark, sf):
    path = _scratch(spark, "sentences")
    st.save_sentences(I.table(spark, sf, "documents").select("doc_id", "text"), path)
    return spark.read.parquet(path)


@query("sink_model", with_(E) + f"""
    SELECT d AS dim, {sql6('avg(v)', 'mean')}, true AS same_matrix, false AS converged FROM e GROUP BY d""")
def sink_model(spark, sf):
    """A whitening model written and read again, as one of a fit that was stopped too early."""
    path = _scratch(spark, "model")
    model = replace(wh.zca_fit(I.vectors(spark, sf)), converged=False)
    st.save_model(model, spark, path)
    back = st.load_model(spark, path)
    same = back.kind == model.kind and back.eps == model.eps and (back.matrix == model.matrix).all()
    return V.dims(back.to_frame(spark), "mean").select(
        "dim", r6("value", "mean"), F.lit(bool(same)).alias("same_matrix"), F.lit(back.converged).alias("converged"))


_TREE_ROWS = """
    SELECT node_id::VARCHAR AS node_id, parent_id::VARCHAR AS parent_id, depth, is_leaf, count(*)::DOUBLE AS count
    FROM topo JOIN mem USING (node_id) GROUP BY ALL"""
_MEM = """
mem AS (
  SELECT vec_id, unnest([0::BIGINT, 1 + label::BIGINT, 100000 + 2 * label + vec_id % 2, 1000000 + vec_id]) AS node_id FROM embeddings)"""


@query("tree_export_json", with_(TOPO, _MEM) + _TREE_ROWS)
def tree_export_json(spark, sf):
    lines = st.tree_json_lines(I.fixed_tree(spark, sf)).where("kind = 'node'")
    return lines.select(F.from_json("json", "node_id string, parent_id string, depth int, is_leaf boolean, count double").alias("n")).select("n.*")


@query("tree_import_json", with_(TOPO, _MEM) + _TREE_ROWS)
def tree_import_json(spark, sf):
    path = _scratch(spark, "tree")
    st.tree_json_lines(I.fixed_tree(spark, sf)).write.partitionBy("kind").text(path)
    lines = spark.read.text(path).select("kind", F.col("value").alias("json"))
    return st.tree_from_json_lines(lines, 3).nodes.select("node_id", "parent_id", "depth", "is_leaf", "count")


def metric_rows(spark, sf):
    """Result rows derived from the embeddings, one result file per label."""
    v = I.vectors(spark, sf).groupBy("label").agg(
        *[F.round(F.avg(F.abs(F.get("vec", F.lit(i)))), 4).alias(n) for i, n in enumerate(["recall", "mrr", "ndcg"])],
        F.count("*").alias("n"))
    return v.select(
        F.concat(F.lit("benchmark_m"), F.col("label") % 3, F.lit("_x_c"), F.col("n") * 100, F.lit("_t9_k10_"), "label").alias("file"),
        F.concat(F.lit("m"), F.col("label") % 3).alias("model"), (F.col("n") * 100).alias("corpus_size"),
        F.explode(F.array(F.lit("dot"), F.lit("best first"))).alias("method"), (F.col("n") / 4.0).alias("avg_latency_ms"),
        (F.col("n") / 8.0).alias("total_s"), "recall", "mrr", "ndcg").withColumn("k", F.explode(F.array(F.lit(5), F.lit(10))))


METRIC_SQL = """
m0 AS (
  SELECT label, count(*) AS n, round(avg(abs(embedding[1]::DOUBLE)), 4) AS recall, round(avg(abs(embedding[2]::DOUBLE)), 4) AS mrr,
         round(avg(abs(embedding[3]::DOUBLE)), 4) AS ndcg FROM embeddings GROUP BY label),
m AS (
  SELECT 'benchmark_m' || label % 3 || '_x_c' || n * 100 || '_t9_k10_' || label AS file, 'm' || label % 3 AS model,
         n * 100 AS corpus_size, method, n / 4.0::DOUBLE AS avg_latency_ms, n / 8.0::DOUBLE AS total_s, k, recall, mrr, ndcg
  FROM m0, (SELECT unnest(['dot', 'best first']) AS method), (SELECT unnest([5, 10]) AS k))"""


@query("src_metrics_text", with_(METRIC_SQL) + """
    SELECT model, corpus_size, method, avg_latency_ms, total_s, k, recall, mrr, ndcg FROM m""")
def src_metrics_text(spark, sf):
    path = _scratch(spark, "results")
    m = metric_rows(spark, sf)
    line = F.format_string("| @%-3d| %s | %s | %s |", "k", F.col("recall").cast("string"), F.col("mrr").cast("string"), F.col("ndcg").cast("string"))
    block = m.groupBy("file", "method", "avg_latency_ms", "total_s").agg(F.concat_ws("\n", F.collect_list(line)).alias("lines"))
    text = block.select("file", F.concat(
        F.lit("\n--- Metrics for "), "method", F.lit(" ---\nAvg Latency: "), F.col("avg_latency_ms").cast("string"),
        F.lit(" ms with total time "), F.col("total_s").cast("string"), F.lit(" seconds\n|  k  | Recall |  MRR   |  nDCG  |\n"), "lines").alias("block"))
    # A handful of short blocks per result file.
    text.groupBy("file").agg(F.concat_ws("\n", F.collect_list("block")).alias("value")).write.partitionBy("file").text(path)
    return rep.read_metrics_text(spark, path).select(
        "model", "corpus_size", "method", "avg_latency_ms", "total_s", "k", "recall", "mrr", "ndcg")


@query("sink_metrics", with_(METRIC_SQL) + """
    SELECT model, method, k, recall, mrr, ndcg, run_id FROM m, (SELECT unnest(['first', 'second']) AS run_id)""")
def sink_metrics(spark, sf):
    path = _scratch(spark, "metrics")
    rows = metric_rows(spark, sf).select("model", "method", "k", "recall", "mrr", "ndcg")
    for run in ("first", "second"):
        st.save_metrics(rows.withColumn("run_id", F.lit(run)), path)
    return spark.read.parquet(path).select("model", "method", "k", "recall", "mrr", "ndcg", "run_id")


@query("src_experiment_grid", """
    SELECT 'exp' || label AS name, 'set' || label % 2 AS dataset, 'c' || count(*) AS config,
           'cpus=' || label || ';mem=' || CASE WHEN label % 2 = 0 THEN '8' ELSE '4' END || ';time=60' AS options
    FROM embeddings WHERE label <> 0 GROUP BY label""")
def src_experiment_grid(spark, sf):
    path = _scratch(spark, "grid")
    rows = I.vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    mapped = F.when(F.col("label") % 2 == 0, F.create_map(F.lit("cpus"), F.col("label").cast("string"), F.lit("mem"), F.lit("8"))).otherwise(
        F.create_map(F.lit("cpus"), F.col("label").cast("string")))
    # One short entry per label.
    doc = rows.agg(F.collect_list(F.struct(
        F.concat(F.lit("exp"), "label").alias("name"), F.concat(F.lit("set"), F.col("label") % 2).alias("dataset"),
        F.concat(F.lit("c"), "n").alias("config"), mapped.alias("slurm_options"))).alias("experiments")).select(F.to_json(F.struct(
            "experiments", F.create_map(F.lit("mem"), F.lit("4"), F.lit("time"), F.lit("60")).alias("default_slurm_options"))).alias("value"))
    doc.coalesce(1).write.text(path)
    grid = st.read_experiment_grid(spark, path)
    grid = grid.where("name <> 'exp0'")
    shown = F.concat_ws(";", F.transform(F.array_sort(F.map_keys("options")), lambda k: F.concat_ws("=", k, F.col("options")[k])))
    return grid.select("name", "dataset", "config", shown.alias("options"))


# ---- encoding --------------------------------------------------------------------------------------------


def _term_sql(name: str, key: str) -> str:
    return f"""
    {name}_tf AS (
      SELECT {key} AS id, term, ln(1 + count(*)) AS damped, CASE WHEN term // 256 % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (
        SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 262144 AS term FROM (
          SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {name}) WHERE w <> '')
      GROUP BY ALL)"""


def _unit_sql(out: str, weight: str, source: str) -> str:
    """Unit vectors in long form, buckets without a term left out."""
    return f"""
    {out} AS (
      SELECT id, d, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM (
        SELECT id, 1 + term % 256 AS d, sum(sign * {weight}) AS x FROM {source} GROUP BY ALL))"""


_ENCODED = (_term_sql("documents", "doc_id"), """
    idf AS (
      SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM documents_tf GROUP BY term)""",
    _unit_sql("dv", "damped * idf", "documents_tf JOIN idf USING (term)"))


@query("encode", with_(*_ENCODED) + f"""
    SELECT c.doc_id, c.dim, {sql6("coalesce(x, 0)", 'value')}
    FROM (SELECT doc_id, unnest(range(1, 257)) AS dim FROM documents) c LEFT JOIN dv ON c.doc_id = dv.id AND c.dim = dv.d""")
def encode(spark, sf):
    """Every document as signed word hashes weighted by document frequencies of the whole table."""
    docs = I.table(spark, sf, "documents")
    enc.register_encoder("hashing_idf", enc.hashing_encoder(idf=enc.term_idf(docs)))
    return V.dims(enc.encode(docs, "hashing_idf"), "vec", "doc_id").select("doc_id", "dim", r6("value"))


@query("encode_dual", with_(*_ENCODED, _term_sql("benchmark", "item_id"), _unit_sql("qv", "damped", "benchmark_tf"), """
    p AS (
      SELECT item_id AS qid, doc_id, coalesce(s, 0) AS s FROM benchmark, documents LEFT JOIN (
        SELECT qv.id AS a, dv.id AS b, sum(qv.x * dv.x) AS s FROM qv JOIN dv USING (d) GROUP BY ALL) ON a = item_id AND b = doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, doc_id) AS rank FROM p QUALIFY rank <= 5)""") + f"""
    SELECT qid, doc_id, {sql6("s", "score")}, rank FROM r""")
def encode_dual(spark, sf):
    """Benchmark passages by plain word hashes as queries against all documents by weighted ones."""
    docs = I.table(spark, sf, "documents")
    enc.register_encoder("hashing_idf", enc.hashing_encoder(idf=enc.term_idf(docs)))
    q, p = enc.encode_dual(I.table(spark, sf, "benchmark"), docs, "hashing", "hashing_idf")
    found = topk_dot(q.select(F.col("item_id").alias("qid"), F.col("vec").alias("qvec")), p.select("doc_id", "vec"), 5)
    return found.select("qid", "doc_id", r6("score"), "rank")


_TOK = """
t0 AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
t1 AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM t0),
t AS (
  SELECT doc_id, pos, CASE WHEN length(word) > 2 THEN 1 ELSE 0 END AS mask,
         [length(word)::DOUBLE, (pos % 7)::DOUBLE, length(regexp_replace(word, '[aeiou]', '', 'g'))::DOUBLE] AS hidden FROM t1)"""


@query("pool_cls", with_(_TOK) + """
    SELECT doc_id, i AS dim, hidden[i] AS value FROM t, (SELECT unnest([1, 2, 3]) AS i) WHERE pos = 0""")
def pool_cls(spark, sf):
    return V.dims(enc.pool_cls(I.tokens(spark, sf)), "vec", "doc_id")


@query("pool_mean", with_(_TOK) + f"""
    SELECT doc_id, i AS dim, {sql6("sum(hidden[i] * mask) / greatest(sum(mask), 1e-9)", 'value')}
    FROM t, (SELECT unnest([1, 2, 3]) AS i) GROUP BY doc_id, i""")
def pool_mean(spark, sf):
    return V.dims(enc.pool_mean(I.tokens(spark, sf)), "vec", "doc_id").select("doc_id", "dim", r6("value"))


@query("l2_normalize", with_(E, Q) + f"""
    SELECT qid, d AS dim, {sql6("CASE WHEN n > 0 THEN x / n ELSE 0 END", 'value')}
    FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY qid)) AS n FROM q)""")
def l2_normalize(spark, sf):
    rows = I.queries(spark, sf).select("qid", V.l2_normalize("qvec").alias("vec"))
    return V.dims(rows, "vec", "qid").select("qid", "dim", r6("value"))


@query("check_dim", """
    SELECT vec_id AS doc_id, CASE WHEN label = 3 THEN 'encode again' ELSE 'good' END AS verdict FROM embeddings""")
def check_dim(spark, sf):
    v = I.vectors(spark, sf).withColumn("vec", F.when(F.col("label") == 3, F.slice("vec", 1, 7)).otherwise(F.col("vec")))
    good, bad = enc.check_dim(v, 64)
    return good.select("doc_id", F.lit("good").alias("verdict")).unionByName(bad.select("doc_id", F.lit("encode again").alias("verdict")))
