"""Corpora, queries and targets from labelled pairs, nested passages and graded pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.skew import first_by_hash, prefix_sums
from arbora.session import materialize

# One sentence: text up to and including its closing marks (fixed value).
SENTENCE_PATTERN = r"[^.!?]+[.!?]*"


def _hash(id_col: str, seed: str):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))


def src_pairs(pairs: DataFrame, subset_size: int, target_size: int, seed: str = "0") -> DataFrame:
    """pairs(pair_id, question1, question2, label) -> (role, doc_id, text, target_text).

    ``corpus`` rows are the second texts of a hash-ordered sample of the positive pairs, filled up with second
    texts of other pairs; ``query`` rows are the first ``target_size`` of the sample with their targets.
    """
    hashed = pairs.withColumn("_h", _hash("pair_id", seed))
    sampled = first_by_hash(hashed.where("label = 1"), subset_size, "_h")
    n_positive = sampled.count()
    corpus = sampled
    if n_positive < subset_size:
        filler = first_by_hash(hashed.where("label is distinct from 1"), subset_size - n_positive, "_h")
        corpus = sampled.unionByName(filler)
    asked = first_by_hash(sampled, target_size, "_h")
    none = F.lit(None).cast("string")
    return corpus.select(F.lit("corpus").alias("role"), F.col("pair_id").alias("doc_id"), F.col("question2").alias("text"),
                         none.alias("target_text")).unionByName(
        asked.select(F.lit("query").alias("role"), F.col("pair_id").alias("doc_id"), F.col("question1").alias("text"),
                     F.col("question2").alias("target_text")))


def src_passages(examples: DataFrame, subset_size: int, target_size: int, seed: str = "0") -> DataFrame:
    """examples(ex_id, query, passages struct<passage_text, is_selected>) -> (role, doc_id, text, target_text).

    In order of ex_id: examples with a selected passage are taken (all their passages, the first selected one is the
    target) until ``target_size``; others go to the filler while the corpus is short of ``subset_size``; the first
    one after that ends the scan. A hash-ordered part of the filler completes the corpus. doc_id is "ex_id:position".
    """
    slim = examples.select(
        "ex_id", F.size("passages.passage_text").alias("size"),
        F.exists("passages.is_selected", lambda s: s == 1).cast("int").alias("positive"))
    slim = prefix_sums(slim, "ex_id", {"positives_before": "positive"}).withColumn(
        "taken", ((F.col("positive") == 1) & (F.col("positives_before") < target_size)).cast("int"))
    slim = slim.withColumn("taken_size", F.col("taken") * F.col("size"))
    slim = materialize(prefix_sums(slim, "ex_id", {"corpus_before": "taken_size"}), "scan")
    stop = slim.where((F.col("taken") == 0) & (F.col("corpus_before") >= subset_size)).agg(F.min("ex_id")).first()[0]
    seen = slim if stop is None else slim.where(F.col("ex_id") < stop)
    n_taken = seen.agg(F.coalesce(F.sum("taken_size"), F.lit(0))).first()[0]
    roles = examples.join(seen.select("ex_id", "taken"), "ex_id")
    passages = roles.select("ex_id", "taken", F.posexplode("passages.passage_text").alias("pos", "text")).withColumn(
        "doc_id", F.concat_ws(":", F.col("ex_id").cast("string"), F.col("pos").cast("string")))
    corpus = passages.where("taken = 1").select("doc_id", "text")
    if n_taken < subset_size:
        filler = passages.where("taken = 0").select("doc_id", "text").withColumn("_h", _hash("doc_id", seed))
        corpus = corpus.unionByName(first_by_hash(filler, subset_size - n_taken, "_h").select("doc_id", "text"))
    first = F.array_position("passages.is_selected", 1).cast("int") - 1
    asked = roles.where("taken = 1").select(
        F.lit("query").alias("role"), F.col("ex_id").cast("string").alias("doc_id"), F.col("query").alias("text"),
        F.get("passages.passage_text", first).alias("target_text"))
    return corpus.select(F.lit("corpus").alias("role"), "doc_id", "text",
                         F.lit(None).cast("string").alias("target_text")).unionByName(asked)


def src_graded_pairs(pairs: DataFrame, score_threshold: float | None = None) -> DataFrame:
    """pairs(pair_id, sentence1, sentence2, similarity_score 0–5) -> two rows per pair sharing score / 5."""
    scored = pairs.withColumn("score", F.col("similarity_score") / F.lit(5.0))
    if score_threshold is not None:
        scored = scored.where(F.col("score") >= score_threshold)
    both = F.array(F.struct(F.lit(1).alias("side"), F.col("sentence1").alias("text")),
                   F.struct(F.lit(2).alias("side"), F.col("sentence2").alias("text")))
    return scored.withColumn("s", F.explode(both)).select("pair_id", "s.side", "s.text", "score")


def src_union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits one after another, each row marked with its split."""
    frames = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def src_unpivot_fields(rows: DataFrame, id_col: str, fields: list[str], max_samples: int | None = None) -> DataFrame:
    """Each text field becomes samples of its own: (id, field, text), null as "".

    Fields the table lacks are ignored; if it has none of them, its first string column is used.
    """
    present = [f for f in fields if f in rows.columns]
    if not present:
        present = [c for c, t in rows.dtypes if t == "string"][:1]
    if not present:
        raise ValueError("no text column to use")
    if max_samples is not None:
        rows = first_by_hash(rows.withColumn("_h", _hash(id_col, "")), max_samples, "_h").drop("_h")
    texts = rows.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in present])
    return texts.unpivot("id", present, "field", "text")


def src_sentences(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, sent_id, text): sentences by closing marks, blank ones left out."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE_PATTERN), 0)).alias("sent_id", "text"))
    return found.select("doc_id", F.col("sent_id").cast("bigint").alias("sent_id"), F.trim("text").alias("text")).where("text <> ''")
