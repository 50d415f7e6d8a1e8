"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is shared out as an expected number of copies per document. Whole copies are certain; the
fractions are rounded together: two fractional documents fight, mass moves at random from one to the other until
one of them is integral, and the other goes on. Expectations are kept, and the words a fight adds or drops are made
up for by the documents still to come, so a source's words stay near its target. Documents of a source are dealt by a hash into blocks of bounded size; inside a block the
larger documents fight first, so the fraction left over is that of a small one. Block remainders meet in a
reduction tree of bounded fan-in, round by round, until each source has one.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import n_words, narrow, register, table
from arbora.session import materialize

BLOCK = 256
FAN_IN = 16
EPS = 1e-9


def _uniform(*parts) -> float:
    """A number in [0, 1) that depends on its arguments only, so reruns and retries agree."""
    digest = hashlib.blake2b(repr(parts).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") / 2.0**64


def fight(p: float, q: float, u: float) -> tuple[float, float]:
    """New probabilities of two fractional ones: one of them 0 or 1, each unchanged in expectation."""
    total = p + q
    if total < 1:
        return (total, 0.0) if u * total < p else (0.0, total)
    return (1.0, total - 1) if u * (2 - total) < 1 - q else (total - 1, 1.0)


def _round_block(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Fights inside one block, in descending size; at most one row of the result stays fractional.

    A fight keeps the sum of two probabilities. The words it thereby adds or drops (zero in expectation) are taken
    back from all documents still to come, each by the same shift of its probability, as far as 0 and 1 allow; what
    is left of them travels with the fractional row.
    """
    pdf = pdf.sort_values(["size", "id", "tag"], ascending=[False, True, True], na_position="last",
                          kind="stable").reset_index(drop=True)
    p, size = pdf["p"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
    ids, tags = pdf["id"].astype(str).to_list(), pdf["tag"].to_list()
    to_come = size[::-1].cumsum()[::-1]
    drift, at = float(pdf["drift"].sum()), -1
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = round(p[i])
            continue
        if drift and to_come[i]:
            shifted = min(1.0, max(0.0, p[i] - drift / to_come[i]))
            shifted = shifted if EPS < shifted < 1 - EPS else float(round(shifted))
            drift += (shifted - p[i]) * size[i]
            p[i] = shifted
        if at >= 0 and EPS < p[i] < 1 - EPS:
            before = p[at] * size[at] + p[i] * size[i]
            p[at], p[i] = fight(p[at], p[i], _uniform(seed, ids[at], ids[i], tags[at], tags[i]))
            for k in (i, at):
                p[k] = p[k] if EPS < p[k] < 1 - EPS else round(p[k])
            drift += p[at] * size[at] + p[i] * size[i] - before
        at = i if 0 < p[i] < 1 else at if at >= 0 and 0 < p[at] < 1 else -1
    pdf["p"], pdf["drift"] = p, 0.0
    if at >= 0:
        pdf.loc[at, "drift"] = drift
    return pdf


FRACTIONS = "src string, block long, id long, size long, tag long, p double, drift double"


def pivotal_round(fractions: DataFrame, seed: int = 17, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """src, id, size, tag, p (0 or 1) for rows (src, id, size, tag, p in [0, 1], n = rows of the source)."""
    blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("long")
    level = fractions.select(
        "src", F.pmod(F.xxhash64("id", "tag", F.lit(seed)), blocks).alias("block"), "id", "size", "tag", "p", F.lit(0.0).alias("drift"))
    done = None
    while True:
        rounded = materialize(
            level.groupBy("src", "block").applyInPandas(lambda g: _round_block(g, seed), FRACTIONS), "rounded")
        settled = rounded.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        rest = rounded.where("p > 0 and p < 1")
        # One remainder per block at most; the last one of a source is drawn alone.
        last = rest.agg(F.max("block"), F.count("*")).first()
        if not last[1]:
            return done.drop("block", "drift")
        if not last[0]:
            draw = (F.pmod(F.xxhash64(F.lit(seed), "id", "tag"), F.lit(1 << 30)) / float(1 << 30)) < F.col("p")
            return done.unionByName(rest.withColumn("p", draw.cast("double"))).drop("block", "drift")
        level = rest.withColumn("block", F.floor(F.col("block") / fan_in))


def source_ranks(sources: DataFrame) -> DataFrame:
    """Rank (0, 1, …) of every source by code point, null last, without bringing them into one task."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("src").asc_nulls_last()
    part = materialize(sources.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "sources")
    inside = Window.partitionBy("_part").orderBy(order)
    # One row per partition of the range.
    before = part.groupBy("_part").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(
            Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.withColumn("_at", F.row_number().over(inside) - 1).join(
        F.broadcast(before.drop("_n")), "_part").withColumn("rank", F.col("_at") + F.col("_before")).drop(
        "_part", "_at", "_before")


def share_targets(sources: DataFrame, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Adds ``target`` to (src, source_size, weight): ``share`` of all sizes by weight, at most ``most`` times the
    source's size; the excess goes to the others by weight, again and again until none is above.

    Only sums come to the driver. Each pass but the last stops at least one more source.
    """
    state = materialize(sources.withColumn("target", F.lit(None).cast("double")), "targets")
    goal = (state.agg(F.sum("source_size")).first()[0] or 0) * share
    if goal > most * (state.agg(F.sum("source_size")).first()[0] or 0):
        raise ValueError("the share asks for more than the allowed copies of all sources")
    while True:
        stopped, weight = state.agg(F.sum("target"), F.sum(F.when(F.col("target").isNull(), F.col("weight")))).first()
        if not weight:
            return state
        each = F.lit(goal - (stopped or 0.0)) * F.col("weight") / F.lit(float(weight))
        limit = F.col("source_size") * F.lit(most)
        over = F.col("target").isNull() & (each > limit)
        if state.where(over).isEmpty():
            return state.withColumn("target", F.coalesce("target", each))
        state = materialize(state.withColumn("target", F.when(over, limit).otherwise(F.col("target"))), "targets")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (= copies · size). Options as in ``_drawn``.

    Sources by code point, null last (a source like any other), weigh ``weights`` in turn. A null text has size 0;
    documents of sources without any word are taken 0 times. Repeated rows are separate documents. An empty table
    gives no rows; other columns are not read. The draw depends on ids and sizes only, not on the partitioning.
    """
    return _drawn(docs, **options).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _drawn(docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """id, src, size, tag, source_size, target, copies: ``tag`` counts rows that are equal in the first three."""
    rows = narrow(docs, id=docs[id_col].cast("long"), src=docs[source_col].cast("string"),
                  size=n_words(docs[text_col].cast("string")))
    rows = materialize(rows, "sizes")
    sources = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    targets = share_targets(source_ranks(sources).withColumn("weight", weight), share, most)
    targets = materialize(targets.select(
        "src", "source_size", "target", "n",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")), "rates")
    # Rows equal in source, id and size are one row with a number of repeats until they are told apart by a tag.
    repeats = Window.partitionBy("src", "id", "size").orderBy(F.lit(0))
    # A source may own a third of all rows; source rows are few bytes, and adaptive execution splits or broadcasts.
    rated = rows.withColumn("tag", F.row_number().over(repeats).cast("long")).join(
        targets, rows["src"].eqNullSafe(targets["src"])).drop(targets["src"])
    whole = F.floor(F.col("rate") + EPS)
    rated = rated.withColumn("whole", whole).withColumn("p", F.greatest(F.col("rate") - whole, F.lit(0.0)))
    rated = materialize(rated, "rated")
    drawn = pivotal_round(rated.select("src", "id", "size", "tag", "p", "n"), seed)
    drawn = drawn.select(F.col("src").alias("_src"), F.col("id").alias("_id"), F.col("size").alias("_size"),
                         F.col("tag").alias("_tag"), F.col("p").alias("_p"))
    same = (rated["id"].eqNullSafe(drawn["_id"]) & rated["src"].eqNullSafe(drawn["_src"])
            & (rated["size"] == drawn["_size"]) & (rated["tag"] == drawn["_tag"]))
    copies = (F.col("whole") + F.col("_p")).cast("long")
    return rated.join(drawn, same).select("id", "src", "size", "tag", "source_size", "target", copies.alias("copies"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                     **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, columns as they were.

    Rows may share an id, and ids may be null: such rows are told apart by source, size and text. Rows equal in all of these are
    told apart by number; which of them gets which number makes no difference.
    """
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    taken = materialize(_drawn(docs, **names, **options).select(
        F.col("id").alias("_id"), F.col("src").alias("_src"), F.col("size").alias("_size"), F.col("tag").alias("_tag"), "copies"), "taken")
    # The whole row travels as one value, so no column of it can clash.
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.struct("*").alias("row"))
    shared = materialize(taken.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1 or _id is null").select(
        F.col("_id").alias("_shared")), "shared")
    kept = taken.where("copies > 0")
    if shared.isEmpty():
        met = rows.join(kept, rows["id"] == kept["_id"]).select("row", "copies")
    else:
        own = rows["id"].eqNullSafe(shared["_shared"])
        alone = rows.join(shared, own, "left_anti").join(kept, F.col("id") == F.col("_id")).select("row", "copies")
        text = docs[text_col].cast("string")
        told = docs.select(docs[id_col].cast("long").alias("id"), docs[source_col].cast("string").alias("src"), n_words(text).alias("size"),
                           F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha"), F.struct("*").alias("row"))
        # Keyed by id, source and size: only rows that repeat all three share a task, and their order streams through it.
        order = Window.partitionBy("id", "src", "size").orderBy("sha")
        told = told.join(shared, told["id"].eqNullSafe(shared["_shared"]), "left_semi").withColumn("tag", F.row_number().over(order))
        same = (F.col("id").eqNullSafe(F.col("_id")) & F.col("src").eqNullSafe(F.col("_src")) & (F.col("size") == F.col("_size"))
                & (F.col("tag") == F.col("_tag")))
        met = alone.unionByName(told.join(kept, same).select("row", "copies"))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


@register("op2_mix_sources")
def op2_mix_sources(spark, sf_dir):
    """How often the mix of 1 : 2 : 3 weights takes every document."""
    return mix_sources(table(spark, sf_dir, "documents"))
