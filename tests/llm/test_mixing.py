from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora.llm.mixing import _round_block, fight, mix_sources, repeat_documents, share_targets
from conftest import SMALL, awkward_rows, split_words


def targets(sizes):
    """Shares by repeated cutting, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        each = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if each[s] > 3 * sizes[s]]
        if not over:
            return fixed | each
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_sizes_and_limits(awkward):
    got = mix_sources(awkward).collect()
    rows = awkward_rows()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(split_words(text))
    want = targets(sizes)
    by_id = {r[0]: (r[3], len(split_words(r[1]))) for r in rows if r[0] != 10}
    for r in got:
        if r.doc_id in by_id:
            source, size = by_id[r.doc_id]
            assert (r.size, r.source_size) == (size, sizes[source])
            assert r.target == pytest.approx(want[source])
        assert r.taken == r.copies * r.size <= 3 * r.size


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(got) == 20
    for r in got:
        assert abs(r.taken - r.target) <= 0.02 * r.target


def test_reruns_and_partitionings_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    a = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    b = {r.doc_id: r.copies for r in mix_sources(docs.repartition(3)).collect()}
    assert a == b


def test_expected_copies(spark):
    """Over many seeds a document is taken as often as its probability says, on the average."""
    pdf = pd.DataFrame({"src": "s", "block": 0, "id": range(12), "size": [50, 40, 30, 30, 20, 10, 10, 9, 8, 7, 5, 3], "tag": 1,
                        "p": 0.3, "drift": 0.0})
    sums = np.zeros(12)
    for seed in range(3000):
        out = _round_block(pdf, seed).sort_values("id")
        assert ((out["p"] > 0) & (out["p"] < 1)).sum() <= 1
        sums += out["p"].to_numpy()
    assert np.abs(sums / 3000 - 0.3).max() < 0.04


def test_fight_leaves_one_integral():
    for p, q in ((0.2, 0.5), (0.7, 0.6), (0.5, 0.5)):
        for u in np.linspace(0, 0.999, 50):
            a, b = fight(p, q, u)
            assert a + b == pytest.approx(p + q) and (a in (0, 1) or b in (0, 1))


def test_excess_is_shared_again(spark):
    s = spark.createDataFrame([("a", 10, 1.0), ("b", 1000, 1.0), ("c", 5, 2.0)], "src string, source_size long, weight double")
    got = {r.src: r.target for r in share_targets(s).collect()}
    assert got == {"a": 30.0, "b": 970.0, "c": 15.0}


def test_repeated_documents(awkward):
    unique = awkward.where("doc_id is not null and doc_id not in (10, 12)")
    copies = {r.doc_id: r.copies for r in mix_sources(unique).collect()}
    got = repeat_documents(unique)
    assert got.columns == unique.columns
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == {i: c for i, c in copies.items() if c}


def test_repeated_documents_with_repeated_ids(spark, awkward):
    """Rows that share an id are repeated as often as their own draw says, whatever their texts."""
    rows = awkward.collect()
    wanted = mix_sources(awkward).collect()
    total = sum(r.copies for r in wanted)
    got = repeat_documents(awkward)
    assert got.columns == awkward.columns
    found = Counter((r.doc_id, r.source, r.text) for r in got.collect())
    assert sum(found.values()) == total
    key = lambda i, s, t: (i, s, len(split_words(t)))
    by_key = Counter()
    for (i, s, t), n in found.items():
        by_key[key(i, s, t)] += n
    have, drawn = Counter((r.doc_id, r.source, r.text) for r in rows), Counter()
    sizes = {(r.doc_id, r.source, r.text): len(split_words(r.text)) for r in rows}
    assert set(found) <= set(have) and all(n <= 3 * have[k] for k, n in found.items())
    for r in wanted:
        drawn[r.doc_id, r.size] += r.copies
    seen = Counter()
    for (i, s, t), n in found.items():
        seen[i, sizes[i, s, t]] += n
    assert +seen == +drawn
    two = spark.createDataFrame([(1, "one two three", "a"), (1, "four five six", "a"), (1, "seven", "b"), (None, "x y", "a")],
                                "doc_id long, text string, source string")
    copies = mix_sources(two, weights=[1.0]).collect()
    assert repeat_documents(two, weights=[1.0]).count() == sum(r.copies for r in copies)


def test_empty_table(nothing):
    assert mix_sources(nothing).count() == 0
    assert repeat_documents(nothing).count() == 0
