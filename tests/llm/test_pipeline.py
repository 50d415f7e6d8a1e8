"""The pipeline on a small table, each stage against a plain reckoning from what the stage before kept."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from arbora.llm.bpe import encoding
from conftest import SMALL
from test_jaccard_join import brute


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    where, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{where}/{i}")
        before, docs = docs, spark.read.parquet(f"{where}/{i}")
        out.append((before, docs))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(steps):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    (first, known), (_, distinct), (_, apart), (_, mixed), (_, encoded) = steps
    for _, after in steps[:-1]:
        assert after.columns == columns
    assert Counter(rows(known)) == Counter((i, t) for i, t in rows(first) if any(c.isalpha() for c in t or ""))
    smallest = {}
    for i, t in sorted(rows(known)):
        smallest.setdefault(t, i)
    assert Counter(rows(distinct)) == Counter((i, t) for t, i in smallest.items())
    component = brute(rows(distinct))
    assert Counter(rows(apart)) == Counter((i, t) for i, t in rows(distinct) if component[i] == i)
    copies = Counter(rows(mixed))
    assert set(copies) <= set(rows(apart)) and max(copies.values()) <= 3
    words, taken = sum(len(t.split()) for _, t in rows(apart)), sum(len(t.split()) * c for (_, t), c in copies.items())
    assert abs(taken - words) <= 0.05 * words
    enc = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter((i, len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows(mixed))
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in encoded.collect()) == want


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
