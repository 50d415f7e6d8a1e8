import zlib

import numpy as np
import pyarrow as pa
import pytest

from arbora.llm import language_id as L
from arbora.llm.common import text_bytes
from conftest import awkward_rows


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return L.fit_language_model(docs.where(L.fold() != 2), steps=250)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    held = [r for r in L.predict_languages(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum(r.lang_pred == rows[r.doc_id].lang for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_gradients():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    w, u, b = (rng.normal(0, 0.5, s).astype(np.float32) for s in ((6, 256), (6, 2), (2, 1)))
    d_out = rng.normal(0, 1, (7, 2, 5)).astype(np.float32)
    grads = {"xW": np.zeros_like(w), "xU": np.zeros_like(u), "xb": np.zeros_like(b)}
    cache = []
    L._states(x, w, u, b, cache)
    L._back_through(x, w, u, grads, cache, d_out, "x")

    def loss():
        return float((L._states(x, w, u, b).astype(float) * d_out).sum())

    for a, g in ((w, grads["xW"]), (u, grads["xU"]), (b, grads["xb"])):
        for i in np.argsort(-np.abs(g), axis=None)[:6]:
            at = np.unravel_index(i, a.shape)
            old = a[at]
            a[at] = old + 1e-2
            up = loss()
            a[at] = old - 1e-2
            down = loss()
            a[at] = old
            assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=2e-3)


def test_pooling_reads_whole_texts(model):
    """A document's probabilities do not depend on its neighbours in the batch, and count each byte once."""
    texts = ["the " * 40_000, "", "und die " * 3, "x", "the end. " * 7 + "und der die das " * 9_000]
    together = L.document_probabilities(model, *text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        alone = L.document_probabilities(model, *text_bytes(pa.array([t])))
        assert np.allclose(together[i], alone[0], atol=1e-4)
    assert together[1].sum() == 0 and np.allclose(together[[0, 2, 3, 4]].sum(1), 1)


def test_undetermined_and_filter(awkward, model):
    got = L.predict_languages(awkward, model).collect()
    assert len(got) == len(awkward_rows())
    letters = {r[0]: any(c.isalpha() for c in r[1] or "") for r in awkward_rows() if r[0] != 10}
    for r in got:
        if r.doc_id in letters:
            assert (r.lang_pred == "und") == (not letters[r.doc_id])
    kept = L.keep_recognised(awkward, model)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} & {1, 2, 3, 11} == set()


def test_without_labels(awkward, nothing):
    from pyspark.sql import functions as F

    model = L.fit_language_model(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert model.labels == []
    assert {r.lang_pred for r in L.predict_languages(awkward, model).collect()} == {"und"}
    assert L.keep_recognised(awkward, model).where("doc_id = 4").count() == 1
    assert L.predict_languages(nothing, L.fit_language_model(nothing)).count() == 0
