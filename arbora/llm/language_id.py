"""Language identification by a bidirectional gated recurrent network over bytes, written in numpy.

Every byte position gets a distribution over the languages from a forward and a backward state; a document's is the
mean over all positions of its whole text that lie on letters. Texts are read in windows of a fixed number of
bytes that overlap by a margin on both sides: a state needs a few dozen bytes to settle, and positions in the
margin only warm it up, so each position is counted once and a text of any length takes constant memory. Training is
backpropagation through time with Adam on a bounded, hash-chosen sample of windows of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import narrow, pieces, register, table, text_bytes

HIDDEN = 8
#: Bytes of a training window; bytes of a window at inference, of which the margins at both ends are not counted.
WINDOW = 96
SPAN = 224
MARGIN = 16
#: The sample that training may see: at most about so many documents of each language, so many windows of each.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 4
STEPS = 500
BATCH = 192
#: Windows that inference works on at once; states of 8 × 2048 stay in the processor's cache.
LANES = 2048


@dataclass
class Model:
    """Two directions of gates over bytes (3h × 256 inputs, 3h × h states, h bias) and a linear read-out."""

    labels: list[str]
    p: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.p["fU"].shape[1]


def _states(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, cache: list | None = None) -> np.ndarray:
    """Hidden states (t, h, n) of bytes x (t, n). Gates: 0 update, 1 reset, 2 candidate (reset after the product).

    A sigmoid is (1 + tanh(a / 2)) / 2.
    """
    steps, lanes = x.shape
    h = u.shape[1]
    out = np.empty((steps, h, lanes), np.float32)
    state = np.zeros((h, lanes), np.float32)
    gates = np.empty((3 * h, lanes), np.float32)
    product = np.empty((3 * h, lanes), np.float32)
    for t in range(steps):
        np.take(w, x[t], axis=1, out=gates, mode="clip")
        np.matmul(u, state, out=product)
        zr = gates[: 2 * h]
        zr += product[: 2 * h]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        inner = product[2 * h :]
        inner += b
        new = gates[2 * h :]
        new += zr[h:] * inner
        np.tanh(new, out=new)
        if cache is not None:
            cache.append((state, zr[:h].copy(), zr[h:].copy(), new.copy(), inner.copy()))
        state = new + zr[:h] * (state - new)
        out[t] = state
    return out


def _softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    logits = np.exp(logits - logits.max(axis=axis, keepdims=True))
    return logits / logits.sum(axis=axis, keepdims=True)


def label_positions(model: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities (t, labels, n) of every position of bytes x (t, n)."""
    p = model.p
    ahead = _states(x, p["fW"], p["fU"], p["fb"])
    back = _states(x[::-1], p["bW"], p["bU"], p["bb"])[::-1]
    logits = np.matmul(p["fV"], ahead)
    logits += np.matmul(p["bV"], back)
    logits += p["c"]
    return _softmax(logits, 1)


def _back_through(x, w, u, grads, cache, d_out, tag):
    """Gradients of one direction, from d_out (t, h, n), into ``grads``."""
    h = u.shape[1]
    d_state = np.zeros_like(d_out[0])
    gw = np.zeros((w.shape[1], 3 * h), np.float32)
    gu, gb = grads[tag + "U"], grads[tag + "b"]
    for t in range(len(x) - 1, -1, -1):
        state, z, r, new, inner = cache[t]
        d = d_state + d_out[t]
        d_z = d * (state - new) * z * (1 - z)
        d_new = d * (1 - z) * (1 - new * new)
        d_r = d_new * inner * r * (1 - r)
        d_gates = np.concatenate([d_z, d_r, d_new])
        d_product = np.concatenate([d_z, d_r, d_new * r])
        np.add.at(gw, x[t], d_gates.T)
        gu += d_product @ state.T
        gb += (d_new * r).sum(1, keepdims=True)
        d_state = d * z + u.T @ d_product
    grads[tag + "W"] += gw.T


def train(windows: np.ndarray, lengths: np.ndarray, target: np.ndarray, labels: list[str], hidden: int = HIDDEN,
          steps: int = STEPS, batch: int = BATCH, seed: int = 5) -> Model:
    """Fit on windows (n, t) of bytes with ``lengths`` and label numbers; every position counts."""
    rng = np.random.default_rng(seed)
    k, h = len(labels), hidden
    shape = {"W": (3 * h, 256), "U": (3 * h, h), "b": (h, 1), "V": (k, h)}
    p = {d + n: rng.normal(0, {"W": 0.4, "U": h**-0.5, "b": 0.0, "V": 0.4}[n], s).astype(np.float32)
         for d in "fb" for n, s in shape.items()}
    p["c"] = np.zeros((k, 1), np.float32)
    first, second = ({n: np.zeros_like(a) for n, a in p.items()} for _ in range(2))
    model = Model(labels, p)
    if k < 2 or not len(windows):
        return model
    by_label = [np.flatnonzero(target == i) for i in range(k)]
    by_label = [(i, rows) for i, rows in enumerate(by_label) if len(rows)]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(rows, batch // len(by_label) + 1) for _, rows in by_label])
        x = np.ascontiguousarray(windows[rows].T)
        counted = np.arange(x.shape[0])[:, None] < lengths[rows][None, :]
        grads = {n: np.zeros_like(a) for n, a in p.items()}
        kept_f: list = []
        kept_b: list = []
        ahead = _states(x, p["fW"], p["fU"], p["fb"], kept_f)
        back = _states(x[::-1], p["bW"], p["bU"], p["bb"], kept_b)[::-1]
        d = _softmax(np.matmul(p["fV"], ahead) + np.matmul(p["bV"], back) + p["c"], 1)
        d[:, target[rows], np.arange(len(rows))] -= 1
        d *= counted[:, None, :] / max(1, counted.sum())
        d = d.astype(np.float32)
        grads["fV"] = np.einsum("tkn,thn->kh", d, ahead, optimize=True)
        grads["bV"] = np.einsum("tkn,thn->kh", d, back, optimize=True)
        grads["c"] = d.sum((0, 2))[:, None]
        _back_through(x, p["fW"], p["fU"], grads, kept_f, np.matmul(p["fV"].T, d), "f")
        _back_through(x[::-1], p["bW"], p["bU"], grads, kept_b, np.matmul(p["bV"].T, d)[::-1], "b")
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.03 * min(1.0, step / 20) * (0.1 ** (step / steps)) * (1 - 0.9**step) ** -1
        for n, g in grads.items():
            g = g * min(1.0, 1.0 / (size + 1e-9))
            first[n] += 0.1 * (g - first[n])
            second[n] += 0.01 * (g * g - second[n])
            p[n] -= (rate * first[n] / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to SAMPLE_WINDOWS windows of each text, spread evenly over it."""
    for batch in batches:
        langs, windows = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            raw = text.encode()
            n = min(SAMPLE_WINDOWS, max(1, len(raw) // WINDOW))
            for i in range(n):
                start = (len(raw) - WINDOW) * (2 * i + 1) // (2 * n) if len(raw) > WINDOW else 0
                langs.append(lang)
                windows.append(raw[start : start + WINDOW])
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "win"])


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                       sample_docs: int = SAMPLE_DOCS, **options) -> Model:
    """Train on about ``sample_docs`` documents of each label, chosen by a hash of the id.

    Rows without label or without a letter teach nothing. Without any label the model has none and predicts nothing;
    with one it always predicts that one.
    """
    rows = narrow(docs, id=docs[id_col].cast("string"), text=docs[text_col].cast("string"),
                  lang=docs[lang_col].cast("string")).where("lang is not null and text rlike '\\\\p{L}'")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = sorted(found)
    if not labels:
        return Model([], {})
    share = F.create_map(*[F.lit(v) for lang in labels for v in (lang, min(1.0, sample_docs / found[lang]))])
    place = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(place < share[F.col("lang")]).select("lang", "text").mapInArrow(
        _sample_windows, "lang string, win binary")
    sample = chosen.toArrow().sort_by([("lang", "ascending"), ("win", "ascending")])
    raw = sample["win"].to_pylist()
    windows = np.zeros((len(raw), WINDOW), np.uint8)
    for i, w in enumerate(raw):
        windows[i, : len(w)] = np.frombuffer(w, np.uint8)
    number = {lang: i for i, lang in enumerate(labels)}
    target = np.array([number[x] for x in sample["lang"].to_pylist()], np.int64)
    return train(windows, np.array([len(w) for w in raw], np.int64), target, labels, **options)


_LETTER = np.array([chr(b).isalpha() for b in range(128)] + [True] * 128)


def document_probabilities(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean position probabilities (n texts, labels) over the letters of each whole text; bytes ≥ 128 count as such."""
    n, k = len(offsets) - 1, len(model.labels)
    sums = np.zeros((n, k))
    core = SPAN - 2 * MARGIN
    count = -(-(offsets[1:] - offsets[:-1]) // core)
    doc = np.repeat(np.arange(n), count)
    start = offsets[doc] + core * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    reach = np.arange(-MARGIN, SPAN - MARGIN)[:, None]
    for at in range(0, len(doc), LANES):
        d, s = doc[at : at + LANES], start[at : at + LANES]
        place = s[None, :] + reach
        inside = (place >= offsets[d]) & (place < offsets[d + 1])
        x = np.where(inside, raw[np.clip(place, 0, len(raw) - 1)], 0)
        counted = inside & _LETTER[x]
        counted[:MARGIN] = counted[SPAN - MARGIN :] = False
        shares = label_positions(model, x)
        np.add.at(sums, d, np.einsum("tkn,tn->nk", shares, counted.astype(np.float32), optimize=True))
    total = sums.sum(1, keepdims=True)
    return np.divide(sums, total, out=np.zeros_like(sums), where=total > 0)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def judge(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best label (as many as there are labels if none applies) and its probability, for each text."""
    letters = has_letter(texts)
    best, score = np.full(len(texts), len(model.labels)), np.zeros(len(texts))
    if model.labels and letters.any():
        shares = document_probabilities(model, *text_bytes(texts))
        best = np.where(letters, shares.argmax(1), best)
        score = np.where(letters, np.minimum(shares.max(1), 1.0), 0.0)
    return best, score


def predict_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (probability of that language; 0 for ``und``).

    ``und`` if the text is null or has no letter, or if the model has no label. Repeated rows give repeated results,
    an empty table none; other columns are not read. The model (a few kB) travels with the tasks.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    labels = np.array([*model.labels, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                best, score = judge(model, piece.column("text"))
                yield pa.record_batch([piece.column("id"), pa.array(labels[best], pa.string()), pa.array(score)],
                                      schema=schema)

    rows = narrow(docs, id=docs[id_col].cast("long"), text=docs[text_col].cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_recognised(docs: DataFrame, model: Model, min_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without rows that are ``und`` or whose best language has less than ``min_score``; columns as they were.

    With a model without labels all rows with a letter stay. Rows stay where they are: each is judged in the task that reads it, with all its columns at hand.
    """
    schema, columns = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = columns.index(text_col)
            texts = batch.column(at).cast(pa.string())
            keep = [np.zeros(0, bool)]
            for piece in pieces(pa.record_batch([texts], names=["text"])):
                best, score = judge(model, piece.column("text"))
                known = (best < len(model.labels)) & (score >= min_score)
                keep.append(known if model.labels else has_letter(piece.column("text")))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, schema)


def fold(id_col: str = "doc_id"):
    """Remainder of the CRC of the id as text; documents with remainder 2 are held out of training."""
    return F.crc32(F.col(id_col).cast("string")) % 4


@register("op8_language_id")
def op8_language_id(spark, sf_dir):
    """Predicted language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(fold() != 2))
    return predict_languages(docs, model).select(
        "doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
