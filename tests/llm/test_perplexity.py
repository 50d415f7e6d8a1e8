import math
import re
from collections import Counter, defaultdict
from functools import partial

import pytest

from arbora.llm.perplexity import ORDER, base_counts, fit_kneser_ney, judge_quality, lang_salt, units
from conftest import awkward_rows, split_words

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def plain_units(text):
    t = re.sub(r"[\x20\x09-\x0D]+", " ", (text or "").translate(LOWER))
    return t[1:].encode() if t[:1] == " " else t.encode()


def probability(tables, g):
    if not g:
        return 1 / 256
    c, d, total, gamma = tables[len(g)]
    if not total[g[:-1]]:
        return probability(tables, g[1:])
    first = (c[g] - d[min(c[g], 3)]) / total[g[:-1]] if c[g] else 0
    return first + gamma[g[:-1]] / total[g[:-1]] * probability(tables, g[1:])


def brute_bits(rows):
    """Bits per byte of every text by modified Kneser-Ney with plain dictionaries."""
    models = {}
    for lang in {r[2] for r in rows}:
        counts = {ORDER: Counter()}
        for r in rows:
            if r[2] == lang and r[1] is not None:
                u = bytes(ORDER - 1) + plain_units(r[1])
                counts[ORDER].update(u[i : i + ORDER] for i in range(len(u) - ORDER + 1))
        for k in range(ORDER - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        tables = {}
        for k, c in counts.items():
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            d = {i: max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and y else 0.5 for i in (1, 2, 3)}
            if k >= 3:
                d[1] = 1
            total, gamma = Counter(), defaultdict(float)
            for g, v in c.items():
                total[g[:-1]] += v
                gamma[g[:-1]] += d[min(v, 3)]
            tables[k] = (c, d, total, gamma)

        models[lang] = partial(probability, tables)
    return models


@pytest.fixture(scope="module")
def rows():
    return [r for r in awkward_rows() if len(r[1] or "") < 5000]


def test_perplexity_against_plain_dictionaries(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    models = brute_bits(rows)
    texts = {r[0]: r for r in rows if r[0] != 10}
    for r in judge_quality(docs, bits=32).collect():
        if r.doc_id in texts:
            _, text, lang, _ = texts[r.doc_id]
            u = bytes(ORDER - 1) + plain_units(text)
            logs = [math.log2(models[lang](u[i : i + ORDER])) for i in range(len(u) - ORDER + 1)]
            want = 2 ** (-sum(logs) / len(logs)) if logs else 1.0
            assert r.perplexity == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("head", [None, 0, 300])
def test_production_bits_and_the_join_beyond_the_head(spark, rows, head):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    models, texts = brute_bits(rows), {r[0]: r for r in rows if r[0] != 10}
    got = judge_quality(docs, **({} if head is None else {"head": head})).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in texts:
            _, text, lang, _ = texts[r.doc_id]
            u = bytes(ORDER - 1) + plain_units(text)
            logs = [math.log2(models[lang](u[i : i + ORDER])) for i in range(len(u) - ORDER + 1)]
            assert r.perplexity == pytest.approx(2 ** (-sum(logs) / len(logs)) if logs else 1.0, rel=1e-4)


def test_a_full_table_gives_no_false_hits(spark):
    import numpy as np

    from arbora.llm.perplexity import _find, cut_hash

    text = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 400_000)))
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en")], "doc_id long, text string, lang string")
    model = fit_kneser_ney(docs)
    noise = np.random.default_rng(6).integers(0, 1 << 40, 200_000).astype(np.uint64) | np.uint64(0x8080808080)
    seen, _ = _find(model.prob[ORDER], cut_hash(np.full(len(noise), lang_salt("en"), np.uint64), noise, model.bits))
    assert len(model.prob[ORDER][0]) > 380_000 and seen.mean() < 1e-4


def test_unseen_text_backs_off(spark, rows):
    import numpy as np
    import pyarrow as pa

    from arbora.llm.common import text_bytes

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model, p = fit_kneser_ney(docs, bits=32), brute_bits(rows)["en"]
    text = "Zebra quux, never seen: éß 日本\n\tabcd"
    code, size = units(*text_bytes(pa.array([text])))
    got = model.log_probs(code, np.full(len(code), lang_salt("en"), np.uint64))
    u = bytes(ORDER - 1) + plain_units(text)
    want = [math.log(p(u[i : i + ORDER])) for i in range(len(u) - ORDER + 1)]
    assert size[0] == len(want) and got == pytest.approx(want, rel=1e-4)


def brute_base(text):
    w = split_words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if split_words(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit))


def test_base_counts(documents):
    for t in [*documents.text, *[r[1] or "" for r in awkward_rows()], "a a a a", "a\na\n \n \nA", "x#*$%&|<>é"]:
        assert base_counts(t) == brute_base(t)


def test_verdicts(awkward, nothing):
    got = judge_quality(awkward).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert r.kept == (not r.base_failed and r.low <= r.perplexity <= r.high)
    assert judge_quality(nothing).count() == 0


def test_band_rejects_noise(spark):
    import random

    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)), "en") for i in range(300)]
    noise = "".join(rng.choice("qwxyz01289") + " " * (rng.random() < 0.2) for _ in range(900))
    rows += [(1000, noise, "en")] + [(2000, " ".join(words[i] for i in range(120)), "en")]
    got = {r.doc_id: r for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[1000].kept and got[1000].perplexity > got[1000].high
    assert sum(got[i].kept for i in range(300)) == 300


def test_each_ngram_of_a_piece_is_looked_up_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from arbora.llm import perplexity

    texts, langs = ["the same words again " * 500, "the same words again " * 300, None, "ab"], ["en", "de", "en", None]
    grams = [units(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for t in texts]
    keys = {(x, int(g)): -1.0 - i % 7 for x, gs in zip(langs, grams) for i, g in enumerate(sorted(set(gs.tolist())))}
    rare = ("en", int(grams[0][-1]))
    head = {k: v for k, v in keys.items() if k != rare}
    slots = np.concatenate([perplexity.cut_hash(np.array([lang_salt(x)], np.uint64), np.array([g], np.uint64), 64) for x, g in head])
    order, asked, find = np.argsort(slots), [], perplexity._find
    monkeypatch.setattr(perplexity, "_find", lambda arrays, k: asked.append(len(k)) or find(arrays, k))
    known = type("Head", (), {"value": (slots[order], np.array(list(head.values()), np.float32)[order])})
    batch = pa.record_batch([pa.array(range(4), pa.int64()), pa.array(texts), pa.array(langs)], names=["id", "text", "lang"])
    out = [r for b in perplexity._score(known, 64)[0](iter([batch])) for r in b.to_pylist()]
    assert [r["ln"] for r in out] == [sum(head.get((x, int(g)), 0.0) for g in gs) for x, gs in zip(langs, grams)]
    assert [r["rest"] for r in out] == [[int(g) for g in gs if (x, int(g)) == rare] for x, gs in zip(langs, grams)]
    assert sum(asked) == len(keys)
