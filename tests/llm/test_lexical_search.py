import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from arbora.llm import lexical_search as ls
from conftest import awkward_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
ITEMS = [(1, "One two THREE four"), (2, None), (3, " .,!"), (4, "nowhere-to-be-found"), (5, "same row same row é É"),
         (6, awkward_rows()[6][1][:3000]), (7, awkward_rows()[20][1]), (7, "1234 the same id again, one"), (None, "end one")]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, top=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        rows = []
        asked = Counter(terms(text))
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def ask(spark, docs, items, **options):
    frame = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ls.search(ls.build_index(docs), frame, **options).collect()), key=str)


def test_awkward_rows(spark, awkward, nothing):
    want = brute_force([(r[0], r[1]) for r in awkward_rows()], ITEMS)
    assert len(want) > 50 and ask(spark, awkward, ITEMS) == want
    assert ask(spark, nothing, ITEMS) == []
    assert ask(spark, awkward, []) == ask(spark, awkward, [(1, None)]) == []


def test_documents(spark, documents):
    rows = [(int(r.doc_id), r.text) for r in documents.itertuples()]
    items = [(i, " ".join((t or "").split()[3:40])) for i, t in rows[:60]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ask(spark, docs, items, top=7) == brute_force(rows, items, 7)


def test_blocks_of_items_and_small_blocks(spark, documents, monkeypatch):
    rows = [(int(r.doc_id), r.text) for r in documents.itertuples()][:80]
    items = [(i, (t or "")[:200]) for i, t in rows[:9]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(ls, "ITEMS", 4)
    assert ask(spark, docs, items, top=5) == brute_force(rows, items, 5)


def test_bounds_hold_and_prune(documents):
    texts = documents.text.tolist()
    blocks = [b.to_pylist()[0] for b in ls._index([pa.record_batch(
        [pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])])]
    blocks = [b for b in blocks if b["kind"] != "terms"]
    counts = {i: Counter(ls.term_counts(pa.array([t]))[2].tolist()) for i, t in enumerate(texts[:5])}
    wanted = np.unique(np.concatenate([np.array(list(c), np.uint64) for c in counts.values()]))
    q = ls._Queries(np.ones(len(wanted)), wanted, [], 1000, 100_000)
    false, cells = 0, 0
    for b in blocks:
        sizes = np.array(b["sizes"], np.int64)
        m = 75 + 25 * sizes * q.n // q.total
        slices = np.frombuffer(b["slices"], np.uint8).reshape(1 << b["bits"], -1)
        bounds = ls._bounds(q, slices, b["bits"], sizes, m)
        ends = np.append(0, np.frombuffer(b["ends"], np.int64))
        for d in range(len(sizes)):
            have = np.frombuffer(b["terms"], np.uint64)[ends[d]:ends[d + 1]]
            tf = dict(zip(have.tolist(), np.frombuffer(b["counts"], np.int64)[ends[d]:ends[d + 1]].tolist()))
            exact = np.array([ls._saturated(tf.get(t, 0), m[d]) for t in wanted.tolist()])
            assert (bounds[:, d] >= exact).all()
            false += int(((bounds[:, d] > 0) & (exact == 0)).sum())
            cells += int((exact == 0).sum())
    assert false < 0.02 * cells


def test_bounds_of_few_documents_are_held_at_a_time(monkeypatch):
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from arbora.llm import lexical_search as ls

    texts = [" ".join(f"w{(i * j) % 37}" for j in range(1, 6)) for i in range(300)]
    batch = pa.record_batch([pa.array(range(300), pa.int64()), pa.array(texts)], names=["id", "text"])
    blocks = [b for b in ls._index(iter([batch])) if b.column("kind")[0].as_py() != "terms"]
    _, _, terms, _ = ls.term_counts(pa.array([" ".join(f"w{i}" for i in range(37))]))
    terms = np.sort(terms)
    items = [(np.arange(k, 37, 3), np.arange(1.0, 38.0)[k::3]) for k in range(3)]
    shared = SimpleNamespace(value=ls._Queries(np.ones(37), terms, items, 300, 1500))
    whole, seen = ls._bounds, []

    def bounds(q, slices, bits, sizes, m):
        seen.append(len(q.terms) * len(sizes))
        return whole(q, slices, bits, sizes, m)

    def answers():
        run, _ = ls._search(shared, np.zeros(3, np.int64), 20)
        return [b.to_pydict() for b in run(iter(blocks))]

    monkeypatch.setattr(ls, "_bounds", bounds)
    want = answers()
    monkeypatch.setattr(ls, "BOUNDS", 37 * 16)
    seen.clear()
    assert answers() == want
    assert max(seen) <= 37 * 16 and len(seen) > 300 // 16


def test_blocks_reach_a_worker_one_at_a_time(spark, awkward, monkeypatch):
    """Blocks are some MB each, so a batch holds one; the caller's session keeps its settings."""
    made, batch_rows = ls._search, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def watched_search(*args):
        run, schema = made(*args)

        def watched(batches):
            def each():
                for batch in batches:
                    assert batch.num_rows <= 1
                    yield batch

            yield from run(each())

        return watched, schema

    monkeypatch.setattr(ls, "_search", watched_search)
    assert ask(spark, awkward.coalesce(1), ITEMS) == brute_force([(r[0], r[1]) for r in awkward_rows()], ITEMS)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch_rows
