import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from arbora.llm.components import connected_components
from arbora.llm.jaccard_join import CountTree, admitted, jaccard_components, keep_one_of_each
from arbora.llm.shingles import shingle_sets
from conftest import SMALL, awkward_rows, split_words

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def sets_of(rows):
    out = []
    for i, text in rows:
        w = split_words((text or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute(rows):
    """component of every row: all pairs with a common shingle are compared."""
    sets = [(i, s) for i, s in sets_of(rows) if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, common = defaultdict(list), Counter()
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for ks in holders.values():
        common.update((a, b) for n, b in enumerate(ks) for a in ks[:n])
    for (a, b), both in common.items():
        if 100 * both >= 75 * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = root(sets[a][0]), root(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def check(docs, rows, **options):
    got = jaccard_components(docs, **options).collect()
    want, sizes = brute(rows), Counter((i, len(s)) for i, s in sets_of(rows))
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    wrong = [(r, want[r.doc_id]) for r in got if r.doc_id is not None and r.component_id != want[r.doc_id]]
    assert not wrong


def test_awkward_rows(awkward):
    check(awkward, [(r[0], r[1]) for r in awkward_rows()])


def test_given_documents(spark, documents):
    check(spark.read.parquet(f"{SMALL}/documents.parquet"), list(zip(documents.doc_id, documents.text)))


@pytest.mark.parametrize("chunk", [5, 20_000])
def test_chains_and_common_passages(spark, chunk):
    """Chains whose ends do not link, unrelated texts around one passage, boundary similarities, short texts."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    texts = []
    for _ in range(12):  # each step changes a few words; the ends of a chain are far apart
        t = prose(rng.randint(20, 120))
        for _ in range(12):
            texts.append(" ".join(t))
            t = list(t)
            t[rng.randrange(len(t))] = rng.choice(words)
    passage = prose(60)
    texts += [" ".join(prose(rng.randint(0, 30)) + passage + prose(rng.randint(0, 30))) for _ in range(150)]
    texts += [" ".join(prose(n)) for n in (1, 2, 3, 4, 5, 6)] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, chunk=chunk, sketch_bits=8)


def test_tree_gives_what_a_scan_gives():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(0, 6, (300, 64)), np.repeat(rng.integers(0, 6, (5, 64)), 40, 0)]).astype("u4")
    points[300:, :3] += rng.integers(0, 2, (200, 3)).astype("u4")
    n = points.sum(1).astype(np.int64)
    order = np.argsort(n)
    points, n = points[order], n[order]
    comp = np.where(rng.random(500) < 0.3, 7, np.arange(500) + 100)
    tree = CountTree(points, n, comp)
    got = {(int(a), int(b)) for i, j in tree.pairs(75, 100) for a, b in zip(i, j)}
    want = {(a, b) for a in range(500) for b in range(a + 1, 500) if comp[a] != comp[b]
            and 100 * n[a] >= 75 * n[b] and admitted(int(np.minimum(points[a], points[b]).sum()), int(n[a] + n[b]), 75, 100)}
    assert want and got == want


def test_shingles_of_many_texts_at_once():
    texts = ["A b c d e f", "a B c d e f", "a b c", "", " \n", "é" * 50 + " x y z w v", "word" * 5000]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    sets = shingle_sets(raw, offsets)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 0, 2, 1]
    assert (sets[0] == sets[1]).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 10 != 9] + [(100, 0), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: i - i % 10 for i in range(50)}, 100: 0}


def test_filter_and_empty_table(awkward, nothing):
    got = keep_one_of_each(awkward)
    assert got.columns == awkward.columns
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert 20 in ids and not ids & set(range(21, 80)) and not ids & set(range(200, 230)) and 300 in ids
    assert jaccard_components(nothing).count() == 0


def test_the_driver_holds_two_bytes_a_counter():
    import tracemalloc

    from arbora.llm import jaccard_join as jj

    bits, chunk = 20, 100
    counts = np.random.default_rng(0).poisson(3, 1 << bits)
    counts[::5000] = 70_000
    counts[jj.SLICE:2 * jj.SLICE] = 0
    batches = [jj._slice_batch(a, 0, counts[a:a + jj.SLICE]) for a in range(0, 1 << bits, jj.SLICE) if counts[a:a + jj.SLICE].any()]
    slices = [(r["at"], r["counts"]) for b in batches for r in b.to_pylist()]
    tracemalloc.start()
    shares = jj.shares_of_parts(slices, bits, chunk)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    usual = counts.mean() + 6 * counts.mean() ** 0.5 + 32
    assert (shares == np.where(counts > usual, -(-counts // chunk), 0)).all()
    assert peak < (2 << bits) + 40 * jj.SLICE
