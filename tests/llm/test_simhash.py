import random

import numpy as np

from arbora.llm.simhash import (
    CHECKS, RADIUS, _columns, anchor_steps, fingerprint_links, fingerprint_text, fingerprints, simhash_components,
    syndromes)
from conftest import awkward_rows


def components(prints, distance):
    """Smallest reachable index of each fingerprint, by comparing all with all."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= distance):
            a, b = sorted((root(i), root(i + 1 + int(j))))
            parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_the_code_covers():
    start, count, steps = anchor_steps(2)
    assert len(_columns()) == 32 and len(start) == 1 << CHECKS
    weights = np.bitwise_count(steps)
    assert count.min() > 0 and weights[start].max() == RADIUS
    values = np.random.default_rng(1).integers(0, 1 << 32, 500)
    own = syndromes(values)
    for v, s in zip(values, own):
        anchors = v ^ steps[start[s]:start[s] + count[s]]
        assert not syndromes(anchors).any() and len(set(anchors.tolist())) == count[s]
        assert np.bitwise_count(anchors ^ v).max() <= RADIUS + 2
    # Nothing nearer is left out: all values within 2 of an anchor's home meet it.
    for v in values[:50]:
        s = syndromes(np.array([v]))[0]
        home, r = v ^ steps[start[s]], np.bitwise_count(steps[start[s]])
        for a in range(32):
            for b in range(a, 32):
                y = v ^ (1 << a) ^ (1 << b if b != a else 0)
                t = syndromes(np.array([y]))[0]
                if np.bitwise_count(steps[start[t]]) >= r:
                    assert home in (y ^ steps[start[t]:start[t] + count[t]])


def test_fingerprints():
    texts = [r[1] for r in awkward_rows()] + ["a B c d e"] * 3 + ["x y z", " ".join(["w"] * 700)]
    got = fingerprints(texts)
    for text, fp in zip(texts, got.tolist()):
        if len(text or "") < 50_000:
            assert fp == fingerprint_text(text)
    assert fingerprint_text(None) == fingerprint_text(" \n") == 0


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(300):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(rng.randint(0, 4)):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                base ^= 1 << bit
            prints.add(base)
    # A dense group, far more than a share of one anchor.
    centre = rng.getrandbits(64)
    for _ in range(400):
        x = centre
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            x ^= 1 << bit
        prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    want = components(prints, 4)
    place = {p: i for i, p in enumerate(prints)}
    for share in (1 << 15, 40):
        parent = list(range(len(prints)))
        pairs = [(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64)))
                 for r in fingerprint_links(frame, share=share).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(parent[place[a]], parent[place[b]])
                changed |= parent[place[a]] != low or parent[place[b]] != low
                parent[place[a]] = parent[place[b]] = low
        assert parent == want


def check(docs, got):
    rows = [(r[0], r[1]) for r in docs]
    prints = [fingerprint_text(t) if len(t or "") < 50_000 else int(fingerprints([t])[0]) for _, t in rows]
    roots = components(prints, 4)
    low = {}
    for (i, _), root in zip(rows, roots):
        if i is not None:
            low[root] = min(i, low.get(root, i))
    want = sorted((str(i), f"{p:016x}", str(low.get(root))) for (i, _), p, root in zip(rows, prints, roots))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_awkward_rows(awkward, nothing):
    check(awkward_rows(), simhash_components(awkward).collect())
    assert simhash_components(nothing).count() == 0


def test_documents(spark, documents):
    rows = [(int(r.doc_id), r.text) for r in documents.itertuples()]
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)
    assert any(r.component_id != r.doc_id for r in got)
