import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from arbora.llm.prefix_trie import prefix_trie, range_min, reach_left, reach_right, sparse_table
from conftest import EXTRA

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    for turns in own.values():
        turns.sort()
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        whole[c] = [t[3:] for t in own.get(base, [])[:h]] + [t[3:] for t in own[c][h:]]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        bytes_ = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * bytes_ + sum(saved[k] for k in kids[node])
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
    out = []
    for node, own_ in members.items():
        ends = ",".join(str(c) for c in sorted(own_) if len(whole[c]) == len(node))
        out.append((min(own_), len(node), min(members[node[:-1]]) if node else None, len(own_), len(kids[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted((tuple(r) for r in prefix_trie(frame, **options).collect()), key=str)


def test_searches_in_sparse_tables():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 64, 100):
        values = rng.integers(0, 5, n)
        minima = sparse_table(values)
        at, depth = np.repeat(np.arange(n), 6), np.tile(np.arange(6), n)
        right, left = reach_right(minima, at, depth), reach_left(minima, at, depth)
        for i, d, r, l in zip(at, depth, right, left):
            end, begin = i, i
            while end + 1 < n and values[end + 1] >= d:
                end += 1
            while begin > 0 and values[begin] >= d:
                begin -= 1
            assert (end, begin) == (r, l)
        assert (range_min(minima, left, right) == [values[a:b + 1].min() for a, b in zip(left, right)]).all()


def conversations(seed, n, texts, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-n, 4 * n), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn else "user", rng.choice(texts)))
    return rows


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_random_conversations(spark, partitions):
    rows = conversations(1, 150, ["a", "bb", "é", ""], 12) + [(900 + i, t, "user", "hot") for i in range(120) for t in range(12)]
    rows += [(c, 0, "user", "hot") for c in range(2000, 2030)]
    assert trie(spark, rows, partitions=partitions) == brute_force(rows)


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "user", "a"), (None, 1, "user", "no id"),
            (2, 3, "ab", "c"), (2, 4, "a", "bc"), (7, None, "", ""), (-3, 1, "user", "x" * 300_000), (5, 0, None, "only"),
            (-8, None, "user", None), (12, 5, "user", "late"), (12, -5, "user", "early")]
    rows += [(40, t, "user", f"turn {t}") for t in range(700)] + [(41, t, "user", f"turn {t}") for t in range(500)]
    rows += [(40 + i, t, "user", "same") for i in (5, 10, 15, 20) for t in range(9)]
    assert trie(spark, rows) == trie(spark, rows, partitions=40) == brute_force(rows)
    assert trie(spark, []) == trie(spark, [(None, 1, "user", "x")]) == []


def test_names_that_clash(spark):
    from pyspark.sql import functions as F

    rows = conversations(5, 40, ["a", "b"], 5)
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[
        F.lit("7").alias(c) for c in {*EXTRA, "at", "digest", "seq", "part", "depth"}])
    assert sorted((tuple(r) for r in prefix_trie(frame).collect()), key=str) == brute_force(rows)
