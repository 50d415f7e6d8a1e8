import hashlib
from collections import defaultdict

import pytest

from arbora.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from conftest import awkward_rows

ROWS = [(r[0], r[1]) for r in awkward_rows()]


def brute(keep):
    groups = defaultdict(list)
    for i, text in ROWS:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(i)
    pick = min if keep == "smallest" else max
    return {sha: (pick((i for i in ids if i is not None), default=None), len(ids)) for sha, ids in groups.items()}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_groups_against_brute_force(awkward, keep, partitions):
    want = brute(keep)
    got = exact_dedup(awkward, keep=keep, partitions=partitions).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(want)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_normalised_texts(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs, normalise=F.lower).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


def test_filter_keeps_columns_and_one_row_each(awkward):
    got = drop_exact_duplicates(awkward)
    assert got.columns == awkward.columns
    assert sorted((r.text or "") for r in got.select("text").collect()) == sorted({t or "" for _, t in ROWS})


def test_empty_table(nothing):
    assert exact_dedup(nothing).count() == 0
    assert drop_exact_duplicates(nothing).columns == nothing.columns
