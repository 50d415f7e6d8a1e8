"""Registration of the text operators."""

import re

import __spark_entry__ as entry


def test_one_query_per_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert {n for n in entry.oracle_sql() if re.match(r"op\d+_", n)} == {"op6_unit_dedup", "op7_license_scan", "op10_exact_dedup",
        "op11_lexical_search", "op12_prefix_trie"}
