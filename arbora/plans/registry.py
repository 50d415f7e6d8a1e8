"""Queries by name, with the SQL each can be checked against; and the SQL pieces they share."""

from __future__ import annotations

import textwrap
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PV = "0.05854983152431917"
LN_2PI = "ln(2 * pi())"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return fn

    return add


def r6(c, name: str | None = None):
    """Six decimals, without negative zero."""
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column, 6) + F.lit(0.0)).alias(name or c)


def sql6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0::DOUBLE AS {name}"


# Vectors in long form, and every vector rounded down to eighths as a query.
E = """
e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings)"""
Q = """
q AS (SELECT vec_id AS qid, label, d, floor(v * 8) / 8.0::DOUBLE AS x FROM e)"""
# The same in list form.
LISTS = """
l AS (SELECT vec_id AS doc_id, label, list(v ORDER BY d) AS vec, list(floor(v * 8) / 8.0::DOUBLE ORDER BY d) AS qvec FROM e GROUP BY vec_id, label)"""
# Topology and statistics of the fixed tree.
TOPO = """
topo AS (
  SELECT DISTINCT t.node_id, t.parent_id, t.depth, t.is_leaf FROM embeddings, LATERAL (VALUES
    (0::BIGINT, NULL::BIGINT, 0, false), (1 + label::BIGINT, 0::BIGINT, 1, false),
    (100000 + 2 * label + vec_id % 2, 1 + label::BIGINT, 2, false),
    (1000000 + vec_id, 100000 + 2 * label + vec_id % 2, 3, true)) t(node_id, parent_id, depth, is_leaf))"""
ND = """
mem AS (
  SELECT vec_id, label, unnest([0::BIGINT, 1 + label::BIGINT, 100000 + 2 * label + vec_id % 2, 1000000 + vec_id]) AS node_id
  FROM embeddings),
nd AS (
  SELECT node_id, d, count(*)::DOUBLE AS n, avg(v) AS mean, var_pop(v) * count(*) AS m2
  FROM mem JOIN e USING (vec_id) GROUP BY node_id, d)"""
NV = f"""
nv AS (SELECT *, m2 / n + {PV} AS var FROM nd)"""
PATHS = """
paths AS (
  SELECT 1000000 + vec_id AS leaf_id, p.depth, p.node_id FROM embeddings, LATERAL (VALUES
    (0, 0::BIGINT), (1, 1 + label::BIGINT), (2, 100000 + 2 * label + vec_id % 2), (3, 1000000 + vec_id)) p(depth, node_id))"""
# Log-likelihood of every query under every node.
def lp(source: str, with_2pi: bool = True) -> str:  # noqa: E302
    constant = f" + {LN_2PI}" if with_2pi else ""
    return f"""
lp AS (
  SELECT s.qid, nv.node_id, -0.5 * sum(ln(nv.var){constant} + (s.x - nv.mean) ** 2 / nv.var) AS lp
  FROM {source} s JOIN nv ON nv.d = s.d GROUP BY s.qid, nv.node_id)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def kl(m1: str, v1: str, m2: str, v2: str) -> str:
    return f"0.5 * (sum(ln({v2})) - sum(ln({v1})) + sum(({v1} + ({m1} - {m2}) ** 2) / {v2}) - count(*))"


def info(v1: str, v2: str) -> str:
    return f"0.5 * (sum(ln({v2})) - sum(ln({v1})))"


def ecg(v1: str, v2: str) -> str:
    return f"sum(1 / (2 * sqrt(pi()) * sqrt({v2}))) - sum(1 / (2 * sqrt(pi()) * sqrt({v1})))"
