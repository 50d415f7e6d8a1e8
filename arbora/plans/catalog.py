"""All registered queries."""

from arbora.plans import concept_queries, eval_queries, source_queries, tree_queries, vector_queries  # noqa: F401
from arbora.plans.registry import ORACLES, QUERIES  # noqa: F401
