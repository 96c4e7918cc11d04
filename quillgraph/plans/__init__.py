"""Named queries over the driver tables, each with its SQL twin."""

from quillgraph.plans import augment_queries, code_queries, corpus_queries, graph_queries, quality_queries, scoring_queries, streaming_queries  # noqa: F401
from quillgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
