"""Registry of the engine's queries: name -> Spark query, and name -> DuckDB oracle."""

from __future__ import annotations

from lodestone.plans import analysis_queries, cluster_queries, collection_queries, context_queries, graph_queries, ingest_queries, relation_queries, retrieval_queries, state_queries, structure_queries, text_queries, topic_queries, traversal_queries  # noqa: F401
from lodestone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
