"""Lodestone: a Spark-first engine for document ingestion, retrieval and analytics."""
