"""Whole pipelines: ingestion, analysis and the registered queries."""
