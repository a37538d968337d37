"""Structured Streaming forms of ingestion, dialogue and caches."""
