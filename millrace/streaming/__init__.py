"""Structured Streaming forms of the ingest, dedup and state operators."""
