"""Streaming ingest, beyond what the batch plans need."""
