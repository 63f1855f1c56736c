"""Structured Streaming: the ingest pass and the roll-ups on growing data."""
