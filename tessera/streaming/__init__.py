"""Structured Streaming forms of the windowed aggregates."""
