"""Structured Streaming: incremental re-indexing."""
