"""Structured Streaming: content history across runs, micro-batch indexing."""
