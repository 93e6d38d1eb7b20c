"""Incremental ingest: block-pulled resources and Structured Streaming sinks."""
