"""Parquet packages described by a JSON manifest: readers, writers and field types."""
