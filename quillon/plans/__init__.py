"""Data model: sparse matrices, containers, graphs and spatial layers."""
