"""Sketching, indexing, searching and comparing as DataFrame operations."""
