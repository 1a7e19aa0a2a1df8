"""Sequence sketching and containment search on Spark."""
