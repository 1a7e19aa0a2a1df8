"""Vectorised kernels and column functions."""
