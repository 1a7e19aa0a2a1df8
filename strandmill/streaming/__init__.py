"""Micro-batch screening."""
