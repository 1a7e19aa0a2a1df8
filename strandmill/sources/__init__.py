"""Readers and writers: sequence files, exchange JSON, index folders, result lines."""
