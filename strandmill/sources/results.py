"""Result lines as text files or on the console."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame

from strandmill.operators.search import result_lines


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes one tab-separated line for each result, in order, without a header."""
    result_lines(results).write.mode(mode).text(path)


def print_results(results: DataFrame, out: TextIO | None = None) -> None:
    """Prints the same lines, fetched partition by partition."""
    for row in result_lines(results).toLocalIterator():
        print(row["line"], file=out or sys.stdout)
