"""Screens a stream of records against an index, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from strandmill.operators.search import search
from strandmill.operators.sketch import sketch
from strandmill.types import Sketches


def screen(records: DataFrame, index: Sketches, sink: Callable[[DataFrame, int], None], cutoff: float = 0.0) -> DataStreamWriter:
    """A writer that sketches each batch's records one by one, as the index was made, searches it and hands on the results."""

    def batch(rows: DataFrame, number: int) -> None:
        query = sketch(rows, index.k, index.fscale, algorithm=index.algorithm, singleton=True)
        sink(search(index, query, cutoff), number)

    return records.writeStream.foreachBatch(batch)
