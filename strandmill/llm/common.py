"""Reading, row keys and connected components for the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandmill.lineage import cut, spread


#: Short rows that may be broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def shield(df: DataFrame, used: Sequence[str], added: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """Renames all columns but `used` by their place, so that no name of theirs can meet one that an operator makes up.

    Columns named like the `added` ones go.  The second result selects the others again under their own names.
    """
    gone, wanted = {c.lower() for c in added}, {c.lower(): c for c in used}
    names = [wanted.get(c.lower(), f"__x{i}") for i, c in enumerate(df.columns)]
    stay = [(n, c) for n, c in zip(names, df.columns, strict=True) if c.lower() not in gone]
    return df.toDF(*names).select(*[n for n, _ in stay]), [F.col(n).alias(c) for n, c in stay]


def row_key(*columns: str) -> list[Column]:
    """Two independent 64-bit hashes of the columns; never null, equal for equal rows."""
    names = [F.col(c) for c in columns]
    return [F.xxhash64(*names).alias("__key_a"), F.xxhash64(F.lit(7), *names, F.lit(11)).alias("__key_b")]


def narrow(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins rows to `small` (a few numbers a row), which is broadcast only if a count shows that it is small enough."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star steps.

    Returns (id, component) for every endpoint, with the smallest reachable id as the component.
    Each step is a grouped minimum joined back, so a hub of any degree stays splittable.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut(small.union(lowest).distinct())
        found = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    roots = pairs.select(F.col("b").alias("a")).distinct()
    return pairs.union(roots.select("a", F.col("a").alias("b"))).toDF("id", "component").distinct()


def tidy(run: Callable[[Iterator], Iterator], after: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """Runs `after` and gives freed memory back when a task is done: Python workers wait for later tasks, of other steps too."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if after is not None:
                after()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def extend(
    df: DataFrame,
    function: Callable[..., Sequence],
    inputs: list[str],
    added: str,
    drop: Sequence[str] = (),
    rows: int = 0,
    after: Callable[[], None] | None = None,
) -> DataFrame:
    """Adds columns that a Python function computes from the Arrow arrays of `inputs`; other columns pass through untouched.

    The function gets slices of a batch, cut by the size of the first input (or after `rows` rows), and returns one
    sequence for each column of the DDL string `added`.  Input columns in `drop` don't stay.  `after` runs when a task is done.
    """
    new = T.StructType.fromDDL(added)
    old = [f for f in df.schema.fields if f.name not in drop]
    types = [to_arrow_type(f.dataType, prefers_large_types=False) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _slices(batch.column(inputs[0]), rows):
                part = batch.slice(first, last - first)
                made = function(*[part.column(c) for c in inputs])
                arrays = [part.column(f.name) for f in old]
                arrays += [pa.array(values, type=t, from_pandas=True) for values, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in old), *new.names])

    return df.mapInArrow(tidy(run, after), T.StructType([*old, *new.fields]))


def _slices(column: pa.Array, rows: int, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Slices of about `limit` bytes (or list values), one row at least."""
    if rows:
        ends = np.arange(rows, len(column) + rows, rows)
    else:
        listed = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
        sizes = pc.list_value_length(column) if listed else pc.binary_length(column)
        total = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
        ends = np.flatnonzero(np.diff(total // limit, append=-1)) + 1
    first = 0
    for end in ends:
        last = min(int(end), len(column))
        if last > first:
            yield first, last
            first = last
