"""A Spark data source for FASTA and FASTQ files, plain or gzip.

`read_fastx` reads local (or mounted) files: each file is one input partition and is read as a stream.  Long sequences come in
parts of `chunk` bases that overlap by `overlap` bases, so a chromosome is never one row; parts of a record share its ordinal.
`read_fasta` reads FASTA files from any file system that Spark reads, in built-in functions, and splits large plain files by
byte range.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from strandmill.sources.paths import resolve
from strandmill.types import RECORDS


def _lines(path: str) -> Iterator[str]:
    with open(path, "rb") as raw:
        packed = raw.read(2) == b"\x1f\x8b"
    with gzip.open(path, "rb") if packed else open(path, "rb") as data:
        for line in data:
            yield line.decode("utf-8", "replace").rstrip("\r\n")


def _fasta(lines: Iterator[str], header: str) -> Iterator[tuple[str, Iterator[str]]]:
    """(name, sequence lines) of each record; a record's lines must be used up before the next record."""
    waiting = [header]

    def body() -> Iterator[str]:
        for line in lines:
            if line.startswith(">"):
                waiting.append(line)
                return
            yield line

    while waiting:
        rest = body()
        yield waiting.pop()[1:], rest
        for _ in rest:
            pass


def _fastq(lines: Iterator[str], header: str, path: str) -> Iterator[tuple[str, Iterator[str]]]:
    while header:
        seq, plus, quality = next(lines, None), next(lines, None), next(lines, None)
        if quality is None or not plus.startswith("+") or len(quality) != len(seq) or not header.startswith("@"):
            raise ValueError(f"{path}: broken record {header!r}")
        yield header[1:], iter([seq])
        header = next((x for x in lines if x), "")


def read_records(path: str) -> Iterator[tuple[str, Iterator[str]]]:
    """(name, sequence lines) of each record of a file; the format is told by the first character."""
    lines = _lines(path)
    header = next((x for x in lines if x), "")
    if header.startswith(">"):
        yield from _fasta(lines, header)
    elif header.startswith("@"):
        yield from _fastq(lines, header, path)
    elif header:
        raise ValueError(f"{path}: neither FASTA nor FASTQ")


def split_parts(lines: Iterator[str], chunk: int, overlap: int) -> Iterator[str]:
    """The sequence in parts of at least `chunk` bases, each beginning with the last `overlap` bases of the one before."""
    held: list[str] = []
    size = 0
    for line in lines:
        line = line.translate(_BLANK)
        held.append(line)
        size += len(line)
        if size >= chunk + overlap:
            whole = "".join(held)
            yield whole
            held = [whole[len(whole) - overlap :]] if overlap else []
            size = overlap
    yield "".join(held)


_BLANK = {ord(c): None for c in " \t\r\n"}


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = resolve(options["path"].split("\n"), options.get("checkExtension", "true") == "true")
        self.chunk, self.overlap = int(options.get("chunk", 1 << 20)), int(options.get("overlap", 127))

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        for ordinal, (name, lines) in enumerate(read_records(partition.path)):
            for part, seq in enumerate(split_parts(lines, self.chunk, self.overlap)):
                yield partition.path, ordinal, name, part, seq


class FastxSource(DataSource):
    """`spark.read.format("fastx")`; options path (several: one for each line), checkExtension, chunk, overlap."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self):
        return RECORDS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_fastx(
    spark: SparkSession, paths: str | list[str], k: int = 21, chunk: int = 1 << 20, check_extension: bool = True
) -> DataFrame:
    """Records of sequence files, folders and manifests, in parts that overlap as k-mers of size `k` need."""
    spark.dataSource.register(FastxSource)
    listed = paths if isinstance(paths, str) else "\n".join(paths)
    reader = spark.read.format("fastx").option("chunk", chunk).option("overlap", k - 1)
    return reader.option("checkExtension", str(check_extension).lower()).load(listed)


def read_fasta(spark: SparkSession, paths: str | list[str], k: int = 21, chunk: int = 1 << 20) -> DataFrame:
    """Records of FASTA files or folders, plain or compressed, as rows of the same form and order as those of `read_fastx`.

    Each record is one row until it is cut into parts, so it must fit into a task's memory.  `file_name` is the file's URI.
    Anything before the first header is an error.
    """
    raw = spark.read.option("lineSep", "\n>").text(paths)
    place = F.struct(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("begin"))
    raw = raw.select(place.alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    # rows of a split are in order; a split's first ordinal is the number of records in the splits before it
    splits = raw.groupBy("at").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("at.file_name").orderBy("at.begin").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = raw.join(splits, "at").withColumn("ordinal", F.col("before") + F.col("id") - F.col("first"))
    broken = F.raise_error(F.concat(F.col("at.file_name"), F.lit(": not FASTA")))
    first = F.when(F.startswith("value", F.lit(">")), F.expr("substr(value, 2)")).otherwise(broken)
    rows = rows.withColumn("value", F.when(F.col("ordinal") == 0, first).otherwise(F.col("value")))
    header = F.substring_index("value", "\n", 1)
    seq = F.translate(F.substr("value", F.length(header) + 2), " \t\r\n", "")
    rows = rows.select("at.file_name", "ordinal", F.rtrim(header, F.lit("\r")).alias("name"), seq.alias("seq"))
    parts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length("seq") - (k - 1)) / F.lit(chunk)) - 1, F.lit(0)).cast("long"))
    rows = rows.select("file_name", "ordinal", "name", "seq", F.explode(parts).alias("part"))
    part = F.substr("seq", (F.col("part") * chunk + 1).cast("int"), F.lit(chunk + k - 1))
    return rows.select("file_name", "ordinal", "name", "part", part.alias("seq"))
