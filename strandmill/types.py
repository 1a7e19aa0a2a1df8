"""Schemas and small containers of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: One sequence record, or one part of a long one (`part` counts from 0; parts overlap by k - 1 bases or more).
RECORDS = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("seq", T.StringType()),
    ]
)

SIGS = T.StructType(
    [
        T.StructField("sketch_id", T.LongType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("num_kmers", T.LongType()),
        T.StructField("num_hashes", T.LongType()),
        T.StructField("kmer_size", T.IntegerType()),
        T.StructField("fscale", T.LongType()),
        T.StructField("algorithm", T.StringType()),
    ]
)

POSTINGS = T.StructType([T.StructField("hash", T.LongType()), T.StructField("sketch_id", T.LongType())])

_SKETCH_JSON = T.StructType(
    [
        T.StructField("num", T.LongType()),
        T.StructField("ksize", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("max_hash", T.DecimalType(20, 0)),
        T.StructField("mins", T.ArrayType(T.DecimalType(20, 0))),
        T.StructField("md5sum", T.StringType()),
        T.StructField("molecule", T.StringType()),
    ]
)

#: The exchange JSON: a list of signatures with their sketches.
EXCHANGE = T.StructType(
    [
        T.StructField("class", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("hash_function", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("signatures", T.ArrayType(_SKETCH_JSON)),
        T.StructField("version", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Sketches:
    """A collection of sketches: `sigs` has a row for each, `postings` a row for each (hash, sketch)."""

    sigs: DataFrame
    postings: DataFrame
    k: int
    fscale: int | None
    algorithm: str
