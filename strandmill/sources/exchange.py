"""The exchange JSON of sketch collections: a list of signatures with their sketches and unsigned hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.hashing import threshold
from strandmill.functions.sequences import unsigned_decimal
from strandmill.operators.sketch import number_rows
from strandmill.types import EXCHANGE, Sketches

#: Labels of the hash functions in the file format.
LABELS = {"murmur3": "0.murmur64", "xxhash": "0.xxhash3", "ahash": "0.ahash", "default": "0.default"}


def _bits(value):
    """The BIGINT with the bits of an unsigned DECIMAL(20, 0)."""
    half, whole = (F.lit(str(1 << n)).cast("decimal(20,0)") for n in (63, 64))
    return F.when(value >= half, value - whole).otherwise(value).cast("bigint")


def read_exchange(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> Sketches:
    """Reads exchange files or folders of them; k, max_hash and the hash function must agree throughout, and all be of DNA.

    Each line is a JSON list of signatures, as the format is usually written; `multi_line` reads indented files.
    """
    raw = spark.read.schema(EXCHANGE).option("multiLine", multi_line).json(paths)
    rows = raw.select("filename", "hash_function", F.posexplode("signatures").alias("place", "s"))
    molecule = F.coalesce(F.lower("s.molecule"), F.lit("dna")).alias("molecule")
    kinds = rows.select("hash_function", "s.ksize", "s.max_hash", molecule).distinct().limit(2).collect()
    if len(kinds) != 1:
        raise ValueError("no sketch in the files" if not kinds else "sketches differ in hash function, k, max_hash or molecule")
    if kinds[0]["molecule"] != "dna":
        raise ValueError(f"sketches of {kinds[0]['molecule']!r}")
    algorithm = {v: n for n, v in LABELS.items()}.get(kinds[0]["hash_function"])
    if algorithm is None:
        raise ValueError(f"hash function {kinds[0]['hash_function']!r}")
    top, most = (1 << 64) - 1, int(kinds[0]["max_hash"] or 0)
    fscale = None if most in (0, top) else round(top / most)
    if fscale is not None and threshold(fscale) != most:
        raise ValueError(f"max_hash {most} stands for no whole scale")
    hashes = F.array_distinct(F.transform("s.mins", _bits))
    listed = number_rows(rows.select("filename", "place", hashes.alias("hashes")), ["filename", "place"], "sketch_id")
    size = F.size("hashes").cast("long")
    sigs = listed.select(
        "sketch_id", F.col("filename").alias("file_name"), F.col("filename").alias("name"), size.alias("num_kmers"),
        size.alias("num_hashes"), F.lit(kinds[0]["ksize"]).alias("kmer_size"), F.lit(fscale).cast("long").alias("fscale"),
        F.lit(algorithm).alias("algorithm"),
    )
    return Sketches(sigs, listed.select(F.explode("hashes").alias("hash"), "sketch_id"), kinds[0]["ksize"], fscale, algorithm)


def to_exchange(sketches: Sketches) -> DataFrame:
    """One row for each file with the structure of the exchange JSON; hashes ascend as unsigned values.

    Scaled sketches have `num` 0 and a `max_hash`.
    """
    values = sketches.postings.select("sketch_id", unsigned_decimal(F.col("hash")).alias("value"))
    mins = values.groupBy("sketch_id").agg(F.array_sort(F.collect_list("value")).alias("mins"))
    made = F.struct(
        F.lit(0).cast("long").alias("num"),
        F.lit(sketches.k).alias("ksize"),
        F.lit(42).cast("long").alias("seed"),
        F.lit(str(threshold(sketches.fscale))).cast("decimal(20,0)").alias("max_hash"),
        F.coalesce("mins", F.array().cast("array<decimal(20,0)>")).alias("mins"),
        F.lit(None).cast("string").alias("md5sum"),
        F.lit("dna").alias("molecule"),
    )
    listed = sketches.sigs.join(mins, "sketch_id", "left").select("file_name", "sketch_id", made.alias("sketch"))
    grouped = listed.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("sketch_id", "sketch"))).alias("s"))
    return grouped.select(
        F.lit("signature").alias("class"),
        F.lit("").alias("email"),
        F.lit(LABELS.get(sketches.algorithm, sketches.algorithm)).alias("hash_function"),
        F.col("file_name").alias("filename"),
        F.lit(None).cast("string").alias("name"),
        F.lit("CC0").alias("license"),
        F.transform("s", lambda x: x["sketch"]).alias("signatures"),
        F.lit(0.4).alias("version"),
    )


def write_exchange(sketches: Sketches, path: str, mode: str = "errorifexists") -> None:
    """Writes one JSON list for each signature: every line of the part files is a valid exchange document."""
    lines = to_exchange(sketches).select(F.concat(F.lit("["), F.to_json(F.struct("*")), F.lit("]")).alias("value"))
    lines.write.mode(mode).text(path)
