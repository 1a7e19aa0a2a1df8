"""The inverted index: a folder with `sigs` and hash-ordered `postings`, its checks and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.sequences import unsigned_decimal, unsigned_order
from strandmill.types import POSTINGS, SIGS, Sketches


def posting_lists(sketches: Sketches) -> DataFrame:
    """The grouped form of the postings: each hash with its sketch ids in order."""
    grouped = sketches.postings.groupBy("hash")
    return grouped.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("sketch_id")).alias("sketch_ids"))


def write_index(sketches: Sketches, path: str, mode: str = "errorifexists", partitions: int | None = None) -> None:
    """Writes the index; postings are ranged and sorted by unsigned hash, so readers skip row groups by hash."""
    key = unsigned_order(F.col("hash"))
    dealt = [partitions] if partitions else []
    ordered = sketches.postings.repartitionByRange(*dealt, key, "sketch_id").sortWithinPartitions(key, "sketch_id")
    sketches.sigs.select(*SIGS.names).write.mode(mode).parquet(f"{path}/sigs")
    ordered.select("hash", "sketch_id").write.mode(mode).parquet(f"{path}/postings")


def is_index(spark: SparkSession, path: str) -> bool:
    """Whether a path, in any file system that Spark reads, is an index folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/sigs")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def open_index(spark: SparkSession, path: str) -> Sketches:
    """Opens an index folder; one k, one fscale and one algorithm must hold for all of its sketches."""
    sigs = spark.read.schema(SIGS).parquet(f"{path}/sigs")
    kinds = sigs.select("kmer_size", "fscale", "algorithm").distinct().limit(2).collect()
    if len(kinds) != 1:
        raise ValueError(f"{path}: " + ("index is empty" if not kinds else "sketches differ in k, fscale or algorithm"))
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    return Sketches(sigs, postings, kinds[0]["kmer_size"], kinds[0]["fscale"], kinds[0]["algorithm"])


def coarser(sketches: Sketches, fscale: int) -> Sketches:
    """The sketches at a larger scale: hashes under its threshold, a filter that reaches the Parquet scan."""
    from strandmill.functions.hashing import threshold

    limit = threshold(fscale)
    if fscale < 2 or (sketches.fscale or 1) > fscale:
        raise ValueError("the scale can only grow, to 2 at least")
    postings = sketches.postings.where((F.col("hash") >= 0) & (F.col("hash") < limit))
    sizes = postings.groupBy("sketch_id").agg(F.count("*").alias("n"))
    count = F.coalesce("n", F.lit(0)).cast("long")
    sigs = sketches.sigs.join(sizes, "sketch_id", "left").withColumns(
        {"num_kmers": count, "num_hashes": count, "fscale": F.lit(fscale).cast("long")}
    )
    return Sketches(sigs.drop("n").select(*sketches.sigs.columns), postings, sketches.k, fscale, sketches.algorithm)


def index_summary(sketches: Sketches) -> DataFrame:
    """The number of sketches and of (hash, sketch) entries."""
    counts = sketches.sigs.agg(F.count("*").alias("num_sketches"))
    return counts.crossJoin(sketches.postings.agg(F.count("*").alias("num_postings")))


def index_detail(sketches: Sketches) -> DataFrame:
    """file_name, fscale (`None` or `Some(n)`), kmer_size and num_hashes of each sketch, in id order."""
    scale = F.when(F.col("fscale").isNull(), "None").otherwise(F.concat(F.lit("Some("), F.col("fscale"), F.lit(")")))
    return sketches.sigs.orderBy("sketch_id").select(
        "sketch_id", "file_name", scale.alias("fscale"), "kmer_size", "num_hashes"
    )


def hash_values(sketches: Sketches) -> DataFrame:
    """Postings with the unsigned value of each hash as DECIMAL(20, 0)."""
    return sketches.postings.select(unsigned_decimal(F.col("hash")).alias("hash"), "sketch_id")
