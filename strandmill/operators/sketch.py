"""Sketching: records to distinct hashes under the scale threshold, for each file or each record, and collapsing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.functions.hashing import hash_function
from strandmill.functions.sequences import sketch_column, unsigned_order
from strandmill.lineage import cut
from strandmill.types import Sketches

#: Groups of rows that a file's candidates are spread over before the final bottom-n.
_SALTS = 64


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `name`, consecutive numbers from 0 in the order of the columns, without a single-task sort.

    Rows are dealt by range; each range's offset is the number of rows before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the bounds of the ranges are sampled anew in each evaluation, so there must be only one
    ranged = cut(ranged.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    numbered = ranged.join(F.broadcast(offsets), "__range")
    return numbered.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).select(*df.columns, name)


def bottom_hashes(hashes: DataFrame, group: list[str], nmax: int) -> DataFrame:
    """The `nmax` smallest (unsigned) distinct hashes of each group.

    Bottom-n of a union of bottom-n's is exact, so candidates are first cut down in salted groups: no task gets all
    rows of a large group.
    """
    rank = F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(unsigned_order(F.col("hash"))))
    salted = hashes.distinct().withColumn("__salt", F.pmod(F.xxhash64("hash"), F.lit(_SALTS)))
    least = salted.withColumn("__rank", rank).where(F.col("__rank") <= nmax).drop("__rank", "__salt")
    final = F.row_number().over(Window.partitionBy(*group).orderBy(unsigned_order(F.col("hash"))))
    return least.withColumn("__rank", final).where(F.col("__rank") <= nmax).drop("__rank")


def sketch(
    records: DataFrame,
    k: int = 21,
    fscale: int | None = None,
    nmax: int | None = None,
    algorithm: str | Callable[[np.ndarray], np.ndarray] = "default",
    singleton: bool = False,
) -> Sketches:
    """Sketches records (file_name, ordinal, name, seq; `part` optional): one sketch for each file, or for each record.

    Sketch ids are consecutive in the order of file_name and ordinal.  Sketches without hashes keep their row in `sigs`.
    Null sequences count as empty.  With `nmax` only the smallest hashes stay, for each sketch.
    """
    if not callable(algorithm):
        hash_function(algorithm, k)
    group = ["file_name", "ordinal", "name"] if singleton else ["file_name"]
    # ids and postings both build on the hashes, so the sequences are read and hashed once
    made = cut(records.select(*group, sketch_column(F.col("seq"), k, fscale, nmax, algorithm).alias("hashes")))
    ids = number_rows(made.select(*group).distinct(), group[:2], "sketch_id")
    own = ids.toDF(*[f"__{c}" for c in group], "sketch_id")
    # joined before the hashes are spread out, which then go as pairs of numbers
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group]
    owned = made.join(own, same).select("sketch_id", F.explode("hashes").alias("hash"))
    postings = owned.distinct() if nmax is None else bottom_hashes(owned, ["sketch_id"], nmax)
    sizes = postings.groupBy("sketch_id").agg(F.count("*").alias("n"))
    count = F.coalesce("n", F.lit(0)).cast("long")
    name = "custom" if callable(algorithm) else algorithm
    sigs = ids.join(sizes, "sketch_id", "left").select(
        "sketch_id",
        "file_name",
        F.col("name" if singleton else "file_name").alias("name"),
        count.alias("num_kmers"),
        count.alias("num_hashes"),
        F.lit(k).alias("kmer_size"),
        F.lit(fscale).cast("long").alias("fscale"),
        F.lit(name).alias("algorithm"),
    )
    return Sketches(sigs, postings.select("hash", "sketch_id"), k, fscale, name)


def collapse(sketches: Sketches) -> Sketches:
    """One sketch for each file: the union of its sketches' hashes; `num_kmers` is their sum."""
    grouped = sketches.sigs.groupBy("file_name").agg(F.sum("num_kmers").alias("num_kmers"))
    named = number_rows(grouped, ["file_name"], "new_id")
    owner = sketches.sigs.select("sketch_id", "file_name").join(named.select("file_name", "new_id"), "file_name")
    postings = sketches.postings.join(owner, "sketch_id").select("hash", F.col("new_id").alias("sketch_id")).distinct()
    sizes = postings.groupBy("sketch_id").agg(F.count("*").alias("num_hashes"))
    sigs = named.withColumnRenamed("new_id", "sketch_id").join(sizes, "sketch_id", "left").select(
        "sketch_id",
        "file_name",
        F.col("file_name").alias("name"),
        "num_kmers",
        F.coalesce("num_hashes", F.lit(0)).cast("long").alias("num_hashes"),
        F.lit(sketches.k).alias("kmer_size"),
        F.lit(sketches.fscale).cast("long").alias("fscale"),
        F.lit(sketches.algorithm).alias("algorithm"),
    )
    return Sketches(sigs, postings, sketches.k, sketches.fscale, sketches.algorithm)


def union(*collections: Sketches) -> Sketches:
    """All sketches of several collections with equal parameters, numbered anew."""
    first = collections[0]
    for other in collections[1:]:
        if (other.k, other.fscale, other.algorithm) != (first.k, first.fscale, first.algorithm):
            raise ValueError("collections differ in k, fscale or algorithm")
    sigs, postings = None, None
    for i, one in enumerate(collections):
        s, p = one.sigs.withColumn("__of", F.lit(i)), one.postings.withColumn("__of", F.lit(i))
        sigs, postings = (s, p) if sigs is None else (sigs.unionByName(s), postings.unionByName(p))
    numbered = number_rows(sigs.withColumnRenamed("sketch_id", "old_id"), ["__of", "old_id"], "sketch_id")
    ids = numbered.select("__of", F.col("old_id"), F.col("sketch_id").alias("new_id"))
    renamed = postings.withColumnRenamed("sketch_id", "old_id").join(ids, ["__of", "old_id"])
    out = renamed.select("hash", F.col("new_id").alias("sketch_id"))
    return Sketches(numbered.drop("__of", "old_id").select(*first.sigs.columns), out, first.k, first.fscale, first.algorithm)
