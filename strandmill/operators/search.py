"""Containment search in an index and pairwise comparison of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.functions.sequences import unsigned_order
from strandmill.types import Sketches

RESULT = ["from_name", "to_name", "num_common", "num_kmers", "reverse", "estimated_containment"]


def check_compatible(one: Sketches, two: Sketches) -> None:
    """Collections are comparable if k, fscale and the hash algorithm agree."""
    for what in ("k", "fscale", "algorithm"):
        a, b = getattr(one, what), getattr(two, what)
        if a != b and not (what == "algorithm" and {a, b} == {"default", "ahash" if one.k < 32 else "xxhash"}):
            raise ValueError(f"collections differ in {what}: {a} and {b}")


def common_hashes(query: Sketches, target: Sketches) -> DataFrame:
    """(query_id, sketch_id, num_common) of all sketch pairs that share a hash, by an equi-join on the hash.

    Spark broadcasts the query's hashes where they are small; else both sides shuffle on the hash and adaptive
    execution splits hashes with long posting lists.
    """
    wanted = query.postings.withColumnRenamed("sketch_id", "query_id")
    return wanted.join(target.postings, "hash").groupBy("query_id", "sketch_id").agg(F.count("*").alias("num_common"))


def _sides(query: Sketches, target: Sketches) -> tuple[DataFrame, DataFrame]:
    def side(sigs: DataFrame, key: str, mark: str) -> DataFrame:
        renamed = [F.col(c).alias(f"{mark}_{c}") for c in ("name", "num_kmers", "num_hashes")]
        return sigs.select(F.col("sketch_id").alias(key), *renamed)

    return side(query.sigs, "query_id", "q"), side(target.sigs, "sketch_id", "t")


def search(index: Sketches, query: Sketches, cutoff: float = 0.0) -> DataFrame:
    """Containment of each query sketch in each target that shares a hash, best first.

    `num_kmers` is the smaller of both sketch sizes; rows stay if `num_common / num_kmers * 100 > cutoff`.
    """
    check_compatible(index, query)
    sides = _sides(query, index)
    hits = common_hashes(query, index).join(sides[0], "query_id").join(sides[1], "sketch_id")
    least = F.least("q_num_hashes", "t_num_hashes")
    share = F.col("num_common").cast("double") / F.col("num_kmers").cast("double") * 100.0
    out = hits.select(
        F.col("q_name").alias("from_name"), F.col("t_name").alias("to_name"), "num_common",
        least.alias("num_kmers"), F.lit(False).alias("reverse"),
    )
    out = out.withColumn("estimated_containment", share).where(F.col("estimated_containment") > cutoff)
    return out.orderBy(F.desc("estimated_containment"), "from_name", "to_name")


#: Rows of a tile in a comparison of the sketches that share a prefix.
_TILE = 256


def _nodes(query: Sketches, target: Sketches) -> DataFrame:
    """(side, id, place, hash, before, size, child): the shared prefixes of sorted hash lists at which their sketches part.

    A prefix is told by its last hash, its place and 64 bits of the hashes before; `size` sketches begin with it.  `child` is
    the next hash; it is null where no other sketch goes on in the same way.  A prefix with which all of its sketches go on
    is left out, so that a sketch has a row only where others leave it.
    """

    def first(sketches: Sketches, side: int) -> DataFrame:
        least = F.min(unsigned_order(F.col("hash"))).alias("first")
        return sketches.postings.groupBy(F.col("sketch_id").alias("id")).agg(least).withColumn("side", F.lit(side))

    def placed(sketches: Sketches, side: int) -> DataFrame:
        by_sketch = Window.partitionBy("id").orderBy(unsigned_order(F.col("hash")))
        rows = sketches.postings.select(F.col("sketch_id").alias("id"), "hash")
        rows = rows.join(met.where(F.col("side") == side).select("id"), "id", "left_semi")
        before = F.bit_xor(F.xxhash64("hash")).over(by_sketch.rowsBetween(Window.unboundedPreceding, -1))
        added = {"place": F.row_number().over(by_sketch), "before": F.coalesce(before, F.lit(0)), "last": F.lag("hash").over(by_sketch)}
        return rows.withColumns(added).withColumn("side", F.lit(side))

    # most sketches share not even their first hash
    firsts = first(query, 0) if target is query else first(query, 0).unionByName(first(target, 1))
    met = firsts.join(firsts.groupBy("first").agg(F.count("*").alias("n")).where("n > 1"), "first")
    rows = placed(query, 0) if target is query else placed(query, 0).unionByName(placed(target, 1))
    alike = Window.partitionBy("hash", "place", "before")
    # a common hash at the place before implies a common prefix there, and so on down to the first place
    one = F.min("last").over(alike).eqNullSafe(F.max("last").over(alike))
    size = F.when(one, F.count("*").over(alike)).otherwise(F.raise_error("different prefixes have the same 64 bits").cast("long"))
    shared = rows.withColumn("size", size).where("size > 1").drop("last")
    by_sketch = Window.partitionBy("side", "id").orderBy("place")
    ahead = shared.withColumns({"child": F.lead("hash").over(by_sketch), "left": F.lead("size").over(by_sketch)})
    heavy = F.coalesce(F.col("left") * 2 > F.col("size"), F.lit(False))
    return ahead.where("left IS NULL OR left < size").withColumn("heavy", heavy).drop("left")


def _prefixes(query: Sketches, target: Sketches, sides: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The columns of both sides and num_common, the length of the common prefix of both sorted hash lists, if there is one.

    Two sketches meet once, at the prefix where they part, and each brings its columns along: pairs don't shuffle here.
    Sketches that go on like most others of a prefix only meet those that don't, so that most rows that meet are results.
    The sketches of one side are dealt to tiles, which all get those of the other side, so that no task gets all pairs of a
    large group.
    """
    parts = int(query.sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = _nodes(query, target)
    same = target is query
    one = nodes.where("side = 0").withColumnRenamed("id", "query_id").join(sides[0], "query_id")
    two = nodes.where(F.col("side") == (0 if same else 1)).withColumnRenamed("id", "sketch_id").join(sides[1], "sketch_id")
    two = two.withColumnRenamed("child", "other")
    tiles = F.ceil(F.col("size") / _TILE).cast("int")

    def dealt(rows: DataFrame, key: str, own: list[str], all_of: list[str], heavy: str) -> DataFrame:
        """A place in one tile of the kinds `own` and in every tile of the kinds `all_of`; of heavy rows, one of kind `heavy`."""

        def at(kind: str, tile: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), tile.alias("tile"))

        def everywhere(kind: str) -> Column:
            return F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: at(kind, t))

        tile = F.pmod(F.xxhash64(key), tiles).cast("int")
        light = F.concat(*[F.array(at(kind, tile)) for kind in own], *map(everywhere, all_of))
        at_all = F.explode(F.when(F.col("heavy"), F.array(at(heavy, tile))).otherwise(light)).alias("at")
        rows = rows.select("*", at_all).select("*", "at.kind", "at.tile").drop("at", "side", "size", "heavy")
        # counted partitions stay as they are: adaptive execution would merge them by the size of what meets, not of the pairs
        return rows.repartition(parts, *key_of)

    key_of = ["hash", "place", "before", "kind", "tile"]
    one = dealt(one, "query_id", ["light"], ["to heavy"], "from heavy")
    two = dealt(two, "sketch_id", [], ["light", "from heavy"], "to heavy")
    met = one.join(two, key_of).where("child IS NULL OR other IS NULL OR child != other")
    columns = [*sides[0].columns, *sides[1].columns]
    found = met.select(*columns, F.col("place").cast("long").alias("num_common"))
    if not same:
        return found
    found = found.where("query_id != sketch_id")
    itself = sides[0].select("*", *[F.col(a).alias(b) for a, b in zip(sides[0].columns, sides[1].columns, strict=True)])
    return found.unionByName(itself.withColumn("num_common", F.col("q_num_hashes")))


def _ratio(kmers: str, hashes: str) -> Column:
    return F.col(kmers).cast("double") / F.col(hashes).cast("double")


def compare(
    query: Sketches, target: Sketches, cutoff: float = 0.0, overlap: str = "intersection", most_pairs: int = 1_000_000_000
) -> DataFrame:
    """Pairwise comparison; the sketch with more hashes comes first, `reverse` tells that this is the target.

    `num_kmers` is the larger of both sizes; rows stay if `num_common / num_kmers * 100 > cutoff`, before the ratio of
    k-mers to hashes is applied.  `overlap="prefix"` counts the common prefix of the sorted hash lists instead of the
    intersection.  A negative cutoff keeps pairs without a common hash as well, so it yields all pairs and is an error if
    there are more than `most_pairs`; sketches without hashes are never compared.
    """
    check_compatible(query, target)
    if overlap not in ("intersection", "prefix"):
        raise ValueError(f"overlap {overlap!r}")
    sides = [s.where(F.col(f"{m}_num_hashes") > 0) for s, m in zip(_sides(query, target), "qt", strict=True)]
    if overlap == "intersection":
        found = common_hashes(query, target)
        hits = found.join(sides[0], "query_id").join(sides[1], "sketch_id")
    else:
        hits = _prefixes(query, target, sides)
        found = hits.select("query_id", "sketch_id", "num_common")
    if cutoff < 0:
        if (pairs := sides[0].count() * sides[1].count()) > most_pairs:
            raise ValueError(f"a negative cutoff asks for all {pairs} pairs")
        every = sides[0].crossJoin(sides[1]).join(found, ["query_id", "sketch_id"], "left")
        hits = every.withColumn("num_common", F.coalesce("num_common", F.lit(0)))
    reverse = F.col("q_num_hashes") < F.col("t_num_hashes")
    one, two = _ratio("q_num_kmers", "q_num_hashes"), _ratio("t_num_kmers", "t_num_hashes")
    share = F.col("num_common").cast("double") / F.col("num_kmers").cast("double")
    return (
        hits.withColumn("num_kmers", F.greatest("q_num_kmers", "t_num_kmers"))
        .where(share * 100.0 > cutoff)
        .select(
            F.when(reverse, F.col("t_name")).otherwise(F.col("q_name")).alias("from_name"),
            F.when(reverse, F.col("q_name")).otherwise(F.col("t_name")).alias("to_name"),
            "num_common",
            "num_kmers",
            reverse.alias("reverse"),
            (share * (F.greatest(one, two) / F.least(one, two)) * 100.0).alias("estimated_containment"),
        )
        .orderBy(F.desc("estimated_containment"), "from_name", "to_name")
    )


def two_decimals(value: Column) -> Column:
    """A number from 0 on (below 2000) with two decimals, of its exact binary value; an exact tie goes to the even digit.

    A double from 1 on is a whole number of 2^-52, and one from 2^-8 on of 2^-60; smaller ones are far from the first tie.
    """
    units = F.when(value < 1, F.lit(1 << 60)).otherwise(F.lit(1 << 52))
    whole = (value * units.cast("double")).cast("long").cast("decimal(20,0)")
    units = units.cast("decimal(20,0)")
    hundredths = (whole * F.lit(100).cast("decimal(3,0)")).cast("decimal(25,0)")
    low = F.floor(hundredths / units).cast("decimal(10,0)")
    twice = ((hundredths - low * units) * 2).cast("decimal(25,0)")
    up = (twice > units) | ((twice == units) & (low % 2 == 1))
    return ((low + F.when(up, 1).otherwise(0)) / 100).cast("decimal(12,2)").cast("string")


def result_lines(results: DataFrame) -> DataFrame:
    """`line`: query, target, common hashes, k-mers and the containment with two decimals, tab-separated."""
    query = F.when(F.col("reverse"), F.col("to_name")).otherwise(F.col("from_name"))
    target = F.when(F.col("reverse"), F.col("from_name")).otherwise(F.col("to_name"))
    shown = two_decimals(F.col("estimated_containment"))
    columns = [query, target, F.col("num_common").cast("string"), F.col("num_kmers").cast("string"), shown]
    return results.select(F.concat_ws("\t", *columns).alias("line"))
