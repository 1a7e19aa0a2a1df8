"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards; a node weighs as much as the shards below it.  A document descends level by level:
every child draws `-ln(u) / weight`, `u` being a keyed hash of the child's name and doc_id, and the smallest draw wins.
A child's draw depends on its own name and weight only, so if weights change below a node, rows move
only into or out of subtrees whose weights changed.  `grow` opens a region of its own for one more shard: no
weight of an old subtree changes, so rows move only into the new shard.

Placement is a projection without a shuffle.  Slots are numbered in blocks, by a hash of the row's key: counts by (shard,
block) give each block's offset, so no task holds a whole shard, and a row's slot hangs on the rows alone, not on how they are
stored.  Rows that repeat one key more often than a block is large have blocks of their own, after all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.lineage import cut
from strandmill.llm.common import narrow, shield, table

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]

_ROWS_PER_BLOCK, _LEAST_BLOCKS = 100_000, 512


def layout(regions: int = 2, racks: int = 2, shards: int = 2) -> Tree:
    """A regular tree of equal weights; shards are numbered from 0."""
    number = iter(range(regions * racks * shards))
    return {
        f"region{r}": {f"rack{k}": {next(number): 1.0 for _ in range(shards)} for k in range(racks)}
        for r in range(regions)
    }


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a new region of its own."""
    last = max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return tree | {f"region{len(tree)}": {"rack0": {last + 1: weight}}}


def _weigh(node: dict | float) -> float:
    return node if isinstance(node, int | float) else sum(map(_weigh, node.values()))


def _descend(node: dict, path: str, key: Column, seed: int) -> Column:
    live = {name: child for name, child in node.items() if _weigh(child) > 0}
    if len(live) == 1:
        choice = None
    else:
        draws = []
        for i, (name, child) in enumerate(live.items()):
            hashed = F.xxhash64(F.lit(seed), F.lit(f"{path}/{name}"), key)
            unit = (hashed.bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))
            draws.append(F.struct((-F.log(unit) / F.lit(float(_weigh(child)))).alias("draw"), F.lit(i).alias("child")))
        choice = F.array_min(F.array(*draws))["child"]
    below = [
        F.lit(name).cast("int") if isinstance(child, int | float) else _descend(child, f"{path}/{name}", key, seed)
        for name, child in live.items()
    ]
    if choice is None:
        return below[0]
    if all(isinstance(child, int | float) for child in live.values()):
        return F.get(F.array(*below), choice)
    out = F.when(choice == 0, below[0])
    for i, column in enumerate(below[1:], 1):
        out = out.when(choice == i, column)
    return out


def shard_of(key: Column, tree: Tree, seed: int = 0) -> Column:
    """The shard of a row; nodes without weight get nothing.  Null keys are one key."""
    return _descend(tree, "", key, seed)


def number_slots(placed: DataFrame, key: Sequence[str] = ("doc_id", "text_crc32", "size")) -> DataFrame:
    """Adds `slot`, gapless from 0 within each `shard`, to rows that have a `shard` column.

    Rows are ordered by a hash of the `key` columns and these; nulls are keys like any other.  Rows with equal keys may have each
    other's slots.  Extra columns of any name pass through; a column named `slot` is replaced.  An empty table gives an empty
    result.
    """
    rows, back = shield(placed, ["shard", *key], ["slot"])
    rows = rows.withColumn("__hash", F.xxhash64(*key))
    n_rows = rows.count()
    blocks = max(_LEAST_BLOCKS, -(-n_rows // _ROWS_PER_BLOCK))
    # at most one in _ROWS_PER_BLOCK rows names such a key
    often = rows.groupBy("__hash").agg(F.count("*").alias("n")).where(F.col("n") > _ROWS_PER_BLOCK)
    often = cut(often.select("__hash", F.ceil(F.col("n") / _ROWS_PER_BLOCK).cast("int").alias("__parts")))
    hot = F.col("__parts").isNotNull()
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts"))
    rows = narrow(rows, often, ["__hash"], "left").withColumns(
        {
            "__own": F.when(hot, F.col("__hash").bitwiseAND(F.lit((1 << 62) - 1)) + 1).otherwise(F.lit(0)),
            "__block": F.when(hot, part).otherwise(F.pmod(F.col("__hash"), F.lit(blocks))).cast("int"),
        }
    )
    rows = cut(rows.drop("__parts"))
    block = ["shard", "__own", "__block"]
    counts = rows.groupBy(*block).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__own", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*block).orderBy("__hash", *key))
    return (
        rows.withColumn("__within", within)
        .join(offsets, block)
        .withColumn("slot", F.col("__before") + F.col("__within") - 1)
        .select(*back, "slot")
    )


def place(docs: DataFrame, tree: Tree, seed: int = 0) -> DataFrame:
    """Adds `size`, `text_crc32`, `law`, `shard` and `grown_shard` (with one more shard) to every row of `docs`.

    The law is `key`: doc_id and the tree decide.  `size` is the text's UTF-8 bytes plus 1; a null text counts no
    bytes and has a null checksum.  Rows that repeat a doc_id share a shard; rows without doc_id share one.  Extra columns of any
    name pass through; columns named like the added ones are replaced.  An empty table gives an empty result.
    """
    added = ["size", "text_crc32", "law", "shard", "grown_shard"]
    docs, back = shield(docs, ["doc_id", "text"], added)
    key = F.col("doc_id")
    made = [
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"),
        F.crc32(F.col("text").cast("binary")),
        F.lit("key"),
        shard_of(key, tree, seed),
        shard_of(key, grow(tree), seed),
    ]
    return docs.select(*back, *[c.alias(n) for n, c in zip(added, made, strict=True)])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = place(table(spark, sf_dir, "documents").select("doc_id", "text"), layout())
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return number_slots(docs.drop("text")).select(*names)
