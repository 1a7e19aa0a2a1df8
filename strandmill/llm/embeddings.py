"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected by `TABLES` random Gaussian matrices to eight dimensions and decoded to the nearest point of
the E8 lattice; the point is the vector's cell in that table.  Besides its own cell a vector probes the `PROBES`
neighbouring cells (of the 240 nearest ones) that its projection lies closest to.  Pairs that meet in a cell are verified
by their cosine in double precision.  At a cosine of exactly 0.93 a table finds a pair with probability 0.64, so the
tables miss fewer than one in a thousand; see the test for the measured recall.

Equal vectors with equal labels are one class, so copies never become pairs.  A cell of any size is cut into blocks; a
tile of two blocks is compared at a time, and tiles are dealt by hash in bounded shares.  Pairs aren't written out: a pair
counts in the first of the cells that it shares, which its two vectors tell, so every tile gives the number of links of each of
its vectors and a star of links for each of its components, never more rows than it has.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.lineage import cut
from strandmill.llm.common import components, shield, table
from strandmill.llm.kernels import hash_series, mix64, runs

TABLES, PROBES, SCALE = 8, 16, 1.0
#: Rows of one block of a cell, and of the tiles that are handed to Python at once.
_BLOCK, _SHARD_ROWS = 1024, 4000


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [
        [a if k == i else b if k == j else 0.0 for k in range(8)]
        for i, j in itertools.combinations(range(8), 2)
        for a in (1.0, -1.0)
        for b in (1.0, -1.0)
    ]
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*pairs, *halves])


_NEAR = _neighbours()
_CELL_HASH = hash_series(8, 77)


def _even_integers(points: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: where the sum is odd, the worst rounding is turned round."""
    out = np.rint(points)
    odd = np.flatnonzero(out.sum(axis=1).astype(np.int64) & 1)
    rest = points[odd] - out[odd]
    worst = np.abs(rest).argmax(axis=1)
    out[odd, worst] += np.where(rest[np.arange(len(odd)), worst] >= 0, 1, -1)
    return out


def decode_e8(points: np.ndarray) -> np.ndarray:
    """The nearest lattice points: E8 is the even-sum integers and their shift by one half."""
    whole, half = _even_integers(points), _even_integers(points - 0.5) + 0.5
    closer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _cell(lattice: np.ndarray, number: int) -> np.ndarray:
    doubled = np.rint(2 * lattice).astype(np.int64).view(np.uint64)
    return mix64((doubled * _CELL_HASH).sum(axis=-1, dtype=np.uint64) * np.uint64(TABLES) + np.uint64(number)).view(np.int64)


def _times(rows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The product, summed in one order for each row, so that a vector's cells don't depend on what stands beside it."""
    out = np.zeros((len(rows), matrix.shape[1]))
    for k in range(matrix.shape[0]):
        out += rows[:, k : k + 1] * matrix[k]
    return out


def cells(units: np.ndarray, seed: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each table the vectors' own cells and the cells that they probe."""
    for number in range(TABLES):
        matrix = np.random.default_rng([seed, number]).normal(0, SCALE, (units.shape[1], 8))
        points = _times(units, matrix)
        home = decode_e8(points)
        toward = _times(points - home, _NEAR.T)
        probed = np.argpartition(-toward, PROBES, axis=1)[:, :PROBES]
        yield _cell(home, number), _cell(home[:, None, :] + _NEAR[probed], number)


def first_shared(units: np.ndarray, left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    """For pairs of rows of `units` the first cell that they share: one's own, which the other owns or probes too."""
    found = np.zeros(len(left), dtype=np.int64)
    open_pairs = np.arange(len(left))
    for own, probed in cells(units, seed):
        one, two = left[open_pairs], right[open_pairs]
        low, high = np.where(own[one] <= own[two], one, two), np.where(own[one] <= own[two], two, one)
        in_low = (own[low] == own[high]) | (probed[high] == own[low][:, None]).any(axis=1)
        in_high = (probed[low] == own[high][:, None]).any(axis=1)
        met = in_low | in_high
        found[open_pairs[met]] = np.where(in_low, own[low], own[high])[met]
        open_pairs = open_pairs[~met]
        if not len(open_pairs):
            break
    return found


def _hash_cells(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            widths = batch["embedding"].map(len).to_numpy()
            for width in np.unique(widths):
                same = batch[widths == width]
                for first in range(0, len(same), 1000):
                    part = same.iloc[first : first + 1000]
                    units = _units(part["embedding"])
                    for own, probed in cells(units, seed):
                        probes = probed.shape[1]
                        yield pd.DataFrame(
                            {
                                "cell": np.concatenate([own, probed.ravel()]),
                                "label": np.concatenate([part["label"], np.repeat(part["label"], probes)]),
                                "id": np.concatenate([part["id"], np.repeat(part["id"], probes)]),
                                "owns": np.arange(len(own) * (1 + probes)) < len(own),
                            }
                        )

    return run


def _units(vectors) -> np.ndarray:
    out = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _stars(one: np.ndarray, two: np.ndarray, size: int) -> np.ndarray:
    """The smallest member of each member's component, for links between numbers below `size`."""
    lowest = np.arange(size)
    while True:
        low = np.minimum(lowest[one], lowest[two])
        after = lowest.copy()
        for side in (one, two):
            np.minimum.at(after, side, low)
            np.minimum.at(after, lowest[side], low)
        after = after[after]
        if np.array_equal(after, lowest):
            return lowest
        lowest = after


def _verify(least: float, seed: int):
    """Links of the tiles dealt to one task, owners of block `i` against all rows of block `j`: (a, b, linked).

    Each vector `a` has the number of vectors that it is linked with here and the smallest one, `b`, that links lead to.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable", ignore_index=True)
        tile = rows.groupby(["cell", "label", "i", "j"], sort=False).ngroup().to_numpy()
        ids, member = np.unique(rows["id"].to_numpy(), return_inverse=True)
        source = np.zeros(len(ids), dtype=np.int64)
        source[member] = np.arange(len(rows))
        copies = rows["copies"].to_numpy()[source]
        cell, owns, block = rows["cell"].to_numpy(), rows["owns"].to_numpy(), rows["block"].to_numpy()
        as_one, as_two = owns & (block == rows["i"].to_numpy()), block == rows["j"].to_numpy()
        widths = rows["embedding"].map(len).to_numpy()[source]
        linked, lowest = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for width in np.unique(widths):
            same = np.flatnonzero(widths == width)
            units = np.zeros((len(ids), width))
            units[same] = _units(rows["embedding"].iloc[source[same]])
            one, two = (np.flatnonzero(side & (widths[member] == width)) for side in (as_one, as_two))
            two = two[np.argsort(tile[two], kind="stable")]
            first = np.searchsorted(tile[two], tile[one], side="left")
            count = np.searchsorted(tile[two], tile[one], side="right") - first
            for part in runs(count, 50_000):
                left = np.repeat(one[part], count[part])
                place = np.arange(len(left)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
                right = two[np.repeat(first[part], count[part]) + place]
                # of two owners of the cell only one order is needed
                new = (member[left] != member[right]) & (~owns[right] | (member[left] < member[right]))
                left, right = left[new], right[new]
                near = np.einsum("ij,ij->i", units[member[left]], units[member[right]]) >= least
                left, right = left[near], right[near]
                if not len(left):
                    continue
                some, at = np.unique(member[np.concatenate([left, right])], return_inverse=True)
                here = first_shared(units[some], at[: len(left)], at[len(left) :], seed) == cell[left]
                a, b = member[left[here]], member[right[here]]
                linked += np.bincount(a, copies[b], len(ids)).astype(np.int64) + np.bincount(b, copies[a], len(ids)).astype(np.int64)
                lowest = _stars(np.concatenate([a, lowest]), np.concatenate([b, np.arange(len(ids))]), len(ids))
        some = np.flatnonzero(linked)
        return pd.DataFrame({"a": ids[some], "b": ids[lowest[some]], "linked": linked[some]})

    return run


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, least: float = 0.93, seed: int = 0) -> DataFrame:
    """Adds `n_links`, `component_id` and `kept` to every row of `vectors` (vec_id, embedding, label, ...).

    Vectors are linked if their labels are equal and their cosine is at least `least`.  Null labels, null or empty or zero
    vectors and vectors with null or non-finite components link with nothing; vectors of different length never link.  Rows
    without vec_id are kept and link with nothing; rows that repeat a vec_id are vectors of their own, each of which counts, and
    those with nothing smaller among their copies share a component.  Extra columns of any name pass through; columns named like the added ones are replaced.  An empty
    table gives an empty result.
    """
    added = ["n_links", "component_id", "kept"]
    vectors, back = shield(vectors, ["vec_id", "embedding", "label"], added)
    wide = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _usable(wide)
    keys = {"__key_a": F.xxhash64(wide, "label"), "__key_b": F.xxhash64(F.lit(7), wide, "label", F.lit(11))}
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.xxhash64("label").alias("label"), wide.alias("embedding"), *[
        c.alias(n) for n, c in keys.items()
    ]).where(usable)
    classes = cut(
        rows.groupBy("__key_a", "__key_b").agg(
            F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
        ).withColumn("class", F.monotonically_increasing_id())
    )
    hashed = classes.select(F.col("class").alias("id"), "label", "embedding").mapInPandas(
        _hash_cells(seed), "cell long, label long, id long, owns boolean"
    )
    hashed = cut(hashed)
    sizes = hashed.groupBy("cell", "label").agg(F.count("*").alias("n"), F.count_if("owns").alias("owners"))
    sizes = cut(sizes.where("n > 1 and owners > 0").withColumn("blocks", F.ceil(F.col("n") / _BLOCK).cast("int")))
    shards = -(-(sizes.agg(F.sum(2 * F.col("n") * F.col("blocks"))).first()[0] or 0) // _SHARD_ROWS) or 1
    placed = hashed.join(sizes, ["cell", "label"]).withColumn("block", F.pmod(F.hash("id"), "blocks"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_owner = placed.where("owns").select("cell", "label", F.col("block").alias("i"), F.explode(others).alias("j"), "id", "owns", "block")
    as_other = placed.select("cell", "label", F.explode(others).alias("i"), F.col("block").alias("j"), "id", "owns", "block")
    known = classes.select(F.col("class").alias("id"), "embedding", "copies")
    tiles = as_owner.union(as_other).distinct().join(known, "id")
    shard = F.pmod(F.xxhash64("cell", "label", "i", "j"), F.lit(shards)).alias("shard")
    found = cut(tiles.groupBy(shard).applyInPandas(_verify(least, seed), "a long, b long, linked long"))
    linked = found.groupBy(F.col("a").alias("class")).agg(F.sum("linked").alias("linked"))
    # a class is named by its smallest vec_id, and so is a component
    named = classes.select("class", F.col("id").alias("name"))
    edges = found.select(F.col("a").alias("class"), "b").where("class != b").distinct()
    edges = edges.join(named, "class").select(F.col("name").alias("a"), F.col("b").alias("class")).join(named, "class")
    groups = components(edges.select("a", F.col("name").alias("b")))
    known = (
        classes.select("__key_a", "__key_b", "class", "id", "copies")
        .join(linked, "class", "left")
        .join(groups, "id", "left")
        .select(
            "__key_a", "__key_b",
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("__links"),
            F.coalesce("component", "id").alias("__component"),
        )
    )
    flagged = vectors.withColumns({n: F.when(usable, c) for n, c in keys.items()})
    return (
        flagged.join(known, ["__key_a", "__key_b"], "left")
        .withColumn("n_links", F.coalesce("__links", F.lit(0)).cast("long"))
        .withColumn("component_id", F.coalesce("__component", F.col("vec_id").cast("long")))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
        .select(*back, *added)
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


#: All pairs of equal label; links are the same unless the lattice misses a pair, which is rarer than one in a thousand.
ORACLE_SQL = """
WITH RECURSIVE row_of AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), good AS MATERIALIZED (
  SELECT rid, vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM row_of
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v)
  WHERE a.size > 0 AND b.size > 0 AND list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.93
), reach AS (SELECT vec_id AS a, vec_id AS b FROM row_of UNION SELECT reach.a, pair.b FROM reach JOIN pair ON reach.b = pair.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
linked AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, vec_id IS NULL) AS kept
FROM row_of LEFT JOIN root ON root.a = vec_id LEFT JOIN linked ON linked.a = vec_id
"""
