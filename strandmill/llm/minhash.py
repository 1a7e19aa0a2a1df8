"""MinHash near-duplicate detection with a multi-index Hamming join.

A document's signature is 64 symbols of 16 bits (b-bit minwise hashing).  The signature is split into 16
chunks of four symbols.  Two signatures that differ in at most `RADIUS` = 31 symbols have a chunk with at most one
difference (16 chunks with two each would make 32), so indexing each chunk under its four "one symbol left out"
keys finds every such pair.  A pair with similarity 0.8 differs in 12.8 symbols on average; it exceeds 31 with
a probability below 1e-7.  Every link is confirmed on the full sets.

Groups of copies never become pairs.  Equal texts are one class.  Each bucket first links its members to
one representative; only buckets that still hold several components are compared further, in tiles of bounded
size, and those tiles emit confirmed links alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.lineage import cut
from strandmill.llm.common import components, extend, narrow, row_key, shield, table, tidy
from strandmill.llm.kernels import SPACE_SEPARATED, hash_series, mix64, runs, slices, word_hashes

SYMBOLS, CHUNK = 64, 4
CHUNKS = SYMBOLS // CHUNK
RADIUS = 2 * CHUNKS - 1
#: Rows of one block of a bucket, and of one block of sets; a task compares two blocks at a time.
BUCKET_BLOCK, SET_BLOCK = 1024, 128

#: Comparisons of signatures that one task is meant to make, how many tasks there are at most, and rows of tiles handled at once.
_COMPARED, _MOST_TASKS, _SHARD_ROWS = 20_000_000, 100_000, 4000

_MULTIPLY = hash_series(SYMBOLS, 1) | np.uint64(1)
_ADD = hash_series(SYMBOLS, 2)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` words; the whole sequence if it is shorter."""
    for part in slices(texts):
        words, offsets = word_hashes(texts[part], SPACE_SEPARATED, lower=True)
        size = max(0, len(words) - width + 1)
        joined = np.zeros(size, dtype=np.uint64)
        for k in range(width):
            joined = mix64(joined * np.uint64(0x9E3779B97F4A7C15) + words[k : k + size])
        for first, last in zip(offsets[:-1], offsets[1:], strict=True):
            if last - first >= width:
                yield np.unique(joined[first : last - width + 1])
            elif last > first:
                whole = np.array([last - first], dtype=np.uint64)
                for word in words[first:last]:
                    whole = mix64(whole * np.uint64(31) + word)
                yield whole
            else:
                yield np.empty(0, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 16-bit symbols for each non-empty set."""
    values = np.concatenate(sets)
    starts = np.zeros(len(sets), dtype=np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    out = np.empty((len(sets), SYMBOLS), dtype=np.uint16)
    for i in range(SYMBOLS):
        lowest = np.minimum.reduceat(values * _MULTIPLY[i] + _ADD[i], starts)
        out[:, i] = mix64(lowest) & np.uint64(0xFFFF)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """The 64 keys of each signature: chunk `c` without its symbol `o` makes the key whose low bits are `c * 4 + o`."""
    out = np.empty((len(signature), CHUNKS * CHUNK), dtype=np.uint64)
    wide = signature.astype(np.uint64)
    for chunk in range(CHUNKS):
        for out_of in range(CHUNK):
            key = np.full(len(signature), chunk * CHUNK + out_of + 1, dtype=np.uint64)
            for k in range(CHUNK):
                if k != out_of:
                    key = mix64(key * np.uint64(0x10001) + wide[:, chunk * CHUNK + k])
            slot = chunk * CHUNK + out_of
            out[:, slot] = (key & ~np.uint64(63)) | np.uint64(slot)
    return out


def _sign(width: int):
    def run(column: pa.Array) -> tuple[list, list]:
        sets = list(shingle_sets(column.to_pylist(), width))
        full = [i for i, s in enumerate(sets) if len(s)]
        packed: list[bytes | None] = [None] * len(sets)
        if full:
            for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                packed[i] = row.tobytes()
        return [len(s) for s in sets], packed

    return run


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first in range(0, len(batch), 2000):
            part = batch.iloc[first : first + 2000]
            symbols = np.frombuffer(b"".join(part["signature"]), dtype=np.uint16).reshape(-1, SYMBOLS)
            keys = index_keys(symbols).view(np.int64)
            yield pd.DataFrame(
                {
                    "key": keys.ravel(),
                    "id": np.repeat(part["id"].to_numpy(), keys.shape[1]),
                }
            )


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for part in slices(texts):
                packed = [s.tobytes() for s in shingle_sets(texts[part], width)]
                yield batch.iloc[part].drop(columns="text").assign(items=packed)

    return run


def _unpack(items: bytes) -> np.ndarray:
    return np.frombuffer(items, dtype=np.uint64)


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(one), len(two)))
    if 100 * small < percent * large:
        return False
    merged = np.sort(np.concatenate([one, two]), kind="stable")
    shared = int((merged[1:] == merged[:-1]).sum())
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def _confirm_pairs(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            far = [
                int((np.frombuffer(x, np.uint16) != np.frombuffer(y, np.uint16)).sum())
                for x, y in zip(batch["sig_a"], batch["sig_b"], strict=True)
            ]
            linked = [
                d <= RADIUS and _similar(_unpack(x), _unpack(y), percent)
                for d, x, y in zip(far, batch["set_a"], batch["set_b"], strict=True)
            ]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "near": np.array(far) <= RADIUS, "linked": linked})

    return run


def _bucket_tiles(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of the tiles dealt to one shard within the radius and in different components, each in its first common key only."""
    tile = rows.groupby(["key", "low", "high"], sort=False).ngroup().to_numpy()
    key, ids, labels, homes = (rows[c].to_numpy() for c in ("key", "id", "label", "set_block"))
    low, high, block = (rows[c].to_numpy() for c in ("low", "high", "block"))
    symbols = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(-1, SYMBOLS)
    one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
    two = two[np.argsort(tile[two], kind="stable")]
    first = np.searchsorted(tile[two], tile[one], side="left")
    count = np.searchsorted(tile[two], tile[one], side="right") - first
    found = [(one[:0], one[:0])]
    for part in runs(count, 20_000):
        left = np.repeat(one[part], count[part])
        place = np.arange(len(left)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        right = two[np.repeat(first[part], count[part]) + place]
        new = (labels[left] != labels[right]) & np.where(low[left] == high[left], ids[right] > ids[left], ids[right] != ids[left])
        left, right = left[new], right[new]
        differ = symbols[left] != symbols[right]
        near = np.count_nonzero(differ, axis=1) <= RADIUS
        left, right, differ = left[near], right[near], differ[near]
        errors, each = differ.reshape(-1, CHUNKS, CHUNK).sum(axis=2), np.arange(len(left))
        earliest = (errors <= 1).argmax(axis=1)
        chunk, out_of = np.divmod(key[left] & 63, CHUNK)
        own = np.where(errors[each, earliest] == 0, out_of == 0, differ[each, chunk * CHUNK + out_of]) & (earliest == chunk)
        found.append((left[own], right[own]))
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    own, other = homes[left], homes[right]
    asked = pd.DataFrame({"tile_a": np.minimum(own, other), "tile_b": np.maximum(own, other), "one": ids[left], "two": ids[right]})
    packed = [(*k, g["one"].to_numpy(), g["two"].to_numpy()) for k, g in asked.groupby(["tile_a", "tile_b"])]
    return pd.DataFrame(packed, columns=["tile_a", "tile_b", "one", "two"])


def _merge_tile(tile: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs that all buckets ask of two blocks of sets, and the ids in them: no more than the blocks hold."""
    one, two = np.concatenate(rows["one"].tolist()), np.concatenate(rows["two"].tolist())
    columns = ["tile_a", "tile_b", "members", "one", "two"]
    return pd.DataFrame([(*tile, np.unique(np.concatenate([one, two])), one, two)], columns=columns)


def _confirm_tile(percent: int):
    def run(tile: tuple, sets: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        items = {i: _unpack(x) for i, x in zip(sets["id"], sets["items"], strict=True)}
        links = [
            (a, b)
            for r in wanted.itertuples()
            for a, b in zip(r.one.tolist(), r.two.tolist(), strict=True)
            if a in items and b in items and _similar(items[a], items[b], percent)
        ]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def links(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect all similar classes; `signed` has the classes' id, text keys, signature."""
    keys = signed.select("id", "signature").mapInPandas(tidy(_keys), "key long, id long")
    buckets = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    shared = cut(keys.join(buckets, "key"))
    stars = shared.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    stars = cut(stars)

    involved = cut(signed.join(shared.select("id").distinct(), "id").select("id", "__key_a", "__key_b", "signature"))
    texts = docs.select(F.col("doc_id").alias("id"), *row_key("text"), "text")
    texts = texts.join(involved, ["id", "__key_a", "__key_b"]).groupBy("id", "__key_a", "__key_b")
    texts = texts.agg(F.first("text").alias("text"), F.first("signature").alias("signature"))
    known = cut(texts.select("id", "signature", "text").mapInPandas(tidy(_sets(width)), "id long, signature binary, items binary"))
    sets = known.select("id", "items")

    one = known.select(F.col("id").alias("a"), F.col("items").alias("set_a"), F.col("signature").alias("sig_a"))
    two = known.select(F.col("id").alias("b"), F.col("items").alias("set_b"), F.col("signature").alias("sig_b"))
    judged = stars.join(one, "a").join(two, "b")
    judged = cut(judged.mapInPandas(tidy(_confirm_pairs(percent)), "a long, b long, near boolean, linked boolean"))
    found = judged.where("linked").select("a", "b")

    labels = components(found)
    homes = judged.where("near").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("home"))
    nodes = (
        involved.select("id").distinct().join(labels, "id", "left")
        .join(homes, "id", "left")
        .select("id", F.coalesce("component", "id").alias("label"), F.coalesce("home", "id").alias("home"))
    )
    nodes = cut(nodes)
    # only homes of more than a block are cut up, so at most one in SET_BLOCK rows names one
    spread = nodes.groupBy("home").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    nodes = narrow(nodes, cut(spread), ["home"], "left").select(
        "id", "label", F.xxhash64("home", F.pmod(F.hash("id"), parts)).alias("set_block")
    )
    open_rows = shared.where("n > 2").join(nodes, "id")
    several = open_rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("n").alias("n"))
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks")
    several = cut(several.where("low != high").select("key", "n", blocks))
    tiles = (
        open_rows.drop("n").join(several, "key")
        .join(signed.select("id", "signature"), "id")
        .withColumn("block", F.pmod(F.hash("id"), "blocks"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "id", "label", "set_block", "signature", "block",
            F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
        )
    )
    # few bytes make much work here, so tasks are sized by the comparisons that wait
    square = F.col("n") * F.col("n")
    compared, dealt = (x or 0 for x in several.agg(F.sum(square), F.sum(F.col("n") * F.col("blocks"))).first())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(_MOST_TASKS, -(-compared // _COMPARED)))
    shard = F.pmod(F.xxhash64("key", "low", "high"), F.lit(-(-dealt // _SHARD_ROWS) or 1)).alias("shard")
    tiles = tiles.withColumn("shard", shard).repartition(tasks, "shard")
    met = tiles.groupBy("shard").applyInPandas(_bucket_tiles, "tile_a long, tile_b long, one array<long>, two array<long>")
    wanted = "tile_a long, tile_b long, members array<long>, one array<long>, two array<long>"
    wanted = cut(met.groupBy("tile_a", "tile_b").applyInPandas(_merge_tile, wanted))
    members = wanted.select("tile_a", "tile_b", F.explode("members").alias("id")).join(sets, "id")
    members = members.select("tile_a", "tile_b", "id", "items").toDF("side_a", "side_b", "id", "items")
    asked = wanted.select("tile_a", "tile_b", "one", "two")
    more = members.groupBy("side_a", "side_b").cogroup(asked.groupBy("tile_a", "tile_b")).applyInPandas(
        _confirm_tile(percent), "a long, b long"
    )
    return found.union(cut(more))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Adds `n_shingles`, `component_id` and `kept` to every row of `docs` (doc_id, text, ...).

    Words are lower-cased (A-Z) and split at ASCII white space; a set holds the distinct shingles of `width` words.
    Documents are linked if 100 * |intersection| >= percent * |union|.  Nulls and texts without words have an empty
    set and link with nothing.  A text of fewer words than `width` is one shingle.  Rows that repeat a doc_id count
    as one document; rows without doc_id are kept and linked with nothing.  Extra columns of any name pass through; columns
    named like the added ones are replaced.  An empty table gives an empty result.
    """
    added = ["n_shingles", "component_id", "kept"]
    docs, back = shield(docs, ["doc_id", "text"], added)
    rows = docs.select("doc_id", "text", *row_key("text"))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = extend(rows, _sign(width), ["text"], "n_shingles long, signature binary", drop=["text"])
    classes = cut(
        signed.groupBy("__key_a", "__key_b").agg(
            F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")
        )
    )
    usable = classes.where("id is not null and signature is not null")
    labels = components(links(docs.where("doc_id is not null"), usable, width, percent))
    classes = (
        classes.drop("signature")
        .join(labels, "id", "left")
        .select("__key_a", "__key_b", "n_shingles", F.coalesce("component", "id").alias("__class"))
    )
    empty = F.col("n_shingles") == 0
    own = F.col("doc_id").isNull() | empty
    return (
        docs.withColumns(dict(zip(("__key_a", "__key_b"), row_key("text"), strict=True)))
        .join(classes, ["__key_a", "__key_b"], "left")
        .withColumn("component_id", F.when(own, F.col("doc_id")).otherwise(F.col("__class")).cast("long"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(*back, *added)
    )


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id", "kept")


#: Shingles are joined on their words; a document's component is the smallest doc_id that links reach.
ORACLE_SQL = r"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + 2], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 1, 1))) AS s FROM doc WHERE len(w) > 0)
), number AS MATERIALIZED (SELECT x, row_number() OVER () AS k FROM shingle GROUP BY x HAVING count(*) > 1),
held AS MATERIALIZED (SELECT doc_id, k FROM shingle JOIN number USING (x)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM held a JOIN held b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM common c JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c.n >= 80 * (s.n + t.n - c.n)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, component_id, doc.doc_id = component_id AS kept
FROM doc JOIN root ON root.a = doc.doc_id LEFT JOIN sizes USING (doc_id)
"""
