"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every item is cut into windows of 13 consecutive words (a shorter item is one window).  A window is the set of its
shingles of three words at known offsets.  Containment must be complete, so the necessary prefix of a window, its
shingles ordered by rarity in the documents, is the single rarest one.  Documents join these prefix shingles; a match
at position `p` fixes the only possible window start, which must lie inside the document (length and positional
bounds), and the window's words are compared exactly with the document's.

The prefix index is broadcast only up to `max_broadcast` windows; a larger benchmark is matched in blocks, dealt by hash, of
three quarters of that size on average.  What a row's matches cover is summed up before the shuffle, once for each text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.lineage import cut
from strandmill.llm.common import row_key, shield, table
from strandmill.llm.native import words

_SHINGLE = 3


def _shingle(array: str, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(F.col(array), at + k) for k in range(width)])


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct (item_id, width, window) of a benchmark table; `width` is that of the window's shingles."""
    item = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    last = F.greatest(F.size("w") - size, F.lit(0))
    spread = item.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("s"))
    window = F.slice("w", F.col("s") + 1, size)
    return spread.select("item_id", F.least(F.size(window), F.lit(_SHINGLE)).alias("width"), window.alias("window")).distinct()


def _positions(docs: DataFrame, width: int) -> DataFrame:
    """(w, p) for every position of the documents at which a shingle of `width` words starts."""
    places = F.when(F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width))
    # the outer form keeps Spark from filtering by size first, which would split every text twice
    return docs.withColumn("p", F.explode_outer(places)).where(F.col("p").isNotNull())


def _matches(docs: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(row key, start, length, item_id) of every occurrence of the windows with shingles of this width."""
    parts = windows.withColumn("o", F.explode(F.sequence(F.lit(0), F.size("window") - width)))
    parts = parts.withColumn("shingle", _shingle("window", F.col("o"), width))
    wanted = F.broadcast(parts.select("shingle").distinct())
    seen = _positions(docs.select("w"), width).select(_shingle("w", F.col("p"), width).alias("shingle"))
    counts = seen.join(wanted, "shingle").groupBy("shingle").agg(F.count("*").alias("df"))
    prefix = (
        parts.join(F.broadcast(cut(counts)), "shingle", "left")
        .groupBy("item_id", "window")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "o")).alias("rarest"))
        .where("rarest.df > 0")
        .select("item_id", "window", "rarest.shingle", "rarest.o")
    )
    at = _positions(docs, width).select("__key_a", "__key_b", "w", "p", _shingle("w", F.col("p"), width).alias("shingle"))
    start = F.col("p") - F.col("o")
    length = F.size("window")
    inside = (start >= 0) & (start + length <= F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(0)) + 1, length) == F.col("window")
    return (
        at.join(F.broadcast(cut(prefix)), "shingle")
        .where(inside & same)
        .select("__key_a", "__key_b", start.alias("start"), length.alias("length"), "item_id")
    )


def occurrences(docs: DataFrame, items: DataFrame, size: int, max_broadcast: int) -> DataFrame:
    """Every occurrence of an item window in `docs` (row key, w)."""
    windows = cut(item_windows(items, size))
    found = []
    for width, count in sorted((r["width"], r["count"]) for r in windows.groupBy("width").count().collect()):
        blocks = 1 if count <= max_broadcast else -(-4 * count // (3 * max_broadcast))
        for block in range(blocks):
            here = windows.where((F.col("width") == width) & (F.pmod(F.xxhash64("window"), F.lit(blocks)) == block))
            found.append(_matches(docs, here.select("item_id", "window"), width))
    if not found:
        none = windows.select(*[F.lit(0).alias(c) for c in ("start", "length")], "item_id").where("false")
        found.append(none.select(F.lit(0).cast("long").alias("__key_a"), F.lit(0).cast("long").alias("__key_b"), "*"))
    return reduce(DataFrame.union, found)


def _covered(spans: Column) -> Column:
    """The number of words in a sorted array of (start, length)."""
    start = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))

    def add(seen: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        fresh = F.greatest(end - F.greatest(seen["reach"], span["start"]), F.lit(0))
        return F.struct(F.greatest(seen["reach"], end).alias("reach"), (seen["n"] + fresh).alias("n"))

    return F.coalesce(F.aggregate(spans, start, add)["n"], F.lit(0)).cast("long")


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 13, max_broadcast: int = 200_000) -> DataFrame:
    """Adds `n_words`, `n_hit`, `n_whole`, `n_items`, `item_ids` and `contaminated` to every row of `docs`.

    A word inside any occurrence of an item window is hit (`n_whole`: of a window of `size` words, not of a shorter item); a
    document is contaminated if at least a twentieth of its words are hit.  Nulls have no words.  Items without id, text or
    words match nothing; an id that repeats counts once.  Each row is judged by its own text, also where doc_id is null or
    repeated.  Extra columns of any name pass through; columns named like the added ones are replaced.  Empty tables give
    empty results, or no hits.
    """
    added = ["n_words", "n_hit", "n_whole", "n_items", "item_ids", "contaminated"]
    docs, back = shield(docs, ["text"], added)
    keys = dict(zip(("__key_a", "__key_b"), row_key("text"), strict=True))
    split = docs.select(*row_key("text"), words(F.col("text")).alias("w"))
    hits = occurrences(split, items.select("item_id", "text"), size, max_broadcast)
    found = hits.groupBy("__key_a", "__key_b").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )
    whole = F.filter("spans", lambda x: x["length"] == size)
    counts = [_covered(F.col("spans")).alias("n_hit"), _covered(whole).alias("n_whole")]
    # cut, so that the join reads plain exchanges and Spark can split a text that very many rows share
    found = cut(found.select("__key_a", "__key_b", *counts, "item_ids"))
    zero = F.lit(0).cast("long")
    return (
        docs.withColumns(keys | {"n_words": F.size(words(F.col("text"))).cast("long")})
        .join(found, ["__key_a", "__key_b"], "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("n_hit", "n_whole")})
        .withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
        .select(*back, *added)
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
ORACLE_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 13], ' ') AS t, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS s FROM item WHERE len(w) > 0)
), doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS p FROM doc, sizes WHERE len(w) >= n
), hit AS (
  SELECT rid, p, s.n, item_id FROM (SELECT rid, n, p, array_to_string(w[p + 1 : p + n], ' ') AS t FROM spot) s
  JOIN win ON win.n = s.n AND win.t = s.t
), places AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
listed AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN places USING (rid) LEFT JOIN listed USING (rid)
"""
