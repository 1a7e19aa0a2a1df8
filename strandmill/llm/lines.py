"""Line deduplication with two Bloom filters.

The first pass hashes every line once for each document into two filters of fixed size: "once", and "twice" for hashes that
meet their bits already set.  Every task fills filters of its own; they are merged slice by slice in a tree, where a bit that is
set once on both sides becomes set twice, so no hash of a line shuffles.  The second pass probes the twice filter and only
suspected repeats shuffle, to be counted exactly by 128-bit digest.  The lines found are broadcast, up to a counted bound,
and removed in place: texts don't shuffle.  Beyond the bound documents are joined with the lines that they lose.

The filter grows with the number of lines up to `max_filter_bits`, the proven bound of what is broadcast; beyond it more lines
are suspected and shuffle as digests, and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.lineage import cut
from strandmill.llm.common import extend, row_key, shield, table, tidy
from strandmill.llm.kernels import slices

_BITS_PER_LINE, _PROBES, _SLICE_BITS = 16, 4, 1 << 20
#: Filters that one task merges at once, and the share of all suspects from which a line's rows are joined by broadcast.
_FAN_IN, _HOT_SHARE = 32, 10_000
_BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(_BLANK).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _digests(keys: list[bytes]) -> np.ndarray:
    """One row of two 64-bit numbers for each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), dtype=np.uint64).reshape(-1, 2)


def _once_each(texts: list[str | None], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """The digests of each document's distinct lines, and which text each belongs to."""
    rows = [[k for k in set(line_keys(t)) if _long_enough(k, min_chars)] for t in texts]
    return _digests([k for keys in rows for k in keys]), np.repeat(np.arange(len(rows)), [len(keys) for keys in rows])


class Filter:
    """A bit array in slices; all probes of a hash lie in one slice."""

    def __init__(self, bits: int, parts: int = 1) -> None:
        self.slices = parts
        self.width = bits // self.slices
        self.data = np.zeros(bits // 8, dtype=np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The bits of each hash, one column for each."""
        high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
        steps = np.arange(1, _PROBES + 1, dtype=np.uint64)[:, None]
        within = (high + steps * (low | np.uint64(1))) % np.uint64(self.width)
        return (within + hashes % np.uint64(self.slices) * np.uint64(self.width)).astype(np.int64)

    def holds(self, places: np.ndarray) -> np.ndarray:
        return (self.data[places >> 3] >> (places & 7).astype(np.uint8) & 1).all(axis=0)

    def put(self, places: np.ndarray) -> None:
        places = np.unique(places)
        if len(places):
            byte = places >> 3
            starts = np.flatnonzero(np.diff(byte, prepend=-1))
            self.data[byte[starts]] |= np.bitwise_or.reduceat(np.uint8(1) << (places & 7).astype(np.uint8), starts)

    def part(self, number: int) -> np.ndarray:
        return self.data[number * self.width // 8 : (number + 1) * self.width // 8]


def _fill(bits: int, parts: int, min_chars: int):
    """A task's own filters, one row for each slice that isn't empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice, group = Filter(bits, parts), Filter(bits, parts), 0
        for batch in batches:
            group, texts = int(batch["task"].iloc[0]) if len(batch) else group, batch["text"].tolist()
            for piece in slices(texts):
                digests, _ = _once_each(texts[piece], min_chars)
                hashes, counts = np.unique(digests[:, 0], return_counts=True)
                places = once.places(hashes)
                twice.put(places[:, (counts > 1) | once.holds(places)])
                once.put(places)
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(once.slices):
            if once.part(k).any():
                packed = [pack(f.part(k).tobytes()) for f in (once, twice)]
                yield pd.DataFrame({"slice": [k], "group": [group], "once": packed[:1], "twice": packed[1:]})

    return run


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges filters by slice and group, as they stream in."""
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for r in batch.itertuples():
            once, twice = (np.frombuffer(unpack(x), dtype=np.uint8) for x in (r.once, r.twice))
            if (known := held.get((r.slice, r.group))) is not None:
                once, twice = known[0] | once, known[1] | twice | (known[0] & once)
            held[r.slice, r.group] = once, twice
    for (number, group), (once, twice) in held.items():
        yield pd.DataFrame({"slice": [number], "group": [group], "once": [pack(once.tobytes())], "twice": [pack(twice.tobytes())]})


def twice_filter(texts: DataFrame, bits: int, min_chars: int, tasks: int) -> Filter:
    """The filter of lines that more than one document may hold; `tasks` (about how many fill filters) only shapes the tree."""
    schema = "slice int, group int, once binary, twice binary"
    out = Filter(bits, max(1, bits // _SLICE_BITS))
    filters = texts.select("text", F.spark_partition_id().alias("task"))
    filters = filters.mapInPandas(tidy(_fill(bits, out.slices, min_chars)), schema)
    while True:
        tasks = max(1, -(-tasks // _FAN_IN))
        filters = filters.withColumn("group", (F.col("group") / _FAN_IN).cast("int") if tasks > 1 else F.lit(0))
        parts = min(tasks * out.slices, max(64, 4 * texts.sparkSession.sparkContext.defaultParallelism))
        filters = filters.repartition(parts, "slice", "group").mapInPandas(tidy(_merge), schema)
        if tasks <= 1:
            break
    for number, packed in filters.select("slice", "twice").toLocalIterator():
        out.part(number)[:] = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    return out


def _suspects(shared: Broadcast, min_chars: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for piece in slices(texts):
                digests, owner = _once_each(texts[piece], min_chars)
                hit = np.flatnonzero(shared.value.holds(shared.value.places(digests[:, 0])))
                keys = batch.iloc[piece].iloc[owner[hit]]
                high, low = digests[hit].view(np.int64).T
                yield pd.DataFrame({"high": high, "low": low, "__key_a": keys["__key_a"].array, "__key_b": keys["__key_b"].array})

    return run


def _cut_out(texts: list[str | None], gone_of) -> tuple[list, list, list]:
    """Kept texts, lines and dropped lines; `gone_of(number, digests)` tells which lines of a text go."""
    kept, lines, dropped = [], [], []
    for i, text in enumerate(texts):
        keys = line_keys(text)
        gone = gone_of(i, _digests(keys)) & np.array([len(k) > 0 for k in keys])
        if gone.any():
            raw = text.encode("utf-8", "surrogatepass").split(b"\n")
            text = b"\n".join([x for x, g in zip(raw, gone.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass")
        kept.append(text)
        lines.append(len(keys))
        dropped.append(int(gone.sum()))
    return kept, lines, dropped


class Digests:
    """A set of digests as sorted arrays."""

    def __init__(self, rows: np.ndarray) -> None:
        self.high, self.low = rows[np.lexsort(rows.T[::-1])].T

    def holds(self, digests: np.ndarray) -> np.ndarray:
        high, low = digests.T
        first, last = (np.searchsorted(self.high, high, side=s) for s in ("left", "right"))
        out = np.zeros(len(digests), dtype=bool)
        while (live := np.flatnonzero(~out & (first < last))).size:  # more than one round if different digests share a half
            out[live] = self.low[first[live]] == low[live]
            first[live] += 1
        return out


def _strip_known(shared: Broadcast):
    def run(texts: pa.Array) -> tuple[list, list, list]:
        return _cut_out(texts.to_pylist(), lambda _, digests: shared.value.holds(digests))

    return run


def _strip_joined(texts: pa.Array, found: pa.Array) -> tuple[list, list, list]:
    listed = [Digests(np.array([(x["high"], x["low"]) for x in row or []], dtype=np.int64).view(np.uint64).reshape(-1, 2)) for row in found.to_pylist()]
    return _cut_out(texts.to_pylist(), lambda i, digests: listed[i].holds(digests))


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, max_filter_bits: int = 1 << 28, max_broadcast: int = 1 << 20
) -> DataFrame:
    """Drops every line whose key occurs in at least `min_docs` rows; adds `n_lines` and `n_dropped`.

    Keys shorter than `min_chars` code points (or empty) never count.  A null text stays null and an empty one empty; both have
    one empty line.  Each row is a document, also where doc_id is null or repeated.  Extra columns of any name pass through;
    columns named like the added ones are replaced.  An empty table gives an empty result.
    """
    docs, back = shield(docs, ["text"], ["n_lines", "n_dropped"])
    texts, spark = docs.select("text"), docs.sparkSession
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    sized = texts.select((newlines + 1).alias("n"), F.spark_partition_id().alias("task"))
    lines, tasks = (x or 0 for x in sized.agg(F.sum("n"), F.max("task") + 1).first())
    bits = max(8, min(max_filter_bits, 1 << max(13, (_BITS_PER_LINE * lines - 1).bit_length())))
    bits -= bits % (_SLICE_BITS if bits >= _SLICE_BITS else 8)
    shared = spark.sparkContext.broadcast(twice_filter(texts, bits, min_chars, tasks))

    keyed = docs.withColumns(dict(zip(("__key_a", "__key_b"), row_key("text"), strict=True)))
    schema = "high long, low long, __key_a long, __key_b long"
    suspects = keyed.select("text", "__key_a", "__key_b").mapInPandas(tidy(_suspects(shared, min_chars)), schema)
    counted = suspects.groupBy("high", "low").agg(F.count("*").alias("n"))
    repeated = cut(counted.where(F.col("n") >= min_docs))
    total, held = repeated.agg(F.count("*"), F.sum("n")).first()
    added = "text string, n_lines long, n_dropped long"
    if total <= max_broadcast:
        rows = np.array([(r["high"], r["low"]) for r in repeated.toLocalIterator()], dtype=np.int64).reshape(-1, 2)
        known = spark.sparkContext.broadcast(Digests(rows.view(np.uint64)))
        out = extend(docs, _strip_known(known), ["text"], added, drop=["text"])
    else:
        # at most _HOT_SHARE lines can have this many of the rows; the others' are few enough for one task
        hot = F.col("n") * _HOT_SHARE >= held
        lists = [
            suspects.join(F.broadcast(repeated.where(hot)), ["high", "low"]),
            suspects.join(repeated.where(~hot), ["high", "low"]),
        ]
        gone = lists[0].unionByName(lists[1]).groupBy("__key_a", "__key_b").agg(F.collect_set(F.struct("high", "low")).alias("gone"))
        joined = keyed.join(cut(gone), ["__key_a", "__key_b"], "left").drop("__key_a", "__key_b")
        out = extend(joined, _strip_joined, ["text", "gone"], added, drop=["text", "gone"])
    return out.select(*back, "n_lines", "n_dropped")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH lines AS (
  SELECT rid, doc_id, unnest(line) AS line, unnest(range(len(line))) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents)
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines
), repeated AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10
), judged AS (
  SELECT l.rid, l.doc_id, l.pos, l.line, r.k IS NOT NULL AS gone FROM keyed l LEFT JOIN repeated r ON l.k = r.k
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
"""
