"""The engine's queries over the test tables, with DuckDB oracles.

The tables hold no nucleotides, so texts are spelled with four letters: each ASCII letter becomes the base of its place in the
alphabet modulo four; everything else but white space stays and breaks k-mers.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.hashing import threshold
from strandmill.functions.sequences import hash_column, kmer_counts, normalise, reverse_complement
from strandmill.lineage import shared_path, spread
from strandmill.operators.index import coarser, index_detail, index_summary, open_index, posting_lists, write_index
from strandmill.operators.search import compare, result_lines, search
from strandmill.operators.sketch import collapse, sketch, union
from strandmill.sources.exchange import read_exchange, to_exchange, write_exchange
from strandmill.types import Sketches

_LETTERS = string.ascii_letters
_BASES = "".join("ACGT"[i % 4] for i in range(26)) * 2
K, LONG_K, FSCALE, NMAX = 21, 33, 10, 100

Query = Callable[[SparkSession, str], DataFrame]


def spell(text: Column) -> Column:
    return F.translate(text, _LETTERS, _BASES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records; the source stands for the file."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    name = F.col("doc_id").cast("string").alias("name")
    return docs.select(F.col("source").alias("file_name"), F.col("doc_id").alias("ordinal"), name, spell(F.col("text")).alias("seq"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = F.concat(F.lit("item"), F.col("item_id")).alias("name")
    return items.select(F.lit("benchmark").alias("file_name"), F.col("item_id").alias("ordinal"), name, spell(F.col("text")).alias("seq"))


def _windows(records: DataFrame, k: int) -> DataFrame:
    """(ordinal, kmer): canonical k-mers as strings, in built-in functions."""
    runs = records.select("ordinal", F.explode(F.regexp_extract_all(normalise(F.col("seq")), F.lit(f"([ACGT]{{{k},}})"))).alias("run"))
    starts = F.sequence(F.lit(1), F.length("run") - k + 1)
    kmer = runs.select("ordinal", "run", F.explode(starts).alias("i"))
    kmer = kmer.select("ordinal", F.substring("run", F.col("i"), F.lit(k)).alias("kmer"))
    return kmer.select("ordinal", F.least("kmer", reverse_complement(F.col("kmer"))).alias("kmer"))


def _packed(kmer: Column) -> Column:
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), normalise(F.col("seq")).alias("seq"))


def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = reverse_complement(normalise(F.col("seq")))
    return documents(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), seq.alias("seq"))


def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = documents(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), kmer_counts(F.col("seq"), K).alias("n"))
    return counted.select("doc_id", "n.n_kmers", "n.n_distinct").where("n_kmers > 0")


def kmer_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _windows(benchmark(spark, sf_dir), K).distinct()
    return found.select(F.col("ordinal").alias("item_id"), "kmer", _packed(F.col("kmer")).alias("packed"))


def kmer_long_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(benchmark(spark, sf_dir), LONG_K).distinct().select(F.col("ordinal").alias("item_id"), "kmer")


def _hashed(spark: SparkSession, sf_dir: str, algorithm: str, k: int) -> DataFrame:
    found = _windows(benchmark(spark, sf_dir), k).distinct()
    value = _packed(F.col("kmer")) if k < 32 else F.col("kmer")
    return found.select(F.col("ordinal").alias("item_id"), "kmer", hash_column(value, k, algorithm).alias("hash"))


def document_sketches(spark: SparkSession, sf_dir: str, **more) -> Sketches:
    return sketch(documents(spark, sf_dir), K, FSCALE, algorithm="ahash", **({"singleton": True} | more))


def benchmark_sketches(spark: SparkSession, sf_dir: str) -> Sketches:
    return sketch(benchmark(spark, sf_dir), K, FSCALE, algorithm="ahash", singleton=True)


def _named_postings(sketches: Sketches) -> DataFrame:
    named = sketches.sigs.select("sketch_id", "name", "num_kmers")
    return sketches.postings.join(named, "sketch_id").select("sketch_id", "name", "num_kmers", "hash")


def sketch_fracminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_postings(document_sketches(spark, sf_dir))


def sketch_bottom_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sketch(documents(spark, sf_dir), K, None, NMAX, "ahash")
    return _named_postings(made)


def sketch_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sketches(spark, sf_dir, singleton=False).sigs.select("sketch_id", "file_name", "num_kmers", "num_hashes")


def sketch_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sketches(spark, sf_dir).sigs.select("sketch_id", "file_name", "name", "num_kmers")


def sketch_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(document_sketches(spark, sf_dir)).sigs.select("sketch_id", "file_name", "num_kmers", "num_hashes")


def sketch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = union(benchmark_sketches(spark, sf_dir), document_sketches(spark, sf_dir))
    return both.sigs.select("sketch_id", "file_name", "name", "num_kmers")


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists(document_sketches(spark, sf_dir)).select("hash", "n", F.concat_ws(",", "sketch_ids").alias("sketch_ids"))


def index_coarser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarser(document_sketches(spark, sf_dir), 50).sigs.select("sketch_id", "name", "num_hashes", "fscale")


def exchange_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_exchange(benchmark_sketches(spark, sf_dir)).select("filename", F.explode("signatures").alias("s"))
    mins = F.concat_ws(",", F.transform("s.mins", lambda x: x.cast("string")))
    return rows.select("filename", "s.ksize", "s.molecule", F.size("s.mins").alias("n_mins"), mins.alias("mins"))


def exchange_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches of the benchmark as read again from exchange files."""
    path = shared_path(spark)
    write_exchange(benchmark_sketches(spark, sf_dir), path)
    read = read_exchange(spark, path)
    return read.postings.join(read.sigs, "sketch_id").select("sketch_id", "file_name", "algorithm", "fscale", "num_kmers", "hash")


def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in an index that was written and opened again."""
    path = shared_path(spark)
    write_index(document_sketches(spark, sf_dir), path)
    return search(open_index(spark, path), benchmark_sketches(spark, sf_dir))


def search_containment(spark: SparkSession, sf_dir: str, cutoff: float = 0.0) -> DataFrame:
    return search(document_sketches(spark, sf_dir), benchmark_sketches(spark, sf_dir), cutoff)


def search_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_containment(spark, sf_dir, 50.0)


def compare_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(benchmark_sketches(spark, sf_dir), document_sketches(spark, sf_dir))


def compare_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(benchmark_sketches(spark, sf_dir), collapse(document_sketches(spark, sf_dir)))


def compare_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sketches = document_sketches(spark, sf_dir)
    return compare(sketches, sketches, 0.0, "prefix")


def compare_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = benchmark_sketches(spark, sf_dir)
    return compare(items, items, -1.0)


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("line", "\t")
    lines = result_lines(search_containment(spark, sf_dir))
    return lines.select(*[parts[i].alias(n) for i, n in enumerate(("query", "target", "num_common", "num_kmers", "containment"))])


QUERIES: dict[str, Query] = {
    "normalize_text": normalize_text,
    "reverse_complement": reverse_complements,
    "kmer_count": kmer_count,
    "kmer_canonical": kmer_canonical,
    "kmer_long_canonical": kmer_long_canonical,
    "hash_ahash": lambda spark, sf_dir: _hashed(spark, sf_dir, "ahash", K),
    "hash_murmur3": lambda spark, sf_dir: _hashed(spark, sf_dir, "murmur3", K),
    "hash_murmur3_long": lambda spark, sf_dir: _hashed(spark, sf_dir, "murmur3", LONG_K),
    "hash_xxh3": lambda spark, sf_dir: _hashed(spark, sf_dir, "xxhash", K),
    "hash_xxh3_long": lambda spark, sf_dir: _hashed(spark, sf_dir, "xxhash", LONG_K),
    "sketch_fracminhash": sketch_fracminhash,
    "sketch_bottom_n": sketch_bottom_n,
    "sketch_grouped": sketch_grouped,
    "sketch_singleton": sketch_singleton,
    "sketch_collapse": sketch_collapse,
    "sketch_union": sketch_union,
    "index_postings": index_postings,
    "index_summary": lambda spark, sf_dir: index_summary(document_sketches(spark, sf_dir)),
    "index_detail": lambda spark, sf_dir: index_detail(document_sketches(spark, sf_dir)),
    "index_coarser": index_coarser,
    "exchange_signatures": exchange_signatures,
    "exchange_round_trip": exchange_round_trip,
    "index_round_trip": index_round_trip,
    "search_containment": search_containment,
    "search_cutoff": search_cutoff,
    "compare_pairwise": compare_pairwise,
    "compare_collapsed": compare_collapsed,
    "compare_prefix": compare_prefix,
    "compare_all_pairs": compare_all_pairs,
    "result_lines": result_rows,
}

# The oracles build on these steps: d(id, f, name, seq) and q, windows, hashes of both, and their sketches.


def _records(table: str, key: str, file: str, name: str) -> str:
    spelled = f"regexp_replace(translate(coalesce(text, ''), '{_LETTERS}', '{_BASES}'), '[ \\t\\r\\n]', '', 'g')"
    seq = f"regexp_replace(translate({spelled}, '.~', '--'), '[^ACGTN-]', 'N', 'g')"
    return f"(SELECT {key} AS id, {file} AS f, {name} AS name, {seq} AS seq FROM {table})"


_D = _records("documents", "doc_id", "source", "CAST(doc_id AS VARCHAR)")
_Q = _records("benchmark", "item_id", "'benchmark'", "'item' || item_id")


def _kmers(records: str, k: int) -> str:
    return (
        f"(SELECT id, f, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT id, f, substr(seq, i, {k}) AS w "
        f"FROM (SELECT id, f, seq, unnest(range(1, length(seq) - {k - 2})) AS i FROM {records} r)) v "
        f"WHERE regexp_full_match(w, '[ACGT]{{{k}}}'))"
    )


_PACK = (
    "CAST(CAST(lpad(replace(replace(replace(replace(kmer, 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11'), 64, '0') AS BIT) "
    "AS BIGINT)"
)
_TOP = 2**64 - 1


def _ahash(records: str) -> str:
    """(id, f, kmer, u): the unsigned ahash of each canonical k-mer."""
    product = f"CAST(xor(CAST({_PACK} AS UBIGINT), CAST(16222275662659920551 AS UBIGINT)) AS UHUGEINT) * 6364136223846793005"
    return (
        f"(SELECT id, f, kmer, ((t << 37) & CAST({_TOP} AS UHUGEINT)) | (t >> 27) AS u FROM (SELECT id, f, kmer, "
        f"xor(p & CAST({_TOP} AS UHUGEINT), p >> 64) AS t FROM (SELECT id, f, kmer, {product} AS p FROM {_kmers(records, K)} m)))"
    )


def _steps(source: str, *named: tuple[str, str]) -> str:
    """A select for each name that the ones after it build on."""
    for name, value in named:
        source = f"(SELECT *, {value} AS {name} FROM {source})"
    return source


def _low(value: str) -> str:
    return f"(({value}) & CAST({_TOP} AS UHUGEINT))"


def _wide(value: int) -> str:
    return f"CAST({value} AS UHUGEINT)"


def _rotated(x: str, bits: int) -> str:
    return f"({_low(f'{x} << {bits}')} | ({x} >> {64 - bits}))"


def _mixed(name: str, x: str, shift: int, multiplier: int) -> tuple[str, str]:
    return name, _low(f"xor({x}, {x} >> {shift}) * {_wide(multiplier)}")


def _bytes_as_number(first: int, count: int) -> str:
    """Letters of `kmer` from place `first` (from 0), the first one lowest."""
    return "(" + " + ".join(f"(CAST(ascii(substr(kmer, {first + i + 1}, 1)) AS UHUGEINT) << {8 * i})" for i in range(count)) + ")"


#: The eight bytes of a packed k-mer in reverse order.
_SWAPPED = "(" + " | ".join(f"(((CAST(CAST({_PACK} AS UBIGINT) AS UHUGEINT) >> {56 - 8 * i}) & 255) << {8 * i})" for i in range(8)) + ")"
_M1, _M2 = 0x87C37B91114253D5, 0x4CF5AD432745937F


def _murmur(source: str, blocks: list[tuple[str, str]], tail: str, size: int) -> str:
    """(…, u): blocks are pairs of 64-bit numbers, the tail is one of at most eight bytes."""
    a, b, named = _wide(42), _wide(42), []
    for i, (low, high) in enumerate(blocks):
        named += [(f"p{i}", _low(f"{low} * {_wide(_M1)}")), (f"q{i}", _low(f"{_rotated(f'p{i}', 31)} * {_wide(_M2)}")), (f"r{i}", f"xor({a}, q{i})")]
        named += [(f"a{i}", _low(f"({_rotated(f'r{i}', 27)} + {b}) * 5 + {_wide(0x52DCE729)}"))]
        named += [(f"s{i}", _low(f"{high} * {_wide(_M2)}")), (f"t{i}", _low(f"{_rotated(f's{i}', 33)} * {_wide(_M1)}")), (f"v{i}", f"xor({b}, t{i})")]
        named += [(f"b{i}", _low(f"({_rotated(f'v{i}', 31)} + a{i}) * 5 + {_wide(0x38495AB5)}"))]
        a, b = f"a{i}", f"b{i}"
    named += [("k", _low(f"{tail} * {_wide(_M1)}")), ("l", _low(f"{_rotated('k', 31)} * {_wide(_M2)}"))]
    named += [("x", f"xor(xor({a}, l), {_wide(size)})"), ("y", f"xor({b}, {_wide(size)})"), ("g", _low("x + y")), ("h", _low("y + g"))]
    for x in ("g", "h"):
        named += [_mixed(f"{x}1", x, 33, 0xFF51AFD7ED558CCD), _mixed(f"{x}2", f"{x}1", 33, 0xC4CEB9FE1A85EC53), (f"{x}3", f"xor({x}2, {x}2 >> 33)")]
    return _steps(source, *named, ("u", _low("g3 + h3")))


def _murmur3_long() -> str:
    number = [_bytes_as_number(8 * i, 8) for i in range(4)]
    return _murmur(_kmers(_Q, LONG_K), [(number[0], number[1]), (number[2], number[3])], _bytes_as_number(32, 1), LONG_K)


def _xxh3() -> str:
    prime = 0x9FB21C651E98DF25
    named = [("s", _SWAPPED), ("x", f"xor(({_low('s << 32')} | (s >> 32)), {_wide(0x1CAD21F72C81017C ^ 0xDB979083E96DD4DE)})")]
    named += [("y", f"xor(xor(x, {_rotated('x', 49)}), {_rotated('x', 24)})"), ("z", _low(f"y * {_wide(prime)}"))]
    named += [("w", _low(f"xor(z, (z >> 35) + 8) * {_wide(prime)}")), ("u", "xor(w, w >> 28)")]
    return _steps(_kmers(_Q, K), *named)


#: The first words of the function's secret.
_SECRET = [0xBE4BA423396CFEB8, 0x1CAD21F72C81017C, 0xDB979083E96DD4DE, 0x1F67B3B7A4A44072, 0x78E5C0CC4EE679CB, 0x2172FFCC7DD05A82, 0x8E2443F7744608B8, 0x4C263A81E69035E0]


def _xxh3_long() -> str:
    """For 33 letters: two pairs of words from either end."""
    named = []
    for i, first in enumerate((0, LONG_K - 16, 16, LONG_K - 32)):
        for k in (0, 1):
            named.append((f"w{i}{k}", f"xor({_bytes_as_number(first + 8 * k, 8)}, {_wide(_SECRET[2 * i + k])})"))
        named += [(f"m{i}", f"w{i}0 * w{i}1"), (f"f{i}", f"xor({_low(f'm{i}')}, m{i} >> 64)")]
    start = LONG_K * 0x9E3779B185EBCA87 % 2**64
    named += [("s", _low(f"{_wide(start)} + f0 + f1 + f2 + f3")), _mixed("t", "s", 37, 0x165667919E3779F9), ("u", "xor(t, t >> 32)")]
    return _steps(_kmers(_Q, LONG_K), *named)


_SIGNED = f"CASE WHEN u >= 9223372036854775808 THEN CAST(CAST(u AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST(u AS BIGINT) END"


def _sketches(prefix: str, records: str, fscale: int = FSCALE) -> str:
    """CTEs {prefix}h(id, f, u) with the distinct hashes and {prefix}s(id, f, name, n, sid) with the sketches."""
    return (
        f"{prefix}h AS MATERIALIZED (SELECT DISTINCT id, f, u FROM {_ahash(records)} WHERE u < {threshold(fscale)}), "
        f"{prefix}s AS (SELECT r.id, r.f, r.name, coalesce(n, 0) AS n, row_number() OVER (ORDER BY r.f, r.id) - 1 AS sid "
        f"FROM {records} r LEFT JOIN (SELECT id, count(*) AS n FROM {prefix}h GROUP BY id) c USING (id))"
    )


_BOTH = f"WITH {_sketches('q', _Q)}, {_sketches('d', _D)}"
_COMMON = "c AS (SELECT a.id AS qi, b.id AS di, count(*) AS num_common FROM qh a JOIN dh b USING (u) GROUP BY ALL)"
_FOUND = f"""{_BOTH}, {_COMMON}, found AS (
  SELECT qs.name AS from_name, ds.name AS to_name, num_common, least(qs.n, ds.n) AS num_kmers, false AS reverse,
    CAST(num_common AS DOUBLE) / CAST(least(qs.n, ds.n) AS DOUBLE) * 100 AS estimated_containment
  FROM c JOIN qs ON qs.id = qi JOIN ds ON ds.id = di)"""
_COLLAPSED = (
    "co AS (SELECT f, sum(n) AS n, row_number() OVER (ORDER BY f) - 1 AS sid FROM ds GROUP BY f), "
    "ch AS (SELECT DISTINCT f, u FROM dh), cn AS (SELECT f, count(*) AS h FROM ch GROUP BY f)"
)


def _pairs(common: str, left: str, right: str) -> str:
    """The final select of a comparison of sketches (name, n, h) that `common` (qi, di, num_common) joins by key."""
    rev = "q.h < d.h"
    big, low = "greatest(q.n / q.h, d.n / d.h)", "least(q.n / q.h, d.n / d.h)"
    return (
        f"SELECT CASE WHEN {rev} THEN d.name ELSE q.name END AS from_name, CASE WHEN {rev} THEN q.name ELSE d.name END AS to_name, "
        f"num_common, CAST(greatest(q.n, d.n) AS BIGINT) AS num_kmers, {rev} AS reverse, "
        f"CAST(num_common AS DOUBLE) / CAST(greatest(q.n, d.n) AS DOUBLE) * ({big} / {low}) * 100 AS estimated_containment "
        f"FROM {common} c JOIN {left} q ON q.key = c.qi JOIN {right} d ON d.key = c.di WHERE q.h > 0 AND d.h > 0"
    )


def _plain(name: str) -> str:
    return f"(SELECT id AS key, name, n, n AS h FROM {name})"


ORACLES: dict[str, str] = {
    "normalize_text": f"SELECT id AS doc_id, seq FROM {_D}",
    "reverse_complement": f"SELECT id AS doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM {_D}",
    "kmer_count": f"SELECT id AS doc_id, count(*) AS n_kmers, count(DISTINCT kmer) AS n_distinct FROM {_kmers(_D, K)} GROUP BY id",
    "kmer_canonical": f"SELECT DISTINCT id AS item_id, kmer, {_PACK} AS packed FROM {_kmers(_Q, K)}",
    "kmer_long_canonical": f"SELECT DISTINCT id AS item_id, kmer FROM {_kmers(_Q, LONG_K)}",
    "hash_ahash": f"SELECT DISTINCT id AS item_id, kmer, {_SIGNED} AS hash FROM {_ahash(_Q)}",
    "hash_murmur3": f"SELECT DISTINCT id AS item_id, kmer, {_SIGNED} AS hash FROM {_murmur(_kmers(_Q, K), [], _SWAPPED, 8)}",
    "hash_murmur3_long": f"SELECT DISTINCT id AS item_id, kmer, {_SIGNED} AS hash FROM {_murmur3_long()}",
    "hash_xxh3": f"SELECT DISTINCT id AS item_id, kmer, {_SIGNED} AS hash FROM {_xxh3()}",
    "hash_xxh3_long": f"SELECT DISTINCT id AS item_id, kmer, {_SIGNED} AS hash FROM {_xxh3_long()}",
    "sketch_fracminhash": f"WITH {_sketches('d', _D)} SELECT sid AS sketch_id, name, n AS num_kmers, {_SIGNED} AS hash FROM dh JOIN ds USING (id)",
    "sketch_bottom_n": f"""
WITH h AS (SELECT f, u FROM (SELECT f, u, row_number() OVER (PARTITION BY f ORDER BY u) AS r
  FROM (SELECT DISTINCT f, u FROM {_ahash(_D)})) WHERE r <= {NMAX}),
s AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS sid FROM (SELECT DISTINCT source AS f FROM documents)),
n AS (SELECT f, count(*) AS n FROM h GROUP BY f)
SELECT sid AS sketch_id, f AS name, n AS num_kmers, {_SIGNED} AS hash FROM h JOIN s USING (f) JOIN n USING (f)""",
    "sketch_grouped": f"""
WITH {_sketches('d', _D)}, n AS (SELECT f, count(DISTINCT u) AS n FROM dh GROUP BY f)
SELECT row_number() OVER (ORDER BY f) - 1 AS sketch_id, f AS file_name, coalesce(n, 0) AS num_kmers, coalesce(n, 0) AS num_hashes
FROM (SELECT DISTINCT f FROM ds) LEFT JOIN n USING (f)""",
    "sketch_singleton": f"WITH {_sketches('d', _D)} SELECT sid AS sketch_id, f AS file_name, name, n AS num_kmers FROM ds",
    "sketch_collapse": f"""
WITH {_sketches('d', _D)}, {_COLLAPSED}
SELECT sid AS sketch_id, f AS file_name, CAST(n AS BIGINT) AS num_kmers, coalesce(h, 0) AS num_hashes FROM co LEFT JOIN cn USING (f)""",
    "sketch_union": f"""{_BOTH}
SELECT sid AS sketch_id, f AS file_name, name, n AS num_kmers FROM qs
UNION ALL SELECT sid + (SELECT count(*) FROM qs), f, name, n FROM ds""",
    "index_postings": f"""
WITH {_sketches('d', _D)}
SELECT {_SIGNED} AS hash, count(*) AS n, string_agg(sid, ',' ORDER BY sid) AS sketch_ids FROM dh JOIN ds USING (id) GROUP BY u""",
    "index_summary": f"""
WITH {_sketches('d', _D)} SELECT (SELECT count(*) FROM ds) AS num_sketches, (SELECT count(*) FROM dh) AS num_postings""",
    "index_detail": f"""
WITH {_sketches('d', _D)}
SELECT sid AS sketch_id, f AS file_name, 'Some({FSCALE})' AS fscale, CAST({K} AS INTEGER) AS kmer_size, n AS num_hashes FROM ds""",
    "index_coarser": f"""
WITH {_sketches('d', _D, 50)} SELECT sid AS sketch_id, name, n AS num_hashes, CAST(50 AS BIGINT) AS fscale FROM ds""",
    "exchange_signatures": f"""
WITH {_sketches('q', _Q)}, l AS (SELECT id, string_agg(CAST(u AS VARCHAR), ',' ORDER BY u) AS mins FROM qh GROUP BY id)
SELECT f AS filename, CAST({K} AS INTEGER) AS ksize, 'dna' AS molecule, CAST(n AS INTEGER) AS n_mins, coalesce(mins, '') AS mins
FROM qs LEFT JOIN l USING (id)""",
    "exchange_round_trip": f"""
WITH {_sketches('q', _Q)}
SELECT sid AS sketch_id, f AS file_name, 'ahash' AS algorithm, CAST({FSCALE} AS BIGINT) AS fscale, n AS num_kmers, {_SIGNED} AS hash
FROM qh JOIN qs USING (id, f)""",
    "index_round_trip": f"{_FOUND} SELECT * FROM found WHERE estimated_containment > 0",
    "search_containment": f"{_FOUND} SELECT * FROM found WHERE estimated_containment > 0",
    "search_cutoff": f"{_FOUND} SELECT * FROM found WHERE estimated_containment > 50",
    "compare_pairwise": f"{_BOTH}, {_COMMON} {_pairs('c', _plain('qs'), _plain('ds'))}",
    "compare_collapsed": f"""{_BOTH}, {_COLLAPSED},
cc AS (SELECT a.id AS qi, b.f AS di, count(*) AS num_common FROM qh a JOIN ch b USING (u) GROUP BY ALL)
{_pairs('cc', _plain('qs'), '(SELECT f AS key, f AS name, n, h FROM co JOIN cn USING (f))')}""",
    "compare_prefix": f"""
WITH {_sketches('d', _D)}, l AS (SELECT id, list(u ORDER BY u) AS l FROM dh GROUP BY id),
p AS (
  SELECT a.id AS qi, b.id AS di,
    len(list_filter(range(1, least(len(a.l), len(b.l)) + 1), lambda i: a.l[1:i] = b.l[1:i])) AS num_common
  FROM l a JOIN l b ON a.l[1] = b.l[1]
) {_pairs('p', _plain('ds'), _plain('ds'))}""",
    "compare_all_pairs": f"""
WITH {_sketches('q', _Q)}, c AS (
  SELECT a.id AS qi, b.id AS di, count(x.u) AS num_common FROM qs a CROSS JOIN qs b
  LEFT JOIN (SELECT g.id AS gi, h.id AS hi, g.u FROM qh g JOIN qh h USING (u)) x ON gi = a.id AND hi = b.id GROUP BY ALL
) {_pairs('c', _plain('qs'), _plain('qs'))}""",
    "result_lines": f"""{_FOUND}
SELECT from_name AS query, to_name AS target, CAST(num_common AS VARCHAR) AS num_common, CAST(num_kmers AS VARCHAR) AS num_kmers,
  printf('%.2f', estimated_containment) AS containment
FROM found WHERE estimated_containment > 0""",
}
