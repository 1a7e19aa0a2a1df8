import gzip
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from strandmill.functions.hashing import hash_function, threshold
from strandmill.functions.sequences import sketch_sequence
from strandmill.operators.index import coarser, hash_values, index_detail, index_summary, open_index, write_index
from strandmill.operators.search import compare, result_lines, search, two_decimals
from strandmill.operators.sketch import collapse, sketch, union
from strandmill.sources.exchange import read_exchange, to_exchange, write_exchange
from strandmill.sources.fastx import read_fasta, read_fastx, read_records, split_parts
from strandmill.sources.paths import has_sequence_extension, resolve
from strandmill.sources.results import print_results, write_results
from strandmill.streaming.screen import screen
from strandmill.types import Sketches


def dna(seed, size):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(size))


def records(spark, rows):
    return spark.createDataFrame(rows, "file_name string, ordinal long, name string, seq string")


def made(spark, sketches, k=21):
    """Sketches from {name: (hashes, num_kmers)}."""
    sigs = [(i, n, n, kmers, len(h), k, None, "ahash") for i, (n, (h, kmers)) in enumerate(sketches.items())]
    columns = "sketch_id long, file_name string, name string, num_kmers long, num_hashes long, kmer_size int, fscale long, algorithm string"
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    postings = [(signed(v), i) for i, (h, _) in enumerate(sketches.values()) for v in h]
    return Sketches(
        spark.createDataFrame(sigs, columns), spark.createDataFrame(postings, "hash long, sketch_id long"), k, None, "ahash"
    )


def hashes_of(sketches):
    named = hash_values(sketches).join(sketches.sigs.select("sketch_id", "name"), "sketch_id")
    out = {r["name"]: [] for r in sketches.sigs.collect()}
    for r in named.collect():
        out[r["name"]].append(int(r["hash"]))
    return {n: sorted(h) for n, h in out.items()}


def expected(seqs, fscale, nmax=None, k=21, algorithm="ahash"):
    kernel = hash_function(algorithm, k)
    found = set()
    for s in seqs:
        found |= set(sketch_sequence(s, k, kernel, threshold(fscale), None).tolist())
    return sorted(found)[:nmax]


ROWS = [("f1", 0, "a", dna(1, 400)), ("f1", 1, "b", dna(1, 400)[:200] + dna(2, 100)), ("f0", 0, "c", "ACGT"), ("f0", 1, "d", None)]


@pytest.mark.parametrize(("fscale", "nmax"), [(None, None), (1, 5), (2, None), (10, None), (None, 0), (None, 10_000)])
def test_sketch_of_files_and_records(spark, fscale, nmax):
    df = records(spark, ROWS)
    whole = sketch(df, 21, fscale, nmax)
    assert hashes_of(whole) == {"f0": [], "f1": expected([ROWS[0][3], ROWS[1][3]], fscale, nmax)}
    assert [r["file_name"] for r in whole.sigs.orderBy("sketch_id").collect()] == ["f0", "f1"]
    single = sketch(df, 21, fscale, nmax, singleton=True)
    assert hashes_of(single) == {n: expected([s], fscale, nmax) for _, _, n, s in ROWS}
    assert [r["name"] for r in single.sigs.orderBy("sketch_id").collect()] == ["c", "d", "a", "b"]
    assert all(r["num_kmers"] == len(expected([s], fscale, nmax)) for r in single.sigs.collect() for _, _, n, s in ROWS if n == r["name"])


def test_large_batches_are_sketched_in_slices(spark):
    """However many rows a batch has, about half a megabyte of it are strings at once; no row goes, whatever its length."""
    import pyarrow as pa

    from strandmill.functions import sequences

    texts = [None, "", dna(1, 400)] + [dna(i, 1000) * (800 if i == 5 else 60) for i in range(2, 40)] + [None, dna(3, 50), ""]
    slices = list(sequences._slices(pa.array(texts)))
    assert [x for part in slices for x in part] == texts and list(sequences._slices(pa.array([], pa.string()))) == []
    assert all(sum(map(len, filter(None, part))) <= 2 * sequences._TEXT or sum(len(x or "") > sequences._TEXT for x in part) == 1 for part in slices)
    assert len(slices) > 3
    df = records(spark, [("f", i, f"r{i}", t) for i, t in enumerate(texts)]).coalesce(1)
    kernel, limit = hash_function("ahash", 21), threshold(50)
    rows = df.select("seq", sequences.sketch_column(F.col("seq"), 21, 50, None, "ahash").alias("h"), sequences.kmer_counts(F.col("seq"), 21).alias("n"))
    for text, r in zip(texts, rows.collect(), strict=True):
        kmers = sequences.packed_kmers(sequences.normal_bytes(text or ""), 21)
        assert r["seq"] == text and [h % 2**64 for h in r["h"]] == sketch_sequence(text, 21, kernel, limit, None).tolist()
        assert tuple(r["n"]) == (len(kmers), len(set(kmers.tolist())))


def test_memory_of_a_batch_does_not_grow_with_its_rows(monkeypatch):
    """What the sketch step and the counts hold beside a batch in Arrow is the same for four times the rows."""
    import tracemalloc

    import pyarrow as pa

    from strandmill.functions import sequences

    monkeypatch.setattr(sequences, "arrow_udf", lambda kind: lambda made: made)
    bases = dna(1, 8000)
    texts = [bases[i : i + 4000] for i in range(1200)]
    kernel, limit = hash_function("ahash", 21), threshold(10)
    for column in (lambda b: sequences.sketch_column(b, 21, 10, None, "ahash"), lambda b: sequences.kmer_counts(b, 21)):
        peaks = []
        for rows in (300, 1200):
            batch, seen = pa.array(texts[:rows]), 0
            tracemalloc.start()
            for part in column(iter([batch])):
                if pa.types.is_list(part.type):
                    for text, found in zip(texts[seen : seen + 2], part.slice(0, 2).to_pylist(), strict=False):
                        assert [h % 2**64 for h in found] == sketch_sequence(text, 21, kernel, limit, None).tolist()
                seen += len(part)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert seen == rows
        assert peaks[1] < 1.5 * peaks[0]


def test_long_kmers_and_custom_hash(spark):
    df = records(spark, ROWS[:2])
    assert hashes_of(sketch(df, 33, None, None, "murmur3"))["f1"] == expected([ROWS[0][3], ROWS[1][3]], None, None, 33, "murmur3")
    custom = sketch(df, 21, None, None, lambda packed: packed)
    assert custom.algorithm == "custom" and custom.postings.count() > 0
    with pytest.raises(ValueError):
        sketch(df, 33, algorithm="ahash")


def test_sketch_of_nothing(spark):
    empty = sketch(records(spark, []), 21)
    assert empty.sigs.count() == 0 and empty.postings.count() == 0


def test_collapse_and_union(spark):
    single = sketch(records(spark, ROWS), 21, singleton=True)
    folded = collapse(single)
    row = folded.sigs.where("file_name = 'f1'").first()
    one, two = (expected([s], None) for s in (ROWS[0][3], ROWS[1][3]))
    assert (row["num_kmers"], row["num_hashes"]) == (len(one) + len(two), len(set(one) | set(two)))
    both = union(single, sketch(records(spark, ROWS[:1]), 21))
    assert sorted(r["sketch_id"] for r in both.sigs.collect()) == list(range(5))
    assert hashes_of(both)["f1"] == one
    with pytest.raises(ValueError):
        union(single, sketch(records(spark, ROWS), 15))


def test_compare_counts_the_intersection_or_the_prefix(spark):
    a, b = made(spark, {"a": ([1, 2, 3], 3)}), made(spark, {"b": ([1, 2, 4], 3)})
    row = compare(a, b).first()
    assert tuple(row) == ("a", "b", 2, 3, False, pytest.approx(66.66666666666666, abs=0))
    assert compare(a, b, overlap="prefix").first()["num_common"] == 2
    shifted = made(spark, {"s": ([2, 3, 4], 3)})
    assert compare(a, shifted).first()["num_common"] == 2
    assert compare(a, shifted, overlap="prefix").count() == 0
    top = made(spark, {"t": ([2**63 + 5, 1], 2)}), made(spark, {"u": ([1, 2**63 + 5, 2**64 - 1], 3)})
    row = compare(*top, overlap="prefix").first()
    assert (row["from_name"], row["to_name"], row["num_common"], row["reverse"]) == ("u", "t", 2, True)


def common_prefix(one, two):
    return next((i for i, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))


@pytest.mark.parametrize("same", [True, False])
def test_prefixes_of_many_copies(spark, monkeypatch, same):
    """All pairs against brute force where large groups of copies, outliers and ends meet; pairs don't shuffle before the order."""
    from strandmill.operators import search as module

    monkeypatch.setattr(module, "_TILE", 4, raising=False)
    rng = random.Random(13)
    stem = sorted(rng.getrandbits(64) for _ in range(12))
    lists = [stem] * 15 + [stem[:i] for i in (1, 5, 5, 12)] + [stem[:i] + sorted(h + 1 for h in stem[i:]) for i in (1, 5, 7, 7, 11)]
    lists += [sorted([stem[0], *(rng.randrange(stem[0] + 1, 2**64) for _ in range(3))]) for _ in range(9)] + [[7], [8, 9], []]
    named = [{f"{mark}{i}": (h, len(h)) for i, h in enumerate(lists if mark == "a" else lists[::2])} for mark in "ab"]
    one = made(spark, named[0])
    two = one if same else made(spark, named[1])
    right = named[0] if same else named[1]
    wanted = {(a, b): n for a, (x, _) in named[0].items() for b, (y, _) in right.items() if (n := common_prefix(x, y))}
    result = compare(one, two, overlap="prefix")
    rows = [(r["to_name"], r["from_name"], r["num_common"]) if r["reverse"] else (r["from_name"], r["to_name"], r["num_common"]) for r in result.collect()]
    assert len(rows) == len(wanted) and {(a, b): n for a, b, n in rows} == wanted
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, sketch_id|hashpartitioning\(sketch_id#\d+L?, query_id", result._jdf.queryExecution().toString())


def test_compare_ratio_cutoff_and_empty_sides(spark):
    a = made(spark, {"a": ([1, 2, 3, 4], 8), "none": ([], 0)})
    b = made(spark, {"b": ([1, 2, 9], 3), "far": ([100], 1)})
    row = compare(a, b).first()
    assert row["estimated_containment"] == 2 / 8 * (2.0 / 1.0) * 100.0
    assert compare(a, b, 25.0).count() == 0 and compare(a, b, 24.9).count() == 1
    assert {(r["from_name"], r["to_name"], r["num_common"]) for r in compare(a, b, -1.0).collect()} == {("a", "b", 2), ("a", "far", 0)}
    with pytest.raises(ValueError):
        compare(a, made(spark, {"x": ([1], 1)}, k=15))
    with pytest.raises(ValueError):
        compare(a, b, overlap="union")


def test_search_and_lines(spark, tmp_path, capsys):
    index = made(spark, {"t1": ([1, 2, 3, 4], 4), "t2": ([3, 9], 2), "t3": ([50], 1)})
    query = made(spark, {"q": ([1, 2, 3], 3)})
    rows = [tuple(r) for r in search(index, query).collect()]
    assert rows == [("q", "t1", 3, 3, False, 100.0), ("q", "t2", 1, 2, False, 50.0)]
    assert search(index, query, 50.0).count() == 1
    write_results(search(index, query), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    print_results(search(index, query))
    assert capsys.readouterr().out == "q\tt1\t3\t3\t100.00\nq\tt2\t1\t2\t50.00\n"
    flipped = compare(made(spark, {"q": ([1], 1)}), made(spark, {"t": ([1, 2], 2)}))
    assert result_lines(flipped).first()["line"].startswith("q\tt\t1\t2\t")


def test_index_round_trip(spark, tmp_path):
    single = sketch(records(spark, ROWS), 21, 2, singleton=True)
    path = str(tmp_path / "index")
    write_index(single, path)
    opened = open_index(spark, path)
    assert (opened.k, opened.fscale, opened.algorithm) == (21, 2, "default")
    assert hashes_of(opened) == hashes_of(single)
    summary = index_summary(opened).first()
    assert (summary["num_sketches"], summary["num_postings"]) == (4, single.postings.count())
    assert {r["fscale"] for r in index_detail(opened).collect()} == {"Some(2)"}
    assert hashes_of(coarser(opened, 10)) == hashes_of(sketch(records(spark, ROWS), 21, 10, singleton=True))
    plan = coarser(opened, 10).postings._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(hash), GreaterThanOrEqual(hash,0), LessThan(hash" in plan
    write_index(sketch(records(spark, ROWS), 15), path, mode="append")
    with pytest.raises(ValueError):
        open_index(spark, path)


def test_exchange_round_trip(spark, tmp_path):
    for fscale, algorithm in ((None, "murmur3"), (10, "xxhash")):
        single = sketch(records(spark, ROWS[:2]), 21, fscale, None, algorithm, singleton=True)
        path = str(tmp_path / f"x{fscale}")
        write_exchange(single, path)
        back = read_exchange(spark, path)
        assert (back.k, back.fscale, back.algorithm) == (21, fscale, algorithm)
        assert sorted(map(tuple, hash_values(back).collect())) == sorted(map(tuple, hash_values(single).collect()))
        document = json.loads(spark.read.text(path).first()["value"])[0]
        assert [len(s["mins"]) for s in document["signatures"]] == [len(expected([s], fscale, None, 21, algorithm)) for _, _, _, s in ROWS[:2]]
        assert document["signatures"][0]["max_hash"] == threshold(fscale)
    assert to_exchange(single).first()["hash_function"] == "0.xxhash3"


def test_fastx_source(spark, tmp_path):
    seq = dna(5, 1000)
    fasta, zipped, fastq = tmp_path / "a.fa", tmp_path / "b.fasta.gz", tmp_path / "c.fq"
    fasta.write_text(">one [x y]\n" + "\n".join(seq[i : i + 60] for i in range(0, 1000, 60)) + "\n>two\nACGT\n>empty\n")
    with gzip.open(zipped, "wt") as out:
        out.write(">z\r\nAC\r\nGT\r\n")
    fastq.write_text("@r1\nACGTN\n+\nIIIII\n@r2\nAC\n+r2\nII\n")
    rows = read_fastx(spark, [str(fasta), str(zipped), str(fastq)]).collect()
    found = {(r["file_name"].rsplit("/", 1)[1], r["ordinal"], r["name"], r["seq"]) for r in rows}
    assert found == {
        ("a.fa", 0, "one [x y]", seq), ("a.fa", 1, "two", "ACGT"), ("a.fa", 2, "empty", ""), ("b.fasta.gz", 0, "z", "ACGT"),
        ("c.fq", 0, "r1", "ACGTN"), ("c.fq", 1, "r2", "AC"),
    }
    parts = read_fastx(spark, str(fasta), k=21, chunk=100)
    assert parts.where("ordinal = 0").count() > 5
    assert hashes_of(sketch(parts, 21, singleton=True))["one [x y]"] == expected([seq], None)
    (tmp_path / "bad.fa").write_text("hello\n")
    with pytest.raises(Exception, match="neither FASTA nor FASTQ"):
        read_fastx(spark, str(tmp_path / "bad.fa")).collect()


def test_parts_overlap():
    seq = dna(7, 333)
    parts = list(split_parts(iter([seq[i : i + 10] for i in range(0, 333, 10)]), 50, 20))
    assert parts[0] + "".join(p[20:] for p in parts[1:]) == seq


def test_paths(tmp_path):
    for extension, good in (("fasta", True), ("fa", True), ("fastq", True), ("fq", True), ("gz", True), ("txt", False), ("list", False), ("FA", False)):
        assert has_sequence_extension(f"x.{extension}") is good
    for name in ("a.fa", "b.txt", "c"):
        (tmp_path / name).write_text(">x\nA\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.fa").write_text(">x\nA\n")
    assert resolve(str(tmp_path)) == [str(tmp_path / "a.fa")]
    listing = tmp_path / "files.list"
    listing.write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.txt\n{tmp_path}/missing.fa\n\n")
    assert resolve([str(listing), str(tmp_path / "deep")]) == [str(tmp_path / "a.fa"), str(tmp_path / "deep" / "d.fa")]
    listing.write_text(f"{tmp_path}/c\n")
    for bad in (str(listing), str(tmp_path / "b.txt"), str(tmp_path / "c")):
        with pytest.raises(ValueError):
            resolve(bad)
    assert resolve(str(tmp_path / "b.txt"), check_extension=False) == [str(tmp_path / "b.txt")]
    with pytest.raises(FileNotFoundError):
        resolve(str(tmp_path / "none.fa"))


def test_screening_a_stream(spark, tmp_path):
    index = sketch(records(spark, ROWS[:1]), 21, 2, singleton=True)
    records(spark, [("s", 0, "hit", ROWS[0][3][50:300]), ("s", 1, "miss", dna(9, 200))]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_name string, ordinal long, name string, seq string").parquet(str(tmp_path / "in"))
    found = []
    query = screen(stream, index, lambda df, number: found.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["from_name"], r["to_name"], r["estimated_containment"]) for r in found] == [("hit", "a", 100.0)]


def test_queries_have_oracles():
    from strandmill.plans import tables

    assert set(tables.ORACLES) == set(tables.QUERIES)


#: Fixed value: a sequence whose signature for k = 33 and murmur3 (seed 42) is known from another program.
KNOWN = (
    "GATAATTTATCCACAGCTTGTGGAAAACCTTATCCACAACTGCTTTGAATTTGAGTTTATTTACAGAAGGTTGCTTTTTTGAGCGCAAATTCCTTTATTATTGAGTAATA"
    "CTCCACTCCTTTTATTTTACTTCCTTCTCTTTTACGCACGTATAAAGAACCTATCTCTTTTTCAATTTCCTTTAAGAGTTCATCTTTTGTTATTTCGCTTTTTAGGAATA"
    "GCTCTTTAAAATAAGAAGGCAACCAAAAAAAACTATGTCCACTTTTTTATATTTTAATTCTTCCTCATACTCTTCTTTTCTTTTTTTCATATCTTCAAGAATGAGGCTAA"
    "CATTACCATGTGGGGAGGATAAACTTTTTAAAATATCTGAATATGCTATAACAGTCATCTTTCTTGCTCCTTTATTTTTTTTAGTATAACAATTAGATTGAATTAACCAT"
    "GACAGATGTGGATAACTTGGTTAGAATGGCGACCCCTTCACCTACAGGGTAGGGGTAAATAGTCTTTTTTGAATTTAAAATTGAATGAAGGGGTTTCACATGCTTTGGAC"
    "GGACTGCTTAACTCGCTTGCGACAAGAGCTCTCTGATAATGTCTTTGCCATGTGG"
)


def test_known_signature(spark, tmp_path):
    """All 573 hashes of the known signature, from a FASTA file to exchange JSON and back."""
    (tmp_path / "known.fa").write_text(">known [modified]\n" + "\n".join(KNOWN[i : i + 60] for i in range(0, len(KNOWN), 60)))
    made_of_it = sketch(read_fastx(spark, str(tmp_path / "known.fa"), k=33), 33, None, None, "murmur3")
    write_exchange(made_of_it, str(tmp_path / "sig"))
    lines = [x for p in (tmp_path / "sig").glob("part-*") for x in p.read_text().splitlines()]
    (signature,) = json.loads(lines[0])
    (known,) = signature["signatures"]
    mins = known["mins"]
    assert len(mins) == 573 and mins[:3] == [19916266331765313, 49612108431566693, 127080787518776276] and mins[-1] == 18429209458639152291
    assert hashlib.sha256(",".join(map(str, mins)).encode()).hexdigest() == "a6cbd286cb8b7feb95acd95ddcaa6894f2e92e6e03b2893b529101fb7902030f"
    assert (known["num"], known["ksize"], known["seed"], known["max_hash"], known["molecule"]) == (0, 33, 42, 2**64 - 1, "dna")
    assert signature["hash_function"] == "0.murmur64"
    # the same file as other programs write it: a class name of their own and no name
    signature["class"] = "another"
    signature.pop("name", None)
    (tmp_path / "other.sig").write_text(json.dumps([signature]))
    read = read_exchange(spark, str(tmp_path / "other.sig"))
    assert (read.k, read.fscale, read.algorithm) == (33, None, "murmur3")
    assert hashes_of(read) == {signature["filename"]: mins}
    known["molecule"] = "protein"
    (tmp_path / "protein.sig").write_text(json.dumps([signature]))
    with pytest.raises(ValueError):
        read_exchange(spark, str(tmp_path / "protein.sig"))


def test_two_decimals_round_the_exact_value(spark):
    rng = random.Random(5)
    values = [0.0, 0.125, 3.125, 3.375, 0.005, 0.015, 2.675, 1.005, 99.995, 100.0, 66.66666666666666, 0.375 + 2**-54, 12.5, 1e-9]
    values += [rng.randrange(1, 400) / rng.randrange(400, 900) * 100.0 for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("s", two_decimals(F.col("v")))
    assert [r["s"] for r in df.orderBy("i").collect()] == [f"{v:.2f}" for v in values]


def test_all_pairs_have_a_bound(spark):
    a, b = made(spark, {"a": ([1], 1), "b": ([2], 1)}), made(spark, {"c": ([1], 1)})
    assert compare(a, b, -1.0, most_pairs=2).count() == 2
    with pytest.raises(ValueError):
        compare(a, b, -1.0, most_pairs=1)


def test_kmer_counts(spark, monkeypatch):
    from strandmill.functions import sequences

    seqs = [dna(3, 300), dna(3, 300) * 2, "ACGT" * 20 + "N" + "acgu" * 20, "ACG", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s string").select("i", sequences.kmer_counts(F.col("s"), 21).alias("n"))
    for r in rows.collect():
        found = sequences.packed_kmers(sequences.normal_bytes(seqs[r["i"]] or ""), 21).tolist()
        assert tuple(r["n"]) == (len(found), len(set(found)))


def test_fasta_by_byte_ranges(spark, tmp_path):
    """The same records and order as the streaming reader, from small splits and from compressed files."""
    rng = random.Random(11)
    text = "".join(f">r{i} x>y\n" + "\n".join(dna(i, rng.randrange(1, 90)) for _ in range(rng.randrange(0, 5))) + "\n" for i in range(300))
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">only\r\nACGT ac\r\nGT\r\n>\n")
    with gzip.open(tmp_path / "c.fa.gz", "wt") as out:
        out.write(text[: len(text) // 2])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        found = read_fasta(spark, str(tmp_path), 5, 40).collect()
        assert read_fasta(spark, str(tmp_path / "a.fa"), 5, 40).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    def whole(rows):
        out = {}
        for r in sorted(rows, key=lambda r: (r["file_name"], r["ordinal"], r["part"])):
            key = (r["file_name"].rsplit("/", 1)[1], r["ordinal"], r["name"])
            out[key] = out.get(key, "")[: r["part"] * 40] + r["seq"]
        return out
    expected_rows = [(f"/{n}", i, name, 0, "".join("".join(x.split()) for x in lines)) for n in ("a.fa", "b.fa", "c.fa.gz")
                     for i, (name, lines) in enumerate((a, list(b)) for a, b in read_records(str(tmp_path / n)))]
    assert whole(found) == {(f[1:], i, n): s for f, i, n, _, s in expected_rows}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "d.fa").write_text("ACGT\n>x\nA\n")
    with pytest.raises(Exception, match="not FASTA"):
        read_fasta(spark, str(tmp_path / "bad")).collect()


def test_command_line(spark, tmp_path, capsys):
    from strandmill.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(f">a\n{dna(1, 400)}\n")
    (tmp_path / "in" / "b.fa").write_text(f">b\n{dna(1, 400)[:200]}{dna(2, 100)}\n")
    (tmp_path / "in" / "notes.txt").write_text("x")
    (tmp_path / "q.fa").write_text(f">q\n{dna(1, 400)[:150]}\n")
    index, exchange, source = str(tmp_path / "index"), str(tmp_path / "sig"), str(tmp_path / "in")
    main(["-s", "sketch", source, "-o", index, "--algorithm", "ahash"])
    main(["-s", "sketch", source, "-o", exchange, "--format", "exchange", "--algorithm", "ahash"])
    main(["stats", "-i", index, "-s"])
    assert capsys.readouterr().out.split() == ["2", str(380 + 280)]
    main(["stats", "-i", index])
    assert [x.split("\t")[4] for x in capsys.readouterr().out.splitlines()] == ["380", "280"]
    main(["dist", "-i", str(tmp_path / "q.fa"), "-d", index])
    assert [x.split("\t")[2:] for x in capsys.readouterr().out.splitlines()] == [["130", "130", "100.00"]] * 2
    main(["dist", "-i", str(tmp_path / "q.fa"), "-d", exchange, "-o", str(tmp_path / "out")])
    lines = [x.split("\t") for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x[2:] for x in lines] == [["130", "280", "46.43"], ["130", "380", "34.21"]]
    with pytest.raises(SystemExit):
        main(["sketch", str(tmp_path / "none.fa"), "-o", str(tmp_path / "x")])
