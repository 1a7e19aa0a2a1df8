import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from strandmill.functions import hashing, sequences

PACKED = np.array([0xAAAAAAAAAAAAAAA], dtype=np.uint64)
BYTES = np.frombuffer(b"A" * 11, dtype=np.uint8).reshape(1, -1)


@pytest.mark.parametrize(
    ("function", "value", "expected"),
    [
        (hashing.ahash, PACKED, 6369629604220809163),
        (hashing.murmur3, BYTES, 7773142420371383521),
        (hashing.murmur3_u64, PACKED, 442865051503200633),
        (hashing.xxh3, BYTES, 10563560822279786210),
        (hashing.xxh3_u64, PACKED, 5855080426738543665),
    ],
)
def test_known_hash_values(function, value, expected):
    assert int(function(value)[0]) == expected


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20))
def test_xxh3_of_integers_is_xxh3_of_their_bytes(values):
    found = hashing.xxh3_u64(np.array(values, dtype=np.uint64))
    assert found.tolist() == [xxhash.xxh3_64_intdigest(v.to_bytes(8, "big")) for v in values]


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20))
def test_ahash_is_a_folded_product(values):
    for v, h in zip(values, hashing.ahash(np.array(values, dtype=np.uint64)).tolist(), strict=True):
        product = (v ^ 0xE12119C4114F22A7) * 6364136223846793005
        folded = (product & (2**64 - 1)) ^ (product >> 64)
        assert h == ((folded << 37) | (folded >> 27)) & (2**64 - 1)


@pytest.mark.parametrize("function", [hashing.ahash, hashing.murmur3_u64, hashing.xxh3_u64])
def test_hashes_are_uniform_and_bits_balanced(function):
    values = np.sort(function(np.arange(10**11, 10**11 + 100_000, dtype=np.uint64)))
    steps = np.arange(1, len(values) + 1) / len(values)
    assert np.abs(values / 2.0**64 - steps).max() < 0.005
    for bit in range(64):
        assert 0.49 < ((values >> np.uint64(bit)) & np.uint64(1)).mean() < 0.51


@pytest.mark.parametrize("k", [21, 32])
def test_dispatch(k):
    for name in ("default", "murmur3", "xxhash"):
        assert callable(hashing.hash_function(name, k))
    if k < 32:
        assert hashing.hash_function("default", k) is hashing.hash_function("ahash", k)
    else:
        assert hashing.hash_function("default", k) is hashing.hash_function("xxhash", k)
        with pytest.raises(ValueError):
            hashing.hash_function("ahash", k)
    with pytest.raises(ValueError):
        hashing.hash_function("md5", k)


def test_threshold_is_floating_point():
    top = 2**64 - 1
    assert [hashing.threshold(s) for s in (None, 0, 1)] == [top] * 3
    assert hashing.threshold(10) == 1844674407370955264
    assert hashing.threshold(50) == 368934881474191040
    assert hashing.threshold(3) == 6148914691236516864


def brute_kmers(seq, k):
    clean = "".join({"U": "T"}.get(c, c) for c in seq.upper() if c not in " \t\r\n")
    out = []
    for i in range(len(clean) - k + 1):
        w = clean[i : i + k]
        if set(w) <= set("ACGT"):
            r = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
            out.append(min(w, r))
    return out


@pytest.mark.parametrize("k", [1, 5, 21, 31])
def test_packed_kmers_against_strings(k):
    rng = random.Random(k)
    seq = "".join(rng.choice("ACGTacgtuUN- \n.x") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(500))
    packed = sequences.packed_kmers(sequences.normal_bytes(seq), k)
    expected = [int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in brute_kmers(seq, k)]
    assert packed.tolist() == expected


@pytest.mark.parametrize("k", [32, 33, 50])
def test_byte_kmers_against_strings(k):
    rng = random.Random(k)
    seq = "".join(rng.choice("ACGTN") if rng.random() < 0.05 else rng.choice("ACGT") for _ in range(600))
    rows = sequences.byte_kmers(sequences.normal_bytes(seq), k)
    assert [bytes(r).decode() for r in rows] == brute_kmers(seq, k)
    for row, h in zip(rows[:20], hashing.xxh3(rows[:20]).tolist(), strict=True):
        assert h == xxhash.xxh3_64_intdigest(bytes(row))


@pytest.mark.parametrize("nmax", [None, 0, 1, 7, 10_000])
def test_sketch_kernel(nmax, monkeypatch):
    monkeypatch.setattr(sequences, "_WINDOWS", 64)  # pieces must overlap by k - 1
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(700))
    kernel = hashing.hash_function("ahash", 21)
    limit = hashing.threshold(3)
    found = sequences.sketch_sequence(seq, 21, kernel, limit, nmax)
    packed = [int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in brute_kmers(seq, 21)]
    every = sorted({int(h) for h in kernel(np.array(packed, dtype=np.uint64)) if int(h) < limit})
    assert found.tolist() == every[:nmax]
    assert len(sequences.sketch_sequence(None, 21, kernel, limit, nmax)) == 0
    assert len(sequences.sketch_sequence("ACGT", 21, kernel, limit, nmax)) == 0


def test_column_functions(spark):
    rows = [("ac gu\nT.~-x",), ("",), (None,)]
    df = spark.createDataFrame(rows, "seq string")
    out = df.select(sequences.normalise(df.seq).alias("n"), sequences.reverse_complement(sequences.normalise(df.seq)).alias("r"))
    assert [tuple(r) for r in out.collect()] == [("ACGTT---N", "N---AACGT"), ("", ""), (None, None)]


def test_unsigned_columns(spark):
    values = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    bits = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    df = spark.createDataFrame(bits, "h long").orderBy(sequences.unsigned_order(sequences.F.col("h")))
    assert [int(r[0]) for r in df.select(sequences.unsigned_decimal(df.h)).collect()] == values
