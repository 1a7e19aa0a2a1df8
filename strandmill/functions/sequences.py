"""Nucleotide sequences: normalising, reverse complement, canonical k-mers and the fused sketch kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf, pandas_udf

from strandmill.functions.hashing import hash_function, threshold

#: K-mer windows handled at once; bounds the memory of a long sequence.
_WINDOWS = 1 << 18

#: Bytes of text that are strings at once.
_TEXT = 1 << 19


def normalise(seq: Column) -> Column:
    """White space removed, upper case, U as T, gaps as `-`, anything else but ACGTN as N."""
    bare = F.translate(seq, " \t\r\n", "")
    upper = F.translate(bare, "acgtnuU.~", "ACGTNTT--")
    return F.regexp_replace(upper, "[^ACGTN-]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def _normal_bytes() -> np.ndarray:
    out = np.full(256, ord("N"), dtype=np.uint8)
    for letters, to in (("Aa", "A"), ("Cc", "C"), ("Gg", "G"), ("TtUu", "T"), (".~-", "-")):
        out[[ord(x) for x in letters]] = ord(to)
    return out


_NORMAL = _normal_bytes()
_SPACES = np.isin(np.arange(256), [ord(x) for x in " \t\r\n"])
_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[[ord(x) for x in "ACGT"]] = range(4)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[[ord(x) for x in "ACGT"]] = [ord(x) for x in "TGCA"]


def normal_bytes(seq: str) -> np.ndarray:
    """`normalise` on bytes."""
    data = np.frombuffer(seq.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return _NORMAL[data[~_SPACES[data]]]


def packed_kmers(data: np.ndarray, k: int) -> np.ndarray:
    """Canonical k-mers (k < 32) of normalised bytes as integers, first base most significant; others are left out."""
    code = _CODE[data]
    size = len(code) - k + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    bad = np.concatenate([[0], np.cumsum(code == 4)])
    good = np.flatnonzero(bad[k:] == bad[:-k])
    forward, backward = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
    for i in range(k):
        base = code[i : i + size].astype(np.uint64)
        forward = (forward << np.uint64(2)) | base
        backward |= (np.uint64(3) - base) << np.uint64(2 * i)
    return np.minimum(forward[good], backward[good])


def byte_kmers(data: np.ndarray, k: int) -> np.ndarray:
    """Canonical k-mers of normalised bytes as rows of bytes; windows with other than ACGT are left out."""
    size = len(data) - k + 1
    if size <= 0:
        return np.empty((0, k), dtype=np.uint8)
    bad = np.concatenate([[0], np.cumsum(_CODE[data] == 4)])
    good = np.flatnonzero(bad[k:] == bad[:-k])
    forward = np.lib.stride_tricks.sliding_window_view(data, k)[good]
    backward = _COMPLEMENT[forward[:, ::-1]]
    differ = forward != backward
    first = differ.argmax(axis=1)
    rows = np.arange(len(forward))
    return np.where((forward[rows, first] <= backward[rows, first])[:, None], forward, backward)


def _pieces(seq: str | None, k: int) -> Iterator[np.ndarray]:
    """The k-mers of a sequence, a bounded number at once."""
    data = normal_bytes(seq or "")
    step = _WINDOWS if k < 32 else max(1024, _WINDOWS // k)
    for first in range(0, max(0, len(data) - k + 1), step):
        part = data[first : first + step + k - 1]
        yield packed_kmers(part, k) if k < 32 else byte_kmers(part, k)


def sketch_sequence(
    seq: str | None, k: int, kernel: Callable[[np.ndarray], np.ndarray], limit: int, nmax: int | None
) -> np.ndarray:
    """The sorted distinct hashes below `limit` of a sequence's canonical k-mers, the `nmax` smallest if given."""
    found = np.empty(0, dtype=np.uint64)
    for kmers in _pieces(seq, k):
        hashes = kernel(kmers)
        found = np.union1d(found, hashes[hashes < np.uint64(limit)])
        if nmax is not None:
            found = found[:nmax]
    return found


def _slices(batch: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch, about `_TEXT` bytes at once and one at least; freed memory goes back when a batch is done.

    A batch has up to 10,000 rows of any length, and each core's Python would hold it again as strings and as results.
    """
    total = np.cumsum(pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    for last in np.flatnonzero(np.diff(total // _TEXT, append=-1)) + 1:
        yield batch.slice(first, last - first).to_pylist()
        first = int(last)
    pa.default_memory_pool().release_unused()


def sketch_column(
    seq: Column, k: int, fscale: int | None, nmax: int | None, algorithm: str | Callable[[np.ndarray], np.ndarray]
) -> Column:
    """`sketch_sequence` of a column as array<bigint> (the bits of the unsigned hashes, in unsigned order)."""
    kernel = algorithm if callable(algorithm) else hash_function(algorithm, k)
    limit = threshold(fscale)

    @arrow_udf("array<bigint>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in _slices(batch):
                found = [sketch_sequence(s, k, kernel, limit, nmax).view(np.int64) for s in texts]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            del batch

    return sketch(seq)


def kmer_counts(seq: Column, k: int) -> Column:
    """The number of a sequence's canonical k-mers (k < 32) and of different ones, as a struct (n_kmers, n_distinct)."""
    if k >= 32:
        raise ValueError("k-mers of 32 and more bases are not packed")

    @arrow_udf("n_kmers long, n_distinct long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in _slices(batch):
                rows = []
                for s in texts:
                    total, seen = 0, np.empty(0, dtype=np.uint64)
                    for kmers in _pieces(s, k):
                        total, seen = total + len(kmers), np.union1d(seen, kmers)
                    rows.append((total, len(seen)))
                columns = [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)]
                yield pa.StructArray.from_arrays(columns, names=["n_kmers", "n_distinct"])
            del batch

    return counts(seq)


def hash_column(kmer: Column, k: int, algorithm: str) -> Column:
    """The hash of a column of packed k-mers (BIGINT) or, from k = 32 on, of k-mer strings."""
    kernel = hash_function(algorithm, k)

    @pandas_udf("bigint")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if k < 32:
                values = kernel(batch.to_numpy(dtype=np.int64).view(np.uint64))
            else:
                values = kernel(np.frombuffer("".join(batch).encode(), dtype=np.uint8).reshape(-1, k))
            yield pd.Series(values.view(np.int64))

    return hashed(kmer)


def unsigned_order(value: Column) -> Column:
    """A key whose signed order is the unsigned order of the value's bits."""
    return value.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_decimal(value: Column) -> Column:
    """The unsigned value of a BIGINT's bits as DECIMAL(20, 0)."""
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, (wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)
