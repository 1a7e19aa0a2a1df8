"""Vectorised word hashing shared by the Python-backed operators.

Texts are hashed as UTF-8 bytes.  Every word gets a 64-bit hash of its bytes; work is done in pieces
of about half a megabyte cut between words, so memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_PIECE = 1 << 19
_MULTIPLIER = 0x9E6C63D0876A9A6B


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective avalanche of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_series(count: int, seed: int) -> np.ndarray:
    """`count` fixed pseudo-random 64-bit values for `seed`."""
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(steps + np.uint64(seed))


def _space_table() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def _alnum_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


#: Bytes that belong to a word: `[^\x20\x09-\x0D]` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing.
SPACE_SEPARATED = _space_table()
ALPHANUMERIC = _alnum_table()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class _Tables:
    """Powers and byte values of the polynomial hash, built once in each worker."""

    values = powers = inverse = None

    @classmethod
    def upto(cls, size: int) -> None:
        if cls.values is None:
            cls.values = hash_series(256, 0x51AB)
        if cls.powers is None or len(cls.powers) < size:
            length = max(size, _PIECE + (1 << 16))
            cls.powers = cls._series(_MULTIPLIER, length)
            cls.inverse = cls._series(pow(_MULTIPLIER, -1, 1 << 64), length)

    @staticmethod
    def _series(base: int, length: int) -> np.ndarray:
        out = np.full(length, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def _spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = table[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _Tables.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_Tables.values[data] * _Tables.powers[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _Tables.inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: Sequence[str | None], table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the offset of each text's first word (one more offset at the end)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    starts, ends = _spans(data, table)
    begins = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=begins[1:])
    offsets = np.searchsorted(starts, begins)
    if len(data) <= _PIECE:
        return _hash_piece(data, starts, ends), offsets
    hashes, first = [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _PIECE, side="right")))
        at = starts[first]
        hashes.append(_hash_piece(data[at : ends[last - 1]], starts[first:last] - at, ends[first:last] - at))
        first = last
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), offsets


def slices(texts: Sequence, limit: int = _PIECE) -> Iterator[slice]:
    """Consecutive slices of texts (or lists) with about `limit` characters each, one text at least."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text is not None else 0
        if i > first and total + size > limit:
            yield slice(first, i)
            first, total = i, 0
        total += size + 1
    if first < len(texts):
        yield slice(first, len(texts))


def runs(counts: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive slices with at most about `limit` in total, one element at least."""
    total = np.cumsum(counts)
    first = 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + limit, side="right")))
        yield slice(first, last)
        first = last
