"""64-bit hash functions of k-mers as numpy kernels.

Integer functions take packed k-mers (k < 32), byte functions take rows of equal length (k >= 32).  All results are uint64;
Spark stores their bits as BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

_U = np.uint64
_LOW32 = _U(0xFFFFFFFF)

# Constants of the functions.
_AHASH_KEY = _U(0xE12119C4114F22A7)
_AHASH_MULTIPLIER = _U(6364136223846793005)
_AHASH_ROTATION = 0x60E5 % 64
_MURMUR_SEED = 42
_MURMUR_1 = _U(0x87C37B91114253D5)
_MURMUR_2 = _U(0x4CF5AD432745937F)
_XXH3_SECRET_8 = 0x1CAD21F72C81017C ^ 0xDB979083E96DD4DE
_XXH3_PRIME = _U(0x9FB21C651E98DF25)
_XXH_PRIME_1 = 0x9E3779B185EBCA87
_XXH3_FINISH = _U(0x165667919E3779F9)
_XXH3_SECRET = np.frombuffer(
    bytes.fromhex(
        "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"
    ),
    dtype="<u8",
)

ALGORITHMS = ("default", "ahash", "murmur3", "xxhash")


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << _U(bits)) | (x >> _U(64 - bits))


def _multiply_high(x: np.ndarray, y: np.uint64) -> np.ndarray:
    """The upper half of the 128-bit product."""
    xl, xh, yl, yh = x & _LOW32, x >> _U(32), y & _LOW32, y >> _U(32)
    low, cross, other = xl * yl, xh * yl, xl * yh
    carry = (low >> _U(32)) + (cross & _LOW32) + (other & _LOW32)
    return xh * yh + (cross >> _U(32)) + (other >> _U(32)) + (carry >> _U(32))


def ahash(packed: np.ndarray) -> np.ndarray:
    """Folded multiplication of the keyed k-mer, rotated."""
    x = packed.astype(_U, copy=False) ^ _AHASH_KEY
    return _rotate((x * _AHASH_MULTIPLIER) ^ _multiply_high(x, _AHASH_MULTIPLIER), _AHASH_ROTATION)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def murmur3(rows: np.ndarray) -> np.ndarray:
    """The low half of MurmurHash3 x64-128, seed 42, of each row of an (n, length) byte matrix."""
    count, length = rows.shape
    one = np.full(count, _MURMUR_SEED, dtype=_U)
    two = one.copy()
    padded = np.zeros((count, -(-length // 16) * 16), dtype=np.uint8)
    padded[:, :length] = rows
    lanes = padded.view("<u8")
    for block in range(length // 16):
        one ^= _rotate(lanes[:, 2 * block] * _MURMUR_1, 31) * _MURMUR_2
        one = (_rotate(one, 27) + two) * _U(5) + _U(0x52DCE729)
        two ^= _rotate(lanes[:, 2 * block + 1] * _MURMUR_2, 33) * _MURMUR_1
        two = (_rotate(two, 31) + one) * _U(5) + _U(0x38495AB5)
    if length % 16:
        two ^= _rotate(lanes[:, -1] * _MURMUR_2, 33) * _MURMUR_1
        one ^= _rotate(lanes[:, -2] * _MURMUR_1, 31) * _MURMUR_2
    one, two = one ^ _U(length), two ^ _U(length)
    one = one + two
    two = two + one
    return _finish(one) + _finish(two)


def _big_endian(packed: np.ndarray) -> np.ndarray:
    return packed.astype(">u8").view(np.uint8).reshape(-1, 8)


def murmur3_u64(packed: np.ndarray) -> np.ndarray:
    """`murmur3` of the eight big-endian bytes of each value."""
    return murmur3(_big_endian(packed))


def _fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The halves of the 128-bit product, combined."""
    return (x * y) ^ _multiply_high(x, y)


def xxh3(rows: np.ndarray) -> np.ndarray:
    """XXH3-64, seed 0, of each row of a byte matrix: all rows at once for 17 to 64 bytes, else one by one."""
    count, length = rows.shape
    if not 17 <= length <= 64:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(row) for row in np.ascontiguousarray(rows)), dtype=_U, count=count)

    def lanes(first: int) -> tuple[np.ndarray, np.ndarray]:
        pair = np.ascontiguousarray(rows[:, first : first + 16]).view("<u8")
        return pair[:, 0], pair[:, 1]

    out = np.full(count, length * _XXH_PRIME_1 & (1 << 64) - 1, dtype=_U)
    # pairs of lanes from both ends, the inner ones only if the row is long enough
    for k in range((length - 1) // 32 + 1):
        for place, first in ((2 * k, 16 * k), (2 * k + 1, length - 16 * (k + 1))):
            low, high = lanes(first)
            out += _fold(low ^ _XXH3_SECRET[2 * place], high ^ _XXH3_SECRET[2 * place + 1])
    out = (out ^ (out >> _U(37))) * _XXH3_FINISH
    return out ^ (out >> _U(32))


def xxh3_u64(packed: np.ndarray) -> np.ndarray:
    """XXH3-64 of the eight big-endian bytes of each value, by the function's form for inputs of eight bytes."""
    x = packed.astype(_U).byteswap()
    x = (x << _U(32)) | (x >> _U(32))
    x = x ^ _U(_XXH3_SECRET_8)
    x = x ^ _rotate(x, 49) ^ _rotate(x, 24)
    x = x * _XXH3_PRIME
    x = (x ^ ((x >> _U(35)) + _U(8))) * _XXH3_PRIME
    return x ^ (x >> _U(28))


_PACKED = {"default": ahash, "ahash": ahash, "murmur3": murmur3_u64, "xxhash": xxh3_u64}
_BYTES = {"default": xxh3, "murmur3": murmur3, "xxhash": xxh3}


def hash_function(algorithm: str, k: int) -> Callable[[np.ndarray], np.ndarray]:
    """The kernel of an algorithm for a k-mer size: of packed integers below 32, of byte rows from 32 on."""
    table = _PACKED if k < 32 else _BYTES
    if algorithm not in table:
        raise ValueError(f"no hash function {algorithm!r} for k = {k}")
    return table[algorithm]


def threshold(fscale: int | None) -> int:
    """The largest hash plus one of a scaled sketch, in the floating-point arithmetic that index files rely on."""
    top = 2**64 - 1
    if not fscale:
        return top
    scaled = float(top) / float(fscale)
    return top if scaled >= 2.0**64 else int(scaled)
