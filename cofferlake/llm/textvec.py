"""Text batches as numpy arrays: words, lines and their 64-bit fingerprints without a loop over words.

A fingerprint is a polynomial over random byte values modulo 2**64, read off prefix sums, then mixed. Prefix sums are
made in chunks, so that memory follows the words of a text and not eight times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHUNK = 1 << 17
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INVPOW = _powers(_MULT), _powers(_INV)
_BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Value of each byte, as written and with A-Z lowered.
AS_WRITTEN, LOWERED = _BYTES, _BYTES[_LOWER]


def byte_class(chars: bytes | list[int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SPACE = byte_class([9, 10, 11, 12, 13, 32])
WORD = ~SPACE
#: Runs of letters, digits and bytes of non-ASCII characters.
TOKEN = byte_class([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, budget: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``budget`` bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + budget, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(member: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member``, cut at the positions ``cuts`` (document starts)."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.logical_not(member[:-1], out=first[1:])
    inner = cuts[(cuts > 0) & (cuts < n)]
    first[inner] = True
    starts = np.flatnonzero(first & member)
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(member[1:], out=last[:-1])
    last[inner - 1] = True
    return starts, np.flatnonzero(last & member) + 1


def _at(data: np.ndarray, values: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Prefix polynomial before each of the sorted positions."""
    out = np.zeros(len(pos), dtype=np.uint64)
    carry, scale = 0, 1
    for lo in range(0, len(data), _CHUNK):
        part = data[lo : lo + _CHUNK]
        sums = np.cumsum(values[part] * _POW[: len(part)], dtype=np.uint64)
        a, b = np.searchsorted(pos, [lo + 1, lo + len(part) + 1])
        out[a:b] = np.uint64(carry) + np.uint64(scale) * sums[pos[a:b] - lo - 1]
        carry = (carry + scale * int(sums[-1])) & _MASK
        scale = scale * pow(_MULT, _CHUNK, 1 << 64) & _MASK
    return out


def _inverse_power(pos: np.ndarray) -> np.ndarray:
    high = pos // _CHUNK
    out = _INVPOW[pos % _CHUNK]
    for h in np.unique(high[high > 0]):
        out[high == h] *= np.uint64(pow(_INV, int(h) * _CHUNK, 1 << 64))
    return out


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = AS_WRITTEN) -> np.ndarray:
    """64-bit fingerprints of data[start:end]; starts and ends sorted."""
    with np.errstate(over="ignore"):
        raw = (_at(data, values, ends) - _at(data, values, starts)) * _inverse_power(starts)
        return mix(raw + (ends - starts).astype(np.uint64))


def owner(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the document that holds each start."""
    return np.searchsorted(offsets, starts, "right") - 1


def sums(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owners, weights=values, minlength=n)


def shingles3(words: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of three consecutive words of one document, and the index of each one's first word."""
    if len(words) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owners[2:] == owners[:-2])
    with np.errstate(over="ignore"):
        h = words[at] * np.uint64(0x8CB92BA72F3D8DD7) + words[at + 1] * np.uint64(0xA24BAED4963EE407) + words[at + 2] * np.uint64(0x9FB21C651E98DF25)
        return mix(h + np.uint64(3)), at
