"""Words and shingles of whole texts as 64-bit numbers, computed on Arrow buffers with numpy.

Texts are UTF-8 bytes, lower-cased in A-Z only; a word is a maximal run without the bytes 0x20 and 0x09-0x0D. A word's number is the mixed sum of
a pseudo-random number for each of its bytes at its place, so texts that mirror each other don't collide, as they would in a polynomial modulo 2**64.
Two different words or shingles share a number with a chance of 2**-64, for whatever reason they are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time (a longer document is taken alone), and words in a shingle.
RUN_BYTES = 1 << 20
SHINGLE = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
#: The number of each byte at each of the first places of a word; those of later places are computed.
_PLACES = 64
_SPOT = mix(np.arange(_PLACES * 256, dtype=np.uint64) * _BASE)
_STEP = mix(np.arange(1001, 1001 + 64, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i up to n."""
    up = np.full(n + 1, _BASE)
    up[0] = 1
    down = np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def rolling(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums s and inverse powers d: (s[j] - s[i]) * d[i] is the number of the bytes i to j."""
    size = max(RUN_BYTES * 2, 1 << (len(buf)).bit_length())
    up, down = powers(size)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return sums, down


def runs(column: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; null texts are empty. Rows are whole."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + run_bytes, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_numbers(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, starts, ends, firsts): words of a run with their byte spans, and for each document the index of its first word, then their count."""
    black = ~_SPACE[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = black[:-1], black[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(black & ~before), np.flatnonzero(black & ~after) + 1
    return spelled(_LOW[buf], starts, ends), starts, ends, np.searchsorted(starts, offsets)


def spelled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """The numbers of the byte strings low[start:end], which lie one after the other without overlapping."""
    sizes = ends - starts
    first = np.r_[0, np.cumsum(sizes)]
    place = np.arange(first[-1], dtype=np.int64)
    place -= np.repeat(first[:-1], sizes)
    held = low[place + np.repeat(starts, sizes)]
    spots = place << 8
    spots |= held
    far = np.flatnonzero(place >= _PLACES)
    made = _SPOT[spots & (_PLACES * 256 - 1)]
    if len(far):
        made[far] = mix(spots[far].astype(np.uint64) * _BASE)
    sums = np.zeros(len(made) + 1, np.uint64)
    np.cumsum(made, out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64) + np.uint64(seed))


def shingle_numbers(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The number of the k words from each word on; the last k - 1 are missing."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    total = words[: len(words) - k + 1] * _STEP[0]
    for j in range(1, k):
        total += words[j : len(words) - k + 1 + j] * _STEP[j]
    return mix(total)


def keyed_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text its sorted distinct shingles and a 128-bit key of the set; with fewer than k words the whole sequence is one, without words there is none.

    The key of a single shingle is taken from its words, since one number is all that would tell it from others.
    """
    for _, buf, offsets in runs(column):
        numbers, starts, ends, firsts = word_numbers(buf, offsets)
        shingles = shingle_numbers(numbers, k)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= k:
                found = np.unique(shingles[a : b - k + 1])
            elif b > a:
                found = mix((numbers[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                found = np.zeros(0, np.uint64)
            said = found.tobytes()
            if len(found) == 1:
                said = b"1 " + b" ".join(_LOW[buf[starts[i] : ends[i]]].tobytes() for i in range(a, min(b, a + k)))
            yield found, hashlib.blake2b(said, digest_size=16).digest()


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sets of keyed_sets() alone."""
    return (found for found, _ in keyed_sets(column, k))
