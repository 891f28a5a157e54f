"""Word splitting and hashing in numpy, shared by the operators that read words.

Words are runs of ``[^\\x20\\x09-\\x0D]`` in UTF-8. The words of many texts are hashed at once, on
the bytes of an Arrow column: a hash is the word's bytes, each a random 64-bit number, as a
polynomial in an odd multiplier modulo 2^64, mixed with the length. Prefix sums give it for all words
without a loop over them. Two given words share a hash with a chance of about 2^-64.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; they bound memory, not what is read: a word may span many such chunks.
CHUNK_BYTES = 1 << 16
MULTIPLIER = 0x2545F4914F6CDD1D
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.cache
def _tables(lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: is it space, its number (A-Z as a-z, if ``lower``); powers of the multiplier and of its inverse."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    number = np.random.Generator(np.random.PCG64(20240301)).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        number[ord("A") : ord("Z") + 1] = number[ord("a") : ord("z") + 1]
    return space, number, _powers(MULTIPLIER, CHUNK_BYTES), _powers(pow(MULTIPLIER, -1, 1 << 64), CHUNK_BYTES)


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a column, one after the other, and the texts' numbers of words; null is empty."""
    if pa.types.is_string(column.type) and len(column):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    space, number, power, inverse = _tables(lower)
    begins = offsets[:-1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last = None  # hash and length of the word that the last chunk ended in
    for at in range(0, len(data), CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES]
        word = ~space[part]
        cuts = begins[np.searchsorted(begins, at) : np.searchsorted(begins, at + len(part))] - at
        starts, ends = word.copy(), word.copy()
        gap = ~word
        starts[1:] &= gap[:-1]
        ends[:-1] &= gap[1:]
        starts[cuts] = word[cuts]
        cuts_in = cuts[cuts > 0]
        ends[cuts_in - 1] = word[cuts_in - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(number[part] * power[: len(part)], out=sums[1:])
        h, size = (sums[e] - sums[s]) * inverse[s], e - s
        goes_on = last is not None and len(s) and s[0] == 0 and not (len(cuts) and cuts[0] == 0)
        if goes_on:
            h[0] = (last[0] + pow(MULTIPLIER, last[1], 1 << 64) * int(h[0])) % (1 << 64)
            size[0] += last[1]
            earlier = found[-1]
            found[-1] = tuple(x[:-1] for x in earlier)
            s = s.copy()
            s[0] = earlier[2][-1] - at
        last = (int(h[-1]), int(size[-1])) if len(e) and e[-1] == len(part) else None
        found.append((h, size, s + at))
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(column), np.int64)
    h, size, start = (np.concatenate(x) for x in zip(*found, strict=True))
    return mixed(h + size.astype(np.uint64) * STEP), np.diff(np.searchsorted(start, offsets))


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive rows of a column, of about ``most`` bytes together (one row at least), with the first row's number."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        upto = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, column.slice(first, upto - first)
        first = upto


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-grams of a sequence of word hashes, in order; none if it is shorter."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for i in range(1, n):
        out = mixed(out + STEP) ^ hashes[i : i + count]
    return mixed(out + np.uint64(n))
