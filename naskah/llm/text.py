"""Whole-text helpers on numpy arrays, used inside tasks.

A block is a run of rows whose texts are joined into one byte array; words, their hashes and
shingles are computed for a block at once. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing
A-Z, so working on UTF-8 bytes equals working on characters. Hashes have 64 bits; equal words
always have equal hashes, and two given different words collide with a chance near 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
LANES = _rng.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_VALUES = BYTE_VALUES[LOWER]
BASE = 0x9E3779B97F4A7C13
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, U64), BASE_INVERSE: np.ones(1, U64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) mod 2**64; kept for blocks of usual size."""
    have = _powers[base]
    if len(have) < n:
        have = np.full(n if n > 2 * BLOCK_BYTES else max(n, BLOCK_BYTES), base & (2**64 - 1), U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[j] * BASE**j for j < i."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


class Block(NamedTuple):
    rows: slice
    data: np.ndarray  # uint8
    starts: np.ndarray  # of each row in data
    ends: np.ndarray


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Rows of a string or binary column in blocks of about ``size`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.binary())
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        lo, hi = offsets[at], offsets[to]
        yield Block(slice(at, to), data[lo:hi], offsets[at:to] - lo, offsets[at + 1 : to + 1] - lo)
        at = to


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # index of each row's first word; len rows + 1


def words(block: Block, values: np.ndarray = LOWER_VALUES) -> Words:
    """All words of a block, row by row; ``values`` (one per byte) decide which words are equal."""
    data, n = block.data, len(block.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U64), np.zeros(len(block.starts) + 1, np.int64))
    inside = ~IS_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = block.ends > block.starts
    heads, tails = block.starts[full], block.ends[full] - 1
    begins[heads] = inside[heads]
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    p = prefix_hash(values[data])
    hashes = mix((p[ends] - p[starts]) * powers(BASE_INVERSE, n)[starts])
    first = np.append(np.searchsorted(starts, block.starts), len(starts))
    # empty rows at a later row's start share that row's first word; both ranges stay right
    return Words(starts, ends, hashes, first)


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): shingles of ``size`` words; a shorter row has its whole sequence as one."""
    counts = np.diff(w.first)
    n = len(w.hashes)
    out = np.zeros(max(n - size + 1, 0), U64)
    for k in range(size):
        out += w.hashes[k : k + len(out)] * LANES[k]
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate([[0], np.cumsum(per)])
    got = np.zeros(first[-1], U64)
    rows = np.repeat(np.arange(len(counts)), per)
    at = w.first[:-1][rows] + np.arange(len(got)) - first[:-1][rows]
    long = counts[rows] >= size
    got[long] = mix(out[at[long]])
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        k = counts[r]
        part = w.hashes[w.first[r] : w.first[r] + k]
        got[first[r]] = mix((part * LANES[8 + k : 8 + 2 * k]).sum(dtype=U64, keepdims=True))[0]
    return got, first
