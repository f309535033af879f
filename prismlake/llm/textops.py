"""Vectorised words and hashes over the UTF-8 bytes of whole Arrow batches.

A text column is seen as one byte array with offsets, so that splitting, lower-casing (A-Z only) and
hashing cost a few numpy operations per batch instead of Python work per word. Nulls count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; one longer text is taken whole.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of letters, digits and every non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

#: Words between ASCII white space.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False

_U = np.uint64
_M1, _M2, _G = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (SplitMix64)."""
    x = x + _G
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes each."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with a ``text`` column in parts of about ``CHUNK_BYTES``, each with its bytes and offsets."""
    for batch in batches:
        data, offs = flat(batch.column("text"))
        for lo, hi in chunks(offs):
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the number of words before each text (one more than texts)."""
    inside = member[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) + _U(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
    at, left, todo = starts, size, None
    while len(left):
        keep = np.minimum(left, 8)
        part = eight[np.minimum(at, len(data))] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - (keep.astype(np.uint64) << _U(3)))) * (keep > 0).astype(np.uint64) if len(data) else np.zeros(len(left), np.uint64)
        if todo is None:
            out = mix(out ^ part)
        else:
            out[todo] = mix(out[todo] ^ part)
        more = np.flatnonzero(left > 8)
        todo = more if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def shingles(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words; a text of fewer words, but not none, has one shingle of all of them.

    Returns the shingles' hashes and the number of shingles before each text.
    """
    count = np.diff(before)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(per)])
    at = np.repeat(before[:-1] - bounds[:-1], per) + np.arange(bounds[-1])
    left = np.repeat(before[1:], per) - at
    out = np.full(len(at), 0x1234567, np.uint64)
    for k in range(n):
        there = left > k
        out = np.where(there, mix(out * _U(31) ^ hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else out), out)
    return out, bounds
