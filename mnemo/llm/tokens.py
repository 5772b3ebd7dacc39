"""Whole batches of text as arrays: word boundaries and 64-bit word hashes, without a Python object per word.

A word is a run of bytes between separators. Its hash takes eight bytes at a time, each mixed into what came before by
a bijection, so that words of up to eight bytes and equal lengths never collide and others do as random numbers would;
words of more than LONG bytes, at most one for so many bytes of text, go to XXH3. Equal words have equal hashes in every
process. Null texts count as empty. Words never span two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LONG = 64
_MASK = (1 << 64) - 1
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LENGTH, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_one(word: bytes) -> int:
    """The hash that words() gives one word; for constants and tests."""
    return int(runs_hash(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))[0])


def eights(b: np.ndarray) -> np.ndarray:
    """The little-endian number that the eight bytes from each place make (zeros beyond the end): a view, not copied."""
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    return np.ndarray(len(b) + 1, "<u8", padded, 0, (1,))


@dataclass
class Words:
    """hash, start and end (bytes) of each word; text i has words first[i]:first[i+1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offs):
        offs = np.zeros(1, np.int64)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def release() -> None:
    """Give back to the system what Arrow holds in reserve: workers live on, and an executor's share is small."""
    pa.default_memory_pool().release_unused()


def slices(offs: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; a longer text is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte run b[start:end]."""
    size = end - start
    out = size.astype(np.uint64) * np.uint64(_LENGTH)
    at, eight = np.arange(len(start)), eights(b)
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        here = eight[start[at] + k] & KEEP[np.minimum(size[at] - k, 8)]
        out[at] = mix((out[at] ^ here) * np.uint64(_STEP) + np.uint64(k))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(b[start[i] : end[i]].tobytes())
    return out


def words(data: np.ndarray, offs: np.ndarray, seps: np.ndarray = SPACES, fold: bool = True) -> Words:
    """Words of the texts data[offs[i]:offs[i+1]], lower-cased in A-Z if fold."""
    b = FOLD[data] if fold else data
    n = len(b)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    inside = ~seps[b]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(runs_hash(b, start, end), start, end, np.searchsorted(start, offs))


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text, and where each text's begin; a text of fewer words has one, all its words."""
    lens = np.diff(first)
    short = (lens > 0) & (lens < n)
    count = np.where(short, 1, np.maximum(lens - n + 1, 0))
    out_first = np.concatenate([[0], np.cumsum(count)])
    if not len(hashes):
        return np.zeros(0, np.uint64), out_first
    acc = np.zeros(len(hashes), np.uint64)
    for k in range(n):
        acc[: len(hashes) - k] += hashes[k:] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    pos = np.arange(out_first[-1]) - np.repeat(out_first[:-1], count) + np.repeat(first[:-1], count)
    out = acc[pos]
    for i in np.flatnonzero(short):
        total = lens[i]
        for j in range(first[i], first[i + 1]):
            total = (int(total) * 0x2545F4914F6CDD1D + int(hashes[j])) & _MASK
        out[out_first[i]] = total
    return mix(out), out_first
