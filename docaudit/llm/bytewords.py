"""Words, shingles and their 64-bit hashes for blocks of texts, in numpy over UTF-8 bytes.

A block is cut so that it holds about BLOCK bytes (one longer text makes a block of its own), which
bounds the arrays. Hashes are polynomial sums mod 2^64 of table values, taken for any span from one
cumulative sum, then mixed; equal spans have equal hashes on every machine, unequal ones collide with
probability about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1_000_000
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^0.. and R^-0.., at least n + 1 of each."""
    if len(_powers[0]) <= n:
        m = max(n + 1, BLOCK + 1)
        with np.errstate(over="ignore"):
            for k, r in ((0, _R), (1, _R_INV)):
                a = np.full(m, r, np.uint64)
                a[0] = 1
                _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a block: spans in buf (A-Z folded), document of each, hash; first word of each document."""

    buf: np.ndarray
    offsets: np.ndarray  # of documents in buf
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # document d has words first[d]:first[d + 1]
    sums: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = powers(len(self.buf))[1]
        return mix((self.sums[end] - self.sums[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; null counts as empty."""
    a = texts.cast(pa.large_string()).fill_null("")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = a.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    raw, offsets = bytes_of(texts)
    buf = _FOLD[raw]
    n = len(buf)
    live = ~_SEP[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = live.copy()
    begin[1:] &= ~live[:-1] | edge[1:n]
    stop = live.copy()
    stop[:-1] &= ~live[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    power = powers(n)[0]
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[buf] * power[:n], out=sums[1:])
        w = Words(buf, offsets, start, end, start, np.searchsorted(start, offsets), sums)
        w.hash = w.span_hash(start, end)
    return w


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's word sequences of that width in order, and where each document's begin;
    a document of fewer words has its whole sequence as one, one without words has none."""
    count = np.diff(w.first)
    n = len(w.hash)
    with np.errstate(over="ignore"):
        weight = [np.uint64(c) for c in np.random.default_rng(7).integers(1, 2**63, width).tolist()]
        weight = [c * np.uint64(2) + np.uint64(1) for c in weight]
        full = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            full += w.hash[k : k + len(full)] * weight[k]
        full = mix(full)
        sizes = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
        at = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        out = np.empty(at[-1], np.uint64)
        long = np.flatnonzero(count >= width)
        if len(long):
            reps = sizes[long]
            inner = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            out[np.repeat(at[long], reps) + inner] = full[np.repeat(w.first[long], reps) + inner]
        for d in np.flatnonzero((count > 0) & (count < width)):
            h = np.uint64(count[d])
            for k in range(count[d]):
                h = h + w.hash[w.first[d] + k] * weight[k]
            out[at[d]] = mix(np.array([h], np.uint64) ^ np.uint64(0x5851F42D4C957F2D))[0]
    return out, at


def blocks(batch: pa.RecordBatch, text: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about size bytes of text each."""
    a = batch.column(text).cast(pa.large_string()).fill_null("")
    if not len(a):
        return
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
