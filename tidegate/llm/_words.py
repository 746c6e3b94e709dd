"""Vectorised word splitting and hashing over Arrow string batches.

Texts stay concatenated UTF-8 bytes. Word bounds are found with boolean masks,
and word hashes with a prefix sum of a polynomial over table-mapped bytes
(modulo 2**64), so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Classes of bytes for class_spans: 0 white space, 1 letters, digits and non-ASCII, 2 other signs.
CLASS = np.full(256, 2, np.uint8)
CLASS[SPACE] = 0
CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@cache
def byte_values(fold: bool) -> np.ndarray:
    """A pseudorandom 64-bit value for each byte; with fold, A-Z have the values of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; kept for the next call unless very long."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        up, down = np.full(size, _ODD), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size > 8 * CHUNK_BYTES:
            return up, down
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


@dataclass
class Chunk:
    """Whole texts lo..hi of a batch. bytes: joined UTF-8; bounds: text i has bounds[i] to bounds[i + 1]."""

    lo: int
    hi: int
    bytes: np.ndarray
    bounds: np.ndarray

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte and text number of each maximal run of bytes that are no white space."""
        return self._runs((~SPACE[self.bytes]).view(np.uint8))

    def class_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As spans(), with runs also ending where letters and digits meet other signs."""
        return self._runs(CLASS[self.bytes])

    def _runs(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(kind)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none
        change = np.empty(n + 1, bool)
        change[0] = change[n] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:n])
        change[self.bounds] = True
        at = np.flatnonzero(change)
        solid = kind[at[:-1]] != 0
        starts, ends = at[:-1][solid], at[1:][solid]
        return starts, ends, np.searchsorted(self.bounds, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        up, down = powers(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(byte_values(fold)[self.bytes] * up[: len(self.bytes)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def per_text(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc, weights, minlength=self.hi - self.lo).astype(np.int64)


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of whole texts (null: empty) of at most limit bytes, or of one longer text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(texts))
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words inside one text, and the number of each first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _ODD + hashes[k : n + k]
    return mix(total[first] + np.uint64(size)), first
