"""Words, hashes and n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

A block of texts is one byte buffer plus offsets, as Arrow keeps it. Buffers are worked through
in segments, so that temporary arrays stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(int(BASE), -1, 1 << 64)
SEGMENT = 1 << 20
BLOCK = 1 << 22

WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])


def byte_values(seed: int = 20240229) -> np.ndarray:
    """A fixed random 64-bit value for every byte value."""
    return np.random.default_rng(seed).integers(1, MASK, 256, dtype=np.uint64) | np.uint64(1)


VALUES = byte_values()


def separators(listed: bytes) -> np.ndarray:
    """Table of 256 flags: True where a byte belongs to a word."""
    inside = np.ones(256, dtype=bool)
    inside[list(listed)] = False
    return inside


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


IN_WORD = separators(WHITESPACE)
LOWER = lower_table()


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit values; another seed gives another, unrelated order."""
    x = values ^ np.uint64((seed * 0x9E3779B97F4A7C15) & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done:done + take] = out[:take] * step
        done += take
    return out


class _Powers:
    """Powers of BASE and of its inverse up to a segment's length, made once per process."""

    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            size = max(n, SEGMENT + 1)
            cls.up, cls.down = _powers(size, int(BASE)), _powers(size, _INVERSE)
        return cls.up, cls.down


class Texts:
    """A block of texts: bytes and offsets. Null texts are empty here."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def piece(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def mapped(self, table: np.ndarray) -> "Texts":
        return Texts(table[self.data], self.offsets)

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and where each text's words begin (one more at the end)."""
        data, offsets = self.data, self.offsets
        starts, ends = [], []
        for low in range(0, len(data), SEGMENT):
            high = min(low + SEGMENT, len(data))
            flag = inside[data[low:high]]
            begin, end = flag.copy(), flag.copy()
            begin[1:] &= ~flag[:-1]
            end[:-1] &= ~flag[1:]
            if low and flag[0] and inside[data[low - 1]]:
                begin[0] = False
            if high < len(data) and flag[-1] and inside[data[high]]:
                end[-1] = False
            # A text ends a word even where the next text goes on without a separator.
            cut = offsets[(offsets >= low) & (offsets < high)]
            begin[cut - low] = flag[cut - low]
            cut = offsets[(offsets > low) & (offsets <= high)] - 1
            end[cut - low] = flag[cut - low]
            starts.append(np.flatnonzero(begin) + low)
            ends.append(np.flatnonzero(end) + low + 1)
        if not starts:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(len(offsets), dtype=np.int64)
        first = np.concatenate(starts)
        return first, np.concatenate(ends), np.searchsorted(first, offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span. Spans are in order and do not overlap."""
        out = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(starts):
            low = int(starts[at])
            to = max(int(np.searchsorted(ends, low + SEGMENT, side="right")), at + 1)
            high = int(ends[to - 1])
            up, down = _Powers.of(high - low + 1)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            np.cumsum(VALUES[self.data[low:high]] * up[:high - low], out=sums[1:])
            a, b = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (sums[b] - sums[a]) * down[a]
            at = to
        return mixed(out)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut record batches into blocks of about ``size`` text bytes (a longer text stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        where = batch.schema.get_field_index(column)
        for part, texts in split(batch, batch.column(where), size):
            yield part, texts


def split(batch: pa.RecordBatch, text: pa.Array, size: int) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    text = text.cast(pa.large_binary())
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    if text.null_count:  # a null may stand over bytes; give it none
        filled = text.fill_null(b"")
        bounds = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset:filled.offset + len(filled) + 1]
        raw = filled.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        low, high = int(bounds[at]), int(bounds[to])
        yield batch.slice(at, to - at), Texts(data[low:high], np.asarray(bounds[at:to + 1]) - low)
        at = to


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive hashes, in order."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= BASE
        out += hashes[k:k + size]
    return mixed(out, n)


def runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each of consecutive groups of the given sizes."""
    total = int(sizes.sum())
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.arange(total) - first
