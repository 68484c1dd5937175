"""Words of whole batches of texts as numpy arrays of byte positions and hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mix64

#: Bytes that separate words: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)
#: One odd random-looking number per byte, the same for A-Z and a-z.
_CODE = mix64(_LOWER + np.uint64(1)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WORDS_AT_ONCE = 1 << 15


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    held = _powers(256)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if n > len(cls.held):
            if n > 1 << 20:
                return _powers(n)
            cls.held = _powers(2 * n)
        return cls.held


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the words of all texts, and for each text the index of its first word (one more at the end)."""
    word = ~SEPARATOR[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    start[cut] = word[cut]
    starts = np.flatnonzero(start)
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = cut[cut > 0] - 1
    last[cut] = word[cut]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run (start, end) of the values, none empty; memory is bounded by a block of runs."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), _WORDS_AT_ONCE):
        s, e = starts[i : i + _WORDS_AT_ONCE], ends[i : i + _WORDS_AT_ONCE]
        size = e - s
        first = np.zeros(len(s), np.int64)
        np.cumsum(size[:-1], out=first[1:])
        within = np.arange(int(size.sum())) - np.repeat(first, size)
        found = values[within + np.repeat(s, size)]
        if found.dtype == np.uint8:
            found = _CODE[found]
        found *= _Powers.upto(int(size.max()))[within]
        out[i : i + len(s)] = mix64(np.add.reduceat(found, first) + size.astype(np.uint64))
    return out


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased."""
    return run_hashes(data, starts, ends)


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, by the place of its first word; the last n - 1 places are cut off."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k])
    return out
