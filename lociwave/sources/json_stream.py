"""Objects of JSON streams, wherever a file is cut: the state at a cut is the composition of what the ranges before it do.

Whether a brace counts depends on whether it stands in a string, which depends on
all bytes before it. A range of bytes is therefore first read for each state in
which it could begin (outside of strings, in one, in one behind a backslash) and
gives the state in which it then ends and by how much the depth of braces changes.
These few numbers a range are put together in the order of a file. Then every
range is read once more from its true state, gives the objects that begin in it,
and reads on for the end of the last. Objects may stand behind each other, on
lines of their own, over many lines, or in arrays; what stands between them is
skipped. An object that never ends is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lociwave.sources.files import RANGE_BYTES, byte_ranges, opened

OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_CHUNK = 1 << 20


def _marks(data: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """(places of braces, whether an odd number of quotes stands before each, number of quotes, whether an escape is open behind the bytes)."""
    slashes = np.flatnonzero(data == ord("\\"))
    heads = slashes[np.diff(slashes, prepend=-2) != 1]

    def odd_before(at: np.ndarray) -> np.ndarray:
        """Whether an odd number of backslashes stands right before each place."""
        k = np.searchsorted(slashes, at) - 1
        there = (k >= 0) & (slashes[k] == at - 1) if len(slashes) else np.zeros(len(at), bool)
        head = heads[np.searchsorted(heads, at - 1, "right") - 1] if len(heads) else np.zeros(len(at), np.int64)
        n = np.where(there, at - head, 0)
        return (n + carried * (n == at)) % 2 == 1

    quotes = np.flatnonzero(data == ord('"'))
    quotes = quotes[~odd_before(quotes)]
    braces = np.flatnonzero((data == ord("{")) | (data == ord("}")))
    return braces, np.searchsorted(quotes, braces) % 2 == 1, len(quotes), bool(odd_before(np.array([len(data)]))[0])


def scanned(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of braces outside of strings, 1 or -1 for each, the state behind the bytes)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), state
    braces, odd, quotes, escape = _marks(data, int(state == ESCAPED))
    braces = braces[odd == (state != OUTSIDE)]
    now = OUTSIDE
    if (quotes + (state != OUTSIDE)) % 2:
        now = ESCAPED if escape else INSIDE
    return braces, np.where(data[braces] == ord("{"), 1, -1), now


def changes(data: np.ndarray) -> list[tuple[int, int]]:
    """For each first state the one behind the bytes and the change of depth; the bytes are gone through once unless they begin with what an escape changes."""
    braces, odd, quotes, escape = _marks(data, 0)
    signs = np.where(data[braces] == ord("{"), 1, -1)
    within = ESCAPED if escape else INSIDE
    out = [(within if (quotes + inside) % 2 else OUTSIDE, int(signs[odd == bool(inside)].sum())) for inside in (0, 1)]
    if data[0] in b'\\"':
        _, signs, state = scanned(data, ESCAPED)
        return [*out, (state, int(signs.sum()))]
    return [*out, out[INSIDE]]


def effects(file: str, start: int, stop: int) -> tuple[list[int], list[int]]:
    """For each first state of a range its last one, and the change of depth."""
    states, depths = [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0]
    with opened(file) as f:
        f.seek(start)
        for at in range(start, stop, _CHUNK):
            found = changes(np.frombuffer(f.read(min(_CHUNK, stop - at)), np.uint8))
            depths = [d + found[s][1] for d, s in zip(depths, states, strict=True)]
            states = [found[s][0] for s in states]
    return states, depths


def objects_of(file: str, start: int, stop: int, size: int, state: int, depth: int) -> Iterator[bytes]:
    """The objects that begin in a range, which begins in this state and depth."""
    held, own = bytearray(), False
    with opened(file) as f:
        f.seek(start)
        at = start
        while at < size and (at < stop or own):
            # Behind the range only the end of its last object is wanted.
            raw = f.read(min(_CHUNK, stop - at) if at < stop else 1 << 16)
            data = np.frombuffer(raw, np.uint8)
            braces, signs, state = scanned(data, state)
            levels = depth + np.cumsum(signs)
            begins, ends = braces[(signs > 0) & (levels == 1)], braces[(signs < 0) & (levels == 0)]
            from_ = 0
            for end in ends.tolist():
                k = np.searchsorted(begins, from_)
                if not own and k < len(begins) and begins[k] < end and at + begins[k] < stop:
                    own, from_ = True, int(begins[k])
                if own:
                    yield bytes(held) + raw[from_ : end + 1]
                    held.clear()
                    own = False
                from_ = end + 1
            k = np.searchsorted(begins, from_)
            if own:
                held += raw[from_:]
            elif k < len(begins) and at + begins[k] < stop:
                own = True
                held += raw[int(begins[k]) :]
            depth = int(levels[-1]) if len(levels) else depth
            at += len(raw)
    if own:
        raise ValueError(f"{file}: an object that begins before byte {stop} does not end")


def objects(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """value: the outermost objects of JSON files."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [effects(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["file", "length", "start", "stop", "states", "depths"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, start, stop, state, depth in zip(*(batch.column(c).to_pylist() for c in ("file", "length", "start", "stop", "state", "depth")), strict=True):
                held, size = [], 0
                for x in objects_of(file, start, stop, length, state, depth):
                    held.append(x.decode("utf-8", "replace"))
                    size += len(x)
                    if size > _CHUNK:
                        yield pa.RecordBatch.from_pydict({"value": held})
                        held, size = [], 0
                yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})

    # Ranges are a few bytes in a shuffle and much work in a task, so their number of tasks is given; they are fewer than the ranges.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = byte_ranges(spark, path, range_bytes).repartition(tasks, "file", "start")
    ranges = ranges.mapInArrow(first, "file string, length long, start long, stop long, states array<int>, depths array<long>").toArrow().sort_by([("file", "ascending"), ("start", "ascending")])
    if not ranges.num_rows:
        return spark.createDataFrame([], "value string")
    states, depths, state, depth, own = [], [], OUTSIDE, 0, None
    for file, after, change in zip(*(ranges.column(c).to_pylist() for c in ("file", "states", "depths")), strict=True):
        if file != own:
            own, state, depth = file, OUTSIDE, 0
        states.append(state)
        depths.append(depth)
        state, depth = after[state], depth + change[state]
    known = ranges.drop_columns(["states", "depths"]).append_column("state", pa.array(states, pa.int32())).append_column("depth", pa.array(depths, pa.int64()))
    tasks = min(len(states), max(tasks, -(-len(states) * range_bytes // RANGE_BYTES)))
    return spark.createDataFrame(known).repartition(tasks, "file", "start").mapInArrow(second, "value string")
