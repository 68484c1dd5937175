"""Mates of properly paired reads as keyed state of a stream: the first record of a name waits for the next."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lociwave.operators.reads import is_good, is_proper


def agree(pos: int, seq: str, mate_pos: int, mate_seq: str) -> bool:
    """Whether two matched reads have the same letters where they overlap."""
    if pos > mate_pos:
        pos, seq, mate_pos, mate_seq = mate_pos, mate_seq, pos, seq
    own = seq[mate_pos - pos :]
    n = min(len(own), len(mate_seq))
    return own[:n] == mate_seq[:n]


def proper_pairs(records: DataFrame, least: int | None = None, lateness: int = 100_000_000, buckets: int = 1 << 11) -> DataFrame:
    """name, left_ord, right_ord for a stream of (name, ord, flags, mapq, cigar, pos, seq), as :func:`lociwave.operators.reads.proper_pairs` gives for a table.

    A name's records go in twos in the order in which they come (within a
    micro-batch by ord): the first is kept as state, and the second takes it away,
    whether the two match or not. A first record that can not match keeps its
    place without its letters. The place in the file (ord, from 0) is the event time,
    a second a record, from 1 on as a stream's first watermark is 0: a first record is
    dropped once the stream is ``lateness`` records beyond its own allowance, and none
    may come later than that.

    A state is that of all names whose hash falls into one of ``buckets``, as a call
    of Python for each name would take most of the time; it holds what waits there.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {x[0]: x[1:] for x in zip(*state.get, strict=True)} if state.exists else {}
        out, came = [], set()
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values("ord")
            for name, good, at, pos, seq in zip(*(rows[c].tolist() for c in ("name", "good", "ord", "pos", "seq")), strict=True):
                came.add(name)
                first = held.pop(name, None)
                if first is None:
                    held[name] = (good, at, pos, seq if good else "")
                elif first[0] and good and agree(first[2], first[3], pos, seq):
                    out.append((name, first[1], at) if first[2] <= pos else (name, at, first[1]))
        now = state.getCurrentWatermarkMs()
        held = {name: x for name, x in held.items() if name in came or 1000 * (x[1] + 1 + lateness) >= now}
        if held:
            good, at, pos, seq = (list(x) for x in zip(*held.values(), strict=True))
            state.update((list(held), good, at, pos, seq))
            state.setTimeoutTimestamp(max(1000 * (min(at) + 1 + lateness), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["name", "left_ord", "right_ord"])

    kind = records.schema["name"].dataType
    # A missing name is the empty text, as pandas has no missing ones of its own.
    named = F.coalesce(F.concat(F.lit("="), F.col("name").cast("string")), F.lit("")).alias("name")
    rows = records.where(is_proper()).select(named, "ord", "pos", "seq", is_good(least).alias("good"), F.timestamp_seconds(F.col("ord") + 1).alias("at"), F.pmod(F.hash("name"), F.lit(buckets)).alias("bucket"))
    waiting = "name array<string>, good array<boolean>, ord array<long>, pos array<long>, seq array<string>"
    found = rows.withWatermark("at", f"{lateness} seconds").groupBy("bucket").applyInPandasWithState(run, "name string, left_ord long, right_ord long", waiting, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("name", F.when(F.col("name") != "", F.expr("substr(name, 2)")).cast(kind))
