"""Multiple alignment of families around a centre, and the pairs of aligned sequences that are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociwave.operators.genomes import medians
from lociwave.sources.scratch import written

MATCH, MISMATCH, GAP = 2, -1, -2
CELLS = 1 << 20


def _row(above: np.ndarray, same: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The next row of scores: from above and aslant at once, from the left as a running maximum."""
    row = above + GAP
    row[1:] = np.maximum(row[1:], above[:-1] + np.where(same, MATCH, MISMATCH))
    return np.maximum.accumulate(row - gaps) + gaps


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gaps = np.arange(len(b) + 1, dtype=np.int64) * GAP
    row = gaps
    for x in a:
        row = _row(row, b == x, gaps)
    return row


def aligned_pair(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of both sequences that stand in one column of a best global alignment.

    Sequences whose table has more than ``CELLS`` cells are halved where the best
    alignment crosses the middle, so memory grows with their length only.
    """
    if not len(a) or not len(b):
        return []
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmax(_last_row(a[:half], b) + _last_row(a[half:][::-1], b[::-1])[::-1]))
        return aligned_pair(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in aligned_pair(a[half:], b[cut:])]
    gaps = np.arange(len(b) + 1, dtype=np.int64) * GAP
    table = [gaps]
    for x in a:
        table.append(_row(table[-1], b == x, gaps))
    i, j, out = len(a), len(b), []
    while i and j:
        here = table[i][j]
        if here == table[i - 1][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif here == table[i - 1][j] + GAP:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _against_centre(centre: str, seq: str) -> tuple[str, list[str]]:
    """The letters that stand at the centre's places ('-': none), and those before each of them and behind the last."""
    pairs = aligned_pair(np.array([ord(x) for x in centre]), np.array([ord(x) for x in seq]))
    at, before, done = ["-"] * len(centre), [""] * (len(centre) + 1), 0
    for i, j in pairs:
        before[i], at[i], done = seq[done:j], seq[j], j + 1
    before[len(centre)] = seq[done:]
    return "".join(at), before


def centre_alignment(members: DataFrame) -> DataFrame:
    """family_id, id, aligned: each family's sequences (family_id, id, seq) as rows of equal length, gaps as '-'.

    The centre is the member whose length is nearest the family's median, of equals
    the least id. Each member is aligned to it as a row of its own, wherever Spark
    puts it; the widths of inserts are maxima over the family, so a family is never
    held by one task. Letters without gaps are the member's own. A member without a
    sequence (null or empty) is all gaps; ids are unique within a family.
    """
    known = members.select("family_id", "id", F.coalesce("seq", F.lit("")).alias("seq"))
    sized = known.withColumn("n", F.length("seq").cast("long"))
    middle = medians(sized, "family_id", "n")
    centres = sized.join(middle, "family_id").groupBy("family_id").agg(F.min(F.struct(F.abs(F.col("n") - F.col("median")).alias("off"), "id", "seq")).alias("c")).select("family_id", F.col("c.seq").alias("centre"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_against_centre(c, s) for c, s in zip(batch.column("centre").to_pylist(), batch.column("seq").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("family_id"), batch.column("id"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.list_(pa.string()))], names=["family_id", "id", "at", "before"]
            )

    shape = known.select("family_id", "id", F.lit("").alias("at"), F.array(F.lit("")).alias("before")).schema
    rows = written(known.join(centres, "family_id").repartition("family_id", "id").mapInArrow(run, shape), "aligned")
    wide = rows.select("family_id", F.posexplode("before").alias("i", "letters")).where("letters <> ''").groupBy("family_id", "i").agg(F.max(F.length("letters")).alias("w"))
    # A family's widths are one map, no longer than its centre.
    widths = wide.groupBy("family_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("widths"))
    met = rows.join(widths, "family_id", "left")
    column = F.transform(F.sequence(F.lit(0), F.length("at")), lambda i: F.concat(F.rpad(F.get("before", i), F.coalesce(F.try_element_at("widths", i), F.lit(0)), "-"), F.substr(F.col("at"), i + 1, F.lit(1))))
    return met.select("family_id", "id", F.array_join(column, "").alias("aligned"))


def rows_against_rows(sites: DataFrame) -> DataFrame:
    """All pairs of an alignment's rows: (aln, row, genome, pos, letter, ref) in, (aln, a, b, pos, x, y) at places where the reference has a letter out."""
    left = sites.where("ref <> '-'").select("aln", F.col("row").alias("a"), "pos", F.col("letter").alias("x"))
    return left.join(left.select("aln", F.col("a").alias("b"), "pos", F.col("x").alias("y")), ["aln", "pos"]).where("a < b").select("aln", "a", "b", "pos", "x", "y")


def rows_against_reference(sites: DataFrame) -> DataFrame:
    """The reference against each row of another genome, the same columns; a is null, as the reference's letters are its own. No rows are joined."""
    rows = sites.where("ref <> '-' and genome <> ref_genome")
    return rows.select("aln", F.lit(None).cast(sites.schema["row"].dataType).alias("a"), F.col("row").alias("b"), "pos", F.col("ref").alias("x"), F.col("letter").alias("y"))


# The two ways in which an alignment's sequences are paired, by name.
PAIRS = {"rows": rows_against_rows, "reference": rows_against_reference}
