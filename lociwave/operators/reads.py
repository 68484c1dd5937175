"""Reads: mates, overlaps, release order, reads in genes, bounded lateness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociwave.operators.joins import interval_join
from lociwave.operators.order import running
from lociwave.sources.scratch import written


def released(reads: DataFrame, group: list[str]) -> DataFrame:
    """The heads that a sliding queue releases: adds k (0-based order).

    After each read at most one head leaves, if it ends before that read starts,
    and nothing leaves at the end: with f_k the first later read that starts
    beyond head k, head k leaves iff max(f_j - j, j <= k) + k is below the count.
    """
    rows = running(reads.withColumn("stop", F.col("pos") + F.col("len")), group, ["pos", "read_id"], sums={"k": F.lit(1)}, count="n")
    rows = written(rows.withColumn("k", F.col("k") - 1), "queue")
    # f_k: reads that start at or before the head's end come first in the order, so it is their count.
    both = rows.select(*group, F.col("stop").alias("at"), F.lit(1).alias("ask"), "k").unionByName(rows.select(*group, F.col("pos").alias("at"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("k")))
    first = running(both, group, ["at", "ask"], sums={"f": 1 - F.col("ask")}).where("ask = 1").select(*group, "k", "f")
    rows = running(rows.join(first, [*group, "k"]), group, ["k"], tops={"reach": F.col("f") - F.col("k")})
    return rows.where(F.col("reach") + F.col("k") < F.col("n")).drop("reach", "f", "stop", "n")


def overlapping(heads: DataFrame, reads: DataFrame, group: list[str], width: int) -> DataFrame:
    """Pairs (a, b), b after a in file order and b.pos <= a.pos + a.len; a among the released heads."""
    span = lambda df: df.withColumns({"start": F.col("pos"), "end": F.col("pos") + F.col("len") + 1})
    point = reads.withColumns({"start": F.col("pos"), "end": F.col("pos") + 1})
    rows = interval_join(span(heads).select(*group, "read_id", "pos", "len", "start", "end"), point.select(*group, "read_id", "pos", "len", "start", "end"), group, width)
    later = (F.col("pos_b") > F.col("pos_a")) | ((F.col("pos_b") == F.col("pos_a")) & (F.col("read_id_b") > F.col("read_id_a")))
    return rows.where(later & (F.col("pos_b") <= F.col("pos_a") + F.col("len_a")))


_NUCLEOTIDE = np.isin(np.arange(256), list(b"ATGC"))


def masked(reads: DataFrame, least: int = 30) -> DataFrame:
    """Reads with ``letters``: seq, with '-' where a letter is no upper-case nucleotide or its quality (bytes from 33 on) is not strictly above ``least`` or missing."""

    @F.arrow_udf("string")
    def mask(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for seqs, quals in columns:
            (seq, first), (qual, of) = _bytes(seqs.fill_null("")), _bytes(quals.fill_null(""))
            n = np.diff(first)
            seq = seq[first[0] : first[-1]]
            at = np.arange(len(seq)) - np.repeat(first[:-1] - first[0], n)
            there = at < np.repeat(np.diff(of), n)
            level = np.zeros(len(seq), np.int64)
            level[there] = qual[(np.repeat(of[:-1], n) + at)[there]]
            letters = np.where(_NUCLEOTIDE[seq] & (level - 33 > least), seq, ord("-")).astype(np.uint8)
            yield pa.StringArray.from_buffers(len(n), pa.py_buffer((first - first[0]).astype(np.int32)), pa.py_buffer(letters))

    return reads.withColumn("letters", mask("seq", "quals"))


def difference_sums(pairs: DataFrame, by: str, maxl: int) -> DataFrame:
    """by, known, differ, pairs and, for each lag below ``maxl``, n_lag, sa_lag, sb_lag, sab_lag: sums over overlapping reads (letters_a, letters_b, shift: b starts in a).

    A place of an overlap counts where both letters are known and is 1 where they
    differ; a lag's sums are over pairs of such places of one overlap. A task adds
    up whole batches of pairs as arrays of bytes and gives a row for each value of
    ``by``.
    """
    names = ["pairs", "known", "differ", *(f"{s}_{lag}" for lag in range(maxl) for s in ("n", "sa", "sb", "sab"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = (_bytes(batch.column(c)) for c in ("letters_a", "letters_b"))
            shift, group = batch.column("shift").to_numpy(), batch.column("by").to_numpy()
            n = np.minimum(np.diff(a[1]) - shift, np.diff(b[1]))
            ok = np.flatnonzero(n > 0)
            n, group = n[ok], group[ok]
            if not len(n):
                continue
            head = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(head[-1]) - np.repeat(head[:-1], n)
            x, y = a[0][np.repeat(a[1][ok] + shift[ok], n) + at], b[0][np.repeat(b[1][ok], n) + at]
            known = (x != ord("-")) & (y != ord("-"))
            differ = known & (x != y)
            left = np.repeat(n, n) - at
            values, own = np.unique(group, return_inverse=True)
            places = np.repeat(own, n)
            count = lambda flags, where: np.bincount(where[flags], minlength=len(values))
            columns = [np.bincount(own, minlength=len(values)), count(known, places), count(differ, places)]
            for lag in range(maxl):
                first = np.flatnonzero(left > lag)
                both = known[first] & known[first + lag]
                p, q, where = differ[first] & both, differ[first + lag] & both, places[first]
                columns += [count(both, where), count(p, where), count(q, where), count(p & q, where)]
            for i, v in enumerate(values.tolist()):
                total[v] = total.get(v, 0) + np.array([c[i] for c in columns], np.int64)
        if total:
            sums = np.array(list(total.values()))
            yield pa.RecordBatch.from_pydict({"by": pa.array(list(total), pa.int64())} | {c: sums[:, i] for i, c in enumerate(names)})

    rows = pairs.select(F.col(by).cast("long").alias("by"), F.col("shift").cast("long").alias("shift"), "letters_a", "letters_b")
    parts = rows.mapInArrow(run, "by long, " + ", ".join(f"{c} long" for c in names))
    return parts.groupBy(F.col("by").alias(by)).agg(*[F.sum(c).alias(c) for c in names])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last one ends)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def mates(records: DataFrame) -> DataFrame:
    """name, left_ord, right_ord: mates on one reference; the last record of a side wins, both sides are needed."""
    side = F.when(F.col("pos") < F.col("mate_pos"), "L").otherwise("R")
    rows = records.where("mate_ref = ref").groupBy("name").agg(F.max(F.when(side == "L", F.col("ord"))).alias("left_ord"), F.max(F.when(side == "R", F.col("ord"))).alias("right_ord"))
    return rows.where("left_ord is not null and right_ord is not null")


def mates_overlapping(pairs: DataFrame, width: int) -> DataFrame:
    """Pairs of mated reads (id, left, right half-open ends) that overlap, by right end; no reference is compared."""
    own = pairs.select(F.lit(0).alias("g"), "id", F.col("left").alias("start"), F.col("right").alias("end"))
    rows = interval_join(own, own, ["g"], width).drop("g")
    earlier = (F.col("end_a") < F.col("end_b")) | ((F.col("end_a") == F.col("end_b")) & (F.col("id_a") < F.col("id_b")))
    return rows.where(earlier)


def fragment_shifts(pairs: DataFrame) -> DataFrame:
    """shift, n: how many pairs of ``mates_overlapping`` have their left ends so far apart, without making the pairs.

    Fragments with the same two ends are counted first. A fragment comes behind one
    that ends at a place, and overlaps it, if it covers that place and goes on
    beyond it: for each place the fragments that do so are counted by their left
    ends, and the counts meet those that end there. Only fragments with one right
    end are paired, to be told apart by their ids.
    """
    cells = pairs.where(F.col("right") > F.col("left")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
    inner = cells.where(F.col("right") - F.col("left") > 1).select(F.col("left").alias("other"), F.explode(F.sequence(F.col("left") + 1, F.col("right") - 1)).alias("right"), "n")
    beyond = inner.groupBy("other", "right").agg(F.sum("n").alias("m"))
    apart = cells.join(beyond, "right").groupBy((F.col("other") - F.col("left")).alias("shift")).agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    own = pairs.where(F.col("right") > F.col("left"))
    other = own.select("right", F.col("id").alias("id_b"), F.col("left").alias("left_b"))
    same = own.join(other, "right").where("id < id_b").groupBy((F.col("left_b") - F.col("left")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    return apart.unionByName(same).groupBy("shift").agg(F.sum("n").cast("long").alias("n"))


def in_genes(reads: DataFrame, genes: DataFrame, width: int) -> DataFrame:
    """Reads (ref, read_id, pos 0-based, end) with each gene (ref, gene_id, gene_start 1-based, gene_end) they touch."""
    r = reads.select("ref", "read_id", F.col("pos").alias("start"), F.col("end"))
    g = genes.select("ref", "gene_id", (F.col("gene_start") - 1).alias("start"), F.col("gene_end").alias("end"))
    return interval_join(r, g, ["ref"], width).select("ref", F.col("read_id_a").alias("read_id"), F.col("gene_id_b").alias("gene_id"), F.greatest("start_a", "start_b").alias("start"), F.least("end_a", "end_b").alias("end"))


def swept(reads: DataFrame, genes: DataFrame, width: int, compat: bool = True) -> DataFrame:
    """ref, gene_id, read_id: reads (ref, read_id, pos 0-based, end) in genes (ref, gene_id, gene_start 1-based, gene_end), by a sweep over the places of a reference.

    Without ``compat`` these are the pairs of ``in_genes``. With it a read counts
    for a gene from the letter before the gene on, and two kinds of pairs are
    lost. After each read the sweep drops the genes (in the order of their starts)
    before the last one that ended before that read, also those that still go on:
    a read meets only genes from the one on that the read before it left first.
    And what is not dropped by the end of a reference is given out only for the
    last of the references that have genes.

    The first gene left is a running maximum over gene ends and reads in the order
    of places, carried from range to range: no reference is held by one task.
    """
    shifted = genes if not compat else genes.withColumn("gene_start", F.col("gene_start") - 1)
    pairs = in_genes(reads, shifted, width).select("ref", "gene_id", "read_id")
    if not compat:
        return pairs
    numbers = running(genes.select("ref", "gene_id", "gene_start", "gene_end"), ["ref"], ["gene_start", "gene_id"], sums={"i": F.lit(1)}).withColumn("i", (F.col("i") - 1).cast("long"))
    numbers = written(numbers, "sweep")
    of_genes = numbers.select("ref", F.col("gene_end").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("read_id"), "i")
    of_reads = reads.select("ref", F.col("pos").alias("at"), F.lit(0).alias("kind"), F.col("read_id").cast("long").alias("read_id"), F.lit(None).cast("long").alias("i"))
    # A gene counts as ended for reads beyond its end only, so it comes behind the reads there.
    after = running(of_genes.unionByName(of_reads), ["ref"], ["at", "kind", "read_id"], tops={"ended": F.col("i")}).where("kind = 0")
    before = running(after.select("ref", "at", "read_id", "ended"), ["ref"], ["at", "read_id"], lags={"left": "ended"})
    before = written(before.select("ref", "read_id", F.coalesce("left", F.lit(0)).alias("left"), "ended"), "sweep")
    last = numbers.select("ref").distinct().join(before.groupBy("ref").agg(F.coalesce(F.max("ended"), F.lit(0)).alias("final")), "ref")
    last = last.join(F.broadcast(last.agg(F.max("ref").alias("last"))))
    met = pairs.join(before.select("ref", "read_id", "left"), ["ref", "read_id"]).join(numbers.select("ref", "gene_id", "i"), ["ref", "gene_id"]).where("i >= left")
    return met.join(last, "ref").where("i < final or ref = last").select("ref", "gene_id", "read_id")


def flushed(bases: DataFrame, group: list[str], read_pos: Column, lateness: int = 100, compat: bool = True) -> DataFrame:
    """Positions that a pileup with bounded lateness emits: those more than ``lateness`` before the last read's start."""
    last = bases.groupBy(*group).agg(F.max(read_pos).alias("__last"))
    rows = bases.join(last, group)
    return (rows.where(F.col("pos") < F.col("__last") - lateness) if compat else rows).drop("__last")


def eligible(pairs: DataFrame) -> DataFrame:
    """Fragments whose mates share a reference that has a genome and that end within it."""
    return pairs.where("left_ref = right_ref and right_end <= genome_length")


def is_proper() -> Column:
    return F.col("flags").bitwiseAND(2) > 0


def is_good(least: int | None = None) -> Column:
    """Reads of one match run, of at least this mapping quality."""
    one = (F.size("cigar") == 1) & (F.get("cigar", F.lit(0))["op"] == "M")
    return F.coalesce(one if least is None else one & (F.col("mapq") >= least), F.lit(False))


def proper_pairs(records: DataFrame, least: int | None = None) -> DataFrame:
    """name, left_ord, right_ord: mates of (name, ord, flags, mapq, cigar, pos, seq) that are good reads and agree where they overlap (an optional filter).

    The properly paired records of a name go in twos in file order; a record that
    is no good read takes its mate with it. The left mate is the one at the lesser
    place, of equal ones the first. Names of any number of records are spread over
    ranges.
    """
    own = records.where(is_proper()).select("name", "ord", F.struct("ord", "pos", "seq", is_good(least).alias("good")).alias("own"))
    rows = running(own, ["name"], ["ord"], sums={"k": F.lit(1)}, lags={"mate": "own"}).where("k % 2 = 0 and own.good and mate.good")
    first = F.col("mate.pos") <= F.col("own.pos")
    rows = rows.select("name", F.when(first, F.col("mate")).otherwise(F.col("own")).alias("a"), F.when(first, F.col("own")).otherwise(F.col("mate")).alias("b"))
    gap = (F.col("b.pos") - F.col("a.pos")).cast("int")
    n = F.greatest(F.lit(0), F.least(F.length("a.seq") - gap, F.length("b.seq")))
    agrees = F.substr("a.seq", gap + 1, n) == F.substr("b.seq", F.lit(1), n)
    return rows.where(agrees).select("name", F.col("a.ord").alias("left_ord"), F.col("b.ord").alias("right_ord"))
