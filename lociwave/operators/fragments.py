"""Mated reads laid on their reference, and how their substitutions go together by lag: against the genome, or against each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociwave.functions import sequence as Q
from lociwave.operators import sites as S
from lociwave.operators.reads import _bytes
from lociwave.sources import reference
from lociwave.sources.scratch import delete, written

#: Cells of one matrix of fragments by places in a task, and how many profiles a task adds up before it gives them out.
CELLS, PROFILES = 1 << 22, 256
#: Places of a fragment that go to one task together when fragments are held against each other.
PIECE = 256
_NUCLEOTIDE = np.isin(np.arange(256), list(b"ATGCatgc"))


def accession(name: Column) -> Column:
    """The RefSeq-like accession in a name, or the whole name where there is none."""
    found = Q.reference_accession(name)
    return F.when(found != "", found).otherwise(name)


def fragments(records: DataFrame) -> DataFrame:
    """accession, name, start, letters of alignments (read_id, ord, ref, mate_ref, pos, mate_pos, cigar, seq): mates as one sequence.

    Records of one name on one reference go together; one that lies before its mate
    is the left one, else the right one, the last of a side wins and both are
    needed. A gap between mates is '*', where they overlap the left one's letters
    win. A record whose mate is unknown or on another reference is left out.
    """
    own = F.struct("ord", "pos", Q.map_to_reference(F.col("seq"), F.col("cigar")).alias("letters"))
    left = F.col("pos") < F.col("mate_pos")
    rows = records.where("ref = mate_ref").select(accession(F.col("ref")).alias("accession"), "ref", F.col("read_id").alias("name"), F.when(left, own).alias("l"), F.when(~left, own).alias("r"))
    rows = rows.groupBy("accession", "ref", "name").agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l is not null and r is not null")
    start = F.col("l.pos").cast("long")
    return rows.select("accession", "name", start.alias("start"), Q.joined_mates(F.col("l.letters"), start, F.col("r.letters"), F.col("r.pos").cast("long")).alias("letters")).where("length(letters) > 0")


def placed(rows: DataFrame, sequences: DataFrame, profiles: DataFrame) -> DataFrame:
    """The fragments with nucl and kinds: their slices of the stored sequences and position types; empty where there is none."""
    spans = rows.select(F.struct("accession", "name", "start").alias("k"), "accession", "start", (F.col("start") + F.length("letters")).alias("end"))

    def slices(store: DataFrame, name: str) -> DataFrame:
        found = reference.sliced(store.withColumn("accession", accession(F.col("accession"))), spans, "k")
        return found.select("k.accession", "k.name", "k.start", F.col("text").alias(name))

    keys = ["accession", "name", "start"]
    both = rows.join(slices(sequences, "nucl"), keys, "left").join(slices(profiles, "kinds"), keys, "left")
    return both.fillna("", ["nucl", "kinds"])


def _kinds(wanted: int) -> tuple[int, ...]:
    """Position types that a command-line position takes: third ones include the fourfold ones, an unknown number takes the non-coding ones."""
    kind = Q.position_type(wanted, Q.NON_CODING)
    return (Q.THIRD, Q.FOURFOLD) if kind == Q.THIRD else (kind,)


def against_genome(rows: DataFrame, positions: list[int], maxl: int) -> DataFrame:
    """accession, position, lag, n, sx, sy, sxy over pairs of known places of one fragment; x is 1 where it differs from the genome.

    A fragment that goes on beyond the genome's end is left out. A task lays many
    fragments under each other as rows of zeros and ones and takes the sums of all
    lags at once from their spectra; pairs of places are never rows, and the sums
    of a chunk are whole numbers far below what a double holds exactly.
    """

    def sums(known: np.ndarray, differ: np.ndarray, first: np.ndarray) -> np.ndarray:
        width = 1 << int(2 * known.shape[1] - 1).bit_length()
        a, b = np.fft.rfft(known, width), np.fft.rfft(differ, width)
        pairs = ((a, a), (b, a), (a, b), (b, b))
        spectra = np.stack([np.add.reduceat(np.conj(x) * y, first, axis=0) for x, y in pairs], axis=1)
        return np.rint(np.fft.irfft(spectra, width)[:, :, : min(maxl, known.shape[1])]).astype(np.int64)

    def batch_of(total: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
        key, lag = zip(*((k, np.flatnonzero(v[0])) for k, v in total.items()), strict=True)
        n = [len(x) for x in lag]
        columns = {"accession": pa.array(np.repeat([k[0] for k in key], n).tolist(), pa.string()), "position": np.repeat([k[1] for k in key], n), "lag": np.concatenate(lag)}
        return pa.RecordBatch.from_pydict(columns | {c: np.concatenate([total[k][i, x] for k, x in zip(key, lag, strict=True)]) for i, c in enumerate(("n", "sx", "sy", "sxy"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            own = batch.column("accession").to_pylist()
            texts = [[np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in batch.column(c).to_pylist()] for c in ("letters", "nucl", "kinds")]
            order = sorted(range(len(own)), key=lambda i: own[i])
            while order:
                longest, rows_of = 0, []
                while order and (not rows_of or (len(rows_of) + 1) * max(longest, len(texts[0][order[-1]])) <= CELLS):
                    rows_of.append(order.pop())
                    longest = max(longest, len(texts[0][rows_of[-1]]))
                known, differ = np.zeros((len(rows_of), longest), bool), np.zeros((len(rows_of), longest), bool)
                kinds = np.full((len(rows_of), longest), 255, np.uint8)
                for i, row in enumerate(rows_of):
                    a, b, k = (t[row] for t in texts)
                    known[i, : len(a)] = _NUCLEOTIDE[a] & _NUCLEOTIDE[b]
                    differ[i, : len(a)] = a != b
                    kinds[i, : min(len(k), len(a))] = k[: len(a)] - ord("0")
                names = [own[i] for i in rows_of]
                first = np.flatnonzero([i == 0 or names[i] != names[i - 1] for i in range(len(names))])
                for position in positions:
                    wanted = known & np.isin(kinds, _kinds(position))
                    found = sums(wanted.astype(float), (wanted & differ).astype(float), first)
                    for i, at in enumerate(first.tolist()):
                        state = total.setdefault((names[at], position), np.zeros((4, maxl), np.int64))
                        state[:, : found.shape[2]] += found[i]
                if len(total) > PROFILES:
                    yield batch_of(total)
                    total = {}
        if total:
            yield batch_of(total)

    inside = rows.where(F.length("nucl") == F.length("letters")).select("accession", "letters", "nucl", "kinds")
    parts = inside.mapInArrow(run, "accession string, position long, lag long, n long, sx long, sy long, sxy long")
    return parts.groupBy("accession", F.col("position").cast("int").alias("position"), "lag").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "sx", "sy", "sxy")])


def against_reads(rows: DataFrame, positions: list[int], maxl: int) -> DataFrame:
    """The same over pairs of fragments of one genome that share the places; x is 1 where the two differ.

    Pairs of fragments follow from counts of letters at pairs of places, so the
    work grows with the fragments and not with their squares. All pairs count that
    share a known place, also those that a scan back over right ends would miss
    because a later fragment ends earlier.

    Fragments are dealt by ranges of their starts, so a task counts a stretch of the
    genome, a window of bounded size at a time, and gives out sums by lag. Only pairs
    of places that another range may touch leave it as counts, which are put together.
    Fragments longer than ``PIECE`` go as pieces, each with the places behind it that
    its own pair with.
    """
    at = F.explode(F.sequence(F.lit(0), F.length("letters") - 1, F.lit(PIECE)))
    one = rows.where("letters <> '' and kinds <> ''").select("accession", "start", F.regexp_replace("letters", "[^\\x00-\\x7F]", "*").alias("letters"), "kinds", at.alias("at"))
    cut = [F.substr(c, F.col("at") + 1, F.lit(PIECE + maxl - 1)).alias(c) for c in ("letters", "kinds")]
    one = one.select("accession", (F.col("start") + F.col("at")).alias("start"), *cut)
    letters = b"ATGCatgc" if one.where(F.col("letters").rlike("[atgc]")).limit(1).count() else b"ATGC"
    codes = np.full(256, 255, np.uint8)
    codes[list(letters)] = range(len(letters))
    base, window = len(letters), max(PIECE, CELLS // (maxl * len(letters) ** 2 * max(1, len(positions))))
    names = [chr(x) for x in letters]
    pairs = lambda n: n * (n - 1) // 2

    def counted(out: np.ndarray, starts: np.ndarray, texts: pa.RecordBatch) -> None:
        """Adds the pairs of letters of some fragments to out (position, place, lag, letter, letter); starts count from its first place."""
        (own, first), (kind, kind_first) = (_bytes(texts.column(c)) for c in ("letters", "kinds"))
        n = np.minimum(np.diff(first), np.diff(kind_first))
        read = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(read)) - np.repeat(np.cumsum(n) - n, n)
        code, kind = codes[own[first[read] + j]], kind[kind_first[read] + j] - ord("0")
        for i, position in enumerate(positions):
            known = np.flatnonzero((code < base) & np.isin(kind, _kinds(position)))
            r, x, inside, c = read[known], j[known], starts[read[known]] + j[known], code[known].astype(np.int64)
            keys = [np.zeros(0, np.int64)]
            for d in range(maxl):
                m = len(known) - d
                met = np.flatnonzero((r[d:] == r[:m]) & (x[d:] - x[:m] < maxl) & (x[:m] < PIECE)) if m > 0 else ()
                if not len(met):
                    break
                keys.append(((inside[met] * maxl + x[met + d] - x[met]) * base + c[met]) * base + c[met + d])
            keys = np.concatenate(keys)
            if len(keys):
                low = keys.min()
                found = np.bincount(keys - low)
                out[i].reshape(-1)[low : low + len(found)] += found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, begun, last = None, 0, 0, 0
        held = np.zeros((len(positions), window + PIECE, maxl, base, base), np.int64)
        total = np.zeros((len(positions), maxl, 4), np.int64)

        def given(k: int, end: bool) -> Iterator[pa.RecordBatch]:
            """The first k places of the window, which are complete in this task."""
            places = at + np.arange(k)
            edge = (places < begun + PIECE) | (end & (places > last))
            for i, position in enumerate(positions):
                some = held[i, :k].sum((2, 3))
                place, lag = np.nonzero((some > 1) & ~edge[:, None])
                c = held[i, place, lag]
                n, x, y = pairs(some[place, lag]), pairs(c.sum(2)).sum(1), pairs(c.sum(1)).sum(1)
                np.add.at(total[i], lag, np.stack([n, n - x, n - y, n - x - y + pairs(c).sum((1, 2))], 1))
                rim = np.flatnonzero(edge)
                place, lag, a, b = np.nonzero(held[i, rim])
                if len(place):
                    place = rim[place]
                    shown = {"accession": pa.array([own] * len(place), pa.string()), "position": pa.array([position] * len(place), pa.int32()), "pos_a": places[place], "lag": lag}
                    yield pa.RecordBatch.from_pydict(shown | {"base_a": [names[x] for x in a], "base_b": [names[x] for x in b], "n": held[i, place, lag, a, b]} | {c: pa.nulls(len(place), pa.int64()) for c in ("sx", "sy", "sxy")})

        def finished() -> Iterator[pa.RecordBatch]:
            yield from given(held.shape[1], True)
            i, lag = np.nonzero(total[:, :, 0])
            if len(i):
                none = {"pos_a": pa.nulls(len(i), pa.int64()), "lag": lag, "base_a": pa.nulls(len(i), pa.string()), "base_b": pa.nulls(len(i), pa.string())}
                yield pa.RecordBatch.from_pydict({"accession": pa.array([own] * len(i), pa.string()), "position": pa.array([positions[x] for x in i], pa.int32())} | none | {c: total[i, lag, k] for k, c in enumerate(("n", "sx", "sy", "sxy"))})
            held[:], total[:] = 0, 0

        for batch in batches:
            accessions, starts = batch.column("accession").to_pylist(), batch.column("start").to_numpy()
            i = 0
            while i < len(starts):
                if accessions[i] != own:
                    if own is not None:
                        yield from finished()
                    own, at, begun = accessions[i], int(starts[i]), int(starts[i])
                elif starts[i] >= at + window:
                    k = min(int(starts[i]) - at, held.shape[1])
                    yield from given(k, False)
                    held[:, : held.shape[1] - k] = held[:, k:].copy()
                    held[:, held.shape[1] - k :] = 0
                    at = int(starts[i])
                j = i + 1
                while j < len(starts) and accessions[j] == own and starts[j] < at + window:
                    j += 1
                counted(held, starts[i:j] - at, batch.slice(i, j - i))
                last, i = int(starts[j - 1]), j
        if own is not None:
            yield from finished()

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = one.repartitionByRange(tasks, "accession", "start").sortWithinPartitions("accession", "start")
    found = written(dealt.mapInArrow(run, "accession string, position int, pos_a long, lag long, base_a string, base_b string, n long, sx long, sy long, sxy long"), "counts")
    keys = ["accession", "position", "lag"]
    edges = found.where("pos_a is not null").groupBy(*keys, "pos_a", "base_a", "base_b").agg(F.sum("n").alias("n"))
    edges = S.doublet_statistics(edges, [*keys, "pos_a"], "base_a", "base_b", "n").where("n_reads >= 2").select(*keys, F.col("pairs").alias("n"), "sx", "sy", "sxy")
    sums = edges.unionByName(found.where("pos_a is null").select(*keys, *[F.col(c).cast(edges.schema[c].dataType).alias(c) for c in ("n", "sx", "sy", "sxy")]))
    return sums.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "sx", "sy", "sxy")])


#: Functions over fragments by the names that settings choose them by.
FUNCTIONS: dict[str, Callable[[DataFrame, list[int], int], DataFrame]] = {"reads_vs_genome": against_genome, "reads_vs_reads": against_reads}


def function_name(text: str) -> str:
    """The name in :data:`FUNCTIONS` that a setting means, whatever its case and with or without 'cov_' before it; '' if none."""
    name = text.strip().lower().removeprefix("cov_")
    return name if name in FUNCTIONS else ""


def results(sums: DataFrame, maxl: int) -> DataFrame:
    """Ks, VarKs, N and, for each kept lag, value and obs (kind Ct) beside the other columns of the sums.

    Variances and covariances are sample ones, unknown below two pairs. Of codon
    positions every third lag is kept and numbered by codons; non-coding ones keep
    each lag.
    """
    keys = [c for c in sums.columns if c not in ("lag", "n", "sx", "sy", "sxy")]
    n = F.col("n")
    ks = sums.where("lag = 0").select(*keys, (F.col("sx") / n).alias("Ks"), F.try_divide(F.col("sx") - F.col("sx") * F.col("sx") / n, n - 1).alias("VarKs"), n.cast("long").alias("N"))
    step = F.when(F.col("position") == 0, 1).otherwise(3)
    lags = sums.withColumn("step", step).where((F.col("lag") % F.col("step") == 0) & (F.floor(F.col("lag") / F.col("step")) < F.floor(F.lit(maxl) / F.col("step"))))
    value = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, n - 1)
    lags = lags.select(*keys, F.lit("Ct").alias("kind"), F.floor(F.col("lag") / F.col("step")).cast("int").alias("lag"), value.alias("value"), n.cast("long").alias("obs"))
    return lags.where("value is not null").join(ks, keys)


def covariances(records: DataFrame, sequences: DataFrame, profiles: DataFrame, functions: list[str], positions: list[int], maxl: int) -> DataFrame:
    """accession, function, position, NReads and the columns of :func:`results`, of every genome, function and position at once."""
    own = written(fragments(records), "fragments")
    rows = written(placed(own, sequences, profiles), "placed")
    out = None
    for name in functions:
        found = FUNCTIONS[name](rows, positions, maxl).withColumn("function", F.lit(name))
        out = found if out is None else out.unionByName(found)
    sums = written(out, "sums")
    delete(rows)
    reads = own.groupBy("accession").agg(F.count(F.lit(1)).alias("NReads"))
    return results(sums, maxl).join(reads, "accession")
