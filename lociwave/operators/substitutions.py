"""Substitution profiles of aligned sequences and their correlations by lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociwave.functions.sequence import is_nucleotide, of_type
from lociwave.functions.stats import covariance
from lociwave.operators.joins import band_join
from lociwave.operators.order import numbered
from lociwave.sources.scratch import written


def profile(pairs: DataFrame, wanted: int | None = None) -> DataFrame:
    """row, pos, x from (row, pos, base_a, base_b, pos_type): 1 where the letters differ (case counts), null where one is no nucleotide or the place is not wanted."""
    valid = is_nucleotide(F.col("base_a")) & is_nucleotide(F.col("base_b"))
    if wanted is not None:
        valid = valid & of_type(F.col("pos_type"), wanted)
    return pairs.select("aln", "row", "pos", F.when(valid, (F.col("base_a") != F.col("base_b")).cast("double")).alias("x"))


def ks(subs: DataFrame, sample: bool = True) -> DataFrame:
    x = F.col("x")
    return subs.agg(F.avg(x).alias("ks"), (F.var_samp(x) if sample else F.var_pop(x)).alias("var_ks"), F.count(x).alias("n"))


def total_correlation(subs: DataFrame, maxl: int) -> DataFrame:
    """lag, ct, mean_xy, n over pairs of known places of one row; lag 0 pairs each place with itself."""
    rows = _pairs(subs.where("x is not null"), maxl)
    x, y = F.col("x_a"), F.col("x_b")
    return rows.groupBy("lag").agg(covariance(x, y).alias("ct"), F.avg(x * y).alias("mean_xy"), F.count(F.lit(1)).alias("n"))


def _pairs(known: DataFrame, maxl: int) -> DataFrame:
    """Pairs of places of one row. Keys repeat so often that their shuffled bytes say little of a table in memory, so the join is never a broadcast."""
    return band_join(known.hint("merge"), ["aln", "row"], "pos", maxl)


def _structure(subs: DataFrame, maxl: int, least_rows: int) -> DataFrame:
    """aln, lag, c: for each pair of places the covariance across the rows of an alignment of at least ``least_rows``.

    Places are those known in the first row; a place unknown in any other row
    takes its pairs with it.
    """
    size = subs.groupBy("aln").agg(F.count_distinct("row").alias("rows"), F.min("row").alias("first")).where(F.col("rows") >= least_rows)
    known = subs.where("x is not null").join(size.hint("merge"), "aln")
    places = known.groupBy("aln", "pos", "rows").agg(F.count(F.lit(1)).alias("m"), F.max((F.col("row") == F.col("first")).cast("int")).alias("lead")).where("lead = 1 and m = rows")
    rows = _pairs(known.join(places.select("aln", "pos").hint("merge"), ["aln", "pos"]).select("aln", "row", "pos", "x"), maxl)
    return rows.groupBy("aln", "pos_a", "pos_b", "lag").agg(F.covar_pop("x_a", "x_b").alias("c")).select("aln", "lag", "c")


def _mutation(subs: DataFrame, maxl: int, least_pairs: int) -> DataFrame:
    """aln, lag, c: for each row and lag the covariance along places with at least ``least_pairs`` pairs."""
    rows = _pairs(subs.where("x is not null"), maxl)
    per = rows.groupBy("aln", "row", "lag").agg(F.covar_pop("x_a", "x_b").alias("c"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= least_pairs)
    return per.select("aln", "lag", "c")


def _rows_mean(subs: DataFrame) -> DataFrame:
    """Each alignment's mean over rows as its one row; one unknown row makes a place unknown."""
    mean = subs.groupBy("aln", "pos").agg(F.when(F.count("x") == F.count(F.lit(1)), F.avg("x")).alias("x"))
    return mean.select("aln", F.lit(0).alias("row"), "pos", "x")


def structure_correlation(subs: DataFrame, maxl: int, least_rows: int = 4) -> DataFrame:
    """lag, cs, n: covariances across rows, averaged by lag."""
    return _structure(subs, maxl, least_rows).groupBy("lag").agg(F.avg("c").alias("cs"), F.count("c").alias("n"))


def mutation_correlation(subs: DataFrame, maxl: int, least_pairs: int = 4) -> DataFrame:
    """lag, cm, n: covariances along rows, averaged by lag."""
    return _mutation(subs, maxl, least_pairs).groupBy("lag").agg(F.avg("c").alias("cm"), F.count("c").alias("n"))


def rate_correlation(subs: DataFrame, maxl: int, least_pairs: int = 4) -> DataFrame:
    """lag, cr, n: mutation_correlation of each alignment's mean over rows."""
    return mutation_correlation(_rows_mean(subs), maxl, least_pairs).withColumnRenamed("cm", "cr")


#: What a state adds up: how many, the sums of both values and of their product.
SUMS = ("n", "sx", "sy", "sxy")


def states_by_kind(subs: DataFrame, maxl: int, least_rows: int = 4, least_pairs: int = 4) -> dict[str, DataFrame]:
    """The states of :func:`states`, a table for each kind, so that a long table can be gone through a kind at a time."""

    def sums(rows: DataFrame, kind: str, x: Column, y: Column) -> DataFrame:
        per = rows.groupBy("aln", "lag").agg(F.count(x * y).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"))
        return per.where("n > 0").select("aln", F.lit(kind).alias("kind"), F.col("lag").cast("long").alias("lag"), *SUMS)

    known, c = subs.where("x is not null"), F.col("c")
    tables = {
        "Ks": (known.withColumn("lag", F.lit(0)), F.col("x"), F.col("x")),
        "Ct": (_pairs(known, maxl), F.col("x_a"), F.col("x_b")),
        "Cs": (_structure(subs, maxl, least_rows), c, c),
        "Cm": (_mutation(subs, maxl, least_pairs), c, c),
        "Cr": (_mutation(_rows_mean(subs), maxl, least_pairs), c, c),
    }
    return {kind: sums(rows, kind, x, y) for kind, (rows, x, y) in tables.items()}


def states(subs: DataFrame, maxl: int, least_rows: int = 4, least_pairs: int = 4) -> DataFrame:
    """aln, kind, lag and the sums from which every statistic of an alignment follows, however many are put together.

    Ks adds up substitutions and their squares, Ct the pairs of known places, and
    Cs, Cm and Cr the covariances of ``structure_correlation``,
    ``mutation_correlation`` and ``rate_correlation`` and their squares.
    """
    out, *rest = states_by_kind(subs, maxl, least_rows, least_pairs).values()
    for part in rest:
        out = out.unionByName(part)
    return out


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States of the same kind and lag put together, within ``by``; the order and grouping of merges make no difference."""
    return parts.groupBy(*(by or []), "kind", "lag").agg(*[F.sum(c).alias(c) for c in SUMS])


def finished(merged_states: DataFrame) -> DataFrame:
    """The states' columns with value and var: Ct's covariance, else the mean and sample variance of what was added (unknown below two)."""
    n = F.col("n")
    mean, spread = F.col("sx") / n, F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, n - 1)
    pairs = F.col("kind") == "Ct"
    return merged_states.withColumns({"value": F.when(pairs, F.col("sxy") / n - mean * (F.col("sy") / n)).otherwise(mean), "var": F.when(~pairs, spread)}).drop("sx", "sy", "sxy")


def resampled(parts: DataFrame, key: str, times: int, seed: int = 1) -> DataFrame:
    """boot, kind, lag and sums: ``times`` resamples of the bundles (key) with replacement, as many draws as bundles each.

    Draws are counted by bundle first. A bundle is then one row with its states
    and the number of times each resample drew it, and a task adds these up to a
    matrix of resamples by states: pairs of resample and bundle are never rows. A
    task's memory is times x kinds x lags.
    """
    parts = written(parts, "states")
    placed, total = numbered(parts.select(key).distinct(), [key])
    drawn = draws(parts.sparkSession, total, times, seed).groupBy("idx", "boot").agg(F.count(F.lit(1)).alias("w"))
    drawn = drawn.groupBy("idx").agg(F.collect_list(F.struct("boot", "w")).alias("drawn"))
    bundles = parts.groupBy(key).agg(F.collect_list(F.struct("kind", "lag", *SUMS)).alias("cells"))
    rows = bundles.join(placed.select(key, F.col("at").alias("idx")), key).join(drawn, "idx").select("drawn", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[str, int], int] = {}
        total = np.zeros((times, 64, len(SUMS)))
        for batch in batches:
            for drawn, own in zip(batch.column("drawn").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                at = np.array([cells.setdefault((c["kind"], c["lag"]), len(cells)) for c in own])
                if len(cells) > total.shape[1]:
                    total = np.concatenate([total, np.zeros((times, 2 * len(cells) - total.shape[1], len(SUMS)))], 1)
                boots, w = np.array([d["boot"] for d in drawn]), np.array([d["w"] for d in drawn], float)
                total[boots[:, None], at] += w[:, None, None] * np.array([[c[s] for s in SUMS] for c in own])
        for (kind, lag), at in cells.items():
            boots = np.flatnonzero(total[:, at, 0])
            yield pa.RecordBatch.from_pydict({"boot": pa.array(boots, pa.int32()), "kind": [kind] * len(boots), "lag": pa.array([lag] * len(boots), pa.int64())} | {s: pa.array(total[boots, at, i].astype(np.int64) if s == "n" else total[boots, at, i]) for i, s in enumerate(SUMS)})

    return merged(rows.mapInArrow(run, "boot int, kind string, lag long, n long, sx double, sy double, sxy double"), ["boot"])


def matching_prefix(letters: DataFrame) -> DataFrame:
    """key, prefix, trusted: letters (key, i, a, b) up to the first mismatch; trusted from half of the length on."""
    per = letters.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("a") != F.col("b"), F.col("i"))).alias("at"))
    return per.select("key", F.coalesce("at", "n").alias("prefix"), (F.coalesce("at", "n") * 2 >= F.col("n")).alias("trusted"))


def bootstrap(bundles: DataFrame, drawn: DataFrame) -> DataFrame:
    """boot and the bundle's columns for each draw (boot, idx) of the bundles (idx): partial sums per bundle are resampled, not their rows."""
    return drawn.join(bundles, "idx")


def draws(spark: SparkSession, n: int, times: int, seed: int = 1) -> DataFrame:
    """boot, draw, idx: ``times`` resamples of n things with replacement; a draw is a seeded hash of (boot, draw), the same here and in SQL."""
    rows = spark.range(times * n).select(F.floor(F.col("id") / n).cast("int").alias("boot"), (F.col("id") % n).alias("draw"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "boot", "draw", F.lit(seed)).cast("binary")), 1, 12), 16, 10).cast("long")
    return rows.withColumn("idx", F.pmod(number, F.lit(n)))


#: Correlations by name, each a function of (substitutions, maxl) that gives lag, its value and n.
CORRELATIONS = {"Ct": ("ct", total_correlation), "Cs": ("cs", structure_correlation), "Cm": ("cm", mutation_correlation), "Cr": ("cr", rate_correlation)}


def bundle(subs: DataFrame, maxl: int, names: tuple[str, ...] = ("Ct", "Cs", "Cm", "Cr")) -> DataFrame:
    """kind, lag, value, n of the named correlations as one table."""
    parts = []
    for name in names:
        column, function = CORRELATIONS[name]
        parts.append(function(subs, maxl).select(F.lit(name).alias("kind"), "lag", F.col(column).alias("value"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
