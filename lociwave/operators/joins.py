"""Band and interval joins by bins: equi-joins that Spark can shuffle, split and broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(df: DataFrame, columns: list[str], side: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{side}") for c in columns]


def band_join(df: DataFrame, keys: list[str], pos: str, maxl: int, right: DataFrame | None = None) -> DataFrame:
    """Pairs of rows of one group with 0 <= pos_b - pos_a < maxl: the keys, both sides' columns (suffixes _a, _b) and lag.

    Positions are cut into bins of maxl; b is sent to its own bin and the one
    before, a to its own, so a pair meets exactly once.
    """
    other = df if right is None else right
    a = df.select(*keys, *_named(df, [c for c in df.columns if c not in keys], "a"), F.floor(F.col(pos) / maxl).alias("__bin"))
    bin_b = F.floor(F.col(pos) / maxl)
    b = other.select(*keys, *_named(other, [c for c in other.columns if c not in keys], "b"), F.explode(F.array(bin_b, bin_b - 1)).alias("__bin"))
    lag = F.col(f"{pos}_b") - F.col(f"{pos}_a")
    return a.join(b, [*keys, "__bin"]).where((lag >= 0) & (lag < maxl)).drop("__bin").withColumn("lag", lag)


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows whose half-open intervals overlap, once each: keys and both sides' columns (suffixes _a, _b).

    Both sides are sent to every bin they touch; a pair is kept only in the bin
    where the later of the two starts.
    """
    def binned(df: DataFrame, side: str) -> DataFrame:
        first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
        rows = df.where(F.col(end) > F.col(start))
        return rows.select(*keys, *_named(df, [c for c in df.columns if c not in keys], side), F.explode(F.sequence(first, last)).alias("__bin"))

    rows = binned(a, "a").join(binned(b, "b"), [*keys, "__bin"])
    later = F.greatest(f"{start}_a", f"{start}_b")
    meets = (F.col(f"{start}_a") < F.col(f"{end}_b")) & (F.col(f"{start}_b") < F.col(f"{end}_a"))
    return rows.where(meets & (F.floor(later / width) == F.col("__bin"))).drop("__bin")
