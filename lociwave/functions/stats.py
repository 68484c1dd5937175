"""Statistics with explicit gates; undefined results are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def choose2(n: Column) -> Column:
    """Unordered pairs of n things, as double (exact below 2^53)."""
    return n * (n - 1) / F.lit(2.0)


def clean(x: Column, digits: int = 9) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def known(x: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(x), x)


def variance(x: Column, sample: bool, least: int = 2) -> Column:
    """Variance over a group of at least ``least`` values, else null."""
    return F.when(F.count(x) >= least, F.var_samp(x) if sample else F.var_pop(x))


def covariance(x: Column, y: Column, sample: bool = False, least: int = 1) -> Column:
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    return F.when(n >= max(least, 2 if sample else 1), F.covar_samp(x, y) if sample else F.covar_pop(x, y))


def diversity(total: Column, same: Column) -> Column:
    """Share of pairs that differ, from a site's depth and its sum of squared allele counts."""
    return F.try_divide(total * total - same, total * (total - 1))
