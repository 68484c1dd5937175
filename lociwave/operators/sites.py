"""Per-site diversity and its covariance by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociwave.functions.stats import clean, covariance, diversity, variance
from lociwave.operators.joins import band_join
from lociwave.operators.order import running


def allele_counts(bases: DataFrame, keys: list[str], base: str = "base", upper: bool = True) -> DataFrame:
    """keys, letter, n: letters other than '*' at each site."""
    letter = F.upper(base) if upper else F.col(base)
    return bases.where(F.col(base) != "*").groupBy(*keys, letter.alias("letter")).agg(F.count(F.lit(1)).alias("n"))


def site_diversity(bases: DataFrame, keys: list[str], base: str = "base") -> DataFrame:
    """keys, num, pi: share of read pairs that differ; null below two reads."""
    per = allele_counts(bases, keys, base).groupBy(*keys).agg(F.sum("n").alias("num"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return per.select(*keys, "num", diversity(F.col("num"), F.col("same")).alias("pi"))


def allele_text(bases: DataFrame, keys: list[str], base: str = "base") -> DataFrame:
    """keys, alleles: 'A:3,C:1', the counts in the order of letters."""
    items = F.sort_array(F.collect_list(F.concat_ws(":", "letter", F.col("n").cast("string"))))
    return allele_counts(bases, keys, base).groupBy(*keys).agg(F.array_join(items, ",").alias("alleles"))


def covariance_by_lag(sites: DataFrame, keys: list[str], maxl: int, value: str = "pi", by: list[str] | None = None, sample: bool = False) -> DataFrame:
    """by, lag, cov, mean_x, mean_y, n over pairs of sites of one group (keys) less than maxl apart."""
    by = [] if by is None else by
    pairs = band_join(sites.where(F.col(value).isNotNull()).select(*keys, "pos", value), keys, "pos", maxl)
    x, y = F.col(f"{value}_a"), F.col(f"{value}_b")
    return pairs.groupBy(*by, "lag").agg(covariance(x, y, sample).alias("cov"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n"))


def chunked(sites: DataFrame, group: list[str], order: str, nominal: int, drop_rest: bool = False) -> DataFrame:
    """Adds chunk: runs of len/nominal rows in order.

    Without ``drop_rest`` the remainder makes further chunks, and fewer rows than
    ``nominal`` are one row a chunk, after an empty one; with it rows beyond
    ``nominal`` chunks are dropped.
    """
    rows = running(sites, group, [order], sums={"__rn": F.lit(1)}, count="__size").withColumn("__size", F.floor(F.col("__size") / nominal))
    chunk = F.when(F.col("__size") > 0, F.floor(F.try_divide(F.col("__rn") - 1, F.col("__size")))).otherwise(F.col("__rn")).cast("long")
    rows = rows.withColumn("chunk", chunk)
    if drop_rest:
        rows = rows.where((F.col("__size") > 0) & (F.col("chunk") < nominal))
    return rows.drop("__size", "__rn")


def mean_variance_by_lag(blocks: DataFrame, value: str = "cov", least: int = 0, sample: bool = True) -> DataFrame:
    """lag, mean, var, n over blocks with at least ``least`` pairs."""
    rows = blocks.where((F.col("n") >= least) & F.col(value).isNotNull())
    return rows.groupBy("lag").agg(clean(F.avg(value)).alias("mean"), clean(F.coalesce(variance(F.col(value), sample), F.lit(0.0))).alias("var"), F.count(F.lit(1)).alias("n"))


def gene_runs(sites: DataFrame, group: list[str], order: str = "pos", gene: str = "gene") -> DataFrame:
    """Adds run: consecutive sites of one gene within a group (a reference).

    The tracker starts at '' and is set only when a run ends, so the first site is
    a run of its own unless the second has no gene.
    """
    rows = running(sites, group, [order], sums={"__n": F.lit(1)}, lags={"__before": gene})
    starts = (F.col("__n") == 1) | (F.col(gene) != F.when(F.col("__n") == 2, F.lit("")).otherwise(F.col("__before")))
    rows = rows.withColumn("__starts", starts.cast("int")).drop("__n", "__before")
    return running(rows, group, [order], sums={"run": F.col("__starts")}).drop("__starts")


def deduplicated_reads(bases: DataFrame, keys: list[str], least: int = 13) -> DataFrame:
    """keys, read_id, base: one letter per read and site; reads that contradict themselves are dropped."""
    rows = bases.where(F.col("qual") >= least).withColumn("base", F.upper("base")).where(F.col("base").rlike("^[ATGC]$"))
    return rows.groupBy(*keys, "read_id").agg(F.min("base").alias("base"), F.max("base").alias("__other")).where("base = __other").drop("__other")


def read_pair_covariance(bases: DataFrame, group: list[str], maxl: int, least: int = 20) -> DataFrame:
    """group, pos_a, pos_b, lag, n_reads, pairs, sx, sy, sxy: read pairs that differ at either or both of two sites.

    Reads are joined on their id, counted by (base, base), and pairs follow from
    the counts: no pair of reads is ever formed.
    """
    pairs = band_join(bases.select(*group, "read_id", "pos", "base"), [*group, "read_id"], "pos", maxl)
    site = [*group, "pos_a", "pos_b", "lag"]
    cell = pairs.groupBy(*site, "base_a", "base_b").agg(F.count(F.lit(1)).alias("n"))
    return doublet_statistics(cell, site, "base_a", "base_b", "n").where(F.col("n_reads") >= least)


#: The parts of a gene's covariance, in the order of the wide table.
PARTS = ("cs", "cr", "ct", "xbar", "ybar")


def gene_covariance(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cs, cr, ct, xbar, ybar, n over the site pairs of ``read_pair_covariance`` of one gene and lag (keys).

    cs is the mean of the pairs' covariances, ct that of all read pairs together,
    cr the covariance of the two sites' diversities, whose means are xbar and ybar.
    """
    n, total = F.col("pairs"), F.sum("pairs")
    x, y = F.col("sx") / n, F.col("sy") / n
    pooled = F.sum("sxy") / total - F.sum("sx") / total * (F.sum("sy") / total)
    return pairs.groupBy(*keys).agg(F.avg(F.col("sxy") / n - x * y).alias("cs"), F.covar_pop(x, y).alias("cr"), pooled.alias("ct"), F.avg(x).alias("xbar"), F.avg(y).alias("ybar"), F.count(F.lit(1)).alias("n"))


def over_genes(genes: DataFrame, least: int = 50) -> DataFrame:
    """lag and mean, var, n of each part over genes with at least ``least`` site pairs and no unknown covariance; the variance of one gene is 0."""
    rows = genes.where((F.col("n") >= least) & F.col("cs").isNotNull() & F.col("cr").isNotNull() & F.col("ct").isNotNull())
    made = [x for p in PARTS for x in (clean(F.avg(p)).alias(f"mean_{p}"), clean(F.coalesce(variance(F.col(p), True), F.lit(0.0))).alias(f"var_{p}"), F.count(p).alias(f"n_{p}"))]
    return rows.groupBy("lag").agg(*made)


def doublet_statistics(cells: DataFrame, keys: list[str], x: str, y: str, n: str, extra: str | None = None) -> DataFrame:
    """keys, n_reads, pairs, sx, sy, sxy from counts of (x, y) letters; and the sum of another column as ``extra``."""
    both = lambda c: c * (c - 1) / 2.0
    rows = cells.groupBy(*keys, x).agg(F.sum(extra or n).alias("__extra"), F.sum(n).alias("__row"), F.collect_list(F.struct(F.col(y).alias("y"), F.col(n).alias("n"))).alias("__cells"), F.sum(both(F.col(n))).alias("__cell"))
    per = rows.groupBy(*keys).agg(F.sum("__extra").alias("extra"), F.sum("__row").alias("n_reads"), F.sum(both(F.col("__row"))).alias("__rows"), F.sum("__cell").alias("__same"), F.flatten(F.collect_list("__cells")).alias("__cells"))
    letters = F.array_distinct(F.transform("__cells", lambda c: c["y"]))
    column = lambda y: F.aggregate(F.filter("__cells", lambda c: c["y"] == y), F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    per = per.withColumn("__columns", F.aggregate(F.transform(letters, lambda y: both(column(y))), F.lit(0.0), lambda a, c: a + c))
    pairs = both(F.col("n_reads"))
    return per.select(*keys, *(["extra"] if extra else []), "n_reads", pairs.alias("pairs"), (pairs - F.col("__rows")).alias("sx"), (pairs - F.col("__columns")).alias("sy"), (pairs - F.col("__rows") - F.col("__columns") + F.col("__same")).alias("sxy"))
