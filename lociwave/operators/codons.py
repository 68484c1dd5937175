"""Codon pairs, synonymous groups, doublet counts, P2 and P4 profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociwave.functions.sequence import translated
from lociwave.functions.stats import choose2, clean
from lociwave.operators.joins import band_join
from lociwave.operators.sites import doublet_statistics


def piled(codons: DataFrame) -> DataFrame:
    """One codon per gene, place and read: the last record wins (column ord)."""
    return codons.groupBy("gene_id", "gene_pos", "read_id").agg(F.max_by("codon", "ord").alias("codon"))


def codon_pairs(codons: DataFrame, maxl: int, compat: bool = True) -> DataFrame:
    """Pairs of codons of one read by lag: gene_id, gene_pos_a, gene_pos_b, lag, codon_a, codon_b, n.

    At lag 0 each codon pairs with itself, twice when ``compat``: the pair is
    counted in both directions.
    """
    rows = band_join(codons.select("gene_id", "read_id", "gene_pos", "codon"), ["gene_id", "read_id"], "gene_pos", maxl)
    weight = F.when((F.col("lag") == 0) & F.lit(compat), 2).otherwise(1)
    return rows.groupBy("gene_id", "gene_pos_a", "gene_pos_b", "lag", "codon_a", "codon_b").agg(F.sum(weight).alias("n"))


def own_pairs(codons: DataFrame) -> DataFrame:
    """``codon_pairs`` at lag 0: each codon with itself, in both directions, without a join."""
    place = F.col("gene_pos")
    counts = codons.groupBy("gene_id", "gene_pos", "codon").agg((F.count(F.lit(1)) * 2).alias("n"))
    return counts.select("gene_id", place.alias("gene_pos_a"), place.alias("gene_pos_b"), F.lit(0).cast("bigint").alias("lag"), F.col("codon").alias("codon_a"), F.col("codon").alias("codon_b"), "n")


def synonymous(pairs: DataFrame) -> DataFrame:
    """Adds aa_a, aa_b; pairs with a codon that is not four-letter DNA go."""
    rows = pairs.withColumns({"aa_a": translated(F.col("codon_a")), "aa_b": translated(F.col("codon_b"))})
    return rows.where("aa_a is not null and aa_b is not null")


SITE = ["gene_id", "gene_pos_a", "gene_pos_b", "lag"]


def doublets(pairs: DataFrame) -> DataFrame:
    """Counts of third-base pairs per site pair and synonymous group."""
    third = lambda c: F.substring(c, 3, 1)
    return synonymous(pairs).groupBy(*SITE, "aa_a", "aa_b", third("codon_a").alias("x"), third("codon_b").alias("y")).agg(F.sum("n").alias("n"))


def cov11(cells: DataFrame, keys: list[str], least_allele: int = 0) -> DataFrame:
    """keys, size, xy, pairs: pairs of reads that differ at both places, over cells of more than ``least_allele``.

    size counts all cells; the closed form replaces the loop over pairs of cells.
    """
    counted = F.when(F.col("n") > least_allele, F.col("n")).otherwise(F.lit(0).cast("bigint"))
    stats = doublet_statistics(cells.withColumn("counted", counted), keys, "x", "y", "counted", extra="n")
    return stats.select(*keys, F.col("extra").alias("size"), F.col("sxy").alias("xy"), "pairs")


def cov00(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, xy, pairs: pairs of reads that agree at both places."""
    return cells.groupBy(*keys).agg(F.sum(choose2(F.col("n"))).alias("xy"), F.sum("n").alias("__n")).select(*keys, "xy", choose2(F.col("__n")).alias("pairs"))


def cov_mate11(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, xy, pairs between two clusters: pairs (one read of each) that differ at both places."""
    def sums(df: DataFrame, s: str) -> DataFrame:
        cell = df.select(*keys, F.struct("x", "y").alias("c"), F.col("n"))
        return cell.groupBy(*keys).agg(F.collect_list(F.struct("c", "n")).alias(f"cells_{s}"), F.sum("n").alias(f"n_{s}"))

    rows = sums(left, "l").join(sums(right, "r"), keys)
    differ = F.aggregate("cells_l", F.lit(0).cast("bigint"), lambda a, p: a + F.aggregate("cells_r", F.lit(0).cast("bigint"), lambda b, q: b + F.when((p["c"]["x"] != q["c"]["x"]) & (p["c"]["y"] != q["c"]["y"]), p["n"] * q["n"]).otherwise(0)))
    return rows.select(*keys, differ.cast("double").alias("xy"), (F.col("n_l") * F.col("n_r")).cast("double").alias("pairs"))


def p2(codons: DataFrame, maxl: int, least_depth: int = 5, least_allele: int = 0) -> DataFrame:
    """gene_id, lag, value, count over synonymous groups of more than ``least_depth`` reads; every lag up to the greatest is there."""
    keys = [*SITE, "aa_a", "aa_b"]
    per = cov11(doublets(codon_pairs(codons, maxl)), keys, least_allele).where(F.col("size") > least_depth)
    per = per.groupBy("gene_id", "lag").agg(F.sum("xy").alias("value"), F.sum("pairs").alias("count"))
    lags = per.groupBy("gene_id").agg(F.max("lag").alias("last")).select("gene_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("lag"))
    return lags.join(per, ["gene_id", "lag"], "left").na.fill(0.0, ["value", "count"])


def p4(codons: DataFrame, maxl: int, least_depth: int = 5, least_allele: int = 0) -> DataFrame:
    """gene_id, lag, value, count: products of the diversities of two places."""
    keys = [*SITE, "aa_a", "aa_b"]
    own = cov11(doublets(own_pairs(codons)), keys, least_allele).where(F.col("size") > least_depth)
    place = own.groupBy("gene_id", F.col("gene_pos_a").alias("pos")).agg(F.sum("xy").alias("xy"), F.sum("pairs").alias("pairs"))
    place = place.where("pairs > 0").select("gene_id", "pos", (F.col("xy") / F.col("pairs")).alias("d"))
    rows = band_join(place, ["gene_id"], "pos", maxl)
    return rows.groupBy("gene_id", "lag").agg(F.sum(F.col("d_a") * F.col("d_b")).alias("value"), F.count(F.lit(1)).cast("double").alias("count"))


def collected(results: DataFrame, by_gene: bool = True) -> DataFrame:
    """gene_id ('all' for all genes together), type, lag, mean, var, n of value/count, by grouping sets."""
    rows = results.where("count > 0").withColumn("x", F.col("value") / F.col("count"))
    sets = [[F.col("gene_id"), F.col("type"), F.col("lag")], [F.col("type"), F.col("lag")]] if by_gene else [[F.col("type"), F.col("lag")]]
    x = F.col("x")
    out = rows.groupingSets(sets, F.col("gene_id"), F.col("type"), F.col("lag")).agg(F.avg(x).alias("mean"), F.when(F.count(x) >= 2, F.var_pop(x)).alias("var"), F.count(x).alias("n"), F.grouping("gene_id").alias("__all"))
    return out.select(F.when(F.col("__all") == 1, "all").otherwise(F.col("gene_id").cast("string")).alias("gene_id"), "type", "lag", "mean", "var", "n")


def normalised(profile: DataFrame, step: int = 3) -> DataFrame:
    """Values by the P2 value at lag 0 (type Ks); lags in bases. A missing or zero Ks gives null, never a division by zero."""
    first = (F.col("type") == "P2") & (F.col("lag") == 0)
    # A gene's profile is a row for each type and lag: the window is as small, and the profile is made once.
    rows = profile.withColumn("__ks", F.max(F.when(first, F.col("mean"))).over(Window.partitionBy("gene_id")))
    share = lambda x, k: F.try_divide(x, k)
    return rows.select("gene_id", (F.col("lag") * step).alias("lag"), clean(F.when(first, F.col("mean")).otherwise(share(F.col("mean"), F.col("__ks")))).alias("m"), clean(F.when(first, F.col("var")).otherwise(share(F.col("var"), F.col("__ks") * F.col("__ks")))).alias("v"), "n", F.when(first, "Ks").otherwise(F.col("type")).alias("t"))


def covered(codons: DataFrame, gene_length: Column, least_depth: int = 5, least_share: float = 0.5) -> DataFrame:
    """gene_id, share for genes whose places deeper than ``least_depth`` cover more than ``least_share`` of the gene."""
    depth = codons.groupBy("gene_id", "gene_pos", gene_length.alias("gene_len")).agg(F.count(F.lit(1)).alias("depth"))
    per = depth.groupBy("gene_id", "gene_len").agg(F.sum((F.col("depth") > least_depth).cast("int")).alias("deep"))
    return per.withColumn("share", 3 * F.col("deep") / F.col("gene_len")).where(F.col("share") > least_share).select("gene_id", "share")


def subsampled(reads: DataFrame, key: str, share: Column, seed: int = 1) -> DataFrame:
    """Bernoulli sample by a seeded hash of the read id: the same reads on every run, here and in SQL."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
    return reads.where(number < share * float(1 << 32))


def to_depth(reads: DataFrame, gene: str, gene_length: Column, most: int, key: str = "read_id", seed: int = 1) -> DataFrame:
    """Reads of each gene (columns gene, ord, len) sampled to a depth of about ``most``.

    The share is the whole number of reads of the first one's length that make the
    depth, by the number of reads; a gene with no more than these keeps all.
    """
    per = reads.groupBy(gene).agg(F.count(F.lit(1)).alias("__n"), F.min_by("len", "ord").alias("__len"))
    rows = reads.join(per, gene)
    return subsampled(rows, key, F.floor(F.try_divide(gene_length * most, F.col("__len"))) / F.col("__n"), seed).drop("__n", "__len")


def codons_of_reads(reads: DataFrame) -> DataFrame:
    """gene_id, gene_pos, read_id, codon of mapped reads (seq, pos 0-based) in genes (start 1-based, end, strand).

    A codon needs three mapped bases that end in frame; on the reverse strand its
    letters are reverse-complemented while its number stays left to right.
    """
    offset = F.col("pos") + 1 - F.col("gene_start")
    rows = reads.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("seq") - 1)))
    place = F.col("i") + offset
    rows = rows.where((F.pmod(place + 1, F.lit(3)) == 0) & (F.col("i") >= 2) & ((place + 1) / 3 - 1 >= 0) & (place < F.col("gene_end") - F.col("gene_start") + 1))
    codon = F.substr(F.col("seq"), F.col("i") - 1, F.lit(3))
    turned = F.translate(F.reverse(codon), "ATGCatgc", "TACGtacg")
    rows = rows.select("gene_id", ((place + 1) / 3 - 1).cast("long").alias("gene_pos"), "read_id", F.when(F.col("strand") == "-", turned).otherwise(codon).alias("codon"))
    return without_gaps(rows)


def without_gaps(rows: DataFrame, codon: str = "codon") -> DataFrame:
    """Codons whose three letters are known."""
    return rows.where(~F.col(codon).contains("-"))
