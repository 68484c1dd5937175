"""Pileup to diversity to covariance: pi, Ks, chunks, read pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociwave.functions.sequence import CODING, FOURFOLD, THIRD, masked_qualities, of_type
from lociwave.functions.stats import clean, variance
from lociwave.operators import reads as R
from lociwave.operators import sites as S
from lociwave.plans.registry import query
from lociwave.sources import sinks
from lociwave.sources.views import POS_TYPE, view

SITE = ["genome", "pos"]
TYPE = POS_TYPE.format(pos="pos")
# Naive forms for the oracle: pairs of counts, joins of sites.
PI_SQL = "counts AS (SELECT genome, pos, upper(base) AS b, count(*) AS n FROM {t} WHERE base <> '*' GROUP BY ALL), pi AS (SELECT genome, pos, sum(n)::BIGINT AS num, CASE WHEN sum(n) > 1 THEN (SELECT coalesce(sum(x.n * y.n), 0) FROM counts x JOIN counts y ON x.genome = y.genome AND x.pos = y.pos AND x.b < y.b WHERE x.genome = c.genome AND x.pos = c.pos) / (sum(n) * (sum(n) - 1) / 2.0) END AS pi FROM counts c GROUP BY genome, pos)"


def typed(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", f"{TYPE} AS pos_type", "CAST(floor((pos - 1) / 12) AS BIGINT) AS gene")


@query(", " + PI_SQL.format(t="bases") + " SELECT genome, pos, num, round(pi, 9) + 0.0 AS pi FROM pi", "bases")
def pi_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: share of read pairs with different letters at each site."""
    return S.site_diversity(view(spark, sf_dir, "bases"), SITE).withColumn("pi", clean(F.col("pi")))


@query(", " + PI_SQL.format(t="raw_bases") + " SELECT genome, pos, num, round(pi, 9) + 0.0 AS pi FROM pi", "raw_bases")
def pi_raw_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: as pi_per_site, with '.' and ',' as letters of their own."""
    return S.site_diversity(view(spark, sf_dir, "raw_bases"), SITE).withColumn("pi", clean(F.col("pi")))


@query(" SELECT genome, pos, string_agg(b || ':' || n, ',' ORDER BY b) AS alleles FROM (SELECT genome, pos, upper(base) AS b, count(*) AS n FROM raw_bases WHERE base <> '*' GROUP BY ALL) GROUP BY genome, pos", "raw_bases")
def allele_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the allele counts of each site."""
    return S.allele_text(view(spark, sf_dir, "raw_bases"), SITE)


def long_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(S.site_diversity(view(spark, sf_dir, "long_bases"), SITE))


COV = "round(covar_pop(x.pi, y.pi), 9) + 0.0 AS cov, round(avg(x.pi), 9) + 0.0 AS mean_x, round(avg(y.pi), 9) + 0.0 AS mean_y, count(*) AS n"
BAND = "FROM t x JOIN t y ON x.genome = y.genome AND y.pos >= x.pos AND y.pos - x.pos < {maxl}"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: clean(F.col(c)) for c in ("cov", "mean_x", "mean_y")})


@query(", " + PI_SQL.format(t="long_bases") + f", t AS (SELECT * FROM pi WHERE pi IS NOT NULL) SELECT y.pos - x.pos AS lag, {COV} {BAND.format(maxl=100)} GROUP BY 1", "long_bases")
def pi_cov_by_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of diversity at two sites by their distance."""
    return rounded(S.covariance_by_lag(long_sites(spark, sf_dir), ["genome"], 100))


def _typed_cov(spark: SparkSession, sf_dir: str, wanted: int) -> DataFrame:
    sites = long_sites(spark, sf_dir)
    return rounded(S.covariance_by_lag(sites.where(of_type(F.col("pos_type"), wanted)), ["genome"], 60))


def _typed_sql(kinds: str) -> str:
    return ", " + PI_SQL.format(t="long_bases") + f", t AS (SELECT * FROM pi WHERE pi IS NOT NULL AND {TYPE.replace('/', '//')} IN {kinds}) SELECT y.pos - x.pos AS lag, {COV} {BAND.format(maxl=60)} GROUP BY 1"


@query(_typed_sql("(3, 4)"), "long_bases")
def pos_type_filter_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third positions, fourfold ones included."""
    return _typed_cov(spark, sf_dir, THIRD)


@query(_typed_sql("(1, 2, 3, 4)"), "long_bases")
def pos_type_filter_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed_cov(spark, sf_dir, CODING)


@query(_typed_sql("(4)"), "long_bases")
def pos_type_filter_fourfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed_cov(spark, sf_dir, FOURFOLD)


CHUNK = "ch AS (SELECT *, count(*) OVER (PARTITION BY genome) // {k} AS size, row_number() OVER (PARTITION BY genome ORDER BY pos) AS rn FROM pi), t AS (SELECT genome, pos, pi, CASE WHEN size > 0 THEN (rn - 1) // size ELSE rn END AS chunk FROM ch WHERE pi IS NOT NULL{drop})"
BLOCKS = "blocks AS (SELECT x.genome, x.chunk, y.pos - x.pos AS lag, covar_pop(x.pi, y.pi) AS cov, count(*) AS n FROM t x JOIN t y ON x.genome = y.genome AND x.chunk = y.chunk AND y.pos >= x.pos AND y.pos - x.pos < {maxl} GROUP BY ALL) SELECT lag, round(avg(cov), 9) + 0.0 AS mean, coalesce(round(CASE WHEN count(*) > 1 THEN var_samp(cov) END, 9), 0.0) + 0.0 AS var, count(*) AS n FROM blocks WHERE n >= {least} GROUP BY lag"


def _blocks(spark: SparkSession, sf_dir: str, nominal: int, drop: bool, maxl: int, least: int) -> DataFrame:
    sites = S.chunked(long_sites(spark, sf_dir), ["genome"], "pos", nominal, drop)
    return S.mean_variance_by_lag(S.covariance_by_lag(sites, ["genome", "chunk"], maxl, by=["genome", "chunk"]), least=least)


@query(", " + PI_SQL.format(t="long_bases") + ", " + CHUNK.format(k=100, drop="") + ", " + BLOCKS.format(maxl=60, least=10), "long_bases")
def pi_cov_blocks_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance per chunk of sites (about 100), its mean and variance over chunks; chunks of fewer than 10 pairs are left out."""
    return _blocks(spark, sf_dir, 100, False, 60, 10)


@query(", " + PI_SQL.format(t="long_bases") + ", " + CHUNK.format(k=1000, drop=" AND size > 0 AND (rn - 1) // size < 1000") + ", " + BLOCKS.format(maxl=60, least=0), "long_bases")
def pi_cov_blocks_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 equal chunks, the rest dropped."""
    return _blocks(spark, sf_dir, 1000, True, 60, 0)


@query(", " + PI_SQL.format(t="long_bases") + f", {CHUNK.format(k=100, drop='')}, k AS (SELECT genome, chunk, avg(pi) AS ks FROM t WHERE {POS_TYPE.format(pos='(pos + 1)').replace('/', '//')} IN (3, 4) GROUP BY ALL) SELECT round(avg(ks), 9) AS ks, round(var_samp(ks), 9) AS var_ks, count(*) AS n FROM k", "long_bases")
def ks_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean diversity of third positions per chunk, mean and variance over chunks. As in the original the type is read one place on."""
    sites = S.chunked(long_sites(spark, sf_dir), ["genome"], "pos", 100).where("pi is not null")
    third = sites.selectExpr("genome", "chunk", "pi", f"{POS_TYPE.format(pos='(pos + 1)')} AS next_type").where(of_type(F.col("next_type"), THIRD))
    per = third.groupBy("genome", "chunk").agg(F.avg("pi").alias("ks"))
    return per.agg(clean(F.avg("ks")).alias("ks"), clean(F.var_samp("ks")).alias("var_ks"), F.count("ks").alias("n"))


@query("SELECT id, string_agg(CASE WHEN i % 60 + 20 < 30 THEN '*' ELSE substr(word, i, 1) END, '' ORDER BY i) AS letters FROM (SELECT p_partkey AS id, p_name AS word, unnest(range(1, length(p_name) + 1)) AS i FROM part) GROUP BY id")
def qual_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of low quality are masked (qualities here are bytes 20 to 79 in turn)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("length(p_name) > 0")
    quals = F.array_join(F.transform(F.sequence(F.lit(1), F.length("p_name")), lambda i: F.chr(i % 60 + 20)), "")
    return part.select(F.col("p_partkey").alias("id"), masked_qualities(F.col("p_name"), quals).alias("letters"))


@query(" SELECT genome, pos, count(*) FILTER (base <> '*') AS depth FROM raw_bases GROUP BY ALL HAVING count(*) FILTER (base <> '*') >= 10", "raw_bases")
def depth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with at least ten letters."""
    rows = view(spark, sf_dir, "raw_bases").groupBy(*SITE).agg(F.count(F.when(F.col("base") != "*", 1)).alias("depth"))
    return rows.where("depth >= 10")


DEDUPE = "dd AS (SELECT genome, pos, read_id, min(upper(base)) AS base FROM bases WHERE qual >= 13 GROUP BY ALL HAVING count(DISTINCT upper(base)) = 1)"


@query(f", {DEDUPE} SELECT genome, pos, count(*) AS reads, count(*) FILTER (base = 'A') AS a FROM dd GROUP BY ALL", "bases")
def dedupe_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One letter per read and site; contradictions are dropped."""
    rows = S.deduplicated_reads(view(spark, sf_dir, "bases"), SITE)
    return rows.groupBy(*SITE).agg(F.count(F.lit(1)).alias("reads"), F.count(F.when(F.col("base") == "A", 1)).alias("a"))


@query(" SELECT genome, pos, string_agg(base, '' ORDER BY read_id, ord, base) AS letters, count(*) AS depth FROM bases GROUP BY ALL", "bases")
def pileup_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters over each site, sorted by read."""
    rows = view(spark, sf_dir, "bases")
    ordered = F.array_sort(F.collect_list(F.struct("read_id", "ord", "base")))
    return rows.groupBy(*SITE).agg(F.array_join(F.transform(ordered, lambda x: x["base"]), "").alias("letters"), F.count(F.lit(1)).alias("depth"))


@query(" SELECT genome, pos, count(*) AS depth FROM long_bases WHERE pos < (SELECT max(pos) FROM long_bases b WHERE b.genome = long_bases.genome) - 100 GROUP BY ALL", "long_bases")
def flush_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pileup with a lateness of 100 has emitted when the input ends."""
    rows = R.flushed(view(spark, sf_dir, "long_bases").select("genome", "pos"), ["genome"], F.col("pos"))
    return rows.groupBy(*SITE).agg(F.count(F.lit(1)).alias("depth"))


RUN_SITES = "rs AS (SELECT DISTINCT genome, pos, CASE WHEN pos % 17 = 0 THEN '' ELSE CAST((pos - 1) // 12 AS VARCHAR) END AS gene FROM long_bases), nn AS (SELECT *, row_number() OVER (PARTITION BY genome ORDER BY pos) AS rn, lag(gene) OVER (PARTITION BY genome ORDER BY pos) AS prev FROM rs), runs AS (SELECT genome, pos, gene, CAST(sum(CASE WHEN rn = 1 OR gene <> CASE WHEN rn = 2 THEN '' ELSE prev END THEN 1 ELSE 0 END) OVER (PARTITION BY genome ORDER BY pos) AS BIGINT) AS run FROM nn)"


def _gene_names() -> Column:
    return F.when(F.col("pos") % 17 == 0, "").otherwise(F.floor((F.col("pos") - 1) / 12).cast("string"))


@query(f", {RUN_SITES} SELECT genome, run, gene, min(pos) AS first_pos, count(*) AS n FROM runs GROUP BY ALL", "long_bases")
def gene_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive sites of one gene."""
    sites = view(spark, sf_dir, "long_bases").select(*SITE).distinct().withColumn("gene", _gene_names())
    return S.gene_runs(sites, ["genome"]).groupBy("genome", "run", "gene").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))


PAIRS = "pr AS (SELECT x.genome, x.pos AS pos_a, y.pos AS pos_b, x.read_id, x.base AS ba, y.base AS bb FROM dd x JOIN dd y ON x.genome = y.genome AND x.read_id = y.read_id AND y.pos >= x.pos AND y.pos - x.pos < 12), pc AS (SELECT genome, pos_a, pos_b, count(*) AS n_reads, count(*) * (count(*) - 1) / 2.0 AS pairs FROM pr GROUP BY ALL HAVING count(*) >= 20), cells AS (SELECT genome, pos_a, pos_b, ba, bb, count(*) AS n FROM pr GROUP BY ALL), sums AS (SELECT p.genome, p.pos_a, p.pos_b, coalesce(sum(p.n * q.n) FILTER (p.ba <> q.ba), 0) / 2.0 AS sx, coalesce(sum(p.n * q.n) FILTER (p.bb <> q.bb), 0) / 2.0 AS sy, coalesce(sum(p.n * q.n) FILTER (p.ba <> q.ba AND p.bb <> q.bb), 0) / 2.0 AS sxy FROM cells p JOIN cells q ON p.genome = q.genome AND p.pos_a = q.pos_a AND p.pos_b = q.pos_b GROUP BY ALL), st AS (SELECT pc.*, sx, sy, sxy FROM pc JOIN sums USING (genome, pos_a, pos_b))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_pair_covariance(S.deduplicated_reads(view(spark, sf_dir, "bases"), SITE), ["genome"], 12)


@query(f", {DEDUPE}, {PAIRS} SELECT genome, pos_a, pos_b, n_reads, pairs, sx, sy, sxy, round(sxy / pairs - (sx / pairs) * (sy / pairs), 9) + 0.0 AS cov FROM st", "bases")
def read_pair_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance over read pairs at two sites, from letter counts."""
    n = F.col("pairs")
    return _pairs(spark, sf_dir).select("genome", "pos_a", "pos_b", "n_reads", "pairs", "sx", "sy", "sxy", clean(F.col("sxy") / n - (F.col("sx") / n) * (F.col("sy") / n)).alias("cov"))


PER_GENE = "per AS (SELECT genome, (pos_a - 1) // 12 AS gene, pos_b - pos_a AS lag, avg(sxy / pairs - (sx / pairs) * (sy / pairs)) AS cs, sum(sxy) / sum(pairs) - (sum(sx) / sum(pairs)) * (sum(sy) / sum(pairs)) AS ct, covar_pop(sx / pairs, sy / pairs) AS cr, avg(sx / pairs) AS xbar, avg(sy / pairs) AS ybar, count(*) AS n FROM st WHERE (pos_a - 1) // 12 = (pos_b - 1) // 12 GROUP BY ALL)"
WIDE = ", ".join(f"round(avg({p}), 9) + 0.0 AS mean_{p}, coalesce(round(CASE WHEN count(*) > 1 THEN var_samp({p}) END, 9), 0.0) + 0.0 AS var_{p}, count({p}) AS n_{p}" for p in S.PARTS)


def _per_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of twelve places: a gene has few site pairs of a lag, so the gate is 2 here."""
    gene = lambda c: F.floor((F.col(c) - 1) / 12)
    rows = _pairs(spark, sf_dir).where(gene("pos_a") == gene("pos_b")).withColumn("gene", gene("pos_a"))
    return S.over_genes(S.gene_covariance(rows, ["genome", "gene", "lag"]), 2)


@query(f", {DEDUPE}, {PAIRS}, {PER_GENE} SELECT lag, {WIDE} FROM per WHERE n >= 2 GROUP BY lag", "bases")
def gene_covariance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, variance and count of the five parts over genes, in sixteen columns."""
    return sinks.wide_lags(_per_gene(spark, sf_dir))


@query(f", {DEDUPE}, {PAIRS}, {PER_GENE}, wd AS (SELECT lag, {WIDE} FROM per WHERE n >= 2 GROUP BY lag) SELECT lag, mean_cs AS cs, mean_ct AS ct, mean_cr AS cr, var_cr, n_cr AS n FROM wd", "bases")
def cs_cr_ct_by_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure, rate and total covariance per gene and lag, averaged over genes with enough site pairs."""
    return _per_gene(spark, sf_dir).select("lag", F.col("mean_cs").alias("cs"), F.col("mean_ct").alias("ct"), F.col("mean_cr").alias("cr"), "var_cr", F.col("n_cr").alias("n"))


@query(" SELECT pos_type, count(*) AS sites, count(DISTINCT genome) AS genomes FROM (SELECT DISTINCT genome, pos, " + TYPE.replace("/", "//") + " AS pos_type FROM long_bases) GROUP BY pos_type", "long_bases")
def site_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sites each position type has."""
    sites = typed(view(spark, sf_dir, "long_bases").select(*SITE).distinct())
    return sites.groupBy("pos_type").agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("genome").alias("genomes"))


@query(" SELECT genome, pos, read_id, base FROM bases QUALIFY row_number() OVER (PARTITION BY genome, pos ORDER BY qual DESC, read_id, ord) = 1", "bases")
def best_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The read of the best quality at each site."""
    w = Window.partitionBy(*SITE).orderBy(F.col("qual").desc(), "read_id", "ord")
    return view(spark, sf_dir, "bases").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("genome", "pos", "read_id", "base")
