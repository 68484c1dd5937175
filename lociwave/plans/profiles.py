"""Codon pairs to P2 and P4, collection over genes, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociwave.functions.sequence import genetic_code
from lociwave.functions.stats import clean
from lociwave.operators import codons as C
from lociwave.plans.registry import query
from lociwave.sources.views import view

MAXL, DEPTH = 6, 5
CODE = "code(codon, aa) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in sorted(genetic_code().items())) + ")"
# Every pair of codons of a read, one row each (lag 0 twice), and pairs of those pairs: loops, no closed form.
PAIRED = "cp AS (SELECT x.gene_id, x.read_id, x.gene_pos AS pos_a, y.gene_pos AS pos_b, x.codon AS ca, y.codon AS cb, CASE WHEN x.gene_pos = y.gene_pos THEN 2 ELSE 1 END AS w FROM codons x JOIN codons y USING (gene_id, read_id) WHERE y.gene_pos >= x.gene_pos AND y.gene_pos - x.gene_pos < {maxl})"
SYN = CODE + ", sy AS (SELECT cp.*, p.aa AS aa_a, q.aa AS aa_b, substr(ca, 3, 1) AS x, substr(cb, 3, 1) AS y FROM cp JOIN code p ON p.codon = ca JOIN code q ON q.codon = cb), db AS (SELECT gene_id, pos_a, pos_b, aa_a, aa_b, x, y, sum(w)::BIGINT AS n FROM sy GROUP BY ALL)"
C11 = "g AS (SELECT gene_id, pos_a, pos_b, aa_a, aa_b, sum(n) AS size FROM db GROUP BY ALL), c11 AS (SELECT g.*, (SELECT coalesce(sum(p.n * q.n), 0) / 2.0 FROM db p, db q WHERE (p.gene_id, p.pos_a, p.pos_b, p.aa_a, p.aa_b) = (g.gene_id, g.pos_a, g.pos_b, g.aa_a, g.aa_b) AND (q.gene_id, q.pos_a, q.pos_b, q.aa_a, q.aa_b) = (g.gene_id, g.pos_a, g.pos_b, g.aa_a, g.aa_b) AND p.x <> q.x AND p.y <> q.y) AS xy, size * (size - 1) / 2.0 AS pairs FROM g)"
P2 = f"p2 AS (SELECT gene_id, pos_b - pos_a AS lag, sum(xy) AS value, sum(pairs) AS count FROM c11 WHERE size > {DEPTH} GROUP BY ALL)"
P4 = f"dv AS (SELECT gene_id, pos_a AS pos, sum(xy) / sum(pairs) AS d FROM c11 WHERE size > {DEPTH} AND pos_a = pos_b GROUP BY ALL), p4 AS (SELECT x.gene_id, y.pos - x.pos AS lag, sum(x.d * y.d) AS value, count(*)::DOUBLE AS count FROM dv x JOIN dv y ON x.gene_id = y.gene_id AND y.pos >= x.pos AND y.pos - x.pos < {MAXL} GROUP BY ALL)"
ALL = f", {PAIRED.format(maxl=MAXL)}, {SYN}, {C11}, {P2}, {P4}"
KEYS = [*C.SITE, "aa_a", "aa_b"]


def codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "codons")


def named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"gene_pos_a": "pos_a", "gene_pos_b": "pos_b"})


@query(f", {PAIRED.format(maxl=MAXL)} SELECT gene_id, pos_a, pos_b, ca AS codon_a, cb AS codon_b, sum(w)::BIGINT AS n FROM cp GROUP BY ALL", "codons")
def codon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codon pairs of one read; at lag 0 each counts twice."""
    return named(C.codon_pairs(codons(spark, sf_dir), MAXL).drop("lag"))


@query(f", {PAIRED.format(maxl=MAXL)}, {SYN} SELECT gene_id, pos_a, pos_b, aa_a, aa_b, sum(n)::BIGINT AS n FROM db GROUP BY ALL", "codons")
def synonymous_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codon pairs by their amino acids."""
    rows = C.synonymous(C.codon_pairs(codons(spark, sf_dir), MAXL))
    return named(rows.groupBy("gene_id", "gene_pos_a", "gene_pos_b", "aa_a", "aa_b").agg(F.sum("n").alias("n")))


@query(f", {PAIRED.format(maxl=MAXL)}, {SYN} SELECT * FROM db", "codons")
def doublets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of third-base pairs."""
    return named(C.doublets(C.codon_pairs(codons(spark, sf_dir), MAXL)).drop("lag"))


@query(f", {PAIRED.format(maxl=MAXL)}, {SYN}, {C11} SELECT gene_id, pos_a, pos_b, aa_a, aa_b, size::BIGINT AS size, xy, pairs FROM c11", "codons")
def cov11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of reads that differ at both places, in closed form."""
    return named(C.cov11(C.doublets(C.codon_pairs(codons(spark, sf_dir), MAXL)), KEYS).drop("lag"))


@query(f", {PAIRED.format(maxl=MAXL)}, {SYN} SELECT gene_id, pos_a, pos_b, aa_a, aa_b, sum(n * (n - 1) / 2.0) AS xy, sum(n) * (sum(n) - 1) / 2.0 AS pairs FROM db GROUP BY ALL", "codons")
def cov00(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of reads that agree at both places."""
    return named(C.cov00(C.doublets(C.codon_pairs(codons(spark, sf_dir), MAXL)), KEYS).drop("lag"))


HALF = "(SELECT gene_id, pos_a, pos_b, aa_a, aa_b, x, y, sum(w) AS n FROM sy WHERE read_id % 2 = {r} GROUP BY ALL)"


@query(f", {PAIRED.format(maxl=MAXL)}, {SYN} SELECT gene_id, p.pos_a, p.pos_b, p.aa_a, p.aa_b, coalesce(sum(p.n * q.n) FILTER (p.x <> q.x AND p.y <> q.y), 0)::DOUBLE AS xy, sum(p.n * q.n)::DOUBLE AS pairs FROM {HALF.format(r=0)} p JOIN {HALF.format(r=1)} q USING (gene_id, pos_a, pos_b, aa_a, aa_b) GROUP BY ALL", "codons")
def cov_mate11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between two clusters (here reads of even and odd ids) that differ at both places."""
    half = [C.doublets(C.codon_pairs(codons(spark, sf_dir).where(F.col("read_id") % 2 == r), MAXL)) for r in (0, 1)]
    return named(C.cov_mate11(*half, KEYS).drop("lag"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"value": clean(F.col("value"), 6), "count": clean(F.col("count"), 6)})


@query(f"{ALL} SELECT gene_id, lag, round(value, 6) AS value, round(count, 6) AS count FROM p2", "codons")
def p2_by_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonymous pair correlation by codon lag."""
    return rounded(C.p2(codons(spark, sf_dir), MAXL, DEPTH))


@query(f"{ALL} SELECT gene_id, lag, round(value, 6) AS value, count FROM p4", "codons")
def p4_by_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of site diversities by codon lag."""
    return rounded(C.p4(codons(spark, sf_dir), MAXL, DEPTH))


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codons(spark, sf_dir)
    return C.p2(rows, MAXL, DEPTH).withColumn("type", F.lit("P2")).unionByName(C.p4(rows, MAXL, DEPTH).withColumn("type", F.lit("P4")))


UNION = "u AS (SELECT *, 'P2' AS type FROM p2 UNION ALL SELECT *, 'P4' FROM p4)"
MEANS = "v AS (SELECT *, value / count AS x FROM u WHERE count > 0), col AS (SELECT gene_id::VARCHAR AS gene_id, type, lag, avg(x) AS mean, CASE WHEN count(*) > 1 THEN var_pop(x) END AS var, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'all', type, lag, avg(x), CASE WHEN count(*) > 1 THEN var_pop(x) END, count(*) FROM v GROUP BY ALL)"


@query(f"{ALL}, {UNION} SELECT gene_id, lag, type, round(value, 6) AS value, round(count, 6) AS count FROM u", "codons")
def union_p2_p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both profiles as one table."""
    return rounded(both(spark, sf_dir))


@query(f"{ALL}, {UNION}, {MEANS}, ks AS (SELECT gene_id, mean AS ks FROM col WHERE type = 'P2' AND lag = 0) SELECT gene_id, lag * 3 AS lag, round(CASE WHEN type = 'P2' AND lag = 0 THEN mean ELSE mean / nullif(ks, 0) END, 9) + 0.0 AS m, round(CASE WHEN type = 'P2' AND lag = 0 THEN var ELSE var / nullif(ks * ks, 0) END, 9) + 0.0 AS v, n, CASE WHEN type = 'P2' AND lag = 0 THEN 'Ks' ELSE type END AS t FROM col LEFT JOIN ks USING (gene_id)", "codons")
def collect_all_and_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance per gene and over all genes, by Ks."""
    return C.normalised(C.collected(both(spark, sf_dir)))


@query(" SELECT gene_id, count(*) AS n FROM codons WHERE gene_id IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 1) GROUP BY gene_id", "codons")
def gene_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of a list."""
    listed = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey % 2 = 1").select(F.col("n_nationkey").cast("long").alias("gene_id"))
    return codons(spark, sf_dir).join(listed, "gene_id", "left_semi").groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT gene_id, round(3.0 * count(*) FILTER (depth > 5) / 40, 9) AS share FROM (SELECT gene_id, gene_pos, count(*) AS depth FROM codons GROUP BY ALL) GROUP BY gene_id HAVING 3.0 * count(*) FILTER (depth > 5) / 40 > 0.25", "codons")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of which enough is covered deeply."""
    return C.covered(codons(spark, sf_dir), F.lit(40), 5, 0.25).withColumn("share", clean(F.col("share")))


HASHED = "('0x' || substr(md5(read_id || ':1'), 1, 8))::BIGINT"


@query(f" SELECT ref, count(*) AS n, sum(read_id)::BIGINT AS ids FROM reads WHERE {HASHED} < 0.25 * 4294967296 GROUP BY ref", "reads")
def subsample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of reads, by hash (the sample is the feature)."""
    reads = view(spark, sf_dir, "reads")
    return C.subsampled(reads, "read_id", F.lit(0.25)).groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.sum("read_id").cast("long").alias("ids"))


@query(f", gn AS (SELECT pos % 20 AS gene_id, count(*) AS k, arg_min(len, read_id) AS first_len FROM reads GROUP BY 1) SELECT gene_id, count(*) AS n, sum(read_id)::BIGINT AS ids FROM reads JOIN gn ON gene_id = pos % 20 WHERE {HASHED} < floor((300 + gene_id) * 10 / first_len) / k * 4294967296 GROUP BY gene_id", "reads")
def subsample_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each gene sampled to a depth of ten (the sample is the feature)."""
    reads = view(spark, sf_dir, "reads").withColumns({"gene_id": F.col("pos") % 20, "ord": F.col("read_id")})
    rows = C.to_depth(reads, "gene_id", 300 + F.col("gene_id"), 10)
    return rows.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("read_id").cast("long").alias("ids"))


@query(" SELECT aln AS gene_id, row, count(*) AS codons, count(*) FILTER (NOT contains(codon, '-')) AS known FROM (SELECT aln, row, pos // 3 AS c, string_agg(base_a, '' ORDER BY pos) AS codon FROM aligned GROUP BY ALL HAVING count(*) = 3) GROUP BY ALL", "aligned")
def codon_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codons of aligned rows, and those without a gap."""
    rows = view(spark, sf_dir, "aligned").groupBy("aln", "row", F.floor(F.col("pos") / 3).alias("c")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base_a"))), lambda x: x["base_a"]), "").alias("codon")).where(F.length("codon") == 3)
    per = lambda df, name: df.groupBy(F.col("aln").alias("gene_id"), "row").agg(F.count(F.lit(1)).alias(name))
    return per(rows, "codons").join(per(C.without_gaps(rows), "known"), ["gene_id", "row"], "left").na.fill(0, ["known"])
