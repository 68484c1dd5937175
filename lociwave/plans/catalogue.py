"""Strains, orthologs, families, genomes and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociwave.functions import sequence as Q
from lociwave.functions.stats import clean
from lociwave.operators import codons as C
from lociwave.operators import fit
from lociwave.operators import genomes as G
from lociwave.plans.registry import query
from lociwave.sources.readers import cigar_of
from lociwave.sources.scratch import written
from lociwave.sources.views import view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(" SELECT family_id, count(DISTINCT genome) AS genomes, CASE WHEN count(DISTINCT genome) = 5 THEN 'core' WHEN count(DISTINCT genome) < 5 THEN 'disp' ELSE 'pan' END AS kind FROM members GROUP BY family_id", "members")
def core_disp_pan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families by the number of strains they are in (five strains)."""
    return G.family_kind(view(spark, sf_dir, "members"), F.lit(5))


BEST = ", f AS (SELECT p, s FROM hits QUALIFY row_number() OVER (PARTITION BY p ORDER BY score DESC, s) = 1), b AS (SELECT s, p FROM hits QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, p) = 1)"


@query(BEST + " SELECT f.p AS a, f.s AS b FROM f JOIN b ON f.p = b.p AND f.s = b.s", "hits")
def recip_best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are each other's best hit."""
    hits = view(spark, sf_dir, "hits")
    rows = lambda q, s: hits.select(F.col(q).alias("q"), F.col(s).alias("s"), (-F.col("score")).alias("ord"))
    return G.reciprocal_best_hits(rows("p", "s"), rows("s", "p"))


@query(BEST + ", h AS (SELECT p, s, score FROM hits WHERE score >= 80) SELECT p, s, score FROM h QUALIFY row_number() OVER (PARTITION BY p ORDER BY score DESC, s) = 1", "hits")
def top_hit_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit above a bound per query."""
    w = Window.partitionBy("p").orderBy(F.col("score").desc(), "s")
    return view(spark, sf_dir, "hits").where("score >= 80").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query(" SELECT a.id AS a, b.id AS b FROM taxa a JOIN taxa b ON a.id < b.id", "taxa")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of strains (one row per genome) is to be compared."""
    taxa = view(spark, sf_dir, "taxa").select("id")
    return taxa.alias("a").join(taxa.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query(" SELECT m.family_id, count(*) AS found, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS names FROM members m JOIN supplier ON s_suppkey = m.family_id % 150 GROUP BY m.family_id", "members")
def ortho_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with the records they name; missing ones are left out."""
    records = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_name")
    rows = view(spark, sf_dir, "members").join(records, F.col("family_id") % 150 == F.col("key"))
    return rows.groupBy("family_id").agg(F.count(F.lit(1)).alias("found"), F.array_join(F.array_sort(F.collect_set("s_name")), ",").alias("names"))


@query(" SELECT t.id, h.name AS found FROM (SELECT * FROM taxa UNION ALL SELECT * FROM higher_taxa) t LEFT JOIN higher_taxa h ON h.id = coalesce(t.parent, t.id)", "taxa higher_taxa")
def species_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The species above each taxon, by a recursive query with bounded depth."""
    taxa = view(spark, sf_dir, "taxa").unionByName(view(spark, sf_dir, "higher_taxa"))
    return G.climbed(taxa, taxa.select("id"), "species")


@query(", up AS (SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA') SELECT n_name, r_name AS species, r_name IS NULL AS missing FROM up", "taxa")
def strain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strains with what their path names; missing ones are flagged, as the original warns of them."""
    region = table(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    rows = table(spark, sf_dir, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.select("n_name", F.col("r_name").alias("species"), F.col("r_name").isNull().alias("missing"))


@query("SELECT o_orderstatus AS status, count(*) FILTER (lower(o_orderpriority) LIKE '%urgent%') AS complete, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) AS scaffolds FROM orders WHERE o_orderstatus <> '-' GROUP BY 1")
def strain_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text conditions on a strain's path, status and replicon."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> '-'")
    urgent = F.lower("o_orderpriority").contains("urgent")
    rest = ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.when(urgent, 1)).alias("complete"), F.count(F.when(rest, 1)).alias("scaffolds"))


def reciprocal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: hits between genomes (three of parts, three of suppliers) that are the best of both sides for the other's genome."""
    hits = view(spark, sf_dir, "hits").withColumns({"ord": -F.col("score"), "of_p": F.col("p") % 3, "of_s": F.col("s") % 3})
    forward = G.best_hits(hits.select(F.struct("p", "of_s").alias("q"), "s", "ord")).select(F.col("q.p").alias("p"), "s")
    backward = G.best_hits(hits.select(F.struct("s", "of_p").alias("q"), F.col("p").alias("s"), "ord")).select(F.col("s").alias("p"), F.col("q.s").alias("s"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return forward.join(backward, ["p", "s"]).select(name("p", "p").alias("a"), name("s", "s").alias("b"))


RECIPROCAL = "fw AS (SELECT p, s FROM hits QUALIFY row_number() OVER (PARTITION BY p, s % 3 ORDER BY score DESC, s) = 1), bw AS (SELECT p, s FROM hits QUALIFY row_number() OVER (PARTITION BY s, p % 3 ORDER BY score DESC, p) = 1), ed AS (SELECT concat('p', p) AS a, concat('s', s) AS b FROM fw JOIN bw USING (p, s))"

@query(f", {RECIPROCAL} SELECT a, b FROM ed", "hits")
def genome_best_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that are clustered: reciprocal best hits between all pairs of genomes."""
    return reciprocal_hits(spark, sf_dir)


@query(None)
def mcl_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markov clusters of all reciprocal best hits between the genomes."""
    return G.clusters(written(reciprocal_hits(spark, sf_dir), "edges"))


@query(", md AS (SELECT *, floor(quantile_cont(len, 0.5) OVER (PARTITION BY family_id)) AS median FROM members), kp AS (SELECT *, abs(len - median) / median <= 0.1 AS keep FROM md), wh AS (SELECT *, count(*) OVER (PARTITION BY family_id) >= 3 AND bool_and(keep) OVER (PARTITION BY family_id) AS whole FROM kp) SELECT id, line, family_id, len, median::BIGINT AS median, keep, whole FROM wh", "members")
def length_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose length is off their family's median, and families that are whole."""
    return G.without_outliers(view(spark, sf_dir, "members")).select("id", "line", "family_id", "len", "median", "keep", "whole")


@query("SELECT s_nationkey AS genome, s_suppkey AS ord, 100 + s_suppkey % 50 AS len, coalesce(sum(100 + s_suppkey % 50 + 1000) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", concat(coalesce(sum(100 + s_suppkey % 50 + 1000) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1, '..', coalesce(sum(100 + s_suppkey % 50 + 1000) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 9) AS loc FROM supplier")
def scaffold_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where scaffolds and their genes stand in the joined genome."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("genome"), F.col("s_suppkey").alias("ord"), (100 + F.col("s_suppkey") % 50).alias("len"))
    rows = G.scaffold_offsets(rows, ["genome"])
    return rows.withColumn("loc", F.concat_ws("..", (F.col("offset") + 1).cast("string"), (F.col("offset") + 9).cast("string")))


EXPAND_SITES = "SELECT s_nationkey AS genome, i AS pos, i % 31 < 9 AS coding, i % 47 <> 0 AS valid, 400 AS length"
EXPAND_GENES = "SELECT s_nationkey AS genome, s_suppkey AS gene_id, (s_suppkey * 31) % 372 + 1 AS start, (s_suppkey * 31) % 372 + 9 AS stop FROM supplier"


@query(f"WITH RECURSIVE st AS ({EXPAND_SITES} FROM (SELECT DISTINCT s_nationkey FROM supplier), range(0, 400) AS r(i)), gn AS ({EXPAND_GENES}), wl AS (SELECT gene_id, genome, 0 AS step, start AS a, stop AS b, true AS goes_l, true AS goes_r FROM gn UNION ALL SELECT w.gene_id, w.genome, step + 1, CASE WHEN okl THEN a - 1 ELSE a END, CASE WHEN okr THEN b + 1 ELSE b END, okl, okr FROM (SELECT wl.*, goes_l AND NOT sl.coding AND sl.valid AS okl, goes_r AND NOT sr.coding AND sr.valid AS okr FROM wl JOIN st sl ON sl.genome = wl.genome AND sl.pos = (a - 2 + 400) % 400 JOIN st sr ON sr.genome = wl.genome AND sr.pos = b % 400 WHERE goes_l OR goes_r) w) SELECT wl.genome, wl.gene_id, max(gn.start - a)::BIGINT AS \"left\", max(b - gn.stop)::BIGINT AS \"right\" FROM wl JOIN gn USING (gene_id) GROUP BY ALL")
def gene_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes expanded into the non-coding sites on both sides of a circular genome."""
    supplier = table(spark, sf_dir, "supplier")
    sites = supplier.select("s_nationkey").distinct().select(F.col("s_nationkey").alias("genome"), F.explode(F.sequence(F.lit(0), F.lit(399))).alias("pos"))
    sites = sites.withColumns({"coding": F.col("pos") % 31 < 9, "valid": F.col("pos") % 47 != 0, "length": F.lit(400)})
    genes = supplier.selectExpr("s_nationkey AS genome", "s_suppkey AS gene_id", "(s_suppkey * 31) % 372 + 1 AS start", "(s_suppkey * 31) % 372 + 9 AS end")
    return G.expanded(genes, sites)


@query("SELECT doc_id AS id, regexp_extract(concat(coalesce(text, ''), ' NC_', doc_id), '\\w\\w_\\w+\\d+', 0) AS acc FROM documents")
def refacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first accession in a text."""
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.col("doc_id").alias("id"), Q.reference_accession(F.concat(F.coalesce("text", F.lit("")), F.lit(" NC_"), F.col("doc_id").cast("string"))).alias("acc"))


@query(" SELECT id, length(seq) AS len, md5(seq) AS seq_md5, md5(translate(reverse(seq), 'ATGCatgc', 'TACGtacg')) AS rc_md5 FROM sequences", "sequences")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F16: sequences and their reverse complements."""
    rows = view(spark, sf_dir, "sequences")
    return rows.select("id", F.length("seq").cast("long").alias("len"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.md5(Q.reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"))


PROFILE_GENES = "SELECT s_nationkey AS genome, s_suppkey AS gene_id, s_suppkey AS ord, s_suppkey % 90 * 4 + 1 AS start, s_suppkey % 90 * 4 + 12 AS stop, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM supplier"
PROFILE_SQL = f"WITH gn AS ({PROFILE_GENES}), gs AS (SELECT gn.*, p AS pos, CASE WHEN strand = '-' THEN stop - p ELSE p - start END AS j, CASE WHEN strand = '-' THEN translate(substr('ATGC', CAST((p * 7 + s.genome) % 4 + 1 AS INT), 1), 'ATGC', 'TACG') ELSE substr('ATGC', CAST((p * 7 + s.genome) % 4 + 1 AS INT), 1) END AS base FROM gn JOIN (SELECT s_suppkey AS k, s_nationkey AS genome FROM supplier) s ON s.k = gn.gene_id, range(1, 400) AS r(p) WHERE p BETWEEN start AND stop), cd AS (SELECT genome, gene_id, j // 3 AS c, string_agg(base, '' ORDER BY j) AS codon FROM gs GROUP BY ALL), kd AS (SELECT gs.genome, pos, ord, CASE WHEN j % 3 = 2 AND codon IN ({{four}}) THEN 4 ELSE j % 3 + 1 END AS kind FROM gs JOIN cd ON cd.genome = gs.genome AND cd.gene_id = gs.gene_id AND c = j // 3)".replace("{four}", ", ".join(f"'{x}'" for x in Q.fourfold()))


def gene_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS genome", "s_suppkey AS gene_id", "s_suppkey AS ord", "s_suppkey % 90 * 4 + 1 AS start", "s_suppkey % 90 * 4 + 12 AS end", "CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand")
    plus = F.expr("substr('ATGC', CAST((pos * 7 + genome) % 4 + 1 AS INT), 1)")
    return G.gene_sites(genes).withColumn("base", F.when(F.col("strand") == "-", Q.reverse_complement(plus)).otherwise(plus))


@query(PROFILE_SQL + " SELECT genome, pos, max_by(kind, ord)::INT AS pos_type FROM kd GROUP BY ALL")
def codon_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position types of sites; where genes overlap the later one wins."""
    return G.codon_profile(gene_sites(spark, sf_dir), Q.fourfold(), False).select("genome", "pos", F.col("pos_type").cast("int").alias("pos_type"))


@query(PROFILE_SQL + " SELECT genome, pos, CASE WHEN count(*) > 1 THEN 5 ELSE max(kind) END::INT AS pos_type FROM kd GROUP BY ALL")
def codon_profile_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same; sites of more than one gene are undefined."""
    return G.codon_profile(gene_sites(spark, sf_dir), Q.fourfold(), True).select("genome", "pos", F.col("pos_type").cast("int").alias("pos_type"))


CIGARS = ("32M", "10M2I20M", "12=3D20X", "5S27M", "3H32M")
MAPPED = ("seq", "substr(seq, 1, 10) || substr(seq, 13, 20)", "substr(seq, 1, 12) || '***' || substr(seq, 13, 20)", "substr(seq, 6, 27)", "seq")


def by_id(values: tuple[str, ...], quote: bool = False) -> str:
    return "CASE id % 5 " + " ".join(f"WHEN {i} THEN " + (f"'{x}'" if quote else x) for i, x in enumerate(values)) + " END"


@query(f" SELECT id, {by_id(MAPPED)} AS mapped FROM short_seqs", "short_seqs")
def map2ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads laid on the reference by their CIGAR."""
    rows = view(spark, sf_dir, "short_seqs").withColumn("c", cigar_of(F.expr(by_id(CIGARS, True))))
    return rows.select("id", Q.map_to_reference(F.col("seq"), F.col("c")).alias("mapped"))


@query(f", m AS (SELECT id, string_agg(CASE WHEN (id + i) % 7 = 0 THEN '-' ELSE substr(seq, i, 1) END, '' ORDER BY i) AS seq FROM short_seqs, range(1, 33) AS r(i) GROUP BY id) SELECT id, CASE id % 5 WHEN 1 THEN '' WHEN 2 THEN replace({MAPPED[2]}, '***', '---') ELSE {by_id(MAPPED)} END AS mapped FROM m", "short_seqs")
def codon_map2ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codon programs' rule: reads with insertions are empty, low-quality letters are gaps."""
    rows = view(spark, sf_dir, "short_seqs").withColumn("c", cigar_of(F.expr(by_id(CIGARS, True))))
    qual = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.when((F.col("id") + i) % 7 == 0, 20).otherwise(40))
    return rows.select("id", Q.codon_read(F.col("seq"), qual, F.col("c")).alias("mapped"))


@query(f", m AS (SELECT id, string_agg(CASE WHEN (id + i) % 7 = 0 THEN '?' ELSE substr(seq, i, 1) END, '' ORDER BY i) AS seq FROM short_seqs, range(1, 33) AS r(i) GROUP BY id) SELECT id, {by_id(MAPPED)} AS quals FROM m", "short_seqs")
def map2ref_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """letters and qualities are laid alike: here the qualities stand in for the letters they belong to."""
    rows = view(spark, sf_dir, "short_seqs").withColumn("c", cigar_of(F.expr(by_id(CIGARS, True))))
    quals = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.when((F.col("id") + i) % 7 == 0, "?").otherwise(F.substr(F.col("seq"), i, F.lit(1)))), "")
    return rows.select("id", Q.map_to_reference(quals, F.col("c")).alias("quals"))


@query(" SELECT id, CASE WHEN id % 25 >= 10 THEN substr(seq, 1, 10) || repeat('*', (id % 25 - 10)::INT) || substr(seq, 20, 8) ELSE substr(seq, 1, 10) || CASE WHEN 10 - id % 25 >= 8 THEN '' ELSE substr(substr(seq, 20, 8), (11 - id % 25)::INT) END END AS mapped FROM short_seqs", "short_seqs")
def mated2ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mates as one sequence, apart, overlapping, and one inside the other."""
    rows = view(spark, sf_dir, "short_seqs")
    return rows.select("id", Q.joined_mates(F.substring("seq", 1, 10), F.lit(0), F.substring("seq", 20, 8), (F.col("id") % 25).cast("int")).alias("mapped"))


@query(" SELECT id, CASE WHEN id % 13 < 10 THEN upper(substr(seq, 1, 1) || substr(seq, 2, 1) || substr(seq, 3, 1)) END AS letters, CASE WHEN id % 13 < 10 THEN round((CASE WHEN substr(seq, 1, 1) <> substr(seq, 2, 1) THEN 1 ELSE 0 END + CASE WHEN substr(seq, 1, 1) <> substr(seq, 3, 1) THEN 1 ELSE 0 END + CASE WHEN substr(seq, 2, 1) <> substr(seq, 3, 1) THEN 1 ELSE 0 END) / 3.0, 9) + 0.0 END AS pi FROM short_seqs", "short_seqs")
def decode_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pileup letters and their diversity; rows whose letters do not match the depth are dropped (null here), as those with an indel of two digits are."""
    letter = lambda i: F.substring("seq", i, 1)
    size = (F.col("id") % 13).cast("int")
    bases = F.concat(F.lit("^]"), F.lit("."), F.lit("+"), size.cast("string"), F.repeat(F.lit("N"), size), letter(2), F.lit("$"), F.lower(letter(3)), F.lit("-1A"))
    rows = view(spark, sf_dir, "short_seqs").select("id", letter(1).alias("ref"), bases.alias("bases"), F.lit(3).alias("n"))
    rows = rows.withColumn("letters", Q.pileup_letters(F.col("bases"), F.col("ref")))
    rows = rows.withColumn("letters", F.when(F.length("letters") == F.col("n"), F.col("letters")))
    letters = F.filter(F.split("letters", ""), lambda x: x != "")
    count = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)))
    same = F.aggregate(count, F.lit(0), lambda a, c: a + c * c)
    return rows.select("id", "letters", clean(F.try_divide(F.col("n") * F.col("n") - F.when(F.col("letters").isNotNull(), same), F.col("n") * (F.col("n") - 1))).alias("pi"))


@query(" SELECT id, string_agg(CASE WHEN letter = '-' THEN '---' ELSE substr(seq, (3 * k - 2)::INT, 3) END, '' ORDER BY i) AS aligned FROM (SELECT *, sum(CASE WHEN letter <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS k FROM (SELECT id, seq, i, substr(ref, i, 1) AS letter FROM short_seqs, range(1, 11) AS r(i))) GROUP BY id", "short_seqs")
def back_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codons of an aligned protein; what follows its last letter (the stop codon) is not used."""
    return view(spark, sf_dir, "short_seqs").select("id", Q.back_translated(F.substring("ref", 1, 10), F.col("seq")).alias("aligned"))


@query(" SELECT id, coalesce(string_agg(substr(seq, i, 1), '' ORDER BY i) FILTER (substr(ref, i, 1) <> '-'), '') AS kept FROM short_seqs, range(1, 33) AS r(i) GROUP BY id", "short_seqs")
def strip_reference_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """columns where the reference has a nucleotide."""
    return view(spark, sf_dir, "short_seqs").select("id", Q.without_reference_gaps(F.col("seq"), F.col("ref")).alias("kept"))


@query(" SELECT id AS read_id, c::BIGINT AS gene_pos, CASE WHEN id % 2 = 0 THEN codon ELSE translate(reverse(codon), 'ATGC', 'TACG') END AS codon FROM (SELECT id, c, substr(ref, (10 + 3 * c - id % 17)::INT, 3) AS codon FROM short_seqs, range(0, 7) AS r(c) WHERE 10 + 3 * c - id % 17 >= 1) WHERE NOT contains(codon, '-')", "short_seqs")
def read_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codons of mapped reads in their gene's frame, whole and without gaps."""
    rows = view(spark, sf_dir, "short_seqs").select(F.lit(1).alias("gene_id"), F.lit(10).alias("gene_start"), F.lit(30).alias("gene_end"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("id").alias("read_id"), (F.col("id") % 17).alias("pos"), F.col("ref").alias("seq"))
    return C.codons_of_reads(rows).select("read_id", "gene_pos", "codon")


@query("SELECT DISTINCT n_regionkey::INT AS id, (60.0 + n_regionkey)::DOUBLE AS b0, (4.0 + n_regionkey)::DOUBLE AS b1 FROM nation")
def fit_hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperbolic fits of a curve per region, whose parameters they recover."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("lag")).distinct()
    rows = rows.withColumn("value", 1 / (60.0 + F.col("id") + (4.0 + F.col("id")) * F.col("lag")))
    return fit.fitted(rows, ["id"], "hyper", 0, 1000).select("id", (F.round("b0", 4) + 0.0).alias("b0"), (F.round("b1", 4) + 0.0).alias("b1"))


@query("SELECT DISTINCT n_regionkey::INT AS id, (60.0 + n_regionkey)::DOUBLE AS b0, 150.0::DOUBLE AS b1, 40.0::DOUBLE AS b2 FROM nation")
def fit_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential fits of a curve per region, whose parameters they recover."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(100))).alias("lag")).distinct()
    rows = rows.withColumn("value", 1 / (60.0 + F.col("id") + 150 * (1 - F.exp(-F.col("lag") / 40))))
    return fit.fitted(rows, ["id"], "exp", 0, 1000).select("id", *[(F.round(b, 4) + 0.0).alias(b) for b in ("b0", "b1", "b2")])


@query("SELECT n_regionkey::INT AS strain, CASE WHEN n_regionkey < 3 THEN 'hyper' ELSE 'none' END AS kind, count(*) AS n FROM nation WHERE n_nationkey % 7 <> 0 GROUP BY ALL")
def fit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a window by strain, unknown ones dropped, each strain fitted on its own."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("strain"), F.col("n_nationkey").cast("int").alias("lag"), F.when(F.col("n_nationkey") % 7 == 0, float("nan")).otherwise(1 / (10.0 + F.col("n_nationkey"))).alias("value"))
    fits = fit.fitted(rows.where("strain < 3"), ["strain"], "hyper", 0, 100).select("strain", F.lit("hyper").alias("kind"))
    points = rows.where("not isnan(value)").groupBy("strain").agg(F.count(F.lit(1)).alias("n"))
    return points.join(fits, "strain", "left").select("strain", F.coalesce("kind", F.lit("none")).alias("kind"), "n")
