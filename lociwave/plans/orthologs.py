"""Search and alignment of proteins, pairs with a reference, strains, joined scaffolds and orders of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociwave.functions import sequence as Q
from lociwave.operators import align, search
from lociwave.operators import genomes as G
from lociwave.operators.order import numbered
from lociwave.plans.files import folder
from lociwave.plans.registry import query
from lociwave.sources import readers, sinks
from lociwave.sources.views import POS_TYPE, view

NEAR = "levenshtein(q.seq, p.seq) AS d, greatest(length(q.seq), length(p.seq)) AS n FROM {q} q JOIN {p} p ON 5 * least(length(q.seq), length(p.seq)) >= 4 * greatest(length(q.seq), length(p.seq))"


@query(f", pr AS MATERIALIZED (SELECT q.id AS q, p.id AS s, {NEAR.format(q='query_proteins', p='proteins')}) SELECT q, s, d AS distance, round(1 - d / n, 9) AS identity FROM pr WHERE 5 * (n - d) >= 4 * n QUALIFY row_number() OVER (PARTITION BY q ORDER BY 1 - d / n DESC, s) = 1", "query_proteins proteins")
def protein_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar protein of each query from 0.8 identity on, found by an index of grams."""
    rows = search.top_hits(view(spark, sf_dir, "query_proteins"), view(spark, sf_dir, "proteins"))
    return rows.select("q", "s", F.col("distance").cast("long").alias("distance"), F.round("identity", 9).alias("identity"))


@query(f", a AS (SELECT seq, min(id) AS id FROM query_proteins GROUP BY seq), b AS (SELECT seq, min(id) AS id FROM proteins GROUP BY seq), pr AS (SELECT q.id AS q, p.id AS s, {NEAR.format(q='a', p='b')}) SELECT q, s, d AS distance FROM pr WHERE 5 * (n - d) >= 4 * n", "query_proteins proteins")
def similar_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different proteins from 0.8 identity on."""
    rows = search.similar(view(spark, sf_dir, "query_proteins"), view(spark, sf_dir, "proteins"))
    return rows.select("q", "s", F.col("distance").cast("long").alias("distance"))


@query(None)
def family_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of proteins aligned around a centre, and the codons of each laid on its row."""
    rows = view(spark, sf_dir, "proteins").select("family_id", "id", "seq")
    nucl = rows.select("family_id", "id", F.regexp_replace("seq", "(.)", "$1$1$1").alias("nucl"))
    return align.centre_alignment(rows).join(nucl, ["family_id", "id"]).select("family_id", "id", "aligned", Q.back_translated(F.col("aligned"), F.col("nucl")).alias("codons"))


@query(", rf AS (SELECT aln, pos, base_a AS ref FROM aligned WHERE row = 0 AND base_a <> '-'), s AS (SELECT aln, row, pos, base_a AS letter, ref FROM aligned JOIN rf USING (aln, pos)) SELECT 'reference' AS kind, aln, CAST(NULL AS BIGINT) AS a, row AS b, count(*) AS places, count(*) FILTER (letter <> ref) AS differ FROM s WHERE row <> 0 GROUP BY ALL UNION ALL SELECT 'rows', aln, x.row, y.row, count(*), count(*) FILTER (x.letter <> y.letter) FROM s x JOIN s y USING (aln, pos) WHERE x.row < y.row GROUP BY ALL", "aligned")
def reference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an alignment against each other and against a reference row, chosen by name."""
    sites = view(spark, sf_dir, "aligned").select("aln", "row", F.col("row").alias("genome"), "pos", F.col("base_a").alias("letter"))
    ref = sites.where("row = 0").select("aln", "pos", F.col("letter").alias("ref"), F.col("genome").alias("ref_genome"))
    sites = sites.join(ref, ["aln", "pos"])
    count = lambda kind: align.PAIRS[kind](sites).groupBy("aln", "a", "b").agg(F.count(F.lit(1)).alias("places"), F.count(F.when(F.col("x") != F.col("y"), 1)).alias("differ")).withColumn("kind", F.lit(kind))
    return count("reference").unionByName(count("rows"))


@query(" SELECT id, 'known' AS kind FROM strains WHERE path <> '-' AND species <> '' AND replicon IS NOT NULL UNION ALL SELECT id, 'complete' FROM strains WHERE path <> '-' AND species <> '' AND replicon IS NOT NULL AND id % 6 IN (0, 1) UNION ALL SELECT id, 'unjoined' FROM strains WHERE id % 6 IN (4, 5) UNION ALL SELECT id, 'chromosome' FROM strains WHERE id % 11 <> 0 AND id % 4 <> 0", "strains")
def strain_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strains that are known, complete, to be joined, and chromosomes."""
    strains = view(spark, sf_dir, "strains")
    kinds = {"known": G.known_strains(strains), "complete": G.known_strains(strains, complete=True), "unjoined": G.unjoined_strains(strains), "chromosome": G.chromosomes(strains)}
    first, *rest = [rows.select("id", F.lit(k).alias("kind")) for k, rows in kinds.items()]
    for rows in rest:
        first = first.unionByName(rows)
    return first


@query("WITH sc AS (SELECT s_nationkey AS genome, s_suppkey AS k, coalesce(sum(100 + s_suppkey % 50 + 1000) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM supplier) SELECT (p_partkey % 90 + o)::BIGINT AS start, (p_partkey % 90 + 30 + o)::BIGINT AS \"end\", p_partkey::VARCHAR AS pid, p_name AS gene, genome::BIGINT AS genome FROM part JOIN sc ON k = p_partkey % 1200 WHERE p_partkey % 13 <> 0")
def joined_gene_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene tables of scaffolds moved to the joined genome, written and read again; genes of unknown scaffolds and short lines go."""
    scaffolds = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("genome"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("NC_"), "s_suppkey").alias("acc"), (100 + F.col("s_suppkey") % 50).alias("len"))
    genes = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat('NC_', p_partkey % 1200) AS acc", "p_partkey AS ord", "concat_ws('\t', concat(p_partkey % 90, '..', p_partkey % 90 + 30), '+', if(p_partkey % 13 = 0, NULL, concat_ws('\t', 10, p_partkey, p_name, '-', '-', '-', 'x'))) AS line")
    path = folder(spark, "joined")
    sinks.merged_gene_tables(genes, G.scaffold_offsets(scaffolds, ["genome"]), path)
    own = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("pid"), (F.col("p_partkey") % 1200).alias("s_suppkey"))
    of = own.join(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").cast("long").alias("genome")), "s_suppkey").select("pid", "genome")
    return readers.ptt(spark, path).select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "pid", "gene").join(of, "pid")


@query(" SELECT concat('p', id) AS id, md5(seq) AS seq_md5 FROM proteins", "proteins")
def joined_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protein records of a genome's scaffolds behind each other, written and read again."""
    path = folder(spark, "proteins")
    sinks.merged_proteins(view(spark, sf_dir, "proteins").select("genome", F.col("id").alias("ord"), F.concat(F.lit("p"), "id").alias("id"), "seq"), path)
    return readers.fasta(spark, path).select("id", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query(" SELECT id::VARCHAR AS id, genome::VARCHAR AS genome, seq AS prot, 'm_expanded_orthologs_aligned.json' AS file FROM proteins", "proteins")
def expanded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: aligned families written under the name of expanded ones and read again."""
    text = lambda c: F.col(c).cast("string")
    rows = view(spark, sf_dir, "proteins").select("family_id", F.col("id").alias("idx"), text("id").alias("id"), F.lit("n").alias("name"), text("genome").alias("genome"), F.lit("11").alias("code"), F.col("seq").alias("prot"), F.lit("ATG").alias("nucl"), F.struct(F.lit(1).alias("From"), F.lit(3).alias("To"), F.lit("+").alias("Strand")).alias("loc"))
    path = sinks.aligned_json(rows, folder(spark, "aligned"), "m", expanded=True)
    own = spark.read.schema("Id string, Genome string, Prot string").json(path)
    return own.select(F.col("Id").alias("id"), F.col("Genome").alias("genome"), F.unbase64("Prot").cast("string").alias("prot"), F.lit(path.rsplit("/", 1)[1]).alias("file"))


@query(f", k AS (SELECT {POS_TYPE.format(pos='pos')} AS kind FROM bases) SELECT flag::INT AS flag, count(*) AS n FROM k JOIN range(0, 7) AS r(flag) ON kind = CASE WHEN flag IN (1, 2, 4) THEN flag ELSE 3 END OR (flag IN (3, 5, 6) AND kind = 4) WHERE flag <> 0 GROUP BY flag", "bases")
def position_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases by each number of the command line, where unknown ones stand for third positions, fourfold ones among them."""
    kinds = view(spark, sf_dir, "bases").groupBy(F.expr(POS_TYPE.format(pos="pos")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[F.when(Q.of_type(F.col("kind"), Q.position_type(flag, Q.THIRD)), F.lit(flag)) for flag in range(7)])
    return kinds.select(F.explode(wanted).alias("flag"), "n").where("flag is not null").groupBy("flag").agg(F.sum("n").alias("n"))


@query(" SELECT genome, concat('Pos: ', pos, ', Bases: ', string_agg(base, '' ORDER BY read_id, base)) AS snp FROM bases GROUP BY genome, pos", "bases")
def snp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sites as lines for people, letters in the order of reads."""
    letters = F.transform(F.array_sort(F.collect_list(F.struct("read_id", "base"))), lambda x: x["base"])
    return view(spark, sf_dir, "bases").groupBy("genome", "pos").agg(F.array_join(letters, "").alias("letters")).select("genome", Q.snp_text(F.col("pos"), F.col("letters")).alias("snp"))


@query(", pr AS (SELECT name, min(pos) AS l, max(pos + 20) AS r FROM records GROUP BY name HAVING count(*) >= 2) SELECT name, row_number() OVER (ORDER BY l, name) - 1 AS by_left, row_number() OVER (ORDER BY r, name) - 1 AS by_right, row_number() OVER (ORDER BY name) - 1 AS by_name FROM pr", "records")
def pair_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: places of read pairs by their left start, by their right end and by name."""
    pairs = view(spark, sf_dir, "records").groupBy("name").agg(F.min("pos").alias("left"), F.max(F.col("pos") + 20).alias("right"), F.count(F.lit(1)).alias("n")).where("n >= 2").select("name", "left", "right")
    place = lambda order, name: numbered(pairs, order)[0].select("name", F.col("at").alias(name))
    return place(["left", "name"], "by_left").join(place(["right", "name"], "by_right"), "name").join(place(["name"], "by_name"), "name")


@query(" SELECT ord, row_number() OVER (ORDER BY name, ord) - 1 AS at FROM records", "records")
def name_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: the place of each record when all are sorted by read name."""
    return numbered(view(spark, sf_dir, "records").select("ord", "name"), ["name", "ord"])[0].select("ord", "at")
