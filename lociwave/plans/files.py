"""Readers and sinks over small files that the query writes itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociwave.functions.stats import clean
from lociwave.operators import genomes as G
from lociwave.operators import sites as S
from lociwave.operators.joins import band_join
from lociwave.operators.order import numbered, runs
from lociwave.plans.registry import query
from lociwave.sources import bam, readers, sinks
from lociwave.sources.scratch import scratch_path
from lociwave.sources.views import view


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the session, or in a temporary one of a local session."""
    return scratch_path(spark, name)


def text_file(spark: SparkSession, name: str, lines: DataFrame | list[str]) -> str:
    path = folder(spark, name)
    rows = lines if isinstance(lines, DataFrame) else spark.createDataFrame([(x,) for x in lines], "value string")
    rows.write.text(path)
    return path


def tabbed(df: DataFrame) -> DataFrame:
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns]).alias("value"))


@query("SELECT s_name AS id, concat('ACGT', s_suppkey % 3, 'NN') AS seq FROM supplier")
def read_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence records of FASTA text."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("concat('>', replace(s_name, ' ', '_'), ' note\nACGT', s_suppkey % 3, '\nNN') AS value")
    return readers.fasta(spark, text_file(spark, "fasta", rows)).select("id", "seq")


@query("SELECT l_orderkey AS read_id, l_partkey::INT AS pos, (l_linenumber * 10)::INT AS mapq, 'M' AS op, 4 AS len, 'ACGT' AS seq, 40 AS first_qual FROM lineitem")
def read_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of SAM text, told by the path's ending."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("concat_ws('\t', l_orderkey, '99', 'chr', l_partkey + 1, l_linenumber * 10, '4M', '=', l_partkey + 1, '0', 'ACGT', 'IIII') AS value")
    path = folder(spark, "sam")
    rows.write.text(path)
    own = readers.alignments(spark, path)
    return own.select(F.col("read_id").cast("long").alias("read_id"), "pos", "mapq", own["cigar"][0]["op"].alias("op"), own["cigar"][0]["len"].alias("len"), "seq", own["qual"][0].alias("first_qual"))


@query(" SELECT read_id, ref, pos, mapq, seq, quals, length(seq)::INT AS matched, CAST(NULL AS VARCHAR) AS mate FROM seq_reads", "seq_reads")
def read_bam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as BAM, a file a task, and read again in splits of a few blocks, told by the path's ending."""
    phred = F.transform(F.sequence(F.lit(1), F.length("quals")), lambda i: F.ascii(F.substr(F.col("quals"), i, F.lit(1))) - 33)
    one = F.array(F.struct(F.lit("M").alias("op"), F.length("seq").alias("len")))
    rows = view(spark, sf_dir, "seq_reads").select(F.col("read_id").cast("string").alias("read_id"), F.lit(0).alias("flags"), "ref", "pos", "mapq", one.alias("cigar"), F.lit("*").alias("mate_ref"), F.lit(-1).alias("mate_pos"), "seq", phred.alias("qual"))
    path = f"{folder(spark, 'alignments')}.bam"
    bam.write(rows, path)
    own = readers.alignments(spark, path, 1 << 17)
    quals = F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")
    return own.select(F.col("read_id").cast("long").alias("read_id"), "ref", F.col("pos").cast("long").alias("pos"), "mapq", "seq", quals.alias("quals"), own["cigar"][0]["len"].alias("matched"), F.when(F.col("mate_ref") != "*", F.col("mate_ref")).alias("mate"))


@query("SELECT s_suppkey AS id, s_suppkey * 15 AS start, s_suppkey * 15 + 12 AS \"end\", CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM supplier WHERE s_suppkey % 3 <> 0")
def read_gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDS rows."""
    genes = view(spark, sf_dir, "genes")
    rows = tabbed(genes.select("ref", F.lit("x"), F.when(F.col("gene_id") % 3 == 0, "gene").otherwise("CDS"), "gene_start", "gene_end", F.lit("."), "strand", F.lit("0"), F.concat(F.lit("ID="), F.col("gene_id"), F.lit(";n=1"))))
    own = readers.gff(spark, text_file(spark, "gff", rows))
    return own.select(F.col("id").cast("long").alias("id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand")


@query("SELECT s_suppkey * 15 AS start, s_suppkey * 15 + 12 AS \"end\", '+' AS strand, s_name AS gene FROM supplier")
def read_ptt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protein table rows."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("concat(s_suppkey * 15, '..', s_suppkey * 15 + 12, '\t+\t12\t', s_suppkey, '\t', s_name, '\t-\t-\t-\tprotein') AS value")
    own = readers.ptt(spark, text_file(spark, "ptt", rows))
    return own.select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", "gene")


@query(" SELECT genome, pos, string_agg(base, '' ORDER BY read_id, ord, base) AS letters FROM bases GROUP BY ALL", "bases")
def read_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pileup written as text, with every letter behind a read mark, and read again."""
    bases = view(spark, sf_dir, "bases")
    ordered = F.array_sort(F.collect_list(F.struct("read_id", "ord", "base")))
    per = bases.groupBy("genome", "pos").agg(F.transform(ordered, lambda x: x["base"]).alias("b"))
    rows = per.select("genome", "pos", F.lit("N"), F.size("b"), F.array_join(F.transform("b", lambda x: F.concat(F.lit("^]"), x)), ""), F.array_join(F.transform("b", lambda x: F.lit("I")), ""))
    own = readers.pileup(spark, text_file(spark, "pileup", tabbed(rows)))
    return own.select("genome", F.col("pos").cast("long").alias("pos"), "letters")


@query(" SELECT genome, pos, num, round(pi, 6) AS pi FROM (SELECT genome, pos, sum(n)::BIGINT AS num, (sum(n) * sum(n) - sum(n * n)) / (sum(n) * (sum(n) - 1)) AS pi FROM (SELECT genome, pos, upper(base) AS b, count(*) AS n FROM bases GROUP BY ALL) GROUP BY ALL) WHERE num > 1", "bases")
def diversity_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diversity written as JSON lines and read again."""
    sites = S.site_diversity(view(spark, sf_dir, "bases"), ["genome", "pos"])
    path = folder(spark, "pi")
    sinks.diversity_json(sites.select(F.col("genome").alias("Genome"), F.col("pos").cast("int").alias("Position"), F.col("pi").alias("Pi"), F.col("num").cast("int").alias("Num")), path)
    own = readers.diversity_json(spark, path)
    return own.select(F.col("Genome").alias("genome"), F.col("Position").cast("long").alias("pos"), F.col("Num").cast("long").alias("num"), clean(F.col("Pi"), 6).alias("pi"))


@query("SELECT n_nationkey::VARCHAR AS gene_id, i::INT AS lag, n_regionkey::DOUBLE AS value, (n_nationkey + 1)::BIGINT AS count, 'P2' AS type FROM nation, range(0, 2) AS r(i)")
def correlations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-gene results written to two sample folders and read together."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("gene_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("lag"), F.col("n_regionkey").cast("double").alias("value"), (F.col("n_nationkey") + 1).alias("count"), F.lit("P2").alias("type"))
    paths = [folder(spark, "corr") for _ in range(2)]
    for i, path in enumerate(paths):
        sinks.json_lines(sinks.gene_results(rows.where(F.col("gene_id") % 2 == i)), path)
    return readers.correlations_json(spark, paths).select("gene_id", "lag", "value", "count", "type")


@query("SELECT n_name AS value FROM nation")
def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First columns of a list."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat(' ', n_name, ' \tx') AS value")
    return readers.names(spark, text_file(spark, "names", rows))


@query("SELECT n_name AS organism, n_nationkey::VARCHAR AS taxid, CASE WHEN n_regionkey = 0 THEN '-' ELSE concat('NC_', n_regionkey) END AS chromosomes FROM nation")
def read_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue as a tab table with a header."""
    chromosomes = F.when(F.col("n_regionkey") == 0, "-").otherwise(F.concat(F.lit("NC_"), "n_regionkey"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("Organism"), F.col("n_nationkey").alias("TaxID"), chromosomes.alias("Chromosomes"))
    path = folder(spark, "catalogue")
    rows.write.csv(path, sep="\t", header=True)
    return readers.table_text(spark, path).select(F.col("Organism").alias("organism"), F.col("TaxID").alias("taxid"), F.col("Chromosomes").alias("chromosomes"))


@query("SELECT n_regionkey::BIGINT AS family_key, n_name AS name, 'ACGT' AS nucl FROM nation")
def families_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families written with base64 fields and read again."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("family_id"), F.col("n_nationkey").alias("idx"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("genome"), F.lit("11").alias("code"), F.lit("MP").alias("prot"), F.lit("ACGT").alias("nucl"), F.struct(F.lit(1).alias("From"), F.lit(2).alias("To"), F.lit("+").alias("Strand")).alias("loc"))
    path = folder(spark, "families")
    sinks.families_json(rows, path)
    lines = spark.read.text(path).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    return readers.families(spark, text_file(spark, "families", lines)).select(F.col("genome").cast("long").alias("family_key"), "name", "nucl")


@query(" SELECT p::VARCHAR AS q, s::VARCHAR AS s, 90.5::DOUBLE AS pident, CAST(NULL AS DOUBLE) AS evalue, score AS bitscore FROM hits", "hits")
def read_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabular hits with '|' in ids and '*' for unknown numbers."""
    rows = view(spark, sf_dir, "hits").selectExpr("concat_ws('\t', concat('ref|', p, '|x'), concat('ref|', s), '90.5', '1', '2', '3', '4', '5', '6', '7', '*', score) AS value")
    path = folder(spark, "hits")
    rows.write.text(path)
    return readers.hits(spark, path).select("q", "s", "pident", "evalue", "bitscore")


@query("SELECT string_agg(concat(n_regionkey, ':', n_name), ',' ORDER BY concat(n_regionkey, ':', n_name)) AS members, count(*) AS n FROM nation GROUP BY n_regionkey")
def cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters written a line each and read again."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("cluster_id"), F.concat_ws(":", "n_regionkey", "n_name").alias("member"))
    path = folder(spark, "clusters")
    sinks.cluster_lines(rows, path)
    own = readers.clusters(spark, path)
    return own.groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_list("member")), ",").alias("members"), F.count(F.lit(1)).alias("n")).drop("cluster_id")


@query("SELECT s_nationkey AS genome, sum(length(s_name) + 1000)::BIGINT AS len, md5(string_agg(s_name || repeat('N', 1000), '' ORDER BY s_suppkey)) AS seq_md5 FROM supplier GROUP BY 1")
def merged_scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaffolds of a genome as one sequence with gaps between."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("genome"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("seq"))
    return sinks.merged_scaffolds(rows).select("genome", F.length("seq").cast("long").alias("len"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query(" SELECT r.lag, c.n FROM (SELECT range AS lag FROM range(0, 12)) r LEFT JOIN (SELECT y.pos - x.pos AS lag, count(*) AS n FROM (SELECT DISTINCT pos FROM bases) x JOIN (SELECT DISTINCT pos FROM bases) y ON y.pos >= x.pos AND y.pos - x.pos < 12 GROUP BY 1) c USING (lag)", "bases")
def every_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lags of a table, also those without pairs."""
    sites = view(spark, sf_dir, "bases").select("pos").distinct().withColumn("g", F.lit(0))
    return sinks.every_lag(band_join(sites, ["g"], "pos", 12).groupBy("lag").agg(F.count(F.lit(1)).alias("n")), 12)


@query("SELECT n_regionkey::DOUBLE AS ks, list(n_nationkey::DOUBLE ORDER BY n_nationkey)::VARCHAR AS ct, count(*) AS n FROM nation WHERE n_regionkey > 0 GROUP BY 1")
def cov_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with parallel arrays, written compressed and read again; unknown variances give none."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").cast("double").alias("Ks"), F.when(F.col("n_regionkey") > 0, 1.0).alias("VarKs"), F.lit(1).alias("N"), F.lit(2).alias("NReads"), F.lit("Ct").alias("kind"), F.col("n_nationkey").cast("int").alias("lag"), F.col("n_nationkey").cast("double").alias("value"), F.lit(3).alias("obs"))
    path = folder(spark, "cov")
    sinks.json_lines(sinks.cov_results(rows), path, compress=True)
    own = readers.bootstraps(spark, f"{path}/*.gz")
    return own.select(F.col("Ks").alias("ks"), F.concat(F.lit("["), F.array_join(F.col("Ct").cast("array<string>"), ", "), F.lit("]")).alias("ct"), F.size("CtN").cast("long").alias("n"))


@query(" SELECT ref, count(*) AS records, arg_min(ord, (pos, ord)) AS first_ord, arg_max(ord, (pos, ord)) AS last_ord FROM records GROUP BY ref", "records")
def partition_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by reference; the first and last of each in the order of places."""
    by_place = F.struct("pos", "ord")
    return view(spark, sf_dir, "records").groupBy("ref").agg(F.count(F.lit(1)).alias("records"), F.min_by("ord", by_place).alias("first_ord"), F.max_by("ord", by_place).alias("last_ord"))


@query(" SELECT ref, min(ord) AS first_ord, count(*) AS records FROM (SELECT *, sum(starts) OVER (ORDER BY ord) AS run FROM (SELECT *, CASE WHEN lag(ref) OVER (ORDER BY ord) = ref THEN 0 ELSE 1 END AS starts FROM records)) GROUP BY ref, run", "records")
def reference_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: runs of records of one reference in file order."""
    return runs(view(spark, sf_dir, "records").select("ord", "ref"), "ord", "ref").groupBy("ref", "run").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("records")).drop("run")


@query(" SELECT ord, row_number() OVER (ORDER BY ref, pos, ord) - 1 AS at FROM records", "records")
def record_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each record when all are sorted by reference and place."""
    return numbered(view(spark, sf_dir, "records").select("ord", "ref", "pos"), ["ref", "pos", "ord"])[0].select("ord", "at")


@query("SELECT r_name AS prefix, concat('strains/', n_name) AS path FROM nation JOIN region ON r_regionkey = n_regionkey")
def read_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species and the paths of their strains, written as a list and read again."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("prefix"), F.concat(F.lit("strains/"), "n_name").alias("path"))
    path = folder(spark, "species")
    sinks.species_lines(rows, path)
    return readers.species(spark, path)


@query("SELECT r_name AS name, n_name AS accession, (n_nationkey * 10)::INT AS length FROM nation JOIN region ON r_regionkey = n_regionkey")
def read_strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strains with their genomes, written and read again."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("Name"), F.concat(F.lit("p/"), "r_name").alias("Path"), F.col("n_name").alias("Accession"), (F.col("n_nationkey") * 10).cast("int").alias("Length"))
    path = folder(spark, "strains")
    sinks.strains_json(rows, path)
    return readers.strains(spark, path).select(F.col("Name").alias("name"), F.explode("Genomes").alias("g")).select("name", F.col("g.Accession").alias("accession"), F.col("g.Length").alias("length"))


@query(" SELECT genome, pos, pos_type FROM (SELECT DISTINCT genome, pos - 1 AS pos, CASE WHEN pos % 3 <> 0 THEN pos % 3 ELSE 4 END::TINYINT AS pos_type FROM bases)", "bases")
def position_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position types of genomes, a byte a base, written and read again."""
    sites = view(spark, sf_dir, "bases").select("genome", "pos").distinct().withColumn("pos_type", F.when(F.col("pos") % 3 != 0, F.col("pos") % 3).otherwise(4).cast("tinyint"))
    path = folder(spark, "profile")
    sinks.position_profile(sites.withColumn("pos", F.col("pos") - 1), path)
    own = readers.position_profile(spark, f"{path}/*.pos")
    return own.select(F.regexp_extract("file", r"([^/]+)[.]pos$", 1).alias("genome"), F.col("pos").cast("long").alias("pos"), "pos_type").where("pos_type <> 0")


@query("SELECT n_regionkey::VARCHAR AS strain, 'hyper' AS kind, count(*)::DOUBLE AS b0, 2.5::DOUBLE AS b1 FROM nation GROUP BY 1")
def fit_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: fitted parameters written as JSON and read again."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy(F.col("n_regionkey").cast("string").alias("strain")).agg(F.count(F.lit(1)).cast("double").alias("b0"))
    path = folder(spark, "fits")
    sinks.fit_results(rows.select("strain", F.lit("hyper").alias("kind"), "b0", F.lit(2.5).alias("b1"), F.lit(None).cast("double").alias("b2")), path)
    return spark.read.schema("strain string, kind string, b0 double, b1 double").json(path)


@query("SELECT n_regionkey::VARCHAR AS g, n_nationkey::VARCHAR AS l, 'P2' AS t, (n_nationkey / 4.0)::VARCHAR AS m, CASE WHEN n_nationkey % 5 = 0 THEN 'NaN' ELSE (n_nationkey / 2.0)::VARCHAR END AS v FROM nation")
def gene_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile as a table with columns l, m, v, n, t, g, and as tabbed lines with unknown values as NaN, both read again."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("lag"), (F.col("n_nationkey") / 4).alias("m"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") / 2).alias("v"), F.lit(3).alias("n"), F.lit("P2").alias("t"), F.col("n_regionkey").alias("gene_id"))
    csv, tabs = folder(spark, "genes"), folder(spark, "lags")
    sinks.gene_table(rows, csv)
    sinks.tab_table(rows.select("gene_id", "lag", "v"), tabs, ["gene_id", "lag"], ["# gene lag v"])
    first = spark.read.csv(csv, header=True).select("g", "l", "t", "m")
    f = F.split("value", "\t")
    second = spark.read.text(tabs).where("value not like '#%'").select(f[0].alias("g"), f[1].alias("l"), f[2].alias("v"))
    return first.join(second, ["g", "l"])


@query("SELECT n_nationkey AS lag, n_regionkey::DOUBLE AS mean_cr, 2.0::DOUBLE AS var_cr, 5 AS n_cr, 1.5::DOUBLE AS mean_xbar FROM nation WHERE n_nationkey % 3 <> 0")
def wide_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags with known variances in sixteen columns."""
    number = {f"{s}_{x}": (F.lit(5) if s == "n" else F.lit(2.0) if s == "var" else F.lit(1.5)) for x in ("cs", "cr", "ct", "xbar", "ybar") for s in ("mean", "var", "n")}
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("lag"), "n_regionkey").withColumns(number)
    rows = rows.withColumns({"mean_cr": F.col("n_regionkey").cast("double"), "var_cr": F.when(F.col("lag") % 3 != 0, F.col("var_cr"))})
    return sinks.wide_lags(rows).select("lag", "mean_cr", "var_cr", "n_cr", "mean_xbar")


@query("SELECT n_name AS genome, n_nationkey::BIGINT AS pos FROM nation")
def concatenated_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a stream that stand one behind the other, without line ends."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.format_string('{"Genome":"%s","Position":%d,"Pi":0.5,"Num":3,"Alleles":{"A":1}}', "n_name", "n_nationkey")), "").alias("value"))
    own = readers.diversity_json(spark, text_file(spark, "stream", rows.select("value")))
    return own.select(F.col("Genome").alias("genome"), F.col("Position").cast("long").alias("pos"))


@query("""SELECT doc_id::INT AS pos, md5(concat('}{"', coalesce(text, ''), chr(92))) AS genome_md5, octet_length(encode(coalesce(text, ''))) + 4 AS bytes FROM documents""")
def json_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects over several lines and behind each other, with braces, quotes and backslashes in their strings, read by ranges of 64 KiB."""
    text = F.concat(F.lit('}{"'), F.coalesce("text", F.lit("")), F.lit("\\"))
    own = F.to_json(F.struct(text.alias("Genome"), F.col("doc_id").cast("int").alias("Position"), F.lit(0.5).alias("Pi")))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.regexp_replace(own, "^[{]", "{\n  "), F.when(F.col("doc_id") % 2 == 0, " \n").otherwise("")).alias("value"))
    path = folder(spark, "stream")
    rows.write.text(path, lineSep=" ")
    found = readers.diversity_json(spark, path, 1 << 16)
    return found.select(F.col("Position").alias("pos"), F.md5(F.col("Genome").cast("binary")).alias("genome_md5"), F.octet_length("Genome").cast("long").alias("bytes"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, r_name AS species FROM nation JOIN region ON r_regionkey = n_regionkey")
def read_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy dump written and read again, and the species above each of its strains."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    nodes = nation.selectExpr("concat_ws('\t|\t', n_nationkey, 1000 + n_regionkey, 'strain') AS value").unionByName(region.selectExpr("concat_ws('\t|\t', 1000 + r_regionkey, 1, 'species') AS value"))
    called = nation.selectExpr("n_nationkey AS id", "n_name AS name").union(region.selectExpr("1000 + r_regionkey", "r_name"))
    names = called.withColumn("kind", F.explode(F.array(F.lit("scientific name"), F.lit("synonym")))).selectExpr("concat(concat_ws('\t|\t', id, if(kind = 'synonym', 'other', name), '', kind), '\t|') AS value")
    taxa = readers.taxonomy(spark, text_file(spark, "nodes", nodes), text_file(spark, "taxa", names))
    strains = taxa.where("rank = 'strain'").select("id", "name")
    return strains.join(G.climbed(taxa, strains.select("id"), "species"), "id").select("id", "name", F.col("found").alias("species"))

