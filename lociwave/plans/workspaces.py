"""Whole runs over a workspace that the query writes from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociwave import flows
from lociwave.functions import sequence as Q
from lociwave.plans.registry import query
from lociwave.sources import reference, sinks
from lociwave.sources.config import settings
from lociwave.sources.files import opened_for_writing
from lociwave.sources.readers import COV_SCHEMA
from lociwave.sources.scratch import scratch_path

# Five genomes of one line of 32 letters a supplier, a gene over the first thirty of each; a fragment of two mates an order,
# some with another letter, some with overlapping mates, some that go on beyond their genome.
LINES = "SELECT concat('NC_10000', s_nationkey % 5) AS acc, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) - 1 AS i, translate(md5(CAST(s_suppkey AS STRING)), '0123456789abcdef', 'ATGCATGCATGCATGC') AS l FROM supplier"
MATES = "SELECT o, acc, CAST(start AS BIGINT) AS start, CAST(start + 12 + o % 25 AS BIGINT) AS other, CASE WHEN o % 3 = 0 THEN concat(substr(a, 1, CAST(o % 20 AS INT)), 'G', substr(a, CAST(o % 20 + 2 AS INT))) ELSE a END AS a, CASE WHEN o % 4 = 0 THEN concat(substr(b, 1, CAST(o % 17 AS INT)), 'T', substr(b, CAST(o % 17 + 2 AS INT))) ELSE b END AS b FROM cut"
SETTINGS = "genome:\n reference: ref\nspecies:\n file: species.yaml\ncov:\n maxl: 30\n functions:\n  - \"Cov_Reads_vs_Genome\"\n  - \"Cov_Reads_vs_Reads\"\n positions: [0, 1, 3]\nfit:\n exp:\n  start: 1\n  end: 10\n hyper:\n  start: 1\n  end: 10\n"


def workspace(spark: SparkSession, sf_dir: str) -> str:
    """Writes sequences, gene tables, alignments, the catalogue, species and settings of a workspace."""
    path = scratch_path(spark, "workspace")
    lines = spark.sql(LINES.replace("FROM supplier", "FROM {s}"), s=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    store = reference.stored(lines.groupBy("acc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "l"))), lambda x: x["l"]), "").alias("seq")).withColumnRenamed("acc", "accession"))
    sizes = lines.groupBy("acc").agg((F.count(F.lit(1)) * 32).alias("len"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("o"), F.concat(F.lit("NC_10000"), F.col("o_orderkey") % 5).alias("acc"))
    reads = orders.join(sizes, "acc").withColumn("start", F.col("o") * 7 % F.greatest(F.col("len") - 32, F.lit(1)))
    spans = reads.select(F.explode(F.array(F.struct("o", F.lit(0).alias("s")), F.struct("o", F.lit(1).alias("s")))).alias("k"), F.col("acc").alias("accession"), "start")
    spans = spans.withColumn("start", F.col("start") + F.when(F.col("k.s") == 1, 12 + F.col("k.o") % 25).otherwise(0)).withColumn("end", F.col("start") + 20)
    cut = reference.sliced(store, spans, "k").groupBy(F.col("k.o").alias("o")).agg(*[F.rpad(F.coalesce(F.max(F.when(F.col("k.s") == s, F.col("text"))), F.lit("")), 20, "A").alias(c) for s, c in enumerate("ab")])
    rows = spark.sql(MATES.replace("FROM cut", "FROM {cut}"), cut=reads.join(cut, "o"))
    left, right = F.col("start") + 1, F.col("other") + 1
    sides = [F.concat_ws("\t", F.concat(F.lit("r"), "o"), F.lit(flag), "acc", at, F.lit("42"), F.lit("20M"), F.lit("="), mate, F.lit("0"), seq, F.lit("I" * 20)) for flag, at, mate, seq in (("99", left, right, "a"), ("147", right, left, "b"))]
    sam = rows.select("acc", F.explode(F.array(*sides)).alias("value"))
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    system = hadoop.Path(path).getFileSystem(conf)

    def by_genome(df: DataFrame, name: str, ending: str, compression: str = "none") -> list[str]:
        """The lines of each genome as a folder name/strains/ACCESSION/ACCESSION + ending; its accessions."""
        parts = f"{path}/parts/{name}{ending}"
        df.write.partitionBy("acc").text(parts, compression=compression)
        own = sorted(x.getPath().getName().split("=")[1] for x in system.globStatus(hadoop.Path(f"{parts}/acc=*")))
        for acc in own:
            system.mkdirs(hadoop.Path(f"{path}/{name}/strains/{acc}"))
            system.rename(hadoop.Path(f"{parts}/acc={acc}"), hadoop.Path(f"{path}/{name}/strains/{acc}/{acc}{ending}"))
        return own

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("acc").sortWithinPartitions("acc", "k").select("acc", "value")

    heads = sizes.select("acc", F.lit(-1).cast("long").alias("k"), F.concat(F.lit(">"), "acc", F.lit(" a genome")).alias("value"))
    own = by_genome(in_order(heads.unionByName(lines.select("acc", F.col("k").cast("long").alias("k"), F.col("l").alias("value")))), "ref", ".fna")
    strand = F.when(F.col("k") % 2 == 0, "+").otherwise("-")
    genes = F.concat_ws("\t", F.concat(F.col("i") * 32 + 1, F.lit(".."), F.col("i") * 32 + 30), strand, F.lit("9"), F.col("k").cast("string"), F.lit("-"))
    by_genome(in_order(lines.select("acc", "k", genes.alias("value"))), "ref", ".ptt")
    by_genome(sam, "sam", ".align.sam", "gzip")
    catalogue = "[" + ",".join(f'{{"Name":"s{a}","Path":"strains/{a}","GeneticCode":"11","Genomes":[{{"Accession":"ref|{a}.1|","Replicon":"chromosome"}},{{"Accession":"{a}9","Replicon":"plasmid"}}]}}' for a in own) + "]"
    for text, name in ((catalogue, "reference_strains.json"), ("one: [" + ", ".join(f"strains/{a}" for a in own) + "]", "species.yaml"), (SETTINGS, "config.yaml")):
        with opened_for_writing(f"{path}/{name}") as f:
            f.write(text.encode())
    return path


def families(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Aligned families of a workspace: the genes of the same line of each genome, with a gap of two at one place."""
    lines = spark.sql(LINES.replace("FROM supplier", "FROM {s}"), s=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    plus, gene = F.col("k") % 2 == 0, F.substring("l", 1, 30)
    own = F.when(plus, gene).otherwise(Q.reverse_complement(gene))
    at = (F.col("i") % 20 + 1).cast("int")
    loc = F.struct((F.col("i") * 32 + 1).cast("int").alias("From"), (F.col("i") * 32 + 30).cast("int").alias("To"), F.when(plus, "+").otherwise("-").alias("Strand"))
    nucl = F.concat(F.substr(own, F.lit(1), at), F.lit("--"), F.substr(own, at + 1, F.lit(30)))
    rows = lines.select(F.col("i").alias("family_id"), F.col("acc").alias("idx"), F.col("k").cast("string").alias("id"), F.lit("n").alias("name"), F.concat("acc", F.lit(".1")).alias("genome"), F.lit("11").alias("code"), F.lit("").alias("prot"), nucl.alias("nucl"), loc.alias("loc"))
    sinks.aligned_json(rows, f"{path}/ortho", "one")


def tidy(x: Column) -> Column:
    """Rounded to nine digits from a little above, so that exact halves (of powers of two) don't depend on the order of sums."""
    return F.round(x + 1e-12, 9) + F.lit(0.0)


KEYS = ("strain", "accession", "function", "position")


def _statement() -> str:
    site = "acc, position, pa, pb"
    kept = "SELECT acc, fn, position, CASE WHEN position = 0 THEN lag ELSE lag // 3 END AS lag, CASE WHEN n > 1 THEN (sxy - sx * sy / n) / (n - 1) END AS value, n AS obs FROM sm WHERE position = 0 OR (lag % 3 = 0 AND lag < 30)"
    cuts = ", ".join(f"rpad(substr(seq, (start + 1 + {shift})::INT, 20), 20, 'A') AS {c}" for c, shift in (("a", "0"), ("b", "12 + o % 25")))
    return f"""
WITH ln AS ({LINES.replace("AS STRING", "AS VARCHAR")}),
gs AS (SELECT acc, string_agg(l, '' ORDER BY k) AS seq, 32 * count(*) AS len FROM ln GROUP BY acc),
gb AS (SELECT acc, k, 32 * i + p - 1 AS pos, CASE WHEN k % 2 = 0 THEN p - 1 ELSE 30 - p END AS j, CASE WHEN k % 2 = 0 THEN substr(l, p, 1) ELSE translate(substr(l, p, 1), 'ATGC', 'TACG') END AS b FROM (SELECT ln.*, p::INT AS p FROM ln, range(1, 31) AS r(p))),
cd AS (SELECT acc, k, j // 3 AS c, string_agg(b, '' ORDER BY j) AS codon FROM gb GROUP BY ALL),
pf AS (SELECT gb.acc, pos, CASE WHEN j % 3 = 2 AND codon IN ({", ".join(repr(c) for c in Q.fourfold())}) THEN 4 ELSE j % 3 + 1 END AS kind FROM gb JOIN cd ON cd.acc = gb.acc AND cd.k = gb.k AND c = j // 3),
st AS (SELECT o_orderkey AS o, acc, len, seq, o_orderkey * 7 % greatest(len - 32, 1) AS start FROM orders JOIN gs ON acc = concat('NC_10000', o_orderkey % 5)),
cut AS (SELECT o, acc, start, {cuts} FROM st),
mt AS ({MATES}),
fr AS (SELECT o, acc, start, CASE WHEN other - start >= 20 THEN concat(a, repeat('*', (other - start - 20)::INT), b) ELSE concat(a, substr(b, (21 - other + start)::INT)) END AS letters FROM mt),
bs AS (SELECT o, acc, start, start + i AS pos, substr(letters, (i + 1)::INT, 1) AS x, length(letters) AS n FROM fr, range(0, 60) AS r(i) WHERE i < length(letters)),
kb AS (SELECT o, bs.acc, position, pos, x, substr(seq, (pos + 1)::INT, 1) AS g, start + n <= len AS inside FROM bs JOIN gs USING (acc) LEFT JOIN pf USING (acc, pos) JOIN (VALUES (0), (1), (3)) AS q(position) ON CASE WHEN position = 3 THEN coalesce(kind, 0) IN (3, 4) ELSE coalesce(kind, 0) = position END WHERE pos < len AND x <> '*'),
pp AS (SELECT a.acc, a.position, a.inside, a.pos AS pa, b.pos AS pb, a.x AS la, b.x AS lb, (a.x <> a.g)::INT AS u, (b.x <> b.g)::INT AS v FROM kb a JOIN kb b USING (o, position) WHERE b.pos >= a.pos AND b.pos < a.pos + 30),
vg AS (SELECT acc, 'reads_vs_genome' AS fn, position, pb - pa AS lag, count(*)::DOUBLE AS n, sum(u)::DOUBLE AS sx, sum(v)::DOUBLE AS sy, sum(u * v)::DOUBLE AS sxy FROM pp WHERE inside GROUP BY ALL),
ce AS (SELECT {site}, la, lb, count(*) AS c FROM pp GROUP BY ALL),
ra AS (SELECT {site}, sum(s * (s - 1) / 2) AS r FROM (SELECT {site}, la, sum(c) AS s FROM ce GROUP BY ALL) GROUP BY ALL),
rb AS (SELECT {site}, sum(s * (s - 1) / 2) AS q FROM (SELECT {site}, lb, sum(c) AS s FROM ce GROUP BY ALL) GROUP BY ALL),
tt AS (SELECT {site}, sum(c) * (sum(c) - 1) / 2 AS n, sum(c * (c - 1) / 2) AS same FROM ce GROUP BY ALL HAVING sum(c) >= 2),
vr AS (SELECT acc, 'reads_vs_reads' AS fn, position, pb - pa AS lag, sum(n)::DOUBLE AS n, sum(n - r)::DOUBLE AS sx, sum(n - q)::DOUBLE AS sy, sum(n - r - q + same)::DOUBLE AS sxy FROM tt JOIN ra USING ({site}) JOIN rb USING ({site}) GROUP BY ALL),
sm AS (SELECT * FROM vg UNION ALL SELECT * FROM vr),
ks AS (SELECT acc, fn, position, sx / n AS ks, (sx - sx * sx / n) / (n - 1) AS var_ks, n FROM sm WHERE lag = 0 AND n > 1),
nr AS (SELECT acc, count(*) AS reads FROM fr GROUP BY acc),
kp AS ({kept})
SELECT concat('strains/', acc) AS strain, acc AS accession, fn AS function, position::INT AS position, lag::INT AS lag, round(value + 1e-12, 9) + 0.0 AS value, obs::BIGINT AS obs, round(ks + 1e-12, 9) + 0.0 AS ks, round(var_ks + 1e-12, 9) + 0.0 AS var_ks, ks.n::BIGINT AS n, reads::BIGINT AS reads
FROM kp JOIN ks USING (acc, fn, position) JOIN nr USING (acc) WHERE value IS NOT NULL
"""


@query(_statement())
def reads_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace through genome_profile and cov_reads, with both functions over mated reads at three positions."""
    path = workspace(spark, sf_dir)
    own = settings(flows.loaded(path), {})
    flows.genome_profile(spark, own, path)
    flows.cov_reads(spark, own, path)
    rows = spark.read.schema(f"strain string, accession string, function string, position int, {COV_SCHEMA}").json(f"{path}/cov/reads")
    rows = rows.select(*KEYS, "Ks", "VarKs", "N", "NReads", F.explode(F.arrays_zip("CtIndices", "Ct", "CtN")).alias("c"))
    return rows.select(*KEYS, F.col("c.CtIndices").alias("lag"), tidy(F.col("c.Ct")).alias("value"), F.col("c.CtN").cast("long").alias("obs"), tidy(F.col("Ks")).alias("ks"), tidy(F.col("VarKs")).alias("var_ks"), F.col("N").cast("long").alias("n"), F.col("NReads").cast("long").alias("reads"))


def _families_statement() -> str:
    keys, aln = "g, fn, position, type", "i, g, fn, position"
    kept = " UNION ALL ".join(f"SELECT {keys}, '{k}' AS kind, lag, {v} AS value, {n} AS obs FROM {t} GROUP BY {keys}, lag" for k, t, v, n in (("Ct", "ct", "sum(sxy) / sum(n) - sum(sx) / sum(n) * (sum(sy) / sum(n))", "sum(n)"), ("Cs", "cs", "avg(c)", "count(*)"), ("Cm", "cm", "avg(c)", "count(*)"), ("Cr", "cr", "avg(c)", "count(*)")))
    return f"""
WITH ln AS ({LINES.replace("AS STRING", "AS VARCHAR")}),
gb AS (SELECT acc, k, i, CASE WHEN k % 2 = 0 THEN p - 1 ELSE 30 - p END AS j, CASE WHEN k % 2 = 0 THEN substr(l, p, 1) ELSE translate(substr(l, p, 1), 'ATGC', 'TACG') END AS b FROM (SELECT ln.*, p::INT AS p FROM ln, range(1, 31) AS r(p))),
cd AS (SELECT acc, k, j // 3 AS c, string_agg(b, '' ORDER BY j) AS codon FROM gb GROUP BY ALL),
pl AS (SELECT gb.acc AS g, i, j, b, position FROM gb JOIN cd ON cd.acc = gb.acc AND cd.k = gb.k AND c = j // 3 JOIN (VALUES (1), (3), (4)) AS q(position) ON CASE position WHEN 3 THEN j % 3 = 2 WHEN 4 THEN j % 3 = 2 AND codon IN ({", ".join(repr(c) for c in Q.fourfold())}) ELSE j % 3 + 1 = position END),
sb AS (SELECT pl.i, g, 'genomes_vs_genome' AS fn, position, o.acc AS r1, '' AS r2, pl.j, (pl.b <> o.b)::INT::DOUBLE AS x FROM pl JOIN gb o ON o.i = pl.i AND o.j = pl.j AND o.acc <> g
  UNION ALL SELECT pl.i, g, 'genomes_vs_genomes', position, o.acc, u.acc, pl.j, (o.b <> u.b)::INT::DOUBLE FROM pl JOIN gb o ON o.i = pl.i AND o.j = pl.j JOIN gb u ON u.i = pl.i AND u.j = pl.j AND o.acc < u.acc),
ty AS (SELECT i, unnest(CASE WHEN count(*) = (SELECT count(DISTINCT acc) FROM ln) THEN ['pan', 'core'] ELSE ['pan', 'disp'] END) AS type FROM ln GROUP BY i),
pp AS (SELECT a.i, a.g, a.fn, a.position, a.r1, a.r2, a.j AS ja, b.j - a.j AS lag, a.x AS x, b.x AS y, b.j AS jb FROM sb a JOIN sb b ON a.i = b.i AND a.g = b.g AND a.fn = b.fn AND a.position = b.position AND a.r1 = b.r1 AND a.r2 = b.r2 AND b.j >= a.j AND b.j < a.j + 30),
ct AS (SELECT {keys}, lag, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy FROM pp JOIN ty USING (i) GROUP BY ALL),
cs AS (SELECT {keys}, lag, c FROM (SELECT {aln}, lag, covar_pop(x, y) AS c FROM pp GROUP BY {aln}, ja, jb, lag HAVING count(*) >= 4) JOIN ty USING (i)),
cm AS (SELECT {keys}, lag, c FROM (SELECT {aln}, lag, covar_pop(x, y) AS c FROM pp GROUP BY {aln}, r1, r2, lag HAVING count(*) >= 4) JOIN ty USING (i)),
mn AS (SELECT {aln}, j, avg(x) AS x FROM sb GROUP BY ALL),
cr AS (SELECT {keys}, lag, c FROM (SELECT a.i, a.g, a.fn, a.position, b.j - a.j AS lag, covar_pop(a.x, b.x) AS c FROM mn a JOIN mn b ON a.i = b.i AND a.g = b.g AND a.fn = b.fn AND a.position = b.position AND b.j >= a.j GROUP BY ALL HAVING count(*) >= 4) JOIN ty USING (i)),
ks AS (SELECT {keys}, avg(x) AS ks, var_samp(x) AS var_ks, count(*) AS n FROM sb JOIN ty USING (i) GROUP BY ALL HAVING count(*) > 1),
kp AS ({kept})
SELECT concat('strains/', g) AS strain, g AS accession, fn AS function, position::INT AS position, type, kind, (lag // 3)::INT AS lag, round(value + 1e-12, 9) + 0.0 AS value, obs::BIGINT AS obs, round(ks + 1e-12, 9) + 0.0 AS ks, round(var_ks + 1e-12, 9) + 0.0 AS var_ks, n::BIGINT AS n
FROM kp JOIN ks USING ({keys}) WHERE lag % 3 = 0 AND lag < 30
"""


@query(_families_statement())
def genomes_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned families of a workspace through cov_genomes, with both functions, three positions, all kinds and types."""
    path = workspace(spark, sf_dir)
    families(spark, sf_dir, path)
    own = settings(flows.loaded(path), {}, cov_positions=(1, 3, 4))
    flows.genome_profile(spark, own, path)
    flows.cov_genomes(spark, own, path)
    rows = spark.read.schema(f"strain string, accession string, function string, position int, type string, {COV_SCHEMA}").json(f"{path}/cov/genomes")
    def cells(kind: str) -> Column:
        zipped = F.arrays_zip(F.col(f"{kind}Indices").alias("lag"), F.col(kind).alias("value"), F.col(f"{kind}N").alias("obs"))
        return F.transform(zipped, lambda x: F.struct(F.lit(kind).alias("kind"), x["lag"].alias("lag"), x["value"].alias("value"), x["obs"].cast("long").alias("obs")))

    rows = rows.select(*KEYS, "type", "Ks", "VarKs", "N", F.explode(F.concat(*map(cells, ("Ct", "Cs", "Cm", "Cr")))).alias("c"))
    return rows.select(*KEYS, "type", "c.kind", "c.lag", tidy(F.col("c.value")).alias("value"), "c.obs", tidy(F.col("Ks")).alias("ks"), tidy(F.col("VarKs")).alias("var_ks"), F.col("N").cast("long").alias("n"))
