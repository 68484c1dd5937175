"""Reads, overlaps and alignments: intervals, mates, substitution correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociwave.functions.stats import clean, variance
from lociwave.operators import reads as R
from lociwave.operators import substitutions as X
from lociwave.operators.joins import interval_join
from lociwave.plans.registry import query
from lociwave.sources import reference
from lociwave.sources.scratch import scratch_path, written
from lociwave.sources.views import view
from lociwave.streaming import mates

GOOD = "good AS (SELECT * FROM reads WHERE mapq > 20 AND mapq < 51)"
# The queue: a head leaves when an earlier or own first later read starts beyond its end.
QUEUE = f"{GOOD}, o AS (SELECT *, row_number() OVER (ORDER BY pos, read_id) - 1 AS k, count(*) OVER () AS n FROM good), ff AS (SELECT o.*, (SELECT count(*) FROM good g WHERE g.pos <= o.pos + o.len) AS f FROM o), heads AS (SELECT * FROM ff QUALIFY max(f - k) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) + k < n)"
OVER = "ov AS (SELECT a.read_id AS read_id_a, b.read_id AS read_id_b, b.pos - a.pos AS shift, least(a.pos + a.len, b.pos + b.len) - b.pos AS shared FROM heads a JOIN good b ON b.pos <= a.pos + a.len AND (b.pos > a.pos OR (b.pos = a.pos AND b.read_id > a.read_id)))"


def good_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping quality strictly between the bounds."""
    return view(spark, sf_dir, "reads").where("mapq > 20 and mapq < 51")


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = good_reads(spark, sf_dir)
    rows = R.overlapping(R.released(reads, ["ref"]), reads, ["ref"], 64)
    return rows.withColumns({"shift": F.col("pos_b") - F.col("pos_a"), "shared": F.least(F.col("pos_a") + F.col("len_a"), F.col("pos_b") + F.col("len_b")) - F.col("pos_b")})


@query(f", {QUEUE} SELECT count(*) AS heads, sum(k)::BIGINT AS sum_k, max(pos) AS last_pos FROM heads", "reads")
def released_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reads the sliding queue releases."""
    return R.released(good_reads(spark, sf_dir), ["ref"]).agg(F.count(F.lit(1)).alias("heads"), F.sum("k").cast("long").alias("sum_k"), F.max("pos").alias("last_pos"))


@query(f", {QUEUE}, {OVER} SELECT shift, count(*) AS n, sum(shared)::BIGINT AS shared FROM ov GROUP BY shift", "reads")
def read_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping reads by the distance of their starts."""
    return overlaps(spark, sf_dir).groupBy("shift").agg(F.count(F.lit(1)).alias("n"), F.sum("shared").cast("long").alias("shared"))


# Overlapping reads of a reference, place by place; one sample of ten by the pair's ids.
COMPARED = "gr AS (SELECT * FROM seq_reads WHERE mapq > 20 AND mapq < 51), op AS (SELECT a.read_id AS ra, b.read_id AS rb, (a.read_id * 31 + b.read_id) % 10 AS sample, j, substr(a.seq, (b.pos - a.pos + j)::INT, 1) AS la, substr(b.seq, j::INT, 1) AS lb, ascii(substr(a.quals, (b.pos - a.pos + j)::INT, 1)) - 33 AS qa, ascii(substr(b.quals, j::INT, 1)) - 33 AS qb FROM gr a JOIN gr b ON a.ref = b.ref AND b.pos < a.pos + length(a.seq) AND (b.pos > a.pos OR (b.pos = a.pos AND b.read_id > a.read_id)), range(1, 81) AS r(j) WHERE j <= least(length(a.seq) - (b.pos - a.pos), length(b.seq))), xs AS (SELECT ra, rb, sample, j, CASE WHEN la IN ('A', 'T', 'G', 'C') AND lb IN ('A', 'T', 'G', 'C') AND qa > 30 AND qb > 30 THEN CAST(la <> lb AS INT)::DOUBLE END AS x FROM op)"


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of differences between overlapping reads, by sample."""
    reads = R.masked(view(spark, sf_dir, "seq_reads").where("mapq > 20 and mapq < 51"))
    spans = reads.select("read_id", "ref", "letters", F.col("pos").alias("start"), (F.col("pos") + F.length("seq")).alias("end"))
    both = interval_join(spans, spans, ["ref"], 256)
    later = (F.col("start_b") > F.col("start_a")) | ((F.col("start_b") == F.col("start_a")) & (F.col("read_id_b") > F.col("read_id_a")))
    rows = both.where(later).withColumns({"sample": (F.col("read_id_a") * 31 + F.col("read_id_b")) % 10, "shift": F.col("start_b") - F.col("start_a")})
    return R.difference_sums(rows, "sample", 4)


@query(f", {COMPARED} SELECT sample, count(DISTINCT (ra, rb)) AS pairs, count(x) AS known, sum(x)::BIGINT AS differ FROM xs GROUP BY sample", "seq_reads")
def read_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known and different places of overlapping reads, with the strict quality gate on both."""
    return compared(spark, sf_dir).select("sample", "pairs", "known", "differ")


@query(f", {COMPARED}, lg AS (SELECT p.sample, q.j - p.j AS lag, covar_pop(p.x, q.x) AS cov, count(*) AS n FROM xs p JOIN xs q USING (ra, rb) WHERE q.j >= p.j AND q.j - p.j < 4 AND p.x IS NOT NULL AND q.x IS NOT NULL GROUP BY ALL) SELECT lag, round(avg(cov), 9) + 0.0 AS mean, coalesce(round(CASE WHEN count(*) > 1 THEN var_samp(cov) END, 9), 0.0) + 0.0 AS var, count(*) AS n FROM lg WHERE n > 10 GROUP BY lag", "seq_reads")
def ct_by_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of differences between overlapping reads by lag, over ten samples chosen by the pair's ids."""
    lags = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), *[F.col(f"{c}_{k}").alias(c) for c in ("n", "sa", "sb", "sab")]) for k in range(4)])
    per = compared(spark, sf_dir).select("sample", F.explode(lags).alias("s")).select("sample", "s.*").where("n > 10")
    per = per.withColumn("cov", F.col("sab") / F.col("n") - F.col("sa") / F.col("n") * (F.col("sb") / F.col("n")))
    return per.groupBy("lag").agg(clean(F.avg("cov")).alias("mean"), clean(F.coalesce(variance(F.col("cov"), True), F.lit(0.0))).alias("var"), F.count(F.lit(1)).alias("n"))


MATES = "m AS (SELECT name, max(ord) FILTER (pos < mate_pos) AS left_ord, max(ord) FILTER (NOT pos < mate_pos) AS right_ord FROM records WHERE mate_ref = ref GROUP BY name HAVING left_ord IS NOT NULL AND right_ord IS NOT NULL)"


@query(f", {MATES} SELECT * FROM m", "records")
def mate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and right mate of each name; the last record wins."""
    return R.mates(view(spark, sf_dir, "records"))


FRAGMENTS = f"{MATES}, fr AS (SELECT m.name AS id, least(l.pos, r.pos) AS a, greatest(l.pos, r.pos) + 20 AS b FROM m JOIN records l ON l.ord = left_ord JOIN records r ON r.ord = right_ord)"


@query(f", {FRAGMENTS} SELECT y.a - x.a AS shift, count(*) AS n FROM fr x JOIN fr y ON x.a < y.b AND y.a < x.b AND (x.b < y.b OR (x.b = y.b AND x.id < y.id)) GROUP BY 1", "records")
def mated_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping fragments in the order of their right ends."""
    records = view(spark, sf_dir, "records")
    side = lambda s: records.select(F.col("ord").alias(f"{s}_ord"), F.col("pos").alias(f"{s}_pos"))
    rows = R.mates(records).join(side("left"), "left_ord").join(side("right"), "right_ord")
    rows = rows.select(F.col("name").alias("id"), F.least("left_pos", "right_pos").alias("left"), (F.greatest("left_pos", "right_pos") + 20).alias("right"))
    return R.fragment_shifts(rows)


@query(" SELECT gene_id, count(*) AS reads, sum(least(pos + len, gene_end) - greatest(pos, gene_start - 1))::BIGINT AS bases FROM reads JOIN genes USING (ref) WHERE pos < gene_end AND gene_start - 1 < pos + len GROUP BY gene_id", "reads genes")
def read_gene_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that touch each gene."""
    reads = view(spark, sf_dir, "reads").withColumn("end", F.col("pos") + F.col("len"))
    rows = R.in_genes(reads, view(spark, sf_dir, "genes"), 128)
    return rows.groupBy("gene_id").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.col("end") - F.col("start")).cast("long").alias("bases"))


PROPER = "nm AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS k FROM mate_records WHERE flags & 2 > 0), pr AS (SELECT a.name, CASE WHEN a.pos <= b.pos THEN a.ord ELSE b.ord END AS left_ord, CASE WHEN a.pos <= b.pos THEN b.ord ELSE a.ord END AS right_ord, abs(b.pos - a.pos) AS gap, CASE WHEN a.pos <= b.pos THEN a.seq ELSE b.seq END AS ls, CASE WHEN a.pos <= b.pos THEN b.seq ELSE a.seq END AS rs FROM nm a JOIN nm b ON a.name = b.name AND b.k = a.k + 1 AND a.k % 2 = 1 WHERE a.ops = 1 AND b.ops = 1 AND a.mapq >= 10 AND b.mapq >= 10)"
PROPER_SQL = f", {PROPER} SELECT name, left_ord, right_ord FROM pr WHERE substr(ls, (gap + 1)::INT, greatest(0, least(length(ls) - gap, length(rs)))::INT) = substr(rs, 1, greatest(0, least(length(ls) - gap, length(rs)))::INT)"


def mate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.lit("M").alias("op"), F.lit(20).alias("len"))
    return view(spark, sf_dir, "mate_records").withColumn("cigar", F.array_repeat(item, F.col("ops")))


@query(PROPER_SQL, "mate_records")
def proper_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properly paired, wholly matched mates that agree where they overlap."""
    return R.proper_pairs(mate_records(spark, sf_dir), 10)


@query(PROPER_SQL, "mate_records")
def mate_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with keyed state, over files that come in the order of the records."""
    path, rows = scratch_path(spark, "mates"), mate_records(spark, sf_dir)
    most = rows.agg(F.max("ord")).first()[0] or 0
    for i in range(3):
        rows.where((F.col("ord") > i * most / 3) & (F.col("ord") <= (i + 1) * most / 3)).coalesce(2).write.mode("append").parquet(f"{path}/in/{i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in/*")
    sink = mates.proper_pairs(stream, 10).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("name long, left_ord long, right_ord long").parquet(f"{path}/out")


# The sweep read by read: b is the first gene that is left.
SWEEP = "rr AS (SELECT ref, read_id, pos, length(seq) AS len, row_number() OVER (PARTITION BY ref ORDER BY pos, read_id) AS k FROM seq_reads), gg AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY gene_start, gene_id) - 1 AS i FROM sweep_genes), st(ref, k, b) AS (SELECT DISTINCT ref, 0::BIGINT, 0::BIGINT FROM gg UNION ALL SELECT s.ref, s.k + 1, greatest(s.b, coalesce(max(g.i), 0)) FROM st s JOIN rr r ON r.ref = s.ref AND r.k = s.k + 1 LEFT JOIN gg g ON g.ref = s.ref AND g.i >= s.b AND g.gene_end < r.pos AND g.gene_start - 1 <= r.pos + r.len GROUP BY s.ref, s.k, s.b), met AS (SELECT gg.ref, gg.i, gene_id, read_id FROM rr JOIN st ON st.ref = rr.ref AND st.k = rr.k - 1 JOIN gg ON gg.ref = rr.ref AND gg.i >= st.b AND least(pos + len, gene_end) > CASE WHEN pos > gene_start - 1 THEN pos ELSE gene_start - 2 END), fin AS (SELECT ref, max(b) AS b FROM st GROUP BY ref)"


@query(f", {SWEEP} SELECT met.ref, gene_id, count(*) AS reads, sum(read_id)::BIGINT AS ids FROM met JOIN fin USING (ref) WHERE i < b OR met.ref = (SELECT max(ref) FROM fin) GROUP BY met.ref, gene_id", "seq_reads sweep_genes")
def gene_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each gene as a sweep finds them, with what it loses of long genes and at the end of a reference."""
    reads = view(spark, sf_dir, "seq_reads").select("ref", "read_id", "pos", (F.col("pos") + F.length("seq")).alias("end"))
    rows = R.swept(reads, view(spark, sf_dir, "sweep_genes"), 128)
    return rows.groupBy("ref", "gene_id").agg(F.count(F.lit(1)).alias("reads"), F.sum("read_id").cast("long").alias("ids"))


@query(" SELECT ref, gene_id, count(*) AS reads, sum(read_id)::BIGINT AS ids FROM seq_reads JOIN sweep_genes USING (ref) WHERE pos < gene_end AND gene_start - 1 < pos + length(seq) GROUP BY ref, gene_id", "seq_reads sweep_genes")
def gene_sweep_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without losses."""
    reads = view(spark, sf_dir, "seq_reads").select("ref", "read_id", "pos", (F.col("pos") + F.length("seq")).alias("end"))
    rows = R.swept(reads, view(spark, sf_dir, "sweep_genes"), 128, compat=False)
    return rows.groupBy("ref", "gene_id").agg(F.count(F.lit(1)).alias("reads"), F.sum("read_id").cast("long").alias("ids"))


SPANS = "sp AS (SELECT o_orderkey AS read_id, o_custkey % 200 AS acc, (o_orderkey * 7 + 3) % 1009 AS s, 20 + o_orderkey % 60 AS n FROM orders)"


@query(f", {SPANS}, pr AS (SELECT id, seq, coalesce((SELECT string_agg(i % 3 + 1, '' ORDER BY i) FROM range(length(seq)) AS r(i)), '') AS prof FROM sequences WHERE id < 200) SELECT read_id, substr(seq, s + 1, n) AS nucl, substr(prof, s + 1, n) AS profile FROM sp JOIN pr ON id = acc WHERE s + n <= length(seq)", "sequences")
def reference_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and profile under reads that end within their reference, from a store in blocks of 64 letters."""
    size = 64
    own = view(spark, sf_dir, "sequences").select(F.col("id").alias("accession"), "seq")
    store = written(reference.stored(own, size), "reference")
    kinds = own.select("accession", F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0))), lambda i: (i % 3 + 1).cast("string")), "").alias("seq"))
    profile = reference.stored(kinds, size)
    spans = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS read_id", "o_custkey % 200 AS accession", "(o_orderkey * 7 + 3) % 1009 AS start", "(o_orderkey * 7 + 3) % 1009 + 20 + o_orderkey % 60 AS end")
    spans = spans.join(reference.lengths(store, size), "accession").where("end <= length")
    nucl = reference.sliced(store, spans, "read_id", size).withColumnRenamed("text", "nucl")
    return nucl.join(reference.sliced(profile, spans, "read_id", size).withColumnRenamed("text", "profile"), "read_id")


@query(" SELECT pos // 100 AS bucket, count(*) AS n, min(pos) AS first_pos FROM reads WHERE pos >= 300 AND mapq >= 30 AND len >= 60 GROUP BY 1", "reads")
def read_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of enough quality and length from a position on."""
    reads = view(spark, sf_dir, "reads").where("pos >= 300 and mapq >= 30 and len >= 60")
    return reads.groupBy(F.floor(F.col("pos") / 100).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@query(" SELECT count(*) AS n, sum(a.pos)::BIGINT AS sum_pos FROM records a JOIN records b ON a.name = b.name AND a.ord < b.ord AND a.ref = b.ref WHERE greatest(a.pos, b.pos) + 20 <= 200", "records")
def eligible_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments on one reference that end within it."""
    rows = view(spark, sf_dir, "records")
    a, b = rows.select("name", F.col("ord").alias("oa"), F.col("ref").alias("left_ref"), F.col("pos").alias("pa")), rows.select("name", F.col("ord").alias("ob"), F.col("ref").alias("right_ref"), F.col("pos").alias("pb"))
    pairs = a.join(b, "name").where("oa < ob").withColumns({"right_end": F.greatest("pa", "pb") + 20, "genome_length": F.lit(200)})
    return R.eligible(pairs).agg(F.count(F.lit(1)).alias("n"), F.sum("pa").cast("long").alias("sum_pos"))


SUBS = "subs AS (SELECT aln, row, pos, CASE WHEN base_a IN ('A', 'T', 'G', 'C') AND base_b IN ('A', 'T', 'G', 'C') THEN CAST(base_a <> base_b AS INT)::DOUBLE END AS x FROM aligned)"
BOTH = "b2 AS (SELECT a.aln, a.row, a.pos AS pos_a, b.pos AS pos_b, b.pos - a.pos AS lag, a.x AS xa, b.x AS xb FROM subs a JOIN subs b ON a.aln = b.aln AND a.row = b.row AND b.pos >= a.pos AND b.pos - a.pos < 8 WHERE a.x IS NOT NULL AND b.x IS NOT NULL)"


def substitutions(spark: SparkSession, sf_dir: str, wanted: int | None = None) -> DataFrame:
    return X.profile(view(spark, sf_dir, "aligned"), wanted)


@query(f", {SUBS} SELECT count(x) AS n, round(avg(x), 9) AS ks, round(var_samp(x), 9) AS var_ks FROM subs", "aligned")
def ks_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance of substitutions over all known places."""
    return X.ks(substitutions(spark, sf_dir)).select("n", clean(F.col("ks")).alias("ks"), clean(F.col("var_ks")).alias("var_ks"))


@query(f", {SUBS.replace('THEN CAST', 'AND pos_type IN (3, 4) THEN CAST')} SELECT row, count(x) AS known, sum(x)::BIGINT AS differ FROM subs GROUP BY row", "aligned")
def substitution_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known and different third positions of each row."""
    return substitutions(spark, sf_dir, 3).groupBy("row").agg(F.count("x").alias("known"), F.sum("x").cast("long").alias("differ"))


@query(f", {SUBS}, {BOTH} SELECT lag, round(covar_pop(xa, xb), 9) + 0.0 AS ct, round(avg(xa * xb), 9) AS mean_xy, count(*) AS n FROM b2 GROUP BY lag", "aligned")
def sub_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total correlation by lag."""
    return X.total_correlation(substitutions(spark, sf_dir), 8).select("lag", clean(F.col("ct")).alias("ct"), clean(F.col("mean_xy")).alias("mean_xy"), "n")


@query(f", {SUBS}, sz AS (SELECT aln, count(DISTINCT row) AS rows, min(row) AS lead FROM subs GROUP BY aln HAVING count(DISTINCT row) >= 4), ok AS (SELECT s.aln, s.pos FROM subs s JOIN sz USING (aln) GROUP BY s.aln, s.pos HAVING count(s.x) = max(sz.rows) AND count(s.x) FILTER (s.row = sz.lead) = 1), {BOTH.replace('a.x IS NOT NULL', 'a.x IS NOT NULL AND (a.aln, a.pos) IN (SELECT (aln, pos) FROM ok) AND (b.aln, b.pos) IN (SELECT (aln, pos) FROM ok)')}, c AS (SELECT aln, pos_a, pos_b, lag, covar_pop(xa, xb) AS c FROM b2 GROUP BY ALL) SELECT lag, round(avg(c), 9) + 0.0 AS cs, count(*) AS n FROM c GROUP BY lag", "aligned")
def scov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance across the rows of an alignment, averaged by lag."""
    return X.structure_correlation(substitutions(spark, sf_dir), 8).withColumn("cs", clean(F.col("cs")))


@query(f", {SUBS}, {BOTH}, c AS (SELECT aln, row, lag, covar_pop(xa, xb) AS c FROM b2 GROUP BY ALL HAVING count(*) >= 4) SELECT lag, round(avg(c), 9) + 0.0 AS cm, count(*) AS n FROM c GROUP BY lag", "aligned")
def mcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: covariance along each row, averaged by lag."""
    return X.mutation_correlation(substitutions(spark, sf_dir), 8).withColumn("cm", clean(F.col("cm")))


@query(f", {SUBS}, av AS (SELECT aln, pos, avg(x) AS x FROM subs GROUP BY ALL HAVING count(x) = count(*)), c AS (SELECT a.aln, b.pos - a.pos AS lag, covar_pop(a.x, b.x) AS c FROM av a JOIN av b ON a.aln = b.aln AND b.pos >= a.pos AND b.pos - a.pos < 8 GROUP BY ALL HAVING count(*) >= 4) SELECT lag, round(avg(c), 9) + 0.0 AS cr, count(*) AS n FROM c GROUP BY lag", "aligned")
def rcov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of the rows' mean, by lag; an unknown letter makes its place unknown."""
    return X.rate_correlation(substitutions(spark, sf_dir), 8).withColumn("cr", clean(F.col("cr")))


@query(f", {SUBS}, {BOTH}, cm AS (SELECT aln, row, lag, covar_pop(xa, xb) AS c FROM b2 GROUP BY ALL HAVING count(*) >= 4), av AS (SELECT aln, pos, avg(x) AS x FROM subs GROUP BY ALL HAVING count(x) = count(*)), cr AS (SELECT a.aln, b.pos - a.pos AS lag, covar_pop(a.x, b.x) AS c FROM av a JOIN av b ON a.aln = b.aln AND b.pos >= a.pos AND b.pos - a.pos < 8 GROUP BY ALL HAVING count(*) >= 4) SELECT 'Ct' AS kind, lag, round(covar_pop(xa, xb), 9) + 0.0 AS value, count(*) AS n FROM b2 GROUP BY lag UNION ALL SELECT 'Cm', lag, round(avg(c), 9) + 0.0, count(*) FROM cm GROUP BY lag UNION ALL SELECT 'Cr', lag, round(avg(c), 9) + 0.0, count(*) FROM cr GROUP BY lag", "aligned")
def correlation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations chosen by name, as one table."""
    return X.bundle(substitutions(spark, sf_dir), 8, ("Ct", "Cm", "Cr")).withColumn("value", clean(F.col("value")))


DRAWS = "SELECT CAST(l_linenumber AS BIGINT) AS boot, (l_partkey * 13 + l_orderkey) % 50 AS idx FROM {t}"


@query(f", {SUBS}, al AS (SELECT aln AS idx, count(x)::DOUBLE AS m, sum(x) AS s FROM subs GROUP BY aln), dr AS ({DRAWS.format(t='lineitem')}) SELECT boot, sum(m) AS m, round(sum(s) / sum(m), 9) AS ks, count(DISTINCT idx) AS drawn, count(*) AS draws FROM dr JOIN al USING (idx) GROUP BY boot", "aligned")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments resampled by a table of draws; only their sums are resampled."""
    per = substitutions(spark, sf_dir).groupBy(F.col("aln").alias("idx")).agg(F.count("x").cast("double").alias("m"), F.sum("x").alias("s"))
    drawn = spark.sql(DRAWS.format(t="{t}"), t=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    rows = X.bootstrap(per, drawn)
    return rows.groupBy("boot").agg(F.sum("m").alias("m"), clean(F.sum("s") / F.sum("m")).alias("ks"), F.count_distinct("idx").alias("drawn"), F.count(F.lit(1)).alias("draws"))


DRAWN = "dr AS (SELECT boot::INT AS boot, list_sum(list_transform(range(12), lambda i: (strpos('0123456789abcdef', substr(md5(concat(boot, ':', draw, ':1')), i + 1, 1)) - 1) * (1::BIGINT << (4 * (11 - i)))))::BIGINT % (SELECT count(DISTINCT aln) FROM subs) AS idx FROM range(20) AS b(boot), (SELECT range AS draw FROM range((SELECT count(DISTINCT aln) FROM subs))))"
PLACED = "pl AS (SELECT aln, row_number() OVER (ORDER BY aln) - 1 AS idx FROM (SELECT DISTINCT aln FROM subs))"
# Sums of each alignment by kind and lag, as each kind's own statement makes its values.
STATES = (
    "sz AS (SELECT aln, count(DISTINCT row) AS rows, min(row) AS lead FROM subs GROUP BY aln HAVING count(DISTINCT row) >= 4), ok AS (SELECT s.aln, s.pos FROM subs s JOIN sz USING (aln) GROUP BY s.aln, s.pos HAVING count(s.x) = max(sz.rows) AND count(s.x) FILTER (s.row = sz.lead) = 1),"
    " cs AS (SELECT aln, lag, covar_pop(xa, xb) AS c FROM b2 SEMI JOIN ok o ON o.aln = b2.aln AND o.pos = b2.pos_a SEMI JOIN ok p ON p.aln = b2.aln AND p.pos = b2.pos_b GROUP BY aln, pos_a, pos_b, lag),"
    " cm AS (SELECT aln, lag, covar_pop(xa, xb) AS c FROM b2 GROUP BY aln, row, lag HAVING count(*) >= 4),"
    " av AS (SELECT aln, pos, avg(x) AS x FROM subs GROUP BY ALL HAVING count(x) = count(*)), cr AS (SELECT a.aln, b.pos - a.pos AS lag, covar_pop(a.x, b.x) AS c FROM av a JOIN av b ON a.aln = b.aln AND b.pos >= a.pos AND b.pos - a.pos < 8 GROUP BY ALL HAVING count(*) >= 4),"
    " vs AS (SELECT 'Ks' AS kind, aln, 0 AS lag, x AS x, x AS y FROM subs WHERE x IS NOT NULL UNION ALL SELECT 'Ct', aln, lag, xa, xb FROM b2 UNION ALL SELECT 'Cs', aln, lag, c, c FROM cs UNION ALL SELECT 'Cm', aln, lag, c, c FROM cm UNION ALL SELECT 'Cr', aln, lag, c, c FROM cr)"
)
STATISTICS = "round(CASE kind WHEN 'Ct' THEN covar_pop(x, y) ELSE avg(x) END, 9) + 0.0 AS value, CASE WHEN kind <> 'Ct' AND count(*) > 1 THEN round(var_samp(x), 9) + 0.0 END AS var, count(*) AS n"


@query(f", {SUBS}, {BOTH}, {STATES} SELECT kind, lag, {STATISTICS} FROM vs GROUP BY kind, lag", "aligned")
def correlation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ks, Ct, Cs, Cm and Cr of all alignments, merged from the states of each."""
    rows = X.finished(X.merged(X.states(substitutions(spark, sf_dir), 8)))
    return rows.select("kind", "lag", clean(F.col("value")).alias("value"), clean(F.col("var")).alias("var"), "n")


@query(f", {SUBS}, {BOTH}, {STATES}, {PLACED}, {DRAWN} SELECT boot, kind, lag, {STATISTICS} FROM dr JOIN pl USING (idx) JOIN vs USING (aln) GROUP BY boot, kind, lag", "aligned")
def bootstrap_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five kinds over twenty resamples of the alignments, with replacement, by seeded hashes; states are weighted, their rows never drawn."""
    rows = X.finished(X.resampled(X.states(substitutions(spark, sf_dir), 8), "aln", 20))
    return rows.select("boot", "kind", "lag", clean(F.col("value")).alias("value"), clean(F.col("var")).alias("var"), "n")


@query(f", {SUBS}, r2 AS (SELECT a.aln, a.row AS ra, b.row AS rb, count(*) AS places, count(*) FILTER (a.base_a <> b.base_a) AS differ FROM aligned a JOIN aligned b ON a.aln = b.aln AND a.pos = b.pos AND a.row < b.row GROUP BY ALL) SELECT ra, rb, sum(places)::BIGINT AS places, sum(differ)::BIGINT AS differ FROM r2 GROUP BY ALL", "aligned")
def sequence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of rows of an alignment."""
    rows = view(spark, sf_dir, "aligned").select("aln", "row", "pos", "base_a")
    pairs = rows.join(rows.select("aln", F.col("row").alias("rb"), "pos", F.col("base_a").alias("b")), ["aln", "pos"]).where("row < rb")
    return pairs.groupBy(F.col("row").alias("ra"), "rb").agg(F.count(F.lit(1)).alias("places"), F.count(F.when(F.col("base_a") != F.col("b"), 1)).alias("differ"))


@query(" SELECT aln, row, coalesce(min(i) FILTER (base_a <> base_b), count(*))::BIGINT AS prefix, coalesce(min(i) FILTER (base_a <> base_b), count(*)) * 2 >= count(*) AS trusted FROM (SELECT *, row_number() OVER (PARTITION BY aln, row ORDER BY pos) - 1 AS i FROM aligned) GROUP BY ALL", "aligned")
def matching_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a row agrees with its reference, and whether that is half of it."""
    rows = view(spark, sf_dir, "aligned").withColumn("i", F.row_number().over(Window.partitionBy("aln", "row").orderBy("pos")) - 1)
    out = X.matching_prefix(rows.select(F.struct("aln", "row").alias("key"), F.col("i").cast("bigint").alias("i"), F.col("base_a").alias("a"), F.col("base_b").alias("b")))
    return out.select("key.aln", "key.row", "prefix", "trusted")
