"""Genomics views over the driver tables: one SQL text per view for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Each view: the driver table it reads and its statement; {table} stands for that table.
VIEWS: dict[str, tuple[str, str]] = {
    "bases": (
        "lineitem",
        "SELECT l_returnflag AS genome, CAST(l_partkey % 40 + 1 AS BIGINT) AS pos, l_orderkey AS read_id, substr('ATGC', CAST((l_suppkey + l_linenumber) % 4 + 1 AS INT), 1) AS base, CAST(floor(l_quantity) AS INT) AS qual, CAST(l_linenumber AS BIGINT) AS ord FROM {table}",
    ),
    "long_bases": (
        "lineitem",
        "SELECT l_returnflag AS genome, CAST(l_partkey AS BIGINT) AS pos, l_orderkey AS read_id, substr('ATGC', CAST((l_suppkey + l_linenumber) % 4 + 1 AS INT), 1) AS base, CAST(floor(l_quantity) AS INT) AS qual FROM {table}",
    ),
    "raw_bases": (
        "lineitem",
        "SELECT l_returnflag AS genome, CAST(l_partkey % 40 + 1 AS BIGINT) AS pos, CASE WHEN l_linenumber % 4 = 1 THEN '.' WHEN l_linenumber % 4 = 2 THEN ',' WHEN l_linenumber = 3 THEN '*' ELSE substr('acgt', CAST(l_suppkey % 4 + 1 AS INT), 1) END AS base, l_orderkey AS read_id FROM {table}",
    ),
    "reads": (
        "orders",
        "SELECT o_orderkey AS read_id, CAST('r' AS STRING) AS ref, o_custkey AS pos, CAST(20 + o_orderkey % 80 AS BIGINT) AS len, CAST(o_orderkey % 60 AS INT) AS mapq FROM {table}",
    ),
    # Reads of ten times ten letters over five references, a read every few places: the axis grows with the reads.
    "seq_reads": (
        "orders",
        "SELECT o_orderkey AS read_id, substr(o_orderpriority, 1, 1) AS ref, CAST(o_orderkey * 3 AS BIGINT) AS pos, CAST(o_orderkey % 60 AS INT) AS mapq, substr(translate(concat(md5(CAST(o_orderkey AS STRING)), md5(CAST(o_orderkey + 7 AS STRING)), md5(CAST(o_orderkey + 9 AS STRING))), '0123456789abcdef', 'ATGCATGCATGCATGN'), 1, CAST(20 + o_orderkey % 60 AS INT)) AS seq, substr(translate(concat(md5(CAST(o_orderkey + 1 AS STRING)), md5(CAST(o_orderkey + 2 AS STRING)), md5(CAST(o_orderkey + 3 AS STRING))), '0123456789abcdef', 'IIIIIIIIIIII+5?I'), 1, CAST(20 + o_orderkey % 60 AS INT)) AS quals FROM {table}",
    ),
    "short_seqs": (
        "orders",
        "SELECT o_orderkey AS id, translate(md5(CAST(o_orderkey AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, translate(md5(CAST(o_orderkey + 5 AS STRING)), '0123456789abcdef', 'ACGTACGT--ACGT-A') AS ref FROM {table}",
    ),
    "codons": (
        "lineitem",
        "SELECT CAST(l_suppkey % 2 AS BIGINT) AS gene_id, CAST(l_partkey % 8 AS BIGINT) AS gene_pos, l_orderkey AS read_id, min(concat(substr('CG', CAST(l_suppkey % 2 + 1 AS INT), 1), substr('TC', CAST(l_partkey % 2 + 1 AS INT), 1), substr('ATGC', CAST(l_linenumber % 4 + 1 AS INT), 1))) AS codon FROM {table} GROUP BY 1, 2, 3",
    ),
    "genes": (
        "supplier",
        "SELECT CAST('r' AS STRING) AS ref, CAST(s_suppkey AS BIGINT) AS gene_id, CAST(s_suppkey * 15 AS BIGINT) AS gene_start, CAST(s_suppkey * 15 + 12 AS BIGINT) AS gene_end, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM {table}",
    ),
    # Long genes with short ones inside, over the references and the axis of seq_reads.
    "sweep_genes": (
        "supplier",
        "SELECT CAST(s_suppkey % 5 + 1 AS STRING) AS ref, CAST(s_suppkey * 10 + k AS BIGINT) AS gene_id, CAST(s_suppkey * 1800 + k * 40 AS BIGINT) AS gene_start, CAST(s_suppkey * 1800 + k * 40 + CASE WHEN k = 0 THEN 2500 ELSE 60 END AS BIGINT) AS gene_end FROM {table} CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)",
    ),
    "hits": (
        "lineitem",
        "SELECT CAST(l_partkey AS BIGINT) AS p, CAST(l_suppkey AS BIGINT) AS s, sum(l_quantity) AS score FROM {table} GROUP BY 1, 2",
    ),
    "taxa": (
        "nation",
        "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(1000 + n_regionkey AS BIGINT) AS parent, 'strain' AS rank, n_name AS name FROM {table}",
    ),
    "higher_taxa": ("region", "SELECT CAST(1000 + r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, 'species' AS rank, r_name AS name FROM {table}"),
    "sequences": (
        "documents",
        "SELECT doc_id AS id, regexp_replace(translate(coalesce(text, ''), 'eiosrnatgcEIOSRN', 'ATGCATATGCATGCAT'), '[^ATGC]', ''{global}) AS seq FROM {table}",
    ),
    "members": (
        "lineitem",
        "SELECT CAST(l_partkey AS BIGINT) AS family_id, CAST(l_suppkey % 6 AS BIGINT) AS genome, CAST(100 + l_orderkey % 40 AS BIGINT) AS len, l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS line FROM {table}",
    ),
    # Alignments: four rows over forty places; a place may be unknown in a row.
    "aligned": (
        "lineitem",
        "SELECT CAST(l_suppkey % 50 AS BIGINT) AS aln, CAST(l_linenumber % 5 AS BIGINT) AS row, CAST(l_partkey % 40 AS BIGINT) AS pos, min(substr('ATGC-', CAST(CASE WHEN l_orderkey % 97 = 0 THEN 5 ELSE l_orderkey % 4 + 1 END AS INT), 1)) AS base_a, max(substr('ATGC', CAST(l_suppkey % 4 + 1 AS INT), 1)) AS base_b, CAST(CASE WHEN l_partkey % 40 % 3 = 2 THEN CASE WHEN l_partkey % 40 % 4 = 0 THEN 4 ELSE 3 END ELSE l_partkey % 40 % 3 + 1 END AS INT) AS pos_type FROM {table} GROUP BY 1, 2, 3, 6",
    ),
    "records": (
        "orders",
        "SELECT CAST(o_custkey AS BIGINT) AS name, CAST(o_orderkey AS BIGINT) AS ord, substr(o_orderpriority, 1, 1) AS ref, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE substr(o_orderpriority, 1, 1) END AS mate_ref, CAST(o_orderkey % 211 AS BIGINT) AS pos, CAST(o_orderkey % 199 AS BIGINT) AS mate_pos FROM {table}",
    ),
    # Records whose mates mostly agree; some are no proper pairs, some have an insertion, some other letters.
    "mate_records": (
        "orders",
        "SELECT CAST(o_custkey AS BIGINT) AS name, CAST(o_orderkey AS BIGINT) AS ord, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 3 END AS INT) AS flags, CAST(o_orderkey % 60 AS INT) AS mapq, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS INT) AS ops, CAST(o_custkey * 3 + o_orderkey % 5 AS BIGINT) AS pos, CASE WHEN o_orderkey % 13 = 0 THEN 'NNNN' ELSE substr(translate(md5(CAST(o_custkey AS STRING)), '0123456789abcdef', 'ATGCATGCATGCATGC'), CAST(1 + o_orderkey % 5 AS INT), 20) END AS seq FROM {table}",
    ),
    # Families of five proteins: each has its family's letters with an insert and a deletion at a place of its own; and queries of the same kind.
    "proteins": ("part", "SELECT id, family_id, genome, concat(substr(b, 1, CAST(k AS INT)), substr('WYVT', 1, CAST(id % 3 AS INT)), substr(b, CAST(k + 1 + id % 4 AS INT))) AS seq FROM (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(floor(p_partkey / 5) AS BIGINT) AS family_id, CAST(p_partkey % 5 AS BIGINT) AS genome, p_partkey * 7 % 50 + 5 AS k, translate(concat(md5(CAST(floor(p_partkey / 5) AS BIGINT)||''), md5(CAST(floor(p_partkey / 5 + 1) AS BIGINT)||'')), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS b FROM {table}) AS t"),
    "query_proteins": ("customer", "SELECT id, family_id, genome, concat(substr(b, 1, CAST(k AS INT)), substr('WYVT', 1, CAST(id % 3 AS INT)), substr(b, CAST(k + 1 + id % 4 AS INT))) AS seq FROM (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(floor(c_custkey / 5) AS BIGINT) AS family_id, CAST(c_custkey % 5 AS BIGINT) AS genome, c_custkey * 7 % 50 + 5 AS k, translate(concat(md5(CAST(floor(c_custkey / 5) AS BIGINT)||''), md5(CAST(floor(c_custkey / 5 + 1) AS BIGINT)||'')), '0123456789abcdef', 'ACDEFGHIKLMNPQRS') AS b FROM {table}) AS t"),
    # Strains with paths, statuses and replicons; some have no path, no species or no genome.
    "strains": (
        "supplier",
        "SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 9 = 0 THEN '-' ELSE concat('strains/', s_name) END AS path, CASE s_suppkey % 6 WHEN 0 THEN 'Complete' WHEN 1 THEN ' Complete Genome ' WHEN 2 THEN 'Chromosome with gaps' WHEN 3 THEN 'Gapless Chromosome' WHEN 4 THEN 'Scaffold' ELSE 'Contig' END AS status, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE concat('species', s_nationkey) END AS species, CASE WHEN s_suppkey % 11 = 0 THEN CAST(NULL AS STRING) WHEN s_suppkey % 4 = 0 THEN 'plasmid p1' ELSE 'chromosome 1' END AS replicon FROM {table}",
    ),
}

# Position types and genes of places are plain functions of the place.
POS_TYPE = "CAST(CASE WHEN {pos} % 3 <> 0 THEN {pos} % 3 WHEN ({pos} / 3) % 4 = 0 THEN 4 ELSE 3 END AS INT)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the columns its statement names are read."""
    source, text = VIEWS[name]
    return spark.sql(text.replace("{global}", "").replace("{table}", "{source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def oracle_views(*names: str) -> str:
    """The same views as the WITH list of a DuckDB statement."""
    return ", ".join(f"{n} AS ({VIEWS[n][1].replace('{global}', ', ' + repr('g')).replace('AS STRING', 'AS VARCHAR').replace('{table}', VIEWS[n][0])})" for n in names)
