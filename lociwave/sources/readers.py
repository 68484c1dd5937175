"""Readers: every input format as a DataFrame; files are opened by Spark on the executors."""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociwave.functions.sequence import pileup_letters
from lociwave.sources.bam import BamSource
from lociwave.sources.files import RANGE_BYTES, byte_ranges, opened
from lociwave.sources.json_stream import objects

PI_SCHEMA = "Genome string, Position int, Pi double, Num int, Alleles map<string,int>"
CORR_SCHEMA = "GeneID string, Results array<struct<Lag:int,Value:double,Count:bigint,Type:string,Variance:double>>, ReadNum int, GeneLen int"
STRAIN_SCHEMA = "Name string, TaxId string, ProjectId string, Path string, GeneticCode string, Species string, Status string, Genomes array<struct<Accession:string,Replicon:string,Length:int,Seq:string,PosProfile:string>>"
RECORD = "struct<Id:string,Name:string,Genome:string,Code:string,Prot:string,Nucl:string,Loc:struct<From:int,To:int,Strand:string>>"
COV_SCHEMA = "Ks double, VarKs double, N int, NReads int, Ct array<double>, CtIndices array<int>, CtN array<int>, MeanXY array<double>, Cm array<double>, CmIndices array<int>, CmN array<int>, Cs array<double>, CsIndices array<int>, CsN array<int>, Cr array<double>, CrIndices array<int>, CrN array<int>"


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else path


def fasta(spark: SparkSession, path: str | list[str], first_only: bool = False) -> DataFrame:
    """file, ord, id, seq; with first_only one record per file, as genome readers take it."""
    rows = spark.read.text(_paths(path), lineSep=">").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), "value").where("trim(value) <> ''")
    rows = rows.select("file", "ord", F.regexp_extract("value", r"^(\S+)", 1).alias("id"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))
    if first_only:
        best = rows.groupBy("file").agg(F.min(F.struct("ord", "id", "seq")).alias("r"))
        rows = best.select("file", "r.ord", "r.id", "r.seq")
    return rows


def position_profile(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, pos (0-based), pos_type: one byte a base, read by ranges of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                with opened(file) as f:
                    f.seek(start)
                    for at in range(start, stop, 1 << 16):
                        kinds = np.frombuffer(f.read(min(1 << 16, stop - at)), np.int8)
                        yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(kinds), pa.string()), "pos": pa.array(np.arange(at, at + len(kinds))), "pos_type": pa.array(kinds)})

    return byte_ranges(spark, path, range_bytes).mapInArrow(run, "file string, pos long, pos_type tinyint")


def cigar_of(text: Column) -> Column:
    """array<struct<op:string,len:int>> of a CIGAR text; '*' is empty."""
    items = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(items, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("len")))


ALIGNMENT = ["read_id", "flags", "ref", "pos", "mapq", "cigar", "mate_ref", "mate_pos", "seq", "qual", "ord"]


def sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of SAM text; positions 0-based, '=' as mate reference resolved, ord in file order."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn("ord", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(f[10]), F.lit(1))), lambda i: F.ascii(F.substr(f[10], i, F.lit(1))) - 33)
    return lines.select(f[0].alias("read_id"), f[1].cast("int").alias("flags"), f[2].alias("ref"), (f[3].cast("int") - 1).alias("pos"), f[4].cast("int").alias("mapq"), cigar_of(f[5]).alias("cigar"), F.when(f[6] == "=", f[2]).otherwise(f[6]).alias("mate_ref"), (f[7].cast("int") - 1).alias("mate_pos"), f[9].alias("seq"), F.when(f[10] == "*", F.array().cast("array<int>")).otherwise(at).alias("qual"), "ord")


def bam(spark: SparkSession, path: str, split_bytes: int = RANGE_BYTES) -> DataFrame:
    """Alignments of BAM files in splits of about ``split_bytes`` (0: a task a file); ord is a record's place in its file."""
    spark.dataSource.register(BamSource)
    return spark.read.format("lociwave_bam").option("splitBytes", split_bytes).load(path)


def alignments(spark: SparkSession, path: str, split_bytes: int = RANGE_BYTES) -> DataFrame:
    """BAM if the path ends in 'bam', else SAM."""
    return (bam(spark, path, split_bytes) if path.endswith("bam") else sam(spark, path)).select(*ALIGNMENT)


def gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """seqname, start, end, strand, id of CDS rows."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) >= 9))
    return rows.where(f[2] == "CDS").select(f[0].alias("seqname"), f[3].cast("int").alias("start"), f[4].cast("int").alias("end"), f[6].alias("strand"), F.regexp_extract(f[8], r"(?:^|;)ID=([^;]*)", 1).alias("id"))


def ptt(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """start, end, strand, length, pid, gene, product of rows whose first column is start..end."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\d+\.\.\d+\t"))
    loc = F.split(f[0], r"\.\.")
    return rows.select(loc[0].cast("int").alias("start"), loc[1].cast("int").alias("end"), f[1].alias("strand"), F.try_element_at(f, F.lit(3)).cast("int").alias("length"), F.try_element_at(f, F.lit(4)).alias("pid"), F.try_element_at(f, F.lit(5)).alias("gene"), F.try_element_at(f, F.lit(9)).alias("product"))


def pileup(spark: SparkSession, path: str | list[str], resolve: bool = True, compat: bool = True, keep_mismatch: bool = False) -> DataFrame:
    """genome, pos (1-based), ref, n, letters, quals; rows without reads go, as do rows whose letters do not match n (unless kept)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f[0].alias("genome"), f[1].cast("int").alias("pos"), f[2].alias("ref"), f[3].cast("int").alias("n"), F.get(f, F.lit(4)).alias("bases"), F.get(f, F.lit(5)).alias("quals")).where("n > 0")
    rows = rows.withColumn("letters", pileup_letters(F.col("bases"), F.col("ref") if resolve else None, compat))
    return (rows if keep_mismatch else rows.where("length(letters) = n and length(quals) = n")).select("genome", "pos", "ref", "n", "letters", "quals")


def diversity_json(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    return objects(spark, path, range_bytes).select(F.from_json("value", PI_SCHEMA).alias("r")).select("r.*")


def correlations_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """gene_id, lag, value, count, type, variance of one or more sample files."""
    rows = objects(spark, path).select(F.from_json("value", CORR_SCHEMA).alias("o")).select("o.*").select(F.col("GeneID").alias("gene_id"), F.explode("Results").alias("r"))
    return rows.select("gene_id", F.col("r.Lag").alias("lag"), F.col("r.Value").alias("value"), F.col("r.Count").alias("count"), F.col("r.Type").alias("type"), F.col("r.Variance").alias("variance"))


def names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value: the first tab column of each line, trimmed; empty lines go."""
    return spark.read.text(path).select(F.trim(F.split("value", "\t")[0]).alias("value")).where("value <> ''")


def strains(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STRAIN_SCHEMA).json(path, multiLine=True)


def species(spark: SparkSession, path: str) -> DataFrame:
    """prefix, path from 'prefix: [a, b]' or a list of '- a' lines below 'prefix:'."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    out, prefix = [], None
    for line in "\n".join(lines).splitlines():
        text = line.split("#")[0].rstrip()
        if text.lstrip().startswith("- ") and prefix:
            out.append((prefix, text.lstrip()[2:].strip().strip("'\"")))
        elif ":" in text:
            prefix, rest = (x.strip() for x in text.split(":", 1))
            out += [(prefix, x.strip().strip("'\"")) for x in rest.strip("[]").split(",") if x.strip()]
    return spark.createDataFrame(out, "prefix string, path string")


def table_text(spark: SparkSession, path: str) -> DataFrame:
    """A tab table with a header, as catalogue files are."""
    return spark.read.csv(path, sep="\t", header=True)


def taxonomy(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """id, parent, rank, name of a taxonomy dump: columns stand between '|', the scientific names are taken."""
    f = F.split("value", r"\s*\|\s*")
    own = spark.read.text(nodes).select(F.trim(f[0]).cast("long").alias("id"), f[1].cast("long").alias("parent"), f[2].alias("rank"))
    called = spark.read.text(names).where(f[3] == "scientific name").select(F.trim(f[0]).cast("long").alias("id"), f[1].alias("name"))
    return own.join(called, "id", "left")


def families(spark: SparkSession, path: str) -> DataFrame:
    """family_id, idx and a record's fields; byte fields are base64. A missing file is an error, as for all readers.

    One array of arrays is a row by its format and numbers its families from 0; of
    a family a line, as ``sinks.families_json`` writes them, no file is held whole
    and the numbers only tell families apart.
    """
    first = spark.read.text(path).where("trim(value) <> ''").head()
    if first is not None and first["value"].lstrip(" [\t").startswith("{") and first["value"].count("[", 0, first["value"].index("{")) == 1:
        lines = spark.read.text(path).where("trim(value) <> ''").withColumn("family_id", F.monotonically_increasing_id())
        rows = lines.select("family_id", F.posexplode(F.from_json("value", f"array<{RECORD}>")).alias("idx", "m"))
    else:
        parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<array<{RECORD}>>").alias("f"))
        rows = parsed.select(F.posexplode("f").alias("family_id", "members")).select("family_id", F.posexplode("members").alias("idx", "m"))
    plain = lambda c: F.decode(F.unbase64(F.col(f"m.{c}")), "UTF-8")
    return rows.select(F.col("family_id").cast("long").alias("family_id"), "idx", F.col("m.Id").alias("id"), F.col("m.Name").alias("name"), F.col("m.Genome").alias("genome"), F.col("m.Code").alias("code"), plain("Prot").alias("prot"), plain("Nucl").alias("nucl"), F.col("m.Loc").alias("loc"))


HIT_FIELDS = ["q", "s", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore"]


def hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tabular hits; '*' is null, ids with '|' give their second part; ord in file order."""
    f = F.split("value", "\t")
    part = lambda i: F.when(f[i].contains("|"), F.split(f[i], r"\|")[1]).otherwise(f[i])
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(F.size(f) >= 12)
    numbers = [f[i].try_cast("double" if i in (2, 10, 11) else "int").alias(HIT_FIELDS[i]) for i in range(2, 12)]
    return rows.select(part(0).alias("q"), part(1).alias("s"), *numbers, "ord")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, member: a tab-separated cluster per line."""
    rows = spark.read.text(path).where("value <> ''").withColumn("cluster_id", F.monotonically_increasing_id())
    return rows.select("cluster_id", F.explode(F.split("value", "\t")).alias("member"))


def archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, member, ord, text of gzipped tar files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with tarfile.open(fileobj=io.BytesIO(data.as_py())) as tar:
                    for i, item in enumerate(x for x in tar if x.isfile()):
                        yield pa.RecordBatch.from_pydict({"file": [file], "member": [item.name], "ord": pa.array([i], pa.int32()), "text": [tar.extractfile(item).read().decode()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, member string, ord int, text string")


def bootstraps(spark: SparkSession, path: str) -> DataFrame:
    """Correlation results, one JSON object a line; plain, gzip, zlib and raw DEFLATE files are told apart by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column("content"):
                data = item.as_py()
                for bits in (31, 15, -15):
                    try:
                        data = zlib.decompress(data, bits)
                        break
                    except zlib.error:
                        continue
                yield pa.RecordBatch.from_pydict({"value": [x for x in data.decode().splitlines() if x]})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")
    return lines.select(F.from_json("value", COV_SCHEMA).alias("c")).select("c.*")


def stale(spark: SparkSession, made: str, source: str) -> bool:
    """Whether a made file is missing, or older than the newest of its sources."""

    def newest(path: str):
        try:
            return spark.read.format("binaryFile").load(path).agg(F.max("modificationTime").alias("t")).first()["t"]
        except AnalysisException:
            return None

    own, other = newest(made), newest(source)
    return own is None or (other is not None and own < other)


def stems(spark: SparkSession, path: str, ending: str = "fna.tgz") -> DataFrame:
    """stem: distinct names of the archives in a folder, up to the first dot."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(path).select("path")
    return rows.select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("stem")).distinct()
