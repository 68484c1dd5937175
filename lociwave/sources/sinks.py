"""Sinks: results in the layouts that the programs write."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unknown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("NaN"))


def cov_results(rows: DataFrame, kinds: tuple[str, ...] = ("Ct", "Cm", "Cs", "Cr"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Long rows (keys, Ks, VarKs, N, NReads, kind, lag, value, obs) as one object with parallel arrays; none where VarKs is unknown."""
    rows = rows.where("VarKs is not null and not isnan(VarKs)")
    own = [F.sort_array(F.collect_list(F.when((F.col("kind") == k) & F.col("value").isNotNull() & ~F.isnan("value"), F.struct("lag", "value", "obs")))).alias(k) for k in kinds]
    per = rows.groupBy(*keys, "Ks", "VarKs", "N", "NReads").agg(*own)
    fields = [x for k in kinds for x in (F.transform(k, lambda r: r["value"]).alias(k), F.transform(k, lambda r: r["lag"]).alias(f"{k}Indices"), F.transform(k, lambda r: r["obs"]).alias(f"{k}N"))]
    return per.select(*keys, "Ks", "VarKs", "N", "NReads", *fields)


def json_lines(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.json(path, compression="gzip" if compress else "none")


def diversity_json(sites: DataFrame, path: str) -> None:
    """Sites with a known diversity."""
    sites.where("Pi is not null and not isnan(Pi)").write.json(path)


def every_lag(df: DataFrame, maxl: int) -> DataFrame:
    """Rows for all lags below maxl; missing ones hold nulls."""
    lags = df.sparkSession.range(maxl).select(F.col("id").alias("lag"))
    return lags.join(df.withColumn("lag", F.col("lag").cast("long")), "lag", "left")


def tab_table(df: DataFrame, path: str, order: list[str], header: list[str] | None = None) -> None:
    """Tab-separated, sorted; header lines begin with '#'."""
    lines = df.orderBy(*order).select(F.concat_ws("\t", *[_unknown(c) for c in df.columns]).alias("value"))
    if header:
        first = df.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1)
        lines = first.unionByName(lines)
    lines.coalesce(1).write.text(path)


def gene_table(df: DataFrame, path: str) -> None:
    """l,m,v,n,t,g with a header, sorted by gene and lag; the table is a profile, so one file holds it."""
    df.select(F.col("lag").alias("l"), "m", "v", "n", "t", F.col("gene_id").alias("g")).orderBy("g", "t", "l").coalesce(1).write.csv(path, header=True)


def wide_lags(df: DataFrame) -> DataFrame:
    """Lags with a known variance of cr and observations, in 16 columns."""
    names = [f"{s}_{x}" for x in ("cs", "cr", "ct", "xbar", "ybar") for s in ("mean", "var", "n")]
    return df.where("var_cr is not null and not isnan(var_cr) and n_cr > 0").select("lag", *names)


def gene_results(rows: DataFrame) -> DataFrame:
    """Per gene one object with its results in a list."""
    item = F.struct(F.col("lag").cast("int").alias("Lag"), F.col("value").alias("Value"), F.col("count").cast("long").alias("Count"), F.col("type").alias("Type"), F.lit(0.0).alias("Variance"))
    return rows.groupBy(F.col("gene_id").cast("string").alias("GeneID")).agg(F.sort_array(F.collect_list(item)).alias("Results"))


def cluster_lines(clusters: DataFrame, path: str) -> None:
    clusters.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("member")), "\t").alias("value")).select("value").write.text(path)


def families_json(members: DataFrame, path: str) -> None:
    """A line per family: its records in order, byte fields as base64."""
    coded = lambda c: F.base64(F.encode(F.col(c), "UTF-8"))
    record = F.struct("idx", F.struct(F.col("id").alias("Id"), F.col("name").alias("Name"), F.col("genome").alias("Genome"), F.col("code").alias("Code"), coded("prot").alias("Prot"), coded("nucl").alias("Nucl"), F.col("loc").alias("Loc")).alias("r"))
    per = members.groupBy("family_id").agg(F.transform(F.sort_array(F.collect_list(record)), lambda x: x["r"]).alias("m"))
    per.select(F.to_json("m").alias("value")).write.text(path)


def aligned_json(members: DataFrame, folder: str, prefix: str, expanded: bool = False) -> str:
    """Aligned families under the name that tells their prefix and whether genes were expanded; the path."""
    path = f"{folder}/{prefix}{'_expanded' if expanded else ''}_orthologs_aligned.json"
    families_json(members, path)
    return path


def merged_proteins(records: DataFrame, path: str) -> None:
    """The protein records (genome, ord, id, seq) of all scaffolds of a genome behind each other, a folder genome=... each."""
    rows = records.repartitionByRange("genome", "ord").sortWithinPartitions("genome", "ord")
    rows.select("genome", F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value")).write.partitionBy("genome").text(path)


def merged_gene_tables(genes: DataFrame, offsets: DataFrame, path: str) -> None:
    """Gene lines (acc, ord, line 'start..end<tab>...') moved by their scaffold's offset (genome, acc, offset), a folder genome=... each.

    Lines of scaffolds that are not known, of five columns or fewer and without a
    location are left out.
    """
    f = F.split("line", "\t")
    place = lambda i: F.coalesce(F.try_element_at(F.split(f[0], "[.][.]"), F.lit(i)).try_cast("long"), F.lit(0)) + F.col("offset")
    rows = genes.where((F.size(f) > 5) & f[0].contains("..")).join(offsets.select("genome", "acc", "offset"), "acc")
    rows = rows.repartitionByRange("genome", "offset", "ord").sortWithinPartitions("genome", "offset", "ord")
    moved = F.concat_ws("\t", F.concat(place(1).cast("string"), F.lit(".."), place(2).cast("string")), F.slice(f, 2, F.size(f) - 1))
    rows.select("genome", moved.alias("value")).write.partitionBy("genome").text(path)


def merged_scaffolds(records: DataFrame, gap: int = 1000) -> DataFrame:
    """genome, seq: scaffolds (genome, ord, seq) joined in order with ``gap`` N after each."""
    per = records.groupBy("genome").agg(F.sort_array(F.collect_list(F.struct("ord", "seq"))).alias("s"))
    return per.select("genome", F.array_join(F.transform("s", lambda x: F.concat(x["seq"], F.repeat(F.lit("N"), F.lit(gap)))), "").alias("seq"))


def position_profile(sites: DataFrame, folder: str) -> None:
    """A file genome.pos for each genome of (genome, pos 0-based, pos_type): a byte a base, 0 where there is none.

    A genome's places go to one task in order, which writes its file as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else fs.FileSystem.from_uri(folder.replace("file:", "file://", 1)) if folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        own, out, at, path = None, None, 0, ""
        names: list[str] = []

        def close() -> None:
            out.close()
            system.move(path, f"{base}/{own}.pos")
            names.append(own)

        for batch in batches:
            for genome, pos, kind in zip(*(batch.column(c).to_pylist() for c in ("genome", "pos", "pos_type")), strict=True):
                if genome != own:
                    if out is not None:
                        close()
                    own, at, path = genome, 0, f"{base}/{uuid.uuid4().hex}.tmp"
                    out = system.open_output_stream(path, compression=None)
                if pos < at:
                    raise ValueError(f"two types of place {pos} of {genome}")
                out.write(bytes(pos - at) + bytes([kind]))
                at = pos + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"genome": pa.array(names, pa.string())})

    rows = sites.select(F.col("genome").cast("string").alias("genome"), F.col("pos").cast("long").alias("pos"), "pos_type")
    rows.repartition("genome").sortWithinPartitions("genome", "pos").mapInArrow(run, "genome string").count()


def strains_json(rows: DataFrame, path: str) -> None:
    """An array of strains with their genomes (Name, Path, Accession, Length), a strain's rows in the order of accessions."""
    genome = F.sort_array(F.collect_list(F.struct("Accession", "Length")))
    strains = rows.groupBy("Name", "Path").agg(genome.alias("Genomes")).select(F.to_json(F.struct("Name", "Path", "Genomes")).alias("j"))
    # A catalogue of strains is one array by its format.
    strains.agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("j")), ","), F.lit("]")).alias("value")).write.text(path)


def species_lines(rows: DataFrame, path: str) -> None:
    """'prefix: [path, path]' of each species (prefix, path)."""
    per = rows.groupBy("prefix").agg(F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("paths"))
    per.select(F.concat("prefix", F.lit(": ["), "paths", F.lit("]")).alias("value")).write.text(path)


def fit_results(fits: DataFrame, path: str) -> None:
    """A JSON object a fit (strain, kind, b0, b1, b2); unknown parameters are left out."""
    fits.write.json(path)
