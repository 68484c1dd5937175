"""Whole runs over a workspace, as the subcommands of the command line: from files to files, all genomes in one job.

A workspace holds reference_strains.json, the species file of the settings and
the folders of the settings. A strain's files are in folders of its path: .fna,
.pos and .ptt of a genome below genome.reference, alignments (ACCESSION.align.sam
or .bam) below out.sam. Results are JSON lines with the columns strain, accession,
function and position beside those of a result, so that one folder holds all of a
run and is read by any of these columns.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociwave.functions import sequence as Q
from lociwave.operators import families as A
from lociwave.operators import fit
from lociwave.operators import fragments as P
from lociwave.operators import genomes as G
from lociwave.operators import substitutions as X
from lociwave.sources import readers, reference, sinks
from lociwave.sources.config import Settings
from lociwave.sources.files import listed, opened
from lociwave.sources.files import folder as joined
from lociwave.sources.scratch import delete, written


def loaded(workspace: str, names: str = "config.yaml") -> str:
    """The text of the comma-separated settings files of a workspace; a later file wins."""
    parts = []
    for name in names.split(","):
        with opened(joined(workspace, name.strip())) as f:
            parts.append(f.read().decode())
    return "\n".join(parts)


def genomes(spark: SparkSession, settings: Settings, workspace: str, chromosomes: bool = False) -> DataFrame:
    """species, strain (path), accession, replicon, genetic_code of the strains that the species file names."""
    rows = readers.strains(spark, joined(workspace, "reference_strains.json"))
    rows = rows.select(F.col("Path").alias("strain"), F.col("GeneticCode").alias("genetic_code"), F.explode("Genomes").alias("g"))
    rows = rows.select("strain", P.accession(F.col("g.Accession")).alias("accession"), F.col("g.Replicon").alias("replicon"), "genetic_code")
    species = readers.species(spark, joined(workspace, settings.species_file)).select(F.col("prefix").alias("species"), F.col("path").alias("strain"))
    rows = species.join(rows, "strain").select("species", "strain", "accession", "replicon", "genetic_code")
    return G.chromosomes(rows) if chromosomes else rows


def present(base: str, rows: DataFrame, endings: tuple[str, ...]) -> list[str]:
    """Files, or folders of part files, base/strain/accession + ending of a catalogue of genomes; a warning for each genome that has none of them.

    A catalogue is a list of names that its own format keeps in one array; a
    strain's folder is listed once.
    """
    found, by_strain = [], {}
    for r in rows.select("strain", "accession").distinct().orderBy("strain", "accession").toLocalIterator():
        by_strain.setdefault(r["strain"], []).append(r["accession"])
    for strain, own in by_strain.items():
        try:
            head = joined(base, strain)
            inside = [path.removeprefix(head.removeprefix("file:") if path.startswith("/") else head).lstrip("/") for path, _ in listed(head)]
            there = {x.split("/", 1)[0]: joined(head, x.split("/", 1)[0]) for x in inside}
        except FileNotFoundError:
            there = {}
        for name in own:
            files = [there[name + e] for e in endings if name + e in there][:1]
            found += files
            if not files:
                warnings.warn(f"{joined(base, strain)}: no {' or '.join(name + e for e in endings)}", stacklevel=2)
    return found


def genome_profile(spark: SparkSession, settings: Settings, workspace: str) -> None:
    """Position profiles: ACCESSION.pos of every genome that has .fna and .ptt, to genome.reference/profiles.

    Genes are laid on the stored blocks of the sequences; a gene whose end is not
    behind its start is left out. Fourfold places follow the standard code.
    """
    base = joined(workspace, settings.genome_reference)
    rows = genomes(spark, settings, workspace)
    sequences, tables = present(base, rows, (".fna",)), present(base, rows, (".ptt",))
    if not sequences or not tables:
        raise FileNotFoundError(f"{base}: no genome with .fna and .ptt")
    named = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.ptt(/|$)", 1)
    text = spark.read.text(tables).select(P.accession(named).alias("genome"), "value")
    parts = F.split("value", "\t")
    loc = F.split(parts[0], r"\.\.")
    genes = text.where(F.col("value").rlike(r"^\d+\.\.\d+\t")).select("genome", loc[0].cast("long").alias("start"), loc[1].cast("long").alias("end"), parts[1].alias("strand"), F.try_element_at(parts, F.lit(4)).alias("gene_id"))
    genes = genes.where("start <= end").withColumn("ord", F.struct("start", "end", "gene_id"))
    store = reference.stored_fasta(spark, sequences)
    store = written(store.withColumn("accession", P.accession(F.col("accession"))), "store")
    spans = genes.select(F.struct("genome", "gene_id", "start", "end").alias("k"), F.col("genome").alias("accession"), (F.col("start") - 1).alias("start"), "end")
    cut = reference.sliced(store, spans, "k").select("k.genome", "k.gene_id", "k.start", "k.end", "text")
    sites = G.gene_sites(genes.join(cut.hint("merge"), ["genome", "gene_id", "start", "end"]))
    plus = F.substr("text", (F.col("pos") - F.col("start") + 1).cast("int"), F.lit(1))
    sites = sites.withColumn("base", F.when(F.col("strand") == "-", Q.reverse_complement(plus)).otherwise(plus))
    kinds = written(G.codon_profile(sites, Q.fourfold(), False).select("genome", (F.col("pos") - 1).alias("pos"), F.col("pos_type").cast("int").alias("pos_type")), "kinds")
    # A profile is as long as its sequence: its last place is there even where it is non-coding.
    last = reference.lengths(store).select(F.col("accession").alias("genome"), (F.col("length") - 1).alias("pos"), F.lit(Q.NON_CODING).alias("pos_type"))
    sinks.position_profile(kinds.unionByName(last.join(kinds.hint("merge"), ["genome", "pos"], "left_anti")), joined(base, "profiles"))
    delete(store, kinds)


def cov_reads(spark: SparkSession, settings: Settings, workspace: str) -> None:
    """Correlations of mated reads, of every chromosome that has alignments, to out.cov/reads; position 4 where none is set.

    Genomes without alignments, functions of other names and results without a
    variance are left out, the first with a warning.
    """
    base, rows = joined(workspace, settings.genome_reference), genomes(spark, settings, workspace, chromosomes=True)
    functions = sorted({P.function_name(x) for x in settings.cov_functions} - {""})
    files = present(joined(workspace, settings.out_sam), rows, (".align.sam", ".align.bam"))
    if not files or not functions:
        raise FileNotFoundError(f"{settings.out_sam}: no alignments" if functions else "no known function in cov.functions")
    own = [readers.sam(spark, x) for x in ([f for f in files if f.endswith("sam")],) if x] + [readers.bam(spark, f) for f in files if f.endswith("bam")]
    records = own[0]
    for other in own[1:]:
        records = records.unionByName(other, allowMissingColumns=True)
    sequences = reference.stored_fasta(spark, present(base, rows, (".fna",)))
    profiles = reference.stored_profile(spark, joined(base, "profiles"))
    size = lambda store: reference.lengths(store.withColumn("accession", P.accession(F.col("accession"))))
    unlike = size(sequences).join(size(profiles).withColumnRenamed("length", "other"), "accession").where("length <> other").select("accession").limit(5).collect()
    if unlike:
        raise ValueError(f"sequence and profile differ in length: {', '.join(r['accession'] for r in unlike)}")
    found = P.covariances(records, sequences, profiles, functions, list(settings.cov_positions) or [4], settings.cov_maxl)
    found = found.join(rows.select("strain", "accession").distinct(), "accession")
    keys = ("strain", "accession", "function", "position")
    sinks.json_lines(sinks.cov_results(found, ("Ct",), keys), joined(workspace, settings.out_cov, "reads"))


def _families(spark: SparkSession, settings: Settings, workspace: str, species: list[str], positions: list[int]) -> DataFrame:
    """species, expanded, family_id, idx, accession, genome, nucl, loc of the aligned families of all species; a warning for a file that is not there."""
    folder, out = joined(workspace, settings.out_ortho), None
    try:
        there = {x.removeprefix(folder.removeprefix("file:")).removeprefix(folder).lstrip("/").split("/", 1)[0] for x, _ in listed(folder)}
    except FileNotFoundError:
        there = set()
    for name in species:
        for expanded in sorted({p == 0 for p in positions}):
            file = f"{name}{'_expanded' if expanded else ''}_orthologs_aligned.json"
            if file not in there:
                warnings.warn(f"{folder}: no {file}", stacklevel=3)
                continue
            rows = readers.families(spark, joined(folder, file)).where("nucl <> ''")
            rows = rows.select(F.lit(name).alias("species"), F.lit(expanded).alias("expanded"), "family_id", "idx", P.accession(F.col("genome")).alias("accession"), "genome", "nucl", "loc")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError(f"{folder}: no aligned families")
    return out


def cov_genomes(spark: SparkSession, settings: Settings, workspace: str) -> None:
    """Correlations of aligned families, of every chromosome, both functions, all positions and core, disp and pan families at once, to out.cov/genomes.

    Families are states that merge (``substitutions.states``), so they are gone
    through once for all three types; resamples are a matter of
    ``substitutions.resampled`` over such states and not made here. Position 4
    where none is set; results without a variance are left out.
    """
    positions = list(settings.cov_positions) or [4]
    base, rows = joined(workspace, settings.genome_reference), genomes(spark, settings, workspace)
    chromosomes = G.chromosomes(rows)
    species = [r["species"] for r in rows.select("species").distinct().orderBy("species").collect()]
    members = written(_families(spark, settings, workspace, species, positions), "members")
    sequences = written(reference.stored_fasta(spark, present(base, chromosomes, (".fna",))), "store")
    profiles = written(reference.stored_profile(spark, joined(base, "profiles")), "store")
    places = A.reference_places(members, chromosomes, sequences, profiles)
    subs = written(A.substitutions(members, places, positions), "subs")
    types = written(A.kinds_of(members, rows.groupBy("species").agg(F.count_distinct("strain").alias("strains"))), "types")
    keys = ["species", "accession", "function", "position", "type"]
    # A kind at a time: the driver plans and compiles all stages of a job at once.
    merged = []
    for part in X.states_by_kind(subs, settings.cov_maxl).values():
        part = part.select("aln.k.*", "aln.function", "aln.position", "kind", "lag", *X.SUMS)
        merged.append(written(X.merged(part.join(types.hint("merge"), A.FAMILY), keys), "states"))
    found = X.finished(reduce(DataFrame.unionByName, merged))
    delete(sequences, profiles, places, subs)
    step = F.when(F.col("position") == 0, 1).otherwise(3)
    kept = found.withColumn("step", step).where((F.col("kind") != "Ks") & (F.col("lag") % F.col("step") == 0) & (F.floor(F.col("lag") / F.col("step")) < F.floor(F.lit(settings.cov_maxl) / F.col("step"))))
    kept = kept.select(*keys, "kind", F.floor(F.col("lag") / F.col("step")).cast("int").alias("lag"), "value", F.col("n").alias("obs"))
    ks = found.where("kind = 'Ks'").select(*keys, F.col("value").alias("Ks"), F.col("var").alias("VarKs"), F.col("n").alias("N"), F.lit(0).alias("NReads"))
    out = kept.join(ks, keys).join(chromosomes.select("species", "strain", "accession").distinct(), ["species", "accession"])
    sinks.json_lines(sinks.cov_results(out, keys=("strain", *keys)), joined(workspace, settings.out_cov, "genomes"))


def fit_reads(spark: SparkSession, settings: Settings, workspace: str) -> None:
    """Curves through the correlations of ``cov_reads``, one for each kind of curve whose range is set, to out.fit/reads."""
    schema = f"strain string, accession string, function string, position int, {readers.COV_SCHEMA}"
    rows = spark.read.schema(schema).json(joined(workspace, settings.out_cov, "reads"))
    keys = ["strain", "accession", "function", "position"]
    points = rows.select(*keys, F.explode(F.arrays_zip("CtIndices", "Ct")).alias("p")).select(*keys, F.col("p.CtIndices").alias("lag"), F.col("p.Ct").alias("value"))
    ranges = {"exp": (settings.fit_exp_start, settings.fit_exp_end), "hyper": (settings.fit_hyper_start, settings.fit_hyper_end)}
    fits = [fit.fitted(points, keys, kind, *r).withColumn("kind", F.lit(kind)) for kind, r in ranges.items() if r[1] > r[0]]
    if not fits:
        raise ValueError("neither fit.exp nor fit.hyper has a range")
    out = fits[0]
    for other in fits[1:]:
        out = out.unionByName(other)
    sinks.fit_results(out, joined(workspace, settings.out_fit, "reads"))


#: Subcommands by name.
FLOWS: dict[str, Callable[[SparkSession, Settings, str], None]] = {"genome_profile": genome_profile, "cov_reads": cov_reads, "cov_genomes": cov_genomes, "fit_reads": fit_reads}
