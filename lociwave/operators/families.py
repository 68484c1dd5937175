"""Aligned families of genes against the genomes they come from: trusted places of reference records, and substitutions over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociwave.functions import sequence as Q
from lociwave.operators import fragments as P
from lociwave.operators.align import PAIRS
from lociwave.sources import reference
from lociwave.sources.scratch import delete, written

FAMILY = ["species", "expanded", "family_id"]
#: Functions over aligned families by the names of their results.
FUNCTIONS = {"genomes_vs_genome": "reference", "genomes_vs_genomes": "rows"}


def kinds_of(members: DataFrame, strains: DataFrame) -> DataFrame:
    """FAMILY, type: pan for every family, and core where all strains of the species (species, strains) have a record, disp where fewer do."""
    per = members.groupBy(*FAMILY).agg(F.count_distinct("genome").alias("own")).join(strains, "species")
    own = F.when(F.col("own") == F.col("strains"), "core").when(F.col("own") < F.col("strains"), "disp")
    return per.select(*FAMILY, F.explode(F.array_compact(F.array(F.lit("pan"), own))).alias("type"))


def reference_places(members: DataFrame, genomes: DataFrame, sequences: DataFrame, profiles: DataFrame) -> DataFrame:
    """k (FAMILY, accession, idx of a reference record), at (column of the alignment), pos (letter of the record), ref, kind.

    A family's reference records are those of the genomes (species, accession).
    Written. Their letters without gaps are held against the stored sequence at
    their location; places up to the first mismatch count, and a record with fewer than
    half of its aligned length is left out. On the reverse strand the stored
    letters are complemented and turned; a location that wraps around the origin
    is taken as it stands, as the original does.
    """
    refs = members.join(genomes.select("species", "accession").distinct(), ["species", "accession"])
    refs = refs.select(F.struct(*FAMILY, "accession", "idx").alias("k"), "accession", "nucl", F.col("loc.From").cast("long").alias("from"), F.col("loc.To").cast("long").alias("to"), F.col("loc.Strand").alias("strand"))
    letters = F.transform(F.split("nucl", ""), lambda x, i: F.when(Q.is_nucleotide(x), F.struct(i.alias("at"), x.alias("ref"))))
    sites = refs.select("k", F.floor(F.length("nucl") / 2).alias("half"), F.posexplode(F.filter(letters, lambda x: x.isNotNull())).alias("pos", "l")).select("k", "half", "pos", "l.at", "l.ref")
    spans = refs.select("k", "accession", (F.col("from") - 1).alias("start"), F.col("to").alias("end"))
    keyed = lambda store: reference.circular(store.withColumn("accession", P.accession(F.col("accession"))), spans, "k")
    turned = (F.col("strand") == "-") & (F.col("to") > F.col("from") - 1)
    rows = refs.join(keyed(sequences).withColumnRenamed("text", "seq").hint("merge"), "k").join(keyed(profiles).withColumnRenamed("text", "kinds").hint("merge"), "k")
    rows = rows.select("k", F.when(turned, Q.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(turned, F.reverse("kinds")).otherwise(F.col("kinds")).alias("kinds"))
    rows = rows.select("k", F.posexplode(F.arrays_zip(F.split("seq", "").alias("own"), F.split("kinds", "").alias("kind"))).alias("pos", "s"))
    both = written(sites.join(rows.select("k", "pos", "s.own", F.col("s.kind").cast("int").alias("kind")).hint("merge"), ["k", "pos"]), "letters")
    # The first mismatch, or how many places both have.
    last = both.groupBy("k").agg(F.coalesce(F.min(F.when(F.col("own") != F.col("ref"), F.col("pos"))), F.count(F.lit(1))).alias("prefix"))
    places = written(both.join(last.hint("merge"), "k").where("pos < prefix and prefix >= half").select("k", "at", "pos", "ref", "kind"), "places")
    delete(both)
    return places


def substitutions(members: DataFrame, places: DataFrame, positions: list[int]) -> DataFrame:
    """aln (k, function, position), row, pos, x of both functions at the wanted positions: 1 where two letters differ, null where one is no nucleotide.

    Non-coding places (position 0) come from expanded families, the others from
    plain ones. Pairs of a reference's function hold it against records of other
    genomes, those of the other all records against each other.
    """
    wanted = F.array_compact(F.array(*[F.when(F.col("kind").isin(*P._kinds(p)) & (F.col("k.expanded") == F.lit(p == 0)), F.lit(p)) for p in positions]))
    own = places.select(*[F.col(f"k.{c}").alias(c) for c in FAMILY], "at", "k", "pos", "ref", F.explode(wanted).alias("position"))
    rows = members.select(*FAMILY, F.col("idx").alias("row"), F.col("accession").alias("genome"), F.posexplode(F.split("nucl", "")).alias("at", "letter"))
    sites = own.join(rows.hint("merge"), [*FAMILY, "at"]).select(F.struct("k", "position").alias("aln"), "row", "genome", "pos", "letter", "ref", F.col("k.accession").alias("ref_genome")).hint("merge")
    out = None
    for name, pairs in FUNCTIONS.items():
        found = PAIRS[pairs](sites)
        known = Q.is_nucleotide(F.col("x")) & Q.is_nucleotide(F.col("y"))
        aln = F.struct("aln.k", F.lit(name).alias("function"), "aln.position")
        subs = found.select(aln.alias("aln"), F.struct(F.coalesce("a", F.lit(-1)).alias("a"), "b").alias("row"), "pos", F.when(known, (F.col("x") != F.col("y")).cast("double")).alias("x"))
        out = subs if out is None else out.unionByName(subs)
    return out
