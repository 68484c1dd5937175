"""Genomes, orthologs and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociwave.operators.order import running
from lociwave.sources.scratch import delete, written


def best_hits(hits: DataFrame) -> DataFrame:
    """q, s: each query's first hit in file order."""
    return hits.withColumn("__rn", F.row_number().over(Window.partitionBy("q").orderBy("ord", "s"))).where("__rn = 1").select("q", "s")


def reciprocal_best_hits(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """a, b: pairs that are each other's first hit."""
    back = best_hits(backward).select(F.col("q").alias("s"), F.col("s").alias("q"))
    return best_hits(forward).join(back, ["q", "s"]).select(F.col("q").alias("a"), F.col("s").alias("b"))


def family_kind(members: DataFrame, strains: Column) -> DataFrame:
    """family_id, kind: core if the family has a member in each strain, disp if in fewer, pan if in more."""
    per = members.groupBy("family_id").agg(F.count_distinct("genome").alias("genomes"), F.max(strains).alias("__n"))
    return per.select("family_id", "genomes", F.when(F.col("genomes") == F.col("__n"), "core").when(F.col("genomes") < F.col("__n"), "disp").otherwise("pan").alias("kind"))


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, median: the exact median of each group's known values, the mean of the two in the middle if their number is even.

    Equal values are counted first; the counts are added up in the order of values,
    from range to range, and the values at the wanted ranks are picked. No group is
    held or sorted by one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counts, [group], [value], sums={"__upto": F.col("__n")})
    total = upto.groupBy(F.col(group).alias("__group")).agg(F.max("__upto").alias("__all"))
    met = upto.join(total, F.col(group).eqNullSafe(F.col("__group")))
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    holds = lambda r: ((r >= F.col("__upto") - F.col("__n")) & (r < F.col("__upto"))).cast("int")
    picked = met.withColumn("__times", holds(low) + holds(high)).where("__times > 0")
    return picked.groupBy(group).agg((F.sum(F.col(value) * F.col("__times")) / 2).alias("median"))


def without_outliers(members: DataFrame, share: float = 0.1) -> DataFrame:
    """Adds median (whole number), keep and whole (at least three members and none removed)."""
    per = medians(members, "family_id", "len").select(F.col("family_id").alias("__family"), F.floor("median").alias("median"))
    rows = members.join(per, F.col("family_id").eqNullSafe(F.col("__family")), "left").drop("__family")
    rows = written(rows.withColumn("keep", F.abs(F.col("len") - F.col("median")) / F.col("median") <= share), "families")
    whole = rows.groupBy(F.col("family_id").alias("__family")).agg(((F.count(F.lit(1)) >= 3) & F.min("keep")).alias("whole"))
    return rows.join(whole, F.col("family_id").eqNullSafe(F.col("__family"))).drop("__family")


def climbed(taxa: DataFrame, start: DataFrame, rank: str, most: int = 256) -> DataFrame:
    """id, found: the nearest ancestor (or self) of the given rank; null where there is none. A climb beyond ``most`` steps is an error; a taxon above itself is a root."""
    on = "t.rank <> :rank AND t.parent IS NOT NULL AND t.parent <> t.id"
    spark = taxa.sparkSession
    return spark.sql(
        f"""WITH RECURSIVE up(id, at, depth) MAX RECURSION LEVEL {most + 2} AS (
            SELECT id, id AS at, 0 AS depth FROM {{start}}
            UNION ALL
            SELECT up.id, t.parent, up.depth + 1 FROM up JOIN {{taxa}} t ON t.id = up.at WHERE {on} AND up.depth < {most})
        SELECT up.id, max(CASE WHEN t.rank = :rank THEN t.name WHEN up.depth >= {most} AND {on} THEN raise_error('lineage deeper than {most}') END) AS found FROM up JOIN {{taxa}} t ON t.id = up.at GROUP BY up.id""",
        {"rank": rank},
        taxa=taxa,
        start=start,
    )


def scaffold_offsets(scaffolds: DataFrame, group: list[str], gap: int = 1000) -> DataFrame:
    """Adds offset: where a scaffold starts when all are joined with ``gap`` letters after each."""
    w = Window.partitionBy(*group).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return scaffolds.withColumn("offset", F.coalesce(F.sum(F.col("len") + gap).over(w), F.lit(0)).cast("long"))


# The statuses of assemblies that need no joining.
JOINED = ("Complete", "Complete Genome", "Chromosome with gaps", "Gapless Chromosome")


def known_strains(strains: DataFrame, complete: bool = False) -> DataFrame:
    """Strains with a path ('-' is none), a species and at least one replicon; with ``complete`` those whose status says so in any case."""
    rows = strains.where("path <> '-' and species <> '' and replicon is not null")
    return rows.where(F.lower("status").contains("complete")) if complete else rows


def unjoined_strains(strains: DataFrame) -> DataFrame:
    """Strains whose scaffolds are to be joined: their status, without blanks around it, is none of :data:`JOINED`; an unknown one counts as such."""
    return strains.where(~F.coalesce(F.trim("status").isin(*JOINED), F.lit(False)))


def chromosomes(strains: DataFrame) -> DataFrame:
    """Replicons whose name holds 'chromosome', in small letters."""
    return strains.where(F.col("replicon").contains("chromosome"))


def gene_sites(genes: DataFrame) -> DataFrame:
    """Explodes genes (genome, gene_id, ord, start 1-based, end, strand) to sites with place 1, 2, 3 in the codon, from the gene's own start."""
    rows = genes.where("start <= end").withColumn("pos", F.explode(F.sequence("start", "end")))
    j = F.when(F.col("strand") == "-", F.col("end") - F.col("pos")).otherwise(F.col("pos") - F.col("start"))
    return rows.withColumns({"place": (j % 3 + 1).cast("int"), "codon_no": F.floor(j / 3)})


def codon_profile(sites: DataFrame, fourfold: list[str], overlap_undefined: bool) -> DataFrame:
    """genome, pos, pos_type from gene sites with base (reverse strand: the complement).

    Third bases of a fourfold codon are 4. Where genes overlap the later gene wins,
    or, with ``overlap_undefined``, the site is 5.
    """
    w = Window.partitionBy("genome", "gene_id", "codon_no")
    codon = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "base")).over(w)), lambda x: x["base"]), "")
    rows = sites.withColumn("codon", codon)
    kind = F.when((F.col("place") == 3) & F.col("codon").isin(fourfold), 4).otherwise(F.col("place"))
    per = rows.groupBy("genome", "pos").agg(F.max_by(kind, "ord").alias("last"), F.count(F.lit(1)).alias("genes"))
    return per.select("genome", "pos", (F.when(F.col("genes") > 1, 5).otherwise(F.col("last")) if overlap_undefined else F.col("last")).alias("pos_type"))


def expanded(genes: DataFrame, sites: DataFrame) -> DataFrame:
    """genome, gene_id, left, right: how far a gene reaches into the non-coding sites around it on a circular genome.

    From each end the flank goes through non-coding nucleotides up to the next
    coding or invalid site. Sites (genome, pos 0-based, coding, valid, length).
    """
    stop = sites.where("coding or not valid").select("genome", F.explode(F.array(F.col("pos") - F.col("length"), F.col("pos").cast("long"), F.col("pos") + F.col("length"))).alias("pos"))
    marks = stop.select("genome", F.col("pos").alias("at"), F.col("pos").alias("mark"), F.lit(None).cast("string").alias("gene_id"), F.lit(None).cast("string").alias("end"))
    ends = genes.select("genome", "gene_id", F.explode(F.array(F.struct((F.col("start") - 1).cast("long").alias("at"), F.lit("left").alias("end")), F.struct(F.col("end").cast("long").alias("at"), F.lit("right").alias("end")))).alias("e"))
    ends = ends.select("genome", F.col("e.at").alias("at"), F.lit(None).cast("long").alias("mark"), "gene_id", F.col("e.end").alias("end"))
    rows = marks.unionByName(ends).withColumns({"is_mark": F.col("mark").isNotNull().cast("int"), "back": -F.col("at"), "is_end": F.col("mark").isNull().cast("int")})
    # An end comes before a mark at the same place: the left mark is beyond it, the right one may be there. Marks
    # rise with their places, so the last one before is the greatest, and the next one the least of those behind.
    rows = running(rows, ["genome"], ["at", "is_mark"], tops={"before": F.col("mark")})
    rows = running(rows, ["genome"], ["back", "is_end"], tops={"after": -F.col("mark")}).where("gene_id is not null")
    return rows.groupBy("genome", "gene_id").agg(F.max(F.when(F.col("end") == "left", F.col("at") - F.col("before") - 1)).alias("left"), F.max(F.when(F.col("end") == "right", -F.col("after") - F.col("at"))).alias("right"))


def _moves(new: DataFrame, old: DataFrame) -> bool:
    both = new.select("r", "c", F.col("v").alias("now")).join(old, ["r", "c"], "full")
    moved = both.agg(F.max(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)))).alias("d")).first()["d"]
    return moved is not None and moved >= 1e-9


def clusters(edges: DataFrame, inflation: float = 2.0, rounds: int = 100, least: float = 1e-8, slice_rows: int = 1000) -> DataFrame:
    """cluster_id (its least member), member: Markov clusters of the edges (a, b): expand, inflate, prune, until nothing moves.

    The matrices of all components are one table (r, c, v) of the values that are
    not 0, so a step is a join and sums, however large a component is. What still
    moves after ``rounds`` is an error.
    """

    def scaled(cells: DataFrame) -> DataFrame:
        return written(cells.join(cells.groupBy("c").agg(F.sum("v").alias("all")), "c").select("r", "c", (F.col("v") / F.col("all")).alias("v")), "mcl")

    def squared(m: DataFrame) -> DataFrame:
        # A vertex with many edges meets itself in as many slices as its row has thousands of them.
        parts = m.groupBy("r").agg(F.ceil(F.count(F.lit(1)) / slice_rows).alias("parts")).where("parts > 1").select(F.col("r").alias("k"), "parts")
        left = m.select("r", F.col("c").alias("k"), F.col("v").alias("first")).join(parts, "k", "left")
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        right = m.select(F.col("r").alias("k"), "c", F.col("v").alias("second")).join(parts, "k", "left")
        right = right.withColumn("part", F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1)))).drop("parts")
        steps = left.join(right, ["k", "part"])
        return steps.groupBy("r", "c").agg(F.sum(F.col("first") * F.col("second")).alias("v"))

    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))
    m = scaled(edges.select(F.explode(ends).alias("e")).select(F.col("e.a").alias("r"), F.col("e.b").alias("c"), F.lit(1.0).alias("v")).distinct())
    for n in range(rounds):
        grown = written(squared(m).select("r", "c", F.pow("v", F.lit(inflation)).alias("v")).where(F.col("v") >= least), "mcl")
        new = scaled(grown)
        # Every third round tells whether something moves; rounds after the last move change nothing.
        still = n % 3 == 2 and not _moves(new, m)
        delete(grown, m)
        m = new
        if still:
            break
    else:
        raise ValueError(f"clusters still move after {rounds} rounds")
    # Equal values differ by rounding only; the least row of them owns the column.
    best = m.join(m.groupBy("c").agg(F.max("v").alias("most")), "c").where(F.col("v") >= F.col("most") * (1 - 1e-6))
    owner = written(best.groupBy("c").agg(F.min("r").alias("owner")), "mcl")
    named = owner.groupBy("owner").agg(F.min("c").alias("cluster_id"))
    return owner.join(named, "owner").select("cluster_id", F.col("c").alias("member"))
