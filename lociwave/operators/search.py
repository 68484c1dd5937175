"""Search of similar sequences by an inverted index of pieces, exact for its edit identity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def similar(queries: DataFrame, targets: DataFrame, least: int = 80) -> DataFrame:
    """q, s, distance, identity: all pairs of different or equal sequences whose edit identity is at least ``least`` per cent.

    Rows are (id, seq); the identity of a pair is 1 - edits / letters of the longer one.
    Equal sequences are searched once: q and s are the least ids of those that hold
    them. The longer one of a pair allows d edits and is cut into d + 1 pieces, so one
    of them stands whole in the shorter one, behind as many edits at most as there are
    pieces before it, and before as many as there are behind it. A pair meets through
    such pieces (length class, place, letters, as one hash), so no pair is lost, and
    is then held against the edit distance, which is banded by its bound. Null and
    empty sequences have no hits. Pieces are many times their sequences, which sizes
    before the explode don't show: their join is never a broadcast. Frequent pieces
    are split by Spark's skew join.
    """
    if not 0 < least <= 100:
        raise ValueError("least is a percentage")
    off = 100 - least
    step = math.log(100 / least) + 0.001  # Lengths of a similar pair are at most one class apart.
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = lambda n: F.floor(F.log(n) / step)
    width = lambda b: F.floor(off * F.exp((b + 1) * step) / least) + 1
    allowed = lambda n: F.floor(off * n / 100).cast("int")
    met_by = lambda place: F.hash(F.col("class"), place, F.col("text")).alias("piece")

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.where("length(seq) > 0").groupBy("seq").agg(F.min("id").alias("id"))

    def spread(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "id").select("id", "seq", F.length("seq").alias("n"))

    def text(at: Column, size: Column) -> Column:
        return F.substr(F.col("seq"), at + 1, size).alias("text")

    def cut(rows: DataFrame) -> DataFrame:
        """piece, long, l_n, i, l_at: the pieces of each sequence at the places where shorter ones may hold them."""
        rows = spread(rows).withColumn("d", allowed(F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
        size, short = F.floor(F.col("n") / (F.col("d") + 1)).cast("int"), F.col("d") + 1 - F.col("n") % (F.col("d") + 1)
        rows = rows.withColumn("at", F.col("i") * size + F.greatest(F.col("i") - short, F.lit(0)))
        rows = rows.select("id", "n", "i", "d", "at", text(F.col("at"), size + (F.col("i") >= short).cast("int")), F.explode(F.array(bucket(F.col("n")) - 1, bucket(F.col("n")))).alias("class"))
        first, last = F.greatest(F.col("at") - F.col("i"), F.lit(0)), F.col("at") + F.least(F.col("i"), F.col("d") - F.col("i"))
        rows = rows.withColumn("place", F.explode(F.sequence(F.floor(first / width(F.col("class"))), F.floor(last / width(F.col("class"))))))
        return rows.select(met_by(F.col("place")), F.col("id").alias("long"), F.col("n").alias("l_n"), "i", F.col("at").alias("l_at"))

    def windows(rows: DataFrame) -> DataFrame:
        """piece, short, s_n, s_at: each place of a sequence as a piece of every size into which a longer one may be cut."""
        sizes = F.transform(F.sequence(F.col("n"), F.floor(100 * F.col("n") / least).cast("int")), lambda x: F.array(F.floor(x / (allowed(x) + 1)).cast("int"), F.ceil(x / (allowed(x) + 1)).cast("int")))
        rows = spread(rows).withColumn("size", F.explode(F.array_distinct(F.flatten(sizes)))).where("size <= n").withColumn("class", bucket(F.col("n")))
        rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
        rows = rows.select("id", "n", "class", "at", text(F.col("at"), F.col("size")))
        return rows.select(met_by(F.floor(F.col("at") / width(F.col("class")))), F.col("id").alias("short"), F.col("n").alias("s_n"), F.col("at").alias("s_at"))

    def met(longer: DataFrame, shorter: DataFrame) -> DataFrame:
        shift, left = F.col("s_at") - F.col("l_at"), allowed(F.col("l_n")) - F.col("i")
        near = (F.abs(shift) <= F.col("i")) & (F.abs(shift - F.col("s_n") + F.col("l_n")) <= left) & (100 * F.col("s_n") >= least * F.col("l_n"))
        return cut(longer).hint("merge").join(windows(shorter).hint("merge"), "piece").where(near)

    ours, theirs = distinct(queries), distinct(targets)
    pairs = met(ours, theirs).where("l_n >= s_n").select(F.col("long").alias("q"), F.col("short").alias("s"))
    pairs = pairs.unionByName(met(theirs, ours).where("l_n > s_n").select(F.col("short").alias("q"), F.col("long").alias("s"))).distinct()
    both = pairs.join(ours.select(F.col("id").alias("q"), F.col("seq").alias("q_seq")), "q").join(theirs.select(F.col("id").alias("s"), F.col("seq").alias("s_seq")), "s")
    longer = F.greatest(F.length("q_seq"), F.length("s_seq"))
    both = both.withColumn("distance", F.expr(f"levenshtein(q_seq, s_seq, CAST(floor({off} * greatest(length(q_seq), length(s_seq)) / 100) AS INT))")).where("distance >= 0")
    return both.select("q", "s", "distance", (1 - F.col("distance") / longer).alias("identity"))


def top_hits(queries: DataFrame, targets: DataFrame, least: int = 80) -> DataFrame:
    """q, s, distance, identity: each query's most similar target of at least ``least`` per cent, ties to the smaller id; queries without one are left out."""
    found = similar(queries, targets, least)
    best = found.groupBy("q").agg(F.min(F.struct((-F.col("identity")).alias("order"), "s", "distance", "identity")).alias("best"))
    own = queries.where("length(seq) > 0")
    first = own.groupBy("seq").agg(F.min("id").alias("first"))
    kept = first.join(best.withColumnRenamed("q", "first"), "first").select("seq", "best")
    return own.join(kept, "seq").select(F.col("id").alias("q"), "best.s", "best.distance", "best.identity")
