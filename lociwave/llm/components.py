"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each end of an edge (a, b); root is the smallest vertex of its component.

    Each round gives every vertex its smallest neighbour as parent, jumps once,
    and contracts the edges to parents; the number of rounds grows with the
    logarithm of the longest path. All of it stays in tables in the shared folder.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return written(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")

    levels: list[DataFrame] = []
    e = tidy(edges)
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        parent = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("p")), "cc-parents")
        above = maybe_broadcast(parent.select(F.col("v").alias("w"), F.col("p").alias("root")))
        level = written(parent.join(above, F.col("p") == F.col("w")).select("v", "root"), "cc-level")
        levels.append(level)
        own = maybe_broadcast(level)
        e = e.join(own.withColumnsRenamed({"v": "va", "root": "ra"}), F.col("a") == F.col("va")).join(own.withColumnsRenamed({"v": "vb", "root": "rb"}), F.col("b") == F.col("vb"))
        e = tidy(e.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    if not levels:
        return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = levels[0]
    for level in levels[1:]:
        later = maybe_broadcast(level.select(F.col("v").alias("w"), F.col("root").alias("higher")))
        out = out.join(later, F.col("root") == F.col("w"), "left").select("v", F.coalesce("higher", "root").alias("root"))
    return written(out, "cc-roots")
