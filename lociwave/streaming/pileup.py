"""The bounded-lateness pileup as a stateful stream: sites leave once reads start well beyond them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def site_depths(bases: DataFrame, lateness: int = 100) -> DataFrame:
    """window of one site, genome, depth for a stream of (genome, pos, base) in order of position.

    Positions become event time (a second a base), so that the watermark is the
    pileup's lateness bound: state of a site is dropped once it is passed, and a
    base that comes later than that is not counted.
    """
    rows = bases.withColumn("at", F.timestamp_seconds(F.col("pos")))
    per = rows.withWatermark("at", f"{lateness} seconds").groupBy(F.window("at", "1 second"), "genome").agg(F.count(F.lit(1)).alias("depth"))
    return per.select("genome", F.unix_timestamp(F.col("window.start")).alias("pos"), "depth")
