"""Global order without global windows: range partitions, counted apart and added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociwave.sources.scratch import written


def numbered(rows: DataFrame, order: list[str], tag: str = "order") -> tuple[DataFrame, int]:
    """The rows (written) with ``at``, their 0-based place in ``order``, and their number.

    A task counts within its range; the ranges' counts, one number for each, are
    added up on the driver.
    """
    names, number = rows.columns, F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(dealt.select("*", F.shiftright(number, 33).cast("int").alias("__part"), number.bitwiseAND((1 << 33) - 1).alias("__at")), tag)
    before, total = [], 0
    for part, count in sorted((r["__part"], r["count"]) for r in found.groupBy("__part").count().collect()):
        before.append((part, total))
        total += count
    offsets = rows.sparkSession.createDataFrame(before, "__of int, __before long")
    found = found.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
    return found.select(*[f"`{c}`" for c in names], (F.col("__at") + F.col("__before")).alias("at")), total


def runs(rows: DataFrame, order: str, key: str) -> DataFrame:
    """Adds run: the place of the first row of the stretch of equal keys that a row stands in, in the order of all rows.

    A row starts a stretch where the one before it has another key; starts are
    joined back by range, a start for each of its rows' bins.
    """
    placed, total = numbered(rows, [order])
    before = placed.select((F.col("at") + 1).alias("at"), F.col(key).alias("__key"))
    starts = placed.join(before, "at", "left").where(~F.col(key).eqNullSafe(F.col("__key")) | (F.col("at") == 0)).select(F.col("at").alias("run"))
    starts = written(starts, "runs")
    ends, _ = numbered(starts, ["run"])
    ends = ends.select("run", "at").join(ends.select((F.col("at") - 1).alias("at"), F.col("run").alias("next")), "at", "left").select("run", F.coalesce("next", F.lit(total)).alias("next"))
    size = 4096
    bins = ends.select("run", "next", F.explode(F.sequence(F.floor(F.col("run") / size), F.floor((F.col("next") - 1) / size))).alias("bin"))
    met = placed.withColumn("bin", F.floor(F.col("at") / size)).join(bins, "bin").where("at >= run and at < next")
    return met.select(*[f"`{c}`" for c in rows.columns], "run")


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, lags: dict[str, str] | None = None, count: str | None = None) -> DataFrame:
    """The rows (written) with running sums and maxima up to each row, columns of the row before it, and the number of its group's rows.

    Rows are range-partitioned by group and order, so a group of any size is
    spread over tasks. A window covers what a group has in one range; what its
    ranges before hold, a row for each of them, is added.
    """
    sums, tops, lags = sums or {}, tops or {}, lags or {}
    placed = written(rows.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "running")
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = {f"__own_{k}": F.sum(v).over(upto) for k, v in sums.items()} | {f"__own_{k}": F.max(v).over(upto) for k, v in tops.items()}
    own |= {f"__own_{k}": F.lag(v).over(inside) for k, v in lags.items()} | ({"__first": F.row_number().over(inside) == 1} if lags else {})
    parts = [F.sum(v).alias(k) for k, v in sums.items()] + [F.max(v).alias(k) for k, v in tops.items()]
    parts += [F.max(F.struct(*order, F.col(v).alias("__value"))).alias(k) for k, v in lags.items()]
    per = placed.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__rows"), *parts)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(k).over(before).alias(k) for k in sums] + [F.max(k).over(before).alias(k) for k in [*tops, *lags]]
    all_rows = [F.sum("__rows").over(Window.partitionBy(*group)).alias(count)] if count else []
    keys = [*group, "__part"]
    per = per.select(*[F.col(c).alias(f"__key{i}") for i, c in enumerate(keys)], *carried, *all_rows)
    met = placed.withColumns(own).join(per, [F.col(c).eqNullSafe(F.col(f"__key{i}")) for i, c in enumerate(keys)])
    made = [(F.coalesce(f"__own_{k}", F.lit(0)) + F.coalesce(k, F.lit(0))).alias(k) for k in sums]
    made += [F.greatest(f"__own_{k}", k).alias(k) for k in tops]
    made += [F.when(F.col("__first"), F.col(f"{k}.__value")).otherwise(F.col(f"__own_{k}")).alias(k) for k in lags]
    return met.select(*[f"`{c}`" for c in rows.columns], *made, *([count] if count else []))
