"""Mixing sources to target weights by entropy balancing.

A document's rate is ``min(cap, exp(lambda * size / mean size))`` with one dual
variable per source: the distribution nearest to the corpus (in entropy) whose
expected words meet the source's target. Documents of one source and size share
a rate, so the corpus is first counted by (source, size); distributed Newton
iterations on the dual then read these counts only, and the dual variables stay
a table. A dual that has not met its target after ``MOST_ITERATIONS`` is an error.

Rates become whole copies by systematic rounding along one order of all documents
(source, size, hash of the id): each document gets what the running sum of rates
passes in whole numbers. The order is made by range partitions, so a source or a
size that holds a third of all rows is spread over tasks like any other, and the
result depends on the documents alone, not on their number or partitions. A
source's words then stray from its target by less than about one document; up to
``REPAIRS`` single copies are added or taken where that brings it nearer.

Null, empty and very long texts: size 0, taken 0 times, or a size like any other.
A null source is a source of its own, ordered last; repeated rows count each for
itself (which of them gets a copy does not matter); an empty table gives no rows;
input columns with an output's name are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, maybe_broadcast, numbered, table, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
TOLERANCE = 1e-7
MOST_ITERATIONS = 120
REPAIRS = 3
#: Rates are whole multiples of 2^-20, so that running sums are exact and the same in any partitioning.
RATE_BITS = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size): by weight, what is above a source's cap reshared among the others.

    Each round caps the sources that the common level passes and spreads the rest
    over the others; a source once capped stays so.
    """
    rows, _ = numbered(sources, [F.col("source").asc_nulls_last()], tag="mix-order")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    rows = written(rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("most")), "mix-weights")
    level, held = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        found = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("most")).otherwise(0.0)).alias("capped"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("free"), F.count(F.when(above, 1)).alias("n")).first()
        if found["n"] == held or not found["free"]:
            break
        held, level = found["n"], (share * found["all"] - found["capped"]) / found["free"]
    return rows.select("source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"))


def _same(a: DataFrame, b: DataFrame, *keys: str) -> tuple[DataFrame, Column]:
    """b with its keys renamed, and the null-safe condition."""
    b = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"__r_{k}"])
    return b, on


def joined(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """a with the columns of b that has one row for each null-safe key."""
    b, on = _same(a, b, *keys)
    return a.join(b, on).drop(*[f"__r_{k}" for k in keys])


def rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(cap), F.exp(F.least(F.lit(50.0), lam * size / mean))))


def duals(cells: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """source, lam, mean: Newton on the logarithm of each source's words, kept inside a bracket."""
    sources = sources.withColumn("full", F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12)))
    state = sources.select("source", "target", "mean", "full", F.lit(0.0).alias("lam"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"))
    state = written(state.withColumn("lam", F.when(F.col("full"), 1e9).otherwise(0.0)), "mix-dual")
    for _ in range(MOST_ITERATIONS):
        w = rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        words = F.col("size") * F.col("n") * w
        moved = joined(cells, maybe_broadcast(state).where("not full and target > 0"), "source")
        moved = moved.groupBy("source", "target", "mean", "lam", "lo", "hi").agg(F.sum(words).alias("f"), F.sum(F.when(w < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        off = F.abs(F.col("f") - F.col("target")) / F.col("target")
        moved = moved.withColumns({"off": off, "lo": F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))})
        step = F.col("lam") - F.ln(F.col("f") / F.col("target")) * F.try_divide(F.col("f"), F.col("slope"))
        inside = F.coalesce((step > F.col("lo")) & (step < F.col("hi")), F.lit(False))
        far = F.when(F.col("f") < F.col("target"), F.least((F.col("lo") + F.col("hi")) / 2, F.abs(F.col("lam")) * 2 + 1)).otherwise(F.greatest((F.col("lo") + F.col("hi")) / 2, -F.abs(F.col("lam")) * 2 - 1))
        moved = written(moved.select("source", "target", "mean", F.lit(False).alias("full"), F.when(F.col("off") <= TOLERANCE, F.col("lam")).when(inside, step).otherwise(far).alias("lam"), "lo", "hi", "off"), "mix-dual")
        worst = moved.agg(F.max("off")).first()[0]
        before, state = state, written(moved.drop("off").unionByName(state.where("full or target <= 0")), "mix-dual")
        delete(before, moved)
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise ValueError(f"a source is off its target by {worst} of it after {MOST_ITERATIONS} Newton steps")
    return state.select("source", F.when(F.col("target") <= 0, -1e9).otherwise(F.col("lam")).alias("lam"))


def repairs(cells: DataFrame, most: int) -> DataFrame:
    """at, sign: single copies to add or take, from cells (source, size, target, taken, up, down: a row that may get or lose one)."""
    out = []
    for _ in range(REPAIRS):
        lack = cells.groupBy("source").agg((F.max("target") - F.sum(F.col("taken") * F.col("size"))).alias("lack"))
        able = joined(cells, maybe_broadcast(written(lack, "mix-lack")), "source").where("size > 0 and size < 2 * abs(lack)")
        able = able.withColumn("at", F.when(F.col("lack") > 0, F.col("up")).otherwise(F.col("down"))).where("at is not null")
        best = able.groupBy("source").agg(F.min(F.struct(F.abs(F.abs("lack") - F.col("size")).alias("off"), "size", "at", F.signum("lack").cast("long").alias("sign"))).alias("b"))
        best = written(best.select("source", "b.size", "b.at", "b.sign"), "mix-repairs")
        out.append(best.select("at", "sign"))
        # A row is changed once at most: its cell has no other part in later rounds.
        other, on = _same(cells, maybe_broadcast(best.select("source", "size", "sign")), "source", "size")
        gone = F.col("sign").isNotNull()
        cells = cells.join(other, on, "left").select("source", "size", "target", (F.col("taken") + F.coalesce("sign", F.lit(0))).alias("taken"), F.when(~gone, F.col("up")).alias("up"), F.when(~gone, F.col("down")).alias("down"))
        cells = written(cells, "mix-cells")
    return reduce(DataFrame.unionByName, out)


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows with mix_size, mix_source_size, mix_target and mix_copies (input columns of these names are replaced)."""
    own = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    rest = [c for c in df.columns if c not in own]
    most, unit = int(cap), 1 << RATE_BITS
    size = word_count(F.col("text")) if size is None else size
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    rows, total = numbered(rows, ["source", "size", F.xxhash64("id"), "id"], tag="mix-rows")
    if total * most >= 1 << (62 - RATE_BITS):
        raise ValueError("too many rows for exact running sums")
    cells = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")), "mix-counts")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    sources = written(sources, "mix-sources")
    sources = written(joined(sources.select("source", "mean"), targets(sources.select("source", "source_size"), weights, share, cap), "source"), "mix-sources")
    lam = duals(cells, sources, cap)

    cells = joined(joined(cells, maybe_broadcast(sources), "source"), maybe_broadcast(lam), "source")
    cells = cells.withColumn("rate", F.round(rate(F.col("lam"), F.col("size"), F.col("mean"), cap) * unit).cast("long"))
    cells, _ = numbered(cells.select("source", "size", "source_size", "target", "first", "rate", (F.col("n") * F.col("rate")).alias("want")), ["source", "size"], "want", "mix-rates")
    cells = written(cells.withColumnRenamed("at", "before"), "mix-rates")
    dealt = joined(rows, maybe_broadcast(cells), "source", "size")
    upto = F.col("before") + (F.col("at") - F.col("first")) * F.col("rate") + unit // 2
    copies = F.shiftright(upto + F.col("rate"), RATE_BITS) - F.shiftright(upto, RATE_BITS)
    dealt = dealt.withColumn("copies", copies)
    sums = dealt.groupBy("source", "size").agg(F.max("target").alias("target"), F.sum("copies").alias("taken"), F.min(F.when(F.col("copies") < most, F.col("at"))).alias("up"), F.max(F.when(F.col("copies") > 0, F.col("at"))).alias("down"))
    fixes = written(repairs(written(sums, "mix-cells"), most), "mix-repairs").withColumnRenamed("at", "__at")
    dealt = dealt.join(maybe_broadcast(fixes), F.col("at") == F.col("__at"), "left").withColumn("copies", (F.col("copies") + F.coalesce("sign", F.lit(0))).cast("int"))
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in rest], F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    docs = written(docs, "mix-docs")
    mixed = mix(docs, size=F.col("words"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))
