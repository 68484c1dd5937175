"""Vectors packed into rows of many, so that searches work on matrices in bounded tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD_ROWS = 8192
QUERY_ROWS = 256


def usable(vec: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def distinct_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) without unusable vectors, null ids and rows that repeat both."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return written(rows.where(F.col("id").isNotNull() & usable(F.col("vec"))).dropDuplicates(["id", "vec"]), "vectors")


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    if len(flat) == out.size:
        return flat.reshape(out.shape).astype(float)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def packed(rows: DataFrame, width: int, most: int, build: Callable[..., dict[str, bytes]], names: list[str], extra: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(pack, n, *names) with the binary parts that ``build(ids, vectors, *extra)`` makes of about ``most`` rows; how many packs there may be.

    The rows are dealt in turn to as many tasks as packs, which follow from the
    rows alone; a task is a pack and its number the pack's, so nothing is numbered
    over all of them.
    """
    packs = max(1, -(-rows.count() // most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not any(batch.num_rows for batch in held):
            return
        column = lambda c: np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for batch in held])
        parts = build(column("id"), np.concatenate([matrix(batch.column("vec"), width) for batch in held]), *map(column, extra))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sum(batch.num_rows for batch in held)], pa.int32()), *(pa.array([parts[k]], pa.binary()) for k in names)], ["pack", "n", *names])

    return rows.repartition(packs).mapInArrow(run, "pack int, n int, " + ", ".join(f"{k} binary" for k in names)), packs


def searched(shards: DataFrame, n_shards: int, queries: DataFrame, one: Callable[[dict, dict], dict[str, np.ndarray]], score_type: str, each: bool = True) -> DataFrame:
    """query_id, vec_id, score: what ``one`` finds for the packs of queries in the shards.

    A pack goes to every shard (the stated query set against all rows, in blocks),
    or to one of them; it is the queries that are copied, a shard stays whole in a
    task of its own, and the packs pass it one at a time.
    """
    names = [c for c in queries.columns if c != "pack"]
    to = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))) if each else F.pmod(F.xxhash64("pack"), F.lit(n_shards)).cast("int")
    asks = queries.select(to.alias("to"), F.lit(1).alias("kind"), F.col("pack").alias("turn"), *names)
    both = shards.select(F.col("pack").alias("to"), F.lit(0).alias("kind"), F.lit(0).alias("turn"), *[F.col(c) if c in shards.columns else F.lit(None).cast("binary").alias(c) for c in names]).unionByName(asks)
    both = both.repartitionById(n_shards, F.col("to")).sortWithinPartitions("to", "kind", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = None, None
        kind = pa.float64() if score_type == "double" else pa.int64()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["kind"] == 0:
                    own, shard = row["to"], row
                elif row["to"] == own:
                    found = one(shard, row)
                    yield pa.RecordBatch.from_arrays([pa.array(found["query_id"], pa.int64()), pa.array(found["vec_id"], pa.int64()), pa.array(found["score"].tolist(), kind)], ["query_id", "vec_id", "score"])

    return both.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def width_of(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("vec"))).first()[0] or 0
