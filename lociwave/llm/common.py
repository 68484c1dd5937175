"""Shared helpers: scratch tables, files in the shared folder, text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a broadcast side may have; the row width is fixed where this is used.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none (local tests) a temporary one is set.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lociwave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/lociwave/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(*tables: DataFrame) -> None:
    """Remove the files of tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that Spark drops the shuffle files of steps whose results are written and reread.

    What a plan held is free after a first round only, and files are dropped in the background.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A hint for a written table only after its rows were counted; beyond the bound Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if df.count() <= most else df


def numbered(rows: DataFrame, order: list[str | Column], weight: str | None = None, tag: str = "numbered") -> tuple[DataFrame, int]:
    """The rows (written) with ``at``, the sum of ``weight`` (1 each if none) over all rows before them in ``order``, and the total.

    Rows are range-partitioned by the order, and a task counts within its range
    only; the ranges' sums, one number for each of them, are added up on the
    driver. No window or key holds more than a range, whatever the skew.
    """
    names = rows.columns
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    if weight is None:
        number = F.monotonically_increasing_id()
        found = dealt.select("*", F.shiftright(number, 33).cast("int").alias("__part"), number.bitwiseAND((1 << 33) - 1).alias("__at"), F.lit(1).cast("long").alias("__w"))
    else:
        dealt = dealt.select("*", F.spark_partition_id().alias("__part"), F.col(weight).cast("long").alias("__w"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                own = batch.column("__w").to_numpy(zero_copy_only=False)
                upto = total + np.cumsum(own)
                yield batch.append_column("__at", pa.array(upto - own, pa.int64()))
                total = int(upto[-1]) if len(upto) else total

        found = dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("__at", T.LongType())]))
    found = written(found, tag)
    sums = sorted((r["__part"], r["s"]) for r in found.groupBy("__part").agg(F.sum("__w").alias("s")).collect())
    before, total = [], 0
    for part, own in sums:
        before.append((part, total))
        total += own
    offsets = rows.sparkSession.createDataFrame(before, "__of int, __before long")
    found = found.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
    return found.select(*[f"`{c}`" for c in names], (F.col("__at") + F.col("__before")).alias("at")), total


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod4(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod4(doc_id) == 2, F.lit(False))


def file_system(path: str):
    """(file system, path in it) for a URI or a plain path; works on executors."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def strings(column: pa.Array) -> list[str | None]:
    """Texts of an Arrow column; bytes that are not UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.binary()).to_pylist()
        return [None if x is None else x.decode("utf-8", "replace") for x in raw]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut so that a piece holds about ``most`` bytes of ``column`` (one row at least)."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        stop = min(stop, start + 2000, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: Python workers are kept and would hold their peak through later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x
