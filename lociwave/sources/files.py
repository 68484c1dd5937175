"""Files by byte ranges: listing, opening on executors, ranges dealt to tasks."""

from __future__ import annotations

import fnmatch
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range that one task reads, unless a reader is told otherwise.
RANGE_BYTES = 64 << 20


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a plain path."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def folder(base: str, *parts: str) -> str:
    """A path below another one; a part that is absolute or a URI stands for itself."""
    for part in parts:
        base = part if part.startswith("/") or "://" in part else f"{base.rstrip('/')}/{part}" if part not in ("", ".") else base
    return base


def opened(path: str) -> BinaryIO:
    """A file that can be read from any byte on."""
    system, own = system_of(path)
    return system.open_input_file(own)


def opened_for_writing(path: str) -> BinaryIO:
    """A new file; its folder is made where it is missing."""
    system, own = system_of(path)
    system.create_dir(own.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(own, compression=None)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the data files of a folder, or of those that match a pattern in its last part."""
    system, own = system_of(path)
    head = path[: len(path) - len(own)]
    if "*" in own:
        base, pattern = own.rsplit("/", 1)
        found = [x for x in system.get_file_info(fs.FileSelector(base)) if fnmatch.fnmatch(x.base_name, pattern)]
    else:
        (one,) = system.get_file_info([own])
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [one] if one.is_file else system.get_file_info(fs.FileSelector(own, recursive=True))
    return sorted((head + x.path, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")))


def byte_ranges(spark: SparkSession, path: str | list[str], size: int = RANGE_BYTES) -> DataFrame:
    """file, length, start, stop: every file cut into ranges of ``size`` bytes, dealt over tasks; no file is opened for that."""
    rows = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select(F.col("path").alias("file"), "length").where("length > 0")
    rows = rows.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    rows = rows.withColumn("stop", F.least(F.col("start") + size, F.col("length")))
    return rows.repartition("file", "start")
