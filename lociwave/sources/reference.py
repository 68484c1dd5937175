"""A store of references in blocks: no row holds more than a block, and intervals are put together across borders.

A store has the columns accession, block (from 0) and text: ``size`` letters of a
sequence, or of a position profile as one digit a base; the last block is shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociwave.operators.order import running
from lociwave.sources.files import RANGE_BYTES, byte_ranges, opened

BLOCK = 1 << 14


def _pieces(rows: DataFrame, start: Column, text: Column, size: int) -> DataFrame:
    """accession, block, at, piece of rows whose text stands from ``start`` on in its reference."""
    rows = rows.select("accession", start.alias("start"), text.alias("text")).where("length(text) > 0")
    last = F.col("start") + F.length("text") - 1
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))))
    lo, hi = F.greatest(F.col("block") * size, "start"), F.least((F.col("block") + 1) * size, last + 1)
    return rows.select("accession", "block", lo.alias("at"), F.substr("text", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))


def _joined(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the pieces of a key in the order of their places."""
    per = pieces.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return per.select(*keys, F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))


def stored(sequences: DataFrame, size: int = BLOCK) -> DataFrame:
    """The store of (accession, seq)."""
    return _pieces(sequences, F.lit(0).cast("long"), F.col("seq"), size).select("accession", "block", F.col("piece").alias("text"))


def stored_fasta(spark: SparkSession, path: str | list[str], size: int = BLOCK) -> DataFrame:
    """The store of FASTA files, line by line: a sequence of any length is spread over tasks.

    Lines get their record and place by sums that are carried from range to range
    of a file. Accessions are the first words of the header lines; letters before
    the first header are left out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", r"\s+$", "").alias("value"))
    head = F.col("value").startswith(">")
    own = F.when(head, 0).otherwise(F.length("value"))
    rows = running(lines, ["file"], ["ord"], sums={"record": head.cast("long"), "upto": own})
    rows = rows.withColumn("start", F.col("upto") - own)
    names = rows.where(head).select("file", "record", F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("accession"), F.col("upto").alias("base"))
    rows = rows.where(~head).join(names, ["file", "record"])
    return _joined(_pieces(rows, F.col("start") - F.col("base"), F.col("value"), size), ["accession", "block"])


def stored_profile(spark: SparkSession, path: str | list[str], size: int = BLOCK) -> DataFrame:
    """The store of ``.pos`` files, a block a row, read by ranges of bytes; the accession is the file's name without its ending."""
    per = size * max(1, RANGE_BYTES // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                with opened(file) as f:
                    for at in range(start, stop, size):
                        f.seek(at)
                        text = (np.frombuffer(f.read(min(size, stop - at)), np.uint8) + ord("0")).astype(np.uint8).tobytes().decode("latin-1")
                        yield pa.RecordBatch.from_pydict({"file": [file], "block": pa.array([at // size], pa.int64()), "text": [text]})

    rows = byte_ranges(spark, path, per).mapInArrow(run, "file string, block long, text string")
    return rows.select(F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("accession"), "block", "text")


def lengths(store: DataFrame, size: int = BLOCK) -> DataFrame:
    """accession, length: the last block's place and letters."""
    last = store.groupBy("accession").agg(F.max(F.struct("block", F.length("text").alias("n"))).alias("b"))
    return last.select("accession", (F.col("b.block") * size + F.col("b.n")).alias("length"))


def sliced(store: DataFrame, spans: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """key, text: the letters of each span (key, accession, start 0-based, end) that its reference has; spans without any give no row.

    A span is sent to the blocks it touches and its pieces are put together. Keys
    name one span each.
    """
    rows = spans.where(F.col("end") > F.col("start")).select(key, "accession", F.greatest("start", F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end")).where(F.col("end") > F.col("start"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    met = rows.join(store.select("accession", "block", "text", (F.octet_length("text") == F.length("text")).alias("plain")), ["accession", "block"])
    lo, hi = F.greatest(F.col("block") * size, "start"), F.least((F.col("block") + 1) * size, "end")
    # Letters of one byte each are cut as bytes: a text would be gone through from its first letter on for every span.
    cut = lambda text: F.substr(text, (lo - F.col("block") * size + 1).cast("int"), (hi - lo).cast("int"))
    piece = F.when(F.col("plain"), cut(F.col("text").cast("binary")).cast("string")).otherwise(cut(F.col("text")))
    return _joined(met.select(key, lo.alias("at"), piece.alias("piece")).where("piece <> ''"), [key])


def circular(store: DataFrame, spans: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """key, text of spans on circular references; one whose end is not behind its start goes on from the reference's first letter."""
    rows = spans.join(lengths(store, size), "accession")
    whole = F.col("end") > F.col("start")
    first = F.struct(F.lit(0).alias("part"), F.col("start").cast("long").alias("start"), F.when(whole, F.col("end")).otherwise(F.col("length")).cast("long").alias("end"))
    rest = F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    parts = rows.select(key, "accession", F.explode(F.when(whole, F.array(first)).otherwise(F.array(first, rest))).alias("s")).select(F.struct(key, "s.part").alias("k"), "accession", "s.start", "s.end")
    found = sliced(store, parts, "k", size).select(F.col(f"k.{key}").alias(key), F.col("k.part").alias("at"), F.col("text").alias("piece"))
    return _joined(found, [key])
