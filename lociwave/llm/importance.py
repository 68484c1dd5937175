"""Importance resampling towards a target distribution over hashed word n-grams.

A scan of a text keeps the zlib crc32 states of the n-grams that began at the
last n - 1 words, extends each by a space and the next word, and begins one more
with that word; every state is the hash of a feature, and its remainder the
feature's bucket. The scan happens once a document: the buckets are written as
bytes, counted for all documents, and read again for the documents' weights.

A bucket's gain is the log of its share in the target over its share in the
documents, with one added count for each bucket. A document's weight is the mean
gain of its features, its score the weight and a Gumbel noise drawn from a hash
of its id; the highest scores are a draw without replacement. Ranks come from one
range-partitioned order of all documents.

Null and empty texts have no features, weigh 0 and are never drawn. Very long
texts are read whole, with memory for their buckets. Equal scores go by ascending
id, a null id last; its noise is that of an id without digits. Repeated rows stay
and count each. With an empty target all gains come from its added counts. Empty
documents give no rows; columns of other names are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, give_back, numbered, slices, strings, table, written

NGRAM = 2
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Words of a lower-cased text: digits, letters and all beyond ASCII, in UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LONG_TEXT = 1 << 20


def states(words: Iterable[bytes], n: int) -> tuple[array, int]:
    """(crc32 of each run of 1 to n words joined by a space, number of words); one pass with a ring of the last starts."""
    out, ring, count = array("I"), [], 0
    for word in words:
        joined = b" " + word
        ring = [crc32(word), *[crc32(joined, state) for state in ring[: n - 1]]]
        out.extend(ring)
        count += 1
    return out, count


def bucketed(text: str | None, n: int, buckets: int) -> tuple[np.ndarray, int]:
    """(bucket of each feature, number of words)."""
    raw = (text or "").encode("utf-8", "replace").lower()
    found, count = states(WORD.findall(raw) if len(raw) < _LONG_TEXT else (m.group() for m in WORD.finditer(raw)), n)
    return (np.frombuffer(found, np.uint32) % np.uint32(buckets)).astype(_kind(buckets)), count


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def features(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(id, words, features) from (id, text); features are the buckets' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                found = [bucketed(x, n, buckets) for x in strings(batch.column("text"))]
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "words": pa.array([c for _, c in found], pa.int64()), "features": pa.array([b.tobytes() for b, _ in found], pa.binary())})

    return texts.mapInArrow(run, "id long, words long, features binary")


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all rows, index of each row's first)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(kind) if data is not None else np.zeros(0, kind), (offsets - offsets[0]) // size


def counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket holds: a task adds up its rows, Spark the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for big in batches:
            for batch in slices(big, "features"):
                total += np.bincount(_flat(batch.column("features"), _kind(buckets))[0], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int64()), "n": pa.array(total[full], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for bucket, n in found.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """1000 times the log of target share over source share, rounded down."""
    n, t, s = len(source), target.astype(float), source.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, words, n_features, weight): the mean gain of each row's features, rounded down."""
    shared = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "features"):
                flat, first = _flat(batch.column("features"), _kind(len(shared.value)))
                upto = np.concatenate([[0], np.cumsum(shared.value[flat])])
                n = np.diff(first)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "words": batch.column("words"), "n_features": pa.array(n, pa.int64()), "weight": pa.array((upto[first[1:]] - upto[first[:-1]]) // np.maximum(n, 1), pa.int64())})
        give_back()

    return found.mapInArrow(run, "id long, words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """1000 times a Gumbel value from a hash of seed and id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, n: int = NGRAM, buckets: int = BUCKETS, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null for those not drawn."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = written(features(own, n, buckets), "imp-features")
    wanted = counts(features(target.select(F.lit(0).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), n, buckets), buckets)
    rows = weighed(found, gains(wanted, counts(found, buckets)))
    rows = rows.select("id", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), (F.col("words") >= least).alias("fit"))
    placed, _ = numbered(rows, [F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features")], tag="imp-order")
    drawn = placed.where("fit").count() * percent // 100
    delete(found)
    return placed.select("id", "n_features", "weight", "score", F.when(F.col("at") < drawn, F.col("at") + 1).cast("long").alias("rank"))


def op12_crc_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the texts of the benchmark."""
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")).withColumnRenamed("id", "doc_id")


#: crc32 is linear: a feature's is the exclusive or of what each byte gives by its distance from the end, and of what the length gives.
OP12_SQL = r"""
WITH RECURSIVE
docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
items AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
own AS (SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM docs),
wanted AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM items),
texts AS (SELECT f, hex(encode(f)) AS h, octet_length(encode(f)) AS n FROM (SELECT f FROM own UNION SELECT f FROM wanted)),
bits(b, s, v) AS (
  SELECT range, 0::BIGINT, CASE WHEN range = 256 THEN 4294967295 ELSE range END FROM range(257)
  UNION ALL SELECT b, s + 1, xor(v >> 1, (v & 1) * 3988292384) FROM bits WHERE s < 8 * (SELECT max(n) FROM texts)),
given AS (SELECT b, s // 8 AS d, v FROM bits WHERE s % 8 = 0),
letters AS (SELECT f, n, h, unnest(range(n)) AS i FROM texts),
bytes AS (SELECT f, n, n - i AS d, 16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1 AS b FROM letters),
parts AS (SELECT f, n, bit_xor(v) AS v FROM bytes JOIN given USING (b, d) GROUP BY f, n),
buckets AS (SELECT f, xor(xor(p.v, g.v), 4294967295) % 10000 AS bucket FROM parts p JOIN given g ON g.b = 256 AND g.d = p.n),
held AS (SELECT r, bucket FROM own JOIN buckets USING (f)),
source AS (SELECT bucket, count(*) AS s FROM held GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM held) AS ss, (SELECT count(*) FROM wanted) AS tt),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g
  FROM source LEFT JOIN target USING (bucket), totals),
weights AS (SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS w FROM held JOIN gain USING (bucket) GROUP BY r),
noise AS (
  SELECT r, doc_id, len(ws) >= 20 AS fit,
    list_sum(list_transform(range(8), lambda i: (strpos('0123456789abcdef', substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), i + 1, 1)) - 1) * (1::BIGINT << (4 * (7 - i)))))::BIGINT AS h
  FROM docs),
scored AS (
  SELECT doc_id, fit, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight, (coalesce(w, 0) + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296))))::BIGINT AS score
  FROM noise LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM scored WHERE fit) THEN place END::BIGINT AS rank FROM placed
"""
