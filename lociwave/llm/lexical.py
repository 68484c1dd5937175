"""Ranked lexical search: score-at-a-time over postings in the order of impact.

A term's impact in a document is the whole integer it adds to the score. Each
task lays its documents out in shards of about ``SHARD_POSTINGS`` postings; a
shard keeps, for every term of the queries, the postings by descending impact.
A query takes whole groups of equal impact, highest first, over all of its terms
together and adds them to accumulators. What a document can still gain is at
most the sum of its terms' next impacts; once that is below the k-th score and
nothing but some candidates can be among the k best, the rest of the postings is
left out and the candidates' scores are completed from their documents. A task
carries the k best from shard to shard, as a bound for the next. The result is
exact: where the bounds prove nothing, all postings are scored.

Queries are taken in packs of at most ``PACK_BYTES`` of text (or one longer
query), each pack with a pass over all documents, so that what is broadcast is
bounded however many there are.

Null and empty texts have no terms: such documents count nowhere and such items
give no rows. Very long texts are read whole, with memory for their distinct
terms. Equal scores go by ascending doc_id, a null id last. Repeated rows stay,
documents as documents and items as items. Empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import delete, give_back, list_array, numbered, slices, strings, table, written

TOP = 10
PACK_BYTES = 1 << 24
SHARD_POSTINGS, SHARD_DOCS = 1 << 21, 1 << 17
#: A round takes the groups with at least this share of the greatest impact that is left.
FALL = 0.75
#: Terms: digits, ASCII letters and all beyond ASCII, in UTF-8.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LONG_TEXT = 1 << 20
_NO_ID = np.iinfo(np.int64).max


def term_counts(text: str | None) -> Counter[bytes]:
    """Occurrences of each term; only A-Z are lower-cased."""
    raw = (text or "").encode("utf-8", "replace").lower()
    return Counter(TERM.findall(raw) if len(raw) < _LONG_TEXT else (m.group() for m in TERM.finditer(raw)))


@dataclass
class Queries:
    """A pack: ids of the queries, and for each its terms as numbers with their repeats."""

    items: list
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        found = [term_counts(text) for _, text in rows]
        terms = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in c], np.int64) for c in found]
        return cls([r[0] for r in rows], terms, [np.array(list(c.values()), np.int64) for c in found], vocabulary)


def forward(docs: DataFrame, queries: Queries, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs) of each document with a term: its length in terms, and those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.get
        for big in batches:
            for batch in slices(big, "text"):
                n, terms, tfs = [], [], []
                for text in strings(batch.column("text")):
                    counts = term_counts(text)
                    n.append(sum(counts.values()))
                    own = [(at, c) for t, c in counts.items() if (at := of(t)) is not None]
                    terms.append(np.array([x[0] for x in own], np.int32))
                    tfs.append(np.array([x[1] for x in own], np.int32))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": pa.array(n, pa.int64()), "terms": list_array(terms, pa.int32()), "tfs": list_array(tfs, pa.int32())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class Shard:
    """Documents with their postings by document and, by term, in descending order of impact."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, terms: np.ndarray, impacts: np.ndarray, width: int):
        self.ids, self.first, self.terms, self.impacts = ids, first, terms, impacts
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        order = np.lexsort((-impacts, terms))
        self.by_doc, self.by_impact = doc[order], impacts[order]
        self.heads = np.searchsorted(terms[order], np.arange(width + 1))
        self.sums = np.zeros(len(ids), np.int64)

    def complete(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of the documents from their own terms."""
        size = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        return _grouped(weight[self.terms[at]] * self.impacts[at], size)

    def search(self, terms: np.ndarray, repeats: np.ndarray, weight: np.ndarray, k: int, low: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) among which are all of the k best with at least the score ``low``, and how many postings were added."""
        at, end = self.heads[terms], self.heads[terms + 1]
        live = at < end
        terms, repeats, at, end = terms[live], repeats[live], at[live].copy(), end[live]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        sums, added = self.sums, 0
        sums[:] = 0
        ahead = repeats * self.by_impact[at]
        while True:
            least = max(1, math.ceil(int(ahead.max()) * FALL))
            for i in np.flatnonzero(ahead >= least).tolist():
                own = self.by_impact[at[i] : end[i]]
                n = len(own) - int(np.searchsorted(own[::-1], -(-least // int(repeats[i])), "left"))
                sums[self.by_doc[at[i] : at[i] + n]] += repeats[i] * own[:n]
                at[i] += n
                added += n
                ahead[i] = repeats[i] * self.by_impact[at[i]] if at[i] < end[i] else 0
            left = int(ahead.sum())
            kth = max(low, int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) > k else 0, 1)
            if not left:
                found = np.flatnonzero(sums >= kth)
                return found, sums[found], added
            if left < kth:
                found = np.flatnonzero(sums + left >= kth)
                if len(found) <= k or int((self.first[found + 1] - self.first[found]).sum()) < int((end - at).sum()):
                    score = self.complete(found, weight)
                    return found[score >= kth], score[score >= kth], added


def _grouped(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(size)
    return upto[ends] - upto[ends - size]


class Best:
    """The k best of each query over the shards of a task."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def low(self, q: int) -> int:
        return int(self.scores[q][-1]) if len(self.scores[q]) == self.k else 1

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[first], ids[first]


def search_pack(rows: DataFrame, queries: Queries, n_docs: int, n_terms: int, df: np.ndarray, k: int, item_type: T.DataType) -> DataFrame:
    """(query, item, id, score): the k best of each task's documents, from the forward table."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, weights(df, n_docs)))
    arrow = pa.schema([("query", pa.int64()), ("item", to_arrow_type(item_type)), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w = shared.value
        best = Best(len(queries.items), k)
        weight = np.zeros(len(w), np.int64)
        held: list[tuple] = []
        size = [0, 0]

        def close() -> None:
            ids, n, first, terms, tfs = (np.concatenate([x[i] for x in held]) for i in range(5))
            first = np.concatenate([[0], np.cumsum(first)])
            m = np.repeat(25 + (75 * n * n_docs) // n_terms, np.diff(first))
            tfs = tfs.astype(np.int64)
            shard = Shard(ids, first, terms, w[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m)), len(w))
            for q, (own, repeats) in enumerate(zip(queries.terms, queries.repeats, strict=True)):
                weight[own] = repeats
                found, score, _ = shard.search(own, repeats, weight, k, best.low(q))
                weight[own] = 0
                if len(found):
                    best.add(q, shard.ids[found], score)
            held.clear()
            size[:] = [0, 0]

        for batch in batches:
            terms = batch.column("terms")
            flat = terms.flatten().to_numpy(zero_copy_only=False)
            tfs = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(np.asarray(terms.offsets))
            held.append((batch.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False), lengths, flat, tfs))
            size[0] += len(flat)
            size[1] += len(lengths)
            if size[0] >= SHARD_POSTINGS or size[1] >= SHARD_DOCS:
                close()
        if held:
            close()
        for q in range(0, len(queries.items), 1000):
            own = range(q, min(q + 1000, len(queries.items)))
            ids = np.concatenate([best.ids[i] for i in own])
            counts = [len(best.ids[i]) for i in own]
            items = [queries.items[i] for i, c in zip(own, counts, strict=True) for _ in range(c)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(own), counts)), pa.array(items, arrow.field("item").type), pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([best.scores[i] for i in own]))], schema=arrow)
        give_back()

    return rows.mapInArrow(run, T.StructType([T.StructField("query", T.LongType()), T.StructField("item", item_type), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(item, rank, id, score) of the k documents with the highest scores above 0 for each item."""
    kind = items.schema[item_col].dataType
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("bytes", F.octet_length("text"))
    placed, total = numbered(asked, ["item", "text"], "bytes", "lex-items")
    out = []
    for pack in range(total // pack_bytes + 1):
        queries = Queries.of([(r["item"], r["text"]) for r in placed.where(F.floor(F.col("at") / pack_bytes) == pack).select("item", "text").collect()])
        if not queries.vocabulary:
            continue
        rows = written(forward(docs, queries, id_col, text_col), "lex-forward")
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(queries.vocabulary), np.int64)
        for term, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[term] = n
        best = written(search_pack(rows, queries, n_docs, n_terms, df, k, kind), "lex-best") if n_docs else None
        if best is not None:
            out.append(best.withColumn("pack", F.lit(pack)))
        delete(rows)
    if not out:
        return items.sparkSession.createDataFrame([], T.StructType([T.StructField("item", kind), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("pack", "query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", F.col("rank").cast("int").alias("rank"), "id", "score")


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    found = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT doc_id, r, ws, len(ws)::BIGINT AS n FROM words WHERE len(ws) > 0),
size AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM docs),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
query AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM asked GROUP BY ALL),
posting AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM docs) GROUP BY ALL),
wanted AS (SELECT p.* FROM posting p SEMI JOIN query q ON p.term = q.term),
weight AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM wanted, size GROUP BY term, nd),
impact AS (
  SELECT p.r, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))) AS impact
  FROM wanted p JOIN weight USING (term) JOIN docs USING (r), size),
scores AS (SELECT item_id, r, sum(repeats * impact)::BIGINT AS score FROM query JOIN impact USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
