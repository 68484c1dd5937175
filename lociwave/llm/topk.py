"""Exact top-k search with block-at-a-time pruning over forward indexes.

Vectors become integer weights per term (component). A shard of rows is laid
out so that like rows are neighbours and cut into ranges of ``BLOCK`` rows, each
with its greatest and least weight per term. First each query is searched in one
shard; its k-th score there is a bound that it takes to all shards. A query takes the blocks of a shard
in the order of their bounds (the sum over terms of the greatest product the
block allows), scores whole blocks through their forward index, and stops when
the next bound is below its k-th score, or the one it brought; equal bounds are still scored, so that
ties go to the smaller id. The result is exact whatever the bounds prune.

Rows that repeat id and vector count once; vectors that are null or hold null or
non-finite components and rows without an id take no part; a shorter vector ends
in zeros. Integers whose products could leave 2^53 are computed as Python ints; a
score beyond 63 bits is an error. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, table, written
from .vectors import QUERY_ROWS, SHARD_ROWS, distinct_vectors, packed, ranked, searched, width_of

SCALE = 256
TOP = 5
EVERY = 50
BLOCK = 64
MOST_LONG = (1 << 63) - 1


def laid_out(v: np.ndarray) -> np.ndarray:
    """An order of the rows that puts those nearest to the same pivot together."""
    pivots = v[:: max(1, len(v) // max(1, int(len(v) ** 0.5)))]
    return np.argsort((v @ pivots.T).argmax(1), kind="stable")


def best_of_shard(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, low: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, ids, scores) of each query's k best rows, none below its ``low``, and how many blocks were scored."""
    low = np.full(len(q), -np.inf) if low is None else low
    heads = np.arange(0, len(v), block)
    most, least = np.maximum.reduceat(v, heads, axis=0), np.minimum.reduceat(v, heads, axis=0)
    bound = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    order = np.argsort(-bound, axis=1, kind="stable")
    top = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), MOST_LONG)
    active, at, step, scored = np.arange(len(q)), 0, 1, 0
    while len(active) and at < len(heads):
        mine = order[active, at : at + step]
        wanted = bound[active[:, None], mine] >= np.maximum(top[active, -1], low[active])[:, None]
        for b in np.unique(mine[wanted]):
            rows = active[((mine == b) & wanted).any(1)]
            own, names = v[heads[b] : heads[b] + block], ids[heads[b] : heads[b] + block]
            score = q[rows] @ own.T
            score = np.where(qids[rows, None] == names, -np.inf, score)
            score = np.concatenate([top[rows], score], 1)
            name = np.concatenate([who[rows], np.broadcast_to(names, (len(rows), len(names)))], 1)
            first = np.lexsort((name, -score))[:, :k]
            top[rows], who[rows] = np.take_along_axis(score, first, 1), np.take_along_axis(name, first, 1)
            scored += len(rows)
        at, step = at + step, step * 2
        active = active[bound[active, order[active, at]] >= np.maximum(top[active, -1], low[active])] if at < len(heads) else active[:0]
    found = (top > -np.inf) & (top >= low[:, None])
    return np.repeat(qids, found.sum(1)), who[found], top[found], scored


def exact_ints(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by Python integers, for weights beyond doubles."""
    out = []
    rows = [[int(x) for x in r] for r in v]
    for name, own in zip(qids.tolist(), ([int(x) for x in r] for r in q), strict=True):
        scores = sorted((-sum(a * b for a, b in zip(own, r, strict=True)), i) for i, r in zip(ids.tolist(), rows, strict=True) if i != name)[:k]
        if any(abs(s) > MOST_LONG for s, _ in scores):
            raise OverflowError("a score does not fit into 64 bits")
        out += [(name, i, -s) for s, i in scores]
    return tuple(np.array([x[j] for x in out], np.int64) for j in range(3))


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``queries`` against all rows of ``df``."""
    rows, asks = distinct_vectors(df, id_col, vec_col), distinct_vectors(queries, id_col, vec_col)
    width = width_of(rows.unionByName(asks))

    def forward(ids: np.ndarray, vecs: np.ndarray, *low: np.ndarray) -> dict[str, bytes]:
        w = np.floor(vecs * scale)
        order = laid_out(w) if len(w) else slice(None)
        parts = {"ids": ids[order].astype(np.int64).tobytes(), "w": w[order].tobytes()}
        return parts | ({"low": low[0][order].astype(float).tobytes()} if low else {})

    def one(shard: dict, query: dict) -> dict[str, np.ndarray]:
        ids, qids = np.frombuffer(shard["ids"], np.int64), np.frombuffer(query["ids"], np.int64)
        v, q = np.frombuffer(shard["w"]).reshape(len(ids), width), np.frombuffer(query["w"]).reshape(len(qids), width)
        low = np.frombuffer(query["low"]) if query.get("low") is not None else None
        if np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * max(1, width) >= 2**53:
            a, b, s = exact_ints(ids, v, qids, q, k)
        else:
            a, b, s, _ = best_of_shard(ids, v, qids, q, k, low)
        return {"query_id": a, "vec_id": b, "score": s.astype(np.int64)}

    shards, n = packed(rows, width, SHARD_ROWS, forward, ["ids", "w"])
    shards = written(shards, "topk-shards")
    first = written(packed(asks, width, QUERY_ROWS, forward, ["ids", "w"])[0], "topk-first")
    seeds = searched(shards, n, first, one, "long", each=False).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    # A query id with several vectors has other counts and brings no bound.
    seeds = written(seeds.where(F.col("n") == k).select("query_id", F.col("low").cast("double").alias("low")), "topk-seeds")
    asks = asks.join(maybe_broadcast(seeds), F.col("id") == F.col("query_id"), "left").select("id", "vec", F.coalesce("low", F.lit(float("-inf"))).alias("low"))
    packs = written(packed(asks, width, QUERY_ROWS, forward, ["ids", "w", "low"], ("low",))[0], "topk-queries")
    return ranked(searched(shards, n, packs, one, "long"), k)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows for every fiftieth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
