"""Approximate nearest neighbours: multiprobe p-stable hashing.

``TABLES`` hash tables of m functions ``floor((a . v + b) / w)`` with normal ``a`` and
``b`` such that a boundary lies near the rows' mean, so that it divides them; every row is in one bucket of each table, found by the 64-bit key of (table, cells).
m grows with the logarithm of the number of rows, so that buckets go on holding
about ``BUCKET_ROWS`` rows. A query visits its own bucket and perturbed ones, whose
cells are one up or down in some functions: sets of perturbations come from a heap
in the order of their expected cost, and for each query are put into the order of
the estimated probability that a row at the distance of its k-th neighbour lies
there, until these probabilities sum to ``SUCCESS`` in every table; as many sets are made
as that takes. The distance is
measured on ``SAMPLE`` of the queries against all rows.

Buckets are dealt to groups by their key; a bucket of more than ``PART_ROWS`` rows
is split into parts. Rows and probes of a group meet by their keys, candidates of
its tables are merged and ranked by their exact inner product in double precision,
and each group gives at most k rows per query, ranked once more in the end. So a
query's work is its probes and their candidates, and no row meets a query that
does not look for its bucket.

Nearness is the largest inner product. Rows get one more component that gives all
the same norm, queries a zero there, so that the nearest by Euclidean distance, for
which the hashing holds, is the largest inner product.

Rows with the same vector take part as one, with their k + 1 smallest ids: of equal
scores the smaller ids come first, so no other can be in a result. Queries with the
same vector are asked once. Null, unusable and zero vectors and rows without an id
take no part; a shorter vector ends in zeros; rows that repeat id and vector count
once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import list_array, maybe_broadcast, mix64, table, written
from .vectors import distinct_vectors, matrix, width_of

TOP = 20
EVERY = 20
TABLES = 12
BUCKET_ROWS = 16
#: Cell width as a share of the common norm.
CELL = 3.0
SUCCESS = 0.32
#: Perturbation sets considered for a query and table at first; four times as many where these do not reach ``SUCCESS``, and so on.
SETS = 512
#: Numbers of a block of queries by sets.
_AT_ONCE = 1 << 22
SAMPLE = 64
PART_ROWS = 4096
#: At least so many groups, and more where one would have more than ``GROUP_ROWS`` rows.
GROUPS, GROUP_ROWS = 32, 32_768
#: Buckets of more than a part that are named to all tasks; beyond, parts are larger.
MOST_SPLIT = 100_000
SEED = 11


@dataclass
class Hashing:
    """The functions of all tables and the order of perturbation sets; made alike wherever it is made."""

    width: int
    norm: float
    functions: int
    distance: float
    mean: np.ndarray

    def __post_init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(TABLES, self.width + 1, self.functions)) / (CELL * self.norm)
        self.b = rng.uniform(-0.05, 0.05, (TABLES, self.functions)) - self.mean @ self.a
        self.odd = rng.integers(0, 1 << 63, self.functions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.made: dict[int, np.ndarray] = {}

    def sets(self, most: int) -> np.ndarray:
        if most not in self.made:
            self.made[most] = perturbations(self.functions, self.distance / (CELL * self.norm), most)
        return self.made[most]

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(0, self.norm**2 - (v**2).sum(1)))[:, None]], 1)

    def _keys(self, sums: np.ndarray, t: int) -> np.ndarray:
        return mix64(sums + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)

    def row_keys(self, v: np.ndarray) -> np.ndarray:
        """Bucket keys (rows, TABLES) of rows."""
        lifted = self.lifted(v)
        return np.stack([self._keys((np.floor(lifted @ self.a[t] + self.b[t]).astype(np.int64).view(np.uint64) * self.odd).sum(1, dtype=np.uint64), t) for t in range(TABLES)], 1)

    def probes(self, q: np.ndarray) -> list[np.ndarray]:
        """The bucket keys that each query visits, likeliest first in each table."""
        # A query's length doesn't change the order of its answers; the hashing wants the rows' norm.
        unit = q * (self.norm / np.sqrt((q**2).sum(1)))[:, None]
        out: list[list[np.ndarray]] = [[] for _ in q]
        spread = self.distance / (CELL * self.norm)
        for t in range(TABLES):
            p = unit @ self.a[t][:-1] + self.b[t]
            cell = np.floor(p)
            gap = np.concatenate([p - cell, 1 - (p - cell)], 1)
            sign = np.concatenate([np.full(p.shape, -1), np.ones(p.shape, int)], 1)
            nearest = np.argsort(gap, axis=1, kind="stable")
            cost = np.take_along_axis(step_cost(gap, spread), nearest, 1)
            odd = (np.take_along_axis(sign, nearest, 1).astype(np.int64).view(np.uint64)) * np.concatenate([self.odd, self.odd])[nearest]
            stay = np.log(inside(p - cell, spread)).sum(1)
            home = (cell.astype(np.int64).view(np.uint64) * self.odd).sum(1, dtype=np.uint64)
            todo, most = np.arange(len(q)), SETS
            while len(todo):
                sets = self.sets(most)
                step, short = max(1, _AT_ONCE // len(sets)), []
                for start in range(0, len(todo), step):
                    some = todo[start : start + step]
                    total = cost[some] @ sets.T.astype(float)
                    order = np.argsort(total, axis=1, kind="stable")
                    upto = np.cumsum(np.exp(stay[some, None] - np.take_along_axis(total, order, 1)), axis=1)
                    # Sets beyond the last one made are needed only where all of these do not suffice.
                    enough = (upto[:, -1] >= SUCCESS) | (len(sets) < most)
                    visits = 1 + (upto[:, :-1] < SUCCESS).sum(1)
                    for row in np.flatnonzero(enough):
                        i = some[row]
                        moved = (sets[order[row, : visits[row]]].astype(np.uint64) * odd[i]).sum(1, dtype=np.uint64)
                        out[i].append(self._keys(home[i] + moved, t))
                    short.append(some[~enough])
                todo, most = np.concatenate(short), 4 * most
        return [np.unique(np.concatenate(x)) for x in out]


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by a rational approximation (error below 1e-7)."""
    z = np.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    tail = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


def inside(part: np.ndarray, spread: float) -> np.ndarray:
    """Probability that a neighbour of a point at ``part`` of its cell is in the same cell."""
    return np.maximum(normal((1 - part) / spread) - normal(-part / spread), 1e-12)


def step_cost(gap: np.ndarray, spread: float) -> np.ndarray:
    """How much less likely (in logarithms) than its own cell the one beyond a boundary ``gap`` away is."""
    beyond = np.maximum(normal((gap + 1) / spread) - normal(gap / spread), 1e-12)
    return np.log(inside(gap, spread)) - np.log(beyond)


def perturbations(functions: int, spread: float, most: int = SETS) -> np.ndarray:
    """Sets (rows of 0 and 1) of the 2 m steps, nearest boundary first, in the order of expected cost, from a heap.

    Step j and step 2 m - 1 - j are the two of one function and never in one set.
    """
    m = functions
    low = np.arange(1, m + 1) / (2 * (m + 1))
    cost = step_cost(np.concatenate([low, 1 - low[::-1]]), spread)
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < most:
        total, held = heapq.heappop(heap)
        if not any(2 * m - 1 - j in held for j in held):
            out.append(held)
        last = held[-1] + 1
        if last < 2 * m:
            heapq.heappush(heap, (total - cost[held[-1]] + cost[last], (*held[:-1], last)))
            heapq.heappush(heap, (total + cost[last], (*held, last)))
    sets = np.zeros((len(out), 2 * m), np.int8)
    for i, held in enumerate(out):
        sets[i, list(held)] = 1
    return sets


def bytes_of(v: np.ndarray) -> list[bytes]:
    """Each vector as bytes: in single precision where that is exact."""
    small = v.astype("<f4")
    return [a.tobytes() if same else b.tobytes() for a, b, same in zip(small, v.astype("<f8"), (small == v).all(1), strict=True)]


def vectors_of(parts: list[bytes], width: int) -> np.ndarray:
    if all(len(x) == 4 * width for x in parts):
        return np.frombuffer(b"".join(parts), "<f4").reshape(-1, width).astype(float)
    return np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * width else "<f8").astype(float) for x in parts])


def kth_distance(rows: DataFrame, asks: DataFrame, width: int, norm: float, k: int) -> float:
    """The median distance of the k-th neighbour of ``SAMPLE`` queries among all rows, each scaled to the common norm."""
    some = asks.orderBy(F.xxhash64("vec"), "u").limit(SAMPLE).toArrow()
    q = matrix(pa.concat_arrays(some.column("vec").chunks), width) if some.num_rows else np.zeros((0, width))
    if not len(q):
        return norm
    q = q / np.sqrt((q**2).sum(1))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(q), k + 1), -np.inf)
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                score = q @ matrix(batch.column("vec").slice(i, 4096), width).T
                best = -np.sort(-np.concatenate([best, score], 1), 1)[:, : k + 1]
        of, rank = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_pydict({"q": pa.array(of, pa.int64()), "s": pa.array(best[of, rank], pa.float64())})

    order = Window.partitionBy("q").orderBy(F.col("s").desc())
    found = rows.select("vec").mapInArrow(run, "q long, s double").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    last = found.groupBy("q").agg(F.min("s").alias("s")).toPandas()["s"].to_numpy()
    return max(float(np.sqrt(np.maximum(0, 2 * norm**2 - 2 * norm * np.median(last)))), 1e-3 * norm)


def groups_of(keys: np.ndarray, part: np.ndarray, groups: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(groups)).astype(np.int32)


def parts_of(keys: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Into how many parts each key's bucket is split."""
    if not len(hot):
        return np.ones(len(keys), np.int64)
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    return np.where(hot[at] == keys, parts[at], 1)


def best_ids(score: np.ndarray, ids: list[list[int]], k: int) -> tuple[list[int], list[float]]:
    """The k best of rows that stand for several ids each."""
    first = np.array([x[0] for x in ids], np.int64)
    top = np.lexsort((first, -score))[:k]
    pairs = sorted((-score[i], name) for i in top.tolist() for name in ids[i])[:k]
    return [name for _, name in pairs], [-s for s, _ in pairs]


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows found."""
    some = lambda rows: rows.where(F.exists(vec_col, lambda x: x != 0))
    rows, asks = distinct_vectors(some(df), id_col, vec_col), distinct_vectors(some(queries), id_col, vec_col)
    width = width_of(rows.unionByName(asks))
    # One row for each vector, with the ids that may be in a result.
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    rows = written(least.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann-vectors")
    names = asks.groupBy("vec").agg(F.min("id").alias("u"))
    asked = written(names, "ann-queries")
    total = rows.count()
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    norm = float(rows.agg(F.max(F.sqrt(square))).first()[0] or 1.0) * (1 + 1e-9)
    mean = np.zeros(width + 1)
    for r in rows.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        mean[r["i"]] = r["x"] / total
    mean[width] = rows.agg(F.avg(F.sqrt(F.greatest(F.lit(0.0), F.lit(norm**2) - square)))).first()[0] or 0.0
    count = max(1, round(np.log2(max(2, total / BUCKET_ROWS))))
    hashing = Hashing(width, norm, count, kth_distance(rows, asked, width, norm, k), mean)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                v = matrix(part.column("vec"), width)
                yield pa.RecordBatch.from_arrays([part.column("ids"), pa.array(bytes_of(v), pa.binary()), list_array(list(hashing.row_keys(v)), pa.int64())], ["ids", "v", "keys"])

    index = written(rows.select("ids", "vec").mapInArrow(keyed, "ids array<long>, v binary, keys array<long>"), "ann-keys")
    most = max(PART_ROWS, total * TABLES // MOST_SPLIT)
    sizes = index.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).orderBy("key").toPandas()
    hot, parts = sizes["key"].to_numpy(np.int64), -(-sizes["n"].to_numpy(np.int64) // most)
    groups = max(GROUPS, -(-total * TABLES // GROUP_ROWS))
    kind = "g int, kind int, a long, l array<long>, v binary"

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each table: its bucket's key and group."""
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                own = batch.slice(i, 1024)
                keys = own.column("keys").flatten().to_numpy()
                which = pa.array(np.repeat(np.arange(own.num_rows), TABLES))
                first = own.column("ids").flatten().to_numpy()[own.column("ids").offsets.to_numpy()[:-1] - own.column("ids").offsets[0].as_py()].repeat(TABLES)
                part = (mix64(first.view(np.uint64)) % parts_of(keys, hot, parts).astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(groups_of(keys, part, groups)), pa.array(np.zeros(len(keys), np.int32)), pa.array(keys), own.column("ids").take(which), own.column("v").take(which)], ["g", "kind", "a", "l", "v"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each group that a query's probes lead to, with these."""
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                own = batch.slice(i, 128)
                q = matrix(own.column("vec"), width)
                out: tuple[list, ...] = ([], [], [], [])
                for u, data, keys in zip(own.column("u").to_pylist(), bytes_of(q), hashing.probes(q), strict=True):
                    split = parts_of(keys, hot, parts)
                    each = np.repeat(keys, split)
                    part = np.arange(len(each)) - np.repeat(np.cumsum(split) - split, split)
                    g = groups_of(each, part, groups)
                    order = np.argsort(g, kind="stable")
                    for one in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
                        for column, value in zip(out, (g[one[0]], u, np.unique(each[one]), data), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(np.ones(len(out[0]), np.int32)), pa.array(out[1], pa.int64()), list_array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["g", "kind", "a", "l", "v"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets of a group, then its queries one after another."""
        group, keys, ids, data, v = None, [], [], [], None
        for batch in batches:
            found: tuple[list, ...] = ([], [], [])
            for g, is_query, a, l, raw in zip(batch.column("g").to_pylist(), batch.column("kind").to_pylist(), batch.column("a").to_pylist(), batch.column("l"), batch.column("v"), strict=True):
                if g != group:
                    group, keys, ids, data, v = g, [], [], [], None
                if not is_query:
                    keys.append(a)
                    ids.append(l.as_py())
                    data.append(raw.as_py())
                    continue
                if not len(keys):
                    continue
                if v is None:
                    keys, v, data = np.array(keys), vectors_of(data, width), []
                    first = np.array([x[0] for x in ids])
                wanted = l.values.to_numpy()
                lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
                size = hi - lo
                near = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                near = near[np.unique(first[near], return_index=True)[1]]
                if len(near):
                    score = v[near] @ vectors_of([raw.as_py()], width)[0]
                    top = np.argpartition(-score, k)[: k + 1] if len(near) > k + 1 else np.arange(len(near))
                    if len(near) > k + 1:
                        top = np.flatnonzero(score >= score[top].min())
                    who, s = best_ids(score[top], [ids[j] for j in near[top]], k + 1)
                    found[0].extend([a] * len(who))
                    found[1].extend(who)
                    found[2].extend(s)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["u", "vec_id", "score"])

    both = index.mapInArrow(dealt, kind).unionByName(asked.mapInArrow(probing, kind))
    both = both.repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind", "a")
    found = both.mapInArrow(met, "u long, vec_id long, score double").groupBy("u", "vec_id").agg(F.max("score").alias("score"))
    order = F.col("score").desc(), F.col("vec_id")
    found = written(found.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(*order))).where(F.col("r") <= k + 1).drop("r"), "ann-found")
    # Each query of a vector, without itself.
    each = asks.join(maybe_broadcast(asked), "vec").select(F.col("id").alias("query_id"), "u").join(maybe_broadcast(found), "u").where("vec_id <> query_id")
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("int"))
    return each.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest rows found for every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))
