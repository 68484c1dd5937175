"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE_WORDS`` words. Every passage becomes a
vector: the shares of its words by hash bucket, so that the encoder learns an
embedding for each bucket and takes their mean, and the shares of bytes of each
kind, repeated and distinct words and word shapes. A learned layer encodes it, a
learned gate gives it an attention weight, and the weighted sum of the encoded
passages is scored. Only documents carry labels: the gradient of the document's
loss reaches the passages through the attention.

The fit reads a bounded sample of labelled documents, in the order of a hash of
the id, with whole texts: at most ``TRAIN_DOCS`` documents that together have at
most ``TRAIN_PASSAGES`` passages; a text for which there is no room any more is
left out, and those behind it are still taken. Labels none of whose texts fit are
an error. Scoring reads whole texts of all
rows, a bounded piece of a batch (or one longer text) at a time.

Null and empty texts are one empty passage and are scored as such; a very long
text is many passages. Documents without a label are scored alike. Repeated labels
of a document count once, the smallest; with no label to learn from every score is
0.5, with one class only it is that class. An empty table gives no rows; repeated
rows stay; input columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table, written
from .textkernel import hashes, raw, spans

PASSAGE_WORDS = 100
TRAIN_DOCS, TRAIN_PASSAGES = 3_000, 60_000
THRESHOLD = 0.7
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY, SEED = 200, 0.03, 3e-4, 7
#: Hash buckets of words with an embedding each.
BUCKETS = 256

# Kinds of bytes: each ASCII mark for itself, the rest in groups.
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_KIND = np.zeros(256, np.int64)
for _i, _b in enumerate(_MARKS):
    _KIND[_b] = 7 + _i
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[0x80:] = 4
_KIND[0x20] = 5
_KIND[0x09:0x0E] = 6
KINDS = 7 + len(_MARKS)
SHAPES = KINDS + 9
FEATURES = SHAPES + BUCKETS


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of the passages of all texts, index of each text's first passage)."""
    data, offsets = raw(column)
    starts, ends, first_word = spans(data, offsets)
    n_words = np.diff(first_word)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n_pass)])
    x = np.zeros((first[-1], FEATURES), np.float32)
    if not len(starts):
        return x, first
    text = np.repeat(np.arange(len(n_words)), n_words)
    own = first[text] + (np.arange(len(starts)) - first_word[text]) // PASSAGE_WORDS
    head = np.flatnonzero(np.diff(own, prepend=-1))
    where = own[head]
    count = np.diff(np.append(head, len(own)))
    # Bytes from one passage's first word to the next one's, within the text.
    lo = starts[head]
    hi = np.minimum(np.append(lo[1:], len(data)), offsets[1:][text[head]])
    size = hi - lo
    for i in range(0, len(head), 4096):
        s, n = lo[i : i + 4096], size[i : i + 4096]
        at = np.arange(int(n.sum())) + np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        cell = np.repeat(np.arange(len(n)) * KINDS, n) + _KIND[data[at]]
        x[where[i : i + 4096], :KINDS] = np.bincount(cell, minlength=len(n) * KINDS).reshape(len(n), KINDS) / np.maximum(n, 1)[:, None]
    h = hashes(data, starts, ends)
    length = (ends - starts).astype(np.float64)
    lead = data[starts]
    upper = (lead >= 65) & (lead <= 90)
    second = data[np.minimum(starts + 1, ends - 1)]
    loud = upper & (second >= 65) & (second <= 90)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    key = np.lexsort((h, own))
    new = np.ones(len(h), bool)
    new[1:] = (h[key][1:] != h[key][:-1]) | (own[key][1:] != own[key][:-1])
    distinct = np.add.reduceat(new.astype(np.float64), head)
    mean = np.add.reduceat(length, head) / count
    extra = (np.log1p(count), mean / 10, np.sqrt(np.maximum(0, np.add.reduceat(length**2, head) / count - mean**2)) / 10, np.add.reduceat(same.astype(float), head) / count, distinct / count, np.add.reduceat(upper.astype(float), head) / count, np.add.reduceat(loud.astype(float), head) / count, np.minimum(mean, 40) / 40, np.log1p(n_words[text[head]]) / 5)
    x[where, KINDS:SHAPES] = np.stack(extra, 1)
    cell = np.repeat(np.arange(len(head)) * BUCKETS, count) + (h >> np.uint64(40)).astype(np.int64) % BUCKETS
    x[where, SHAPES:] = np.sqrt(np.bincount(cell, minlength=len(head) * BUCKETS).reshape(len(head), BUCKETS) / count[:, None])
    return x, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    rate: float


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1], axis=0)


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray):
    n = np.diff(first)
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["q"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), n))
    a = e / np.repeat(_sums(e, first), n)
    z = _sums(h * a[:, None], first)
    return h, t, g, a, z, 1 / (1 + np.exp(-(z @ w["c"] + w["c0"])))


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> Model:
    """Adam on the documents' log loss; the same input gives the same model."""
    rate = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    # All words of a passage weigh as much as a few of its other figures.
    scale = np.concatenate([scale[:SHAPES], scale[SHAPES:] * 4]).astype(np.float32)
    if not len(y) or rate in (0.0, 1.0):
        return Model(mean, scale, None, rate)
    x = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    w = {"W": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "q": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c0": np.array(np.log(rate / (1 - rate)))}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    n = np.diff(first)
    for step in range(1, STEPS + 1):
        h, t, g, a, z, p = _forward(w, x, first)
        dl = (p - y) / len(y)
        dz = np.repeat(dl[:, None] * w["c"], n, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(_sums(a * da, first), n))
        dt, dg = de[:, None] * w["q"] * g * (1 - t**2), de[:, None] * w["q"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
        grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "q": (t * g).T @ de, "c": z.T @ dl, "c0": dl.sum()}
        for k in w:
            d = grad[k] + DECAY * w[k] * (k not in ("b", "c0"))
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d**2
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, {k: p.astype(np.float32) for k, p in w.items()}, rate)


def apply(model: Model, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    if model.weights is None:
        return np.full(len(first) - 1, model.rate)
    return _forward(model.weights, np.clip((x - model.mean) / model.scale, -8, 8), first)[-1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS, passages_most: int = TRAIN_PASSAGES) -> Model:
    """Learns from the documents that have a label."""
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    chosen = written(labels.orderBy(F.xxhash64("id"), "id").limit(most), "mil-labels")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                x, first = passages(batch.column("text"))
                bags = [x[a:b].tobytes() if b - a <= passages_most else b"" for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "y": batch.column("y"), "n": pa.array(np.diff(first), pa.int64()), "x": pa.array(bags, pa.binary())})

    # A row that repeats an id counts once: the sample is one text of each chosen document.
    bags = written(rows.mapInArrow(run, "id long, y int, n long, x binary").groupBy("id").agg(F.max(F.struct("n", "x", "y")).alias("b")).select("id", "b.*"), "mil-bags")
    taken, room = [], passages_most
    for r in bags.select("id", "n", F.xxhash64("id").alias("h")).orderBy("h", "id").collect():
        if r["n"] <= room:
            taken.append((r["id"],))
            room -= r["n"]
    if not taken and not bags.isEmpty():
        raise ValueError(f"no labelled text has at most {passages_most} passages")
    found = bags.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "id long")), "id").toPandas().sort_values("id")
    kept = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in found["x"]]
    first = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(int)
    return train(np.concatenate(kept) if kept else np.zeros((0, FEATURES), np.float32), first, found["y"].to_numpy(float))


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = [apply(shared.value, *passages(piece.column(0))).astype(float) for piece in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text")]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    rest = [f"`{c}`" for c in df.columns if c not in ("score", "predicted")]
    return df.select(*rest, scored(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; learnt from labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    model = fit(docs, labels)
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model).select("doc_id", "held_out", "score", "predicted")
