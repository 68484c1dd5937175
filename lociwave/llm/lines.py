"""Quality rules with a line labeller: a linear-chain conditional random field.

A text is the sequence of its lines that hold a word. Every line has a few
figures in bins (length, shares of symbols, capitals, digits and marks, repeated
words, its ends, its place, whether it was there before); the field gives each
bin a weight for ``content`` and for ``boilerplate`` and each step from line to
line another. Viterbi decoding finds the most probable labels of the whole text.
A document stays if it passes the base rules and at least ``SHARE`` of its words
are in content lines.

The field is learnt from labelled documents: lines of good ones are content,
lines of bad ones boilerplate; after a first fit, lines of bad documents that by
their own figures look like content are relabelled so, and the field is fit again
(one hard step of expectation maximisation). The sample is bounded: at most
``TRAIN_DOCS`` documents of at most ``TRAIN_LINES`` lines each, by a hash of the
id; longer texts are not learnt from. All else reads whole texts of all rows.

Null and empty texts have no words and fail the base rules. Very long texts are
decoded whole, with memory for their words and lines. Between equally probable
labels, content wins. Without labels of both kinds every line is content. Repeated
rows are judged alike; an empty table gives no rows; columns of the result's names
in the input are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, slices, table, written
from .textkernel import SEPARATOR, hashes, raw, run_hashes, spans

LEAST_WORDS, MOST_REPEATED = 50, 50
SHARE = 0.5
TRAIN_DOCS, TRAIN_LINES = 2_000, 100
STEPS, RATE, RIDGE = 120, 0.1, 1e-3
BOILERPLATE, CONTENT = 0, 1

_SHARES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
#: Upper bounds of the bins of each figure; one bin more than bounds.
BINS = [
    np.array([1.5, 2.5, 4.5, 8.5, 16.5, 32.5, 64.5, 128.5]),  # words
    _SHARES,  # symbols of bytes
    _SHARES,  # capitals of ASCII letters
    _SHARES,  # digits of bytes
    _SHARES,  # other ASCII marks of bytes
    np.array([2.5, 3.5, 4.5, 5.5, 6.5, 8.5, 11.5, 20.5]),  # mean bytes of a word
    np.array([0.1, 0.25, 0.5, 0.75, 0.9, 0.999]),  # distinct words of words
    _SHARES,  # words equal to the one before
    np.array([0.5]),  # first byte is a capital
    np.array([0.5, 1.5]),  # last byte: letter or digit, end of a sentence, other
    np.array([0.5]),  # equal to an earlier line
    np.array([0.5, 1.5]),  # the first line, the last one, another
]
_BASES = np.concatenate([[0], np.cumsum([len(b) + 1 for b in BINS])])
FEATURES = int(_BASES[-1])


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _class(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT = (_class(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
_MARK = _class(bytes(b for b in range(33, 127) if not chr(b).isalnum())) & ~_SYMBOL
_HEAD_BYTE = (np.arange(256) & 0xC0) != 0x80
_SENTENCE_END = _class(b".!?:;")


@dataclass
class Lines:
    """Lines with a word of a batch of texts: bins of each, its words, and for each text the index of its first line (one more at the end)."""

    bins: np.ndarray
    words: np.ndarray
    first: np.ndarray


def _upto(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def lines_of(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first_word: np.ndarray) -> Lines:
    n_docs = len(offsets) - 1
    if not len(starts):
        return Lines(np.zeros((0, len(BINS)), np.int16), np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64))
    doc_of_word = np.repeat(np.arange(n_docs), np.diff(first_word))
    breaks = np.flatnonzero(data == 10)
    line_of_word = np.searchsorted(breaks, starts) + doc_of_word
    head = np.flatnonzero(np.diff(line_of_word, prepend=-1))
    count = np.diff(np.append(head, len(starts)))
    doc = doc_of_word[head]
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    lo, hi = starts[head], ends[head + count - 1]
    size = (hi - lo).astype(float)

    def within(kind: np.ndarray) -> np.ndarray:
        upto = _upto(kind[data])
        return (upto[hi] - upto[lo]).astype(float)

    upper = within(_UPPER)
    h = hashes(data, starts, ends)
    line = np.repeat(np.arange(len(head)), count)
    order = np.lexsort((h, line))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(h[order].view(np.int64)) != 0) | (np.diff(line[order]) != 0)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    whole = run_hashes(h, head, head + count)
    order = np.lexsort((np.arange(len(head)), whole, doc))
    again = np.zeros(len(head), bool)
    again[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    last = data[hi - 1]
    place = np.where(np.diff(doc, prepend=-1) != 0, 0, np.where(np.diff(doc, append=-1) != 0, 1, 2))
    figures = [
        count, within(_SYMBOL) / size, upper / np.maximum(1, upper + within(_LOWER)), within(_DIGIT) / size, within(_MARK) / size,
        np.add.reduceat((ends - starts).astype(float), head) / count, np.add.reduceat(new.astype(float), head) / count, np.add.reduceat(same.astype(float), head) / count,
        _UPPER[data[lo]], np.where(_SENTENCE_END[last], 1, np.where(_MARK[last] | _SYMBOL[last], 2, 0)), again, place,
    ]
    bins = np.stack([np.searchsorted(b, np.asarray(f, float)) + base for b, f, base in zip(BINS, figures, _BASES[:-1], strict=True)], 1)
    return Lines(bins.astype(np.int16), count, first)


@dataclass
class Field:
    """Weights of a linear chain with two labels: of each bin, of each step (from, to), of the first line."""

    emission: np.ndarray
    step: np.ndarray
    start: np.ndarray


def _deal(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first line of each sequence, how many sequences have a line at each place), longest sequences first; none empty."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[: int((size > 0).sum())]
    size = size[order]
    return first[:-1][order], np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")


def viterbi(field: Field, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most probable label of each line, all sequences side by side."""
    e = field.emission[bins].sum(1)
    heads, alive = _deal(first)
    back = np.zeros((len(bins), 2), np.int8)
    best = np.zeros((len(heads), 2))
    for t, n in enumerate(alive.tolist()):
        at = heads[:n] + t
        if t:
            ways = best[:n, :, None] + field.step
            back[at] = won = ways[:, CONTENT] >= ways[:, BOILERPLATE]
            best[:n] = np.where(won, ways[:, CONTENT], ways[:, BOILERPLATE]) + e[at]
        else:
            best[:n] = field.start + e[at]
    label = np.zeros(len(bins), np.int8)
    now = (best[:, CONTENT] >= best[:, BOILERPLATE]).astype(np.int8)
    for t in range(len(alive) - 1, -1, -1):
        at = heads[: alive[t]] + t
        label[at] = now[: alive[t]]
        now[: alive[t]] = back[at, now[: alive[t]]]
    return label


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(bins: np.ndarray, first: np.ndarray, labels: np.ndarray, start: Field | None = None) -> Field:
    """Greatest conditional likelihood of the labels, with a ridge, by Adam on exact gradients (forward and backward sums)."""
    heads, alive = _deal(first)
    p = {"emission": np.zeros((FEATURES, 2)), "step": np.zeros((2, 2)), "start": np.zeros(2)} if start is None else {k: v.copy() for k, v in vars(start).items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    total = len(bins)
    truth = np.eye(2)[labels]
    inner = np.ones(total, bool)
    inner[heads] = False
    inner = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (labels[inner - 1], labels[inner]), 1)
    flat = bins.ravel().astype(np.int64)
    for n_step in range(1, STEPS + 1):
        e = p["emission"][bins].sum(1)
        forward, backward = np.zeros((total, 2)), np.zeros((total, 2))
        for t, n in enumerate(alive.tolist()):
            at = heads[:n] + t
            forward[at] = (_soft(forward[at - 1][:, :, None] + p["step"], 1) if t else p["start"]) + e[at]
        for t in range(len(alive) - 2, -1, -1):
            at = heads[: alive[t + 1]] + t
            backward[at] = _soft(p["step"] + (e[at + 1] + backward[at + 1])[:, None, :], 2)
        log_z = np.repeat(_soft(forward[heads] + backward[heads], 1), 1)
        z = np.zeros(total)
        length = np.zeros(len(heads), np.int64)
        for n in alive.tolist():
            length[:n] += 1
        z[np.concatenate([np.arange(a, a + n) for a, n in zip(heads.tolist(), length.tolist(), strict=True)])] = np.repeat(log_z, length)
        node = np.exp(forward + backward - z[:, None])
        edge = np.exp(forward[inner - 1][:, :, None] + p["step"] + (e[inner] + backward[inner])[:, None, :] - z[inner][:, None, None]).sum(0)
        miss = node - truth
        grad = {"emission": np.stack([np.bincount(flat, np.repeat(miss[:, y], bins.shape[1]), FEATURES) for y in (0, 1)], 1) / total + RIDGE * p["emission"], "step": (edge - pairs) / total + RIDGE * p["step"], "start": miss[heads].sum(0) / total + RIDGE * p["start"]}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9**n_step)) / (np.sqrt(v[k] / (1 - 0.999**n_step)) + 1e-8)
    return Field(**p)


def learnt(bins: np.ndarray, first: np.ndarray, good: np.ndarray) -> Field | None:
    """The field from the lines of documents marked good or bad; None without both kinds."""
    if not len(bins) or good.all() or not good.any():
        return None
    of_good = np.repeat(good, np.diff(first))
    field = train(bins, first, of_good.astype(np.int64))
    own = field.emission[bins].sum(1)
    return train(bins, first, (of_good | (own[:, CONTENT] > own[:, BOILERPLATE])).astype(np.int64), field)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS, lines_most: int = TRAIN_LINES) -> Field | None:
    """Learns from the documents that have a label; a document with several counts as the smallest."""
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    chosen = written(labels.orderBy(F.xxhash64("id"), "id").limit(most), "crf-labels")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                data, offsets = raw(batch.column("text"))
                found = lines_of(data, offsets, *spans(data, offsets))
                size = np.diff(found.first)
                at = np.flatnonzero((size > 0) & (size <= lines_most))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(at)), "y": batch.column("y").take(pa.array(at)), "bins": pa.array([found.bins[found.first[i] : found.first[i + 1]].tobytes() for i in at], pa.binary())})

    bags = rows.mapInArrow(run, "id long, y int, bins binary").groupBy("id").agg(F.max(F.struct("bins", "y")).alias("b")).select("id", "b.*").toPandas().sort_values("id")
    kept = [np.frombuffer(x, np.int16).reshape(-1, len(BINS)) for x in bags["bins"]]
    first = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)
    return learnt(np.concatenate(kept) if kept else np.zeros((0, len(BINS)), np.int16), first, bags["y"].to_numpy(int) > 0)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more; windows may overlap."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, itertools.count()), np.int64, n)
    if len(seen) == n:
        return 0
    if n < 1 << 21:
        key = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        key = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1] * n + ids[2:]
    order = np.argsort(key, kind="stable")
    equal = np.diff(key[order]) == 0
    twice = np.zeros(len(key), bool)
    twice[order[1:]] = equal
    twice[order[:-1]] |= equal
    held = np.zeros(n, bool)
    for k in range(3):
        held[k : k + len(twice)] |= twice
    return int(held.sum())


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = T.StructType([*(T.StructField(x, T.LongType()) for x in FIGURES), T.StructField("content_share", T.DoubleType())])


def figures(column: pa.Array, field: Field | None) -> dict[str, np.ndarray]:
    """The base figures of each text and the share of its words in content lines (0 without words)."""
    data, offsets = raw(column)
    starts, ends, first_word = spans(data, offsets)
    n_words = np.diff(first_word)
    chars, symbols = _upto(_HEAD_BYTE[data] & ~SEPARATOR[data]), _upto(_SYMBOL[data])
    doubled, repeated = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    for i in np.flatnonzero(n_words).tolist():
        text = data[offsets[i] : offsets[i + 1]].tobytes()
        filled = [x for x in text.split(b"\n") if x.strip()]
        doubled[i] = len(filled) - len(set(filled))
        repeated[i] = repeated_words(text.split())
    found = lines_of(data, offsets, starts, ends, first_word)
    label = np.ones(len(found.words), np.int8) if field is None else viterbi(field, found.bins, found.first)
    upto = _upto(found.words * (label == CONTENT))
    share = (upto[found.first[1:]] - upto[found.first[:-1]]) / np.maximum(1, n_words)
    return dict(zip(FIGURES, (n_words, chars[offsets[1:]] - chars[offsets[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], doubled, repeated), strict=True)) | {"content_share": share}


def judge(df: DataFrame, field: Field | None, text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows with their figures, ``base_failed`` and ``kept``."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    kind = pa.struct([*((x, pa.int64()) for x in FIGURES), ("content_share", pa.float64())])

    @F.arrow_udf(_SCHEMA)
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [figures(piece.column(0), shared.value) for piece in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text")]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[f.name] for p in parts]) if parts else [], f.type) for f in kind], fields=list(kind))

    added = (*FIGURES, "content_share", "base_failed", "kept")
    rows = df.select(*[f"`{c}`" for c in df.columns if c not in added], found(F.col(text_col)).alias("__found")).select("*", "__found.*").drop("__found")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= share))


def op13_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules for every document; the field is learnt from labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    return judge(docs, fit(docs, labels)).drop("text")
