"""Language identification, word first, with back-off to shorter character n-grams.

A known word adds its log frequency in each language; an unseen word adds the
mean log frequency of its longest known character n-grams (5 down to 1, with
marks at the word's ends). The language with the greatest sum wins; ``score`` is
its posterior under equal priors. Words are runs of letters, lower-cased; words
and n-grams are 64-bit hashes, so that whole batches of texts are scored by array
operations.

The model is counted over a bounded sample of the labelled texts: per language
the ``docs_per_language`` distinct texts with the smallest hashes, each once and
whole, with every word and n-gram they hold. A sample with more than
``MOST_ENTRIES`` distinct counts is an error, not a cut. Prediction reads whole
texts of all rows and nothing but the text; memory is bounded by a piece of a
batch, or by the one text that is longer.

Null texts and texts without a letter give ``und`` with score 0; so does every
text when there is no labelled text to learn from. Ties go to the language that
comes first by code point. Repeated rows stay; an empty table gives no rows;
columns ``lang_pred`` and ``score`` of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, maybe_broadcast, mix64, slices, strings, table, written
from .textkernel import chained, run_hashes

DOCS_PER_LANGUAGE = 1_500
MOST_ENTRIES = 5_000_000
#: Parts of a language from which the sample is taken.
PARTS = 1024
LONGEST = 5
SMOOTHING = 0.5
UNKNOWN = "und"

#: Whether a code point is a letter: -1 not asked yet.
_LETTER = np.full(0x110000, -1, np.int8)
#: Values of the marks at a word's ends, beyond all code points.
_HEAD, _TAIL = 0x110000, 0x110001


def _is_letter(codes: np.ndarray) -> np.ndarray:
    kind = _LETTER[codes]
    if len(new := np.unique(codes[kind < 0])):
        _LETTER[new] = [chr(c).isalpha() for c in new.tolist()]
        kind = _LETTER[codes]
    return kind == 1


@dataclass
class Words:
    """Words of a batch of texts: code points, (start, end) of each word, index of each text's first word, hashes."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def _values(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(1))


def words_of(texts: list[str | None]) -> Words:
    low = [x.lower() if x else "" for x in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in low])]).astype(np.int64)
    letter = _is_letter(codes)
    edge = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    return Words(codes, starts, ends, np.searchsorted(starts, at), run_hashes(_values(codes), starts, ends))


def _gathered(found: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, word, place) of the marked letters of the chosen words, one after another."""
    size = found.ends[which] - found.starts[which] + 2
    head = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(which)), size)
    place = np.arange(head[-1]) - head[word]
    codes = np.full(head[-1], _HEAD, np.int64)
    inner = (place > 0) & (place < size[word] - 1)
    codes[inner] = found.codes[found.starts[which][word[inner]] + place[inner] - 1]
    codes[head[1:] - 1] = _TAIL
    return _values(codes), word, size[word] - place


def grams(found: Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the n-grams of the chosen words; single letters have no marks."""
    values, word, left = _gathered(found, which)
    if n == 1:
        ok = (left > 1) & (np.diff(word, prepend=-1) == 0)
        return word[ok], mix64(values[ok] + np.uint64(1))
    ok = left[: max(0, len(values) - n + 1)] >= n
    return word[: len(ok)][ok], mix64(chained(values, n)[ok] + np.uint64(n))


@dataclass
class Model:
    """Log frequencies by language: ``tables[n]`` has a row for each hash of the sorted ``keys[n]``; order 0 holds words."""

    languages: list[str]
    keys: list[np.ndarray]
    tables: list[np.ndarray]

    def find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, found) of each hash in order n."""
        keys = self.keys[n]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        row = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return row, keys[row] == hashes


def word_rows(model: Model, found: Words, which: np.ndarray) -> np.ndarray:
    """Log frequencies of the chosen words, by back-off for those that the model doesn't know."""
    out = np.zeros((len(which), len(model.languages)))
    row, known = model.find(0, found.hashes[which])
    out[known] = model.tables[0][row[known]]
    todo = np.flatnonzero(~known)
    for n in range(LONGEST, 0, -1):
        if not len(todo):
            break
        word, hashes = grams(found, which[todo], n)
        row, met = model.find(n, hashes)
        word, row = word[met], row[met]
        count = np.bincount(word, minlength=len(todo))
        has = count > 0
        for j in range(len(model.languages)):
            total = np.bincount(word, weights=model.tables[n][row, j], minlength=len(todo))
            out[todo[has], j] = total[has] / count[has]
        todo = todo[~has]
    return out


def scores(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    found = words_of(texts)
    of_text = np.repeat(np.arange(len(texts)), np.diff(found.first))
    if not model.languages or not len(found.starts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    _, which, kind = np.unique(found.hashes, return_index=True, return_inverse=True)
    rows = word_rows(model, found, which)
    total = np.stack([np.bincount(of_text, weights=rows[kind, j], minlength=len(texts)) for j in range(len(model.languages))], 1)
    best = total.argmax(1)
    with np.errstate(under="ignore"):
        score = 1 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(1)
    empty = np.diff(found.first) == 0
    return [UNKNOWN if e else model.languages[b] for b, e in zip(best, empty, strict=True)], np.where(empty, 0.0, score)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, n, h, c): words and n-grams of each piece of the sample."""
    for big in batches:
        for batch in slices(big, "text"):
            found = words_of(strings(batch.column("text")))
            labels = batch.column("label").to_pylist()
            own = np.array([sorted(set(labels)).index(x) for x in labels])[np.repeat(np.arange(len(labels)), np.diff(found.first))]
            for i, label in enumerate(sorted(set(labels))):
                mine = np.flatnonzero(own == i)
                h, at, count = np.unique(found.hashes[mine], return_index=True, return_counts=True)
                for n in range(LONGEST + 1):
                    if n:
                        word, gram = grams(found, mine[at], n)
                        h, inverse = np.unique(gram, return_inverse=True)
                        total = np.bincount(inverse, weights=count[word], minlength=len(h)).astype(np.int64)
                    else:
                        total = count
                    yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(h), pa.string()), "n": pa.array(np.full(len(h), n, np.int32)), "h": pa.array(h.view(np.int64)), "c": pa.array(total.astype(np.int64))})


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learns from distinct texts with a label, at most ``docs_per_language`` of each language: those with the smallest hashes."""
    rows = df.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null and text is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # The smallest hashes of each of many parts of a language first, so that no task sorts all of its texts.
    part = Window.partitionBy("label", "part").orderBy("hash")
    least = Window.partitionBy("label").orderBy("hash")
    chosen = rows.select("label", "hash").distinct().withColumn("part", F.pmod("hash", F.lit(PARTS)))
    chosen = chosen.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= docs_per_language)
    chosen = chosen.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= docs_per_language)
    chosen = written(chosen.select("label", "hash"), "lang-sample")
    languages = sorted(r["label"] for r in chosen.select("label").distinct().collect())
    if not languages:
        return Model([], [np.zeros(0, np.uint64)] * (LONGEST + 1), [np.zeros((0, 0), np.float32)] * (LONGEST + 1))
    sample = rows.join(maybe_broadcast(chosen), ["label", "hash"], "left_semi").select("text", "label").distinct()
    counts = sample.mapInArrow(_counted, "label string, n int, h long, c long").groupBy("label", "n", "h").agg(F.sum("c").alias("c"))
    counts = written(counts.select((F.array_position(F.array(*map(F.lit, languages)), F.col("label")) - 1).cast("int").alias("label"), "n", "h", "c"), "lang-counts")
    if (entries := counts.count()) > MOST_ENTRIES:
        raise ValueError(f"the sample holds {entries} counts of words and n-grams; choose a smaller docs_per_language")
    found = counts.toArrow()
    label, order, hashes, count = (found.column(c).to_numpy() for c in ("label", "n", "h", "c"))
    keys, tables = [], []
    for n in range(LONGEST + 1):
        mine = order == n
        own, row = np.unique(hashes[mine].view(np.uint64), return_inverse=True)
        counted = np.zeros((len(own), len(languages)))
        counted[row, label[mine]] = count[mine]
        total, kinds = counted.sum(0), (counted > 0).sum(0)
        # What a language lacks costs the same in each, or one with little text would win unseen words.
        space = np.maximum(total, 1) + SMOOTHING * (np.maximum(kinds, 1) + 1)
        tables.append(np.log((counted + SMOOTHING) / np.where(counted > 0, space, space.max())).astype(np.float32))
        keys.append(own)
    return Model(languages, keys, tables)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            names, numbers = [], [np.zeros(0)]
            for piece in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
                own, score = scores(shared.value, strings(piece.column(0)))
                names += own
                numbers.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(numbers), pa.float64())], ["lang_pred", "score"])

    rest = [f"`{c}`" for c in df.columns if c not in ("lang_pred", "score")]
    return df.select(*rest, scored(F.col(text_col)).alias("__scored")).select(*rest, "__scored.lang_pred", "__scored.score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
