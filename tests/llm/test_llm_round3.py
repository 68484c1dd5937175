"""Impact-ordered search, resampling by crc states and the line field: brute force, edges, bounds."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lociwave.llm import importance, lexical, lines, registry
from lociwave.llm.textkernel import raw, spans

MID = "/root/testdata/sf0.01"
TEXTS = [
    (1, None), (2, ""), (3, "!!! ... ---"), (4, "Alpha beta beta Gamma"), (4, "Alpha beta beta Gamma"), (5, "alpha BETA"), (None, "alpha gamma gamma"),
    (6, "beta " * 40_000), (7, "été Été ÉTÉ naïve 日本"), (8, "x" * 30_000), (9, "gamma beta alpha delta"), (10, "one\ntwo\n\none\ntwo\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 1, True) for i, t in TEXTS], "doc_id long, text string, rank string, score int, kept boolean").repartition(3)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, at + 1, i, -s) for at, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


ITEMS = [("a", "beta gamma"), ("b", None), ("c", ""), ("d", "nothing here"), ("e", "ALPHA alpha alpha 日本"), ("e", "delta"), (None, "naïve beta")]


@pytest.mark.parametrize("pack", [1 << 24, 8])
def test_search_is_brute_force(spark, docs, pack):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = sorted((tuple(r) for r in lexical.search(docs, items, k=3, pack_bytes=pack).collect()), key=str)
    assert found == brute_search(TEXTS, ITEMS, 3)


def test_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert lexical.search(docs.where("false"), items).count() == 0
    assert lexical.search(docs, items.where("false")).count() == 0


def test_bounds_leave_postings_out():
    """One rare and one frequent term: the rare one's impacts prove the best, the frequent one's postings stay unread; a carried bound does so alone."""
    rng = np.random.default_rng(3)
    n, width = 5000, 2
    own = [np.array([0, 1] if i < 8 else [1]) for i in range(n)]
    impacts = np.concatenate([np.array([9_000_000, int(rng.integers(1, 300))] if i < 8 else [int(rng.integers(1, 300))]) for i in range(n)])
    shard = lexical.Shard(np.arange(n), np.concatenate([[0], np.cumsum([len(x) for x in own])]), np.concatenate(own), impacts, width)
    found, score, added = shard.search(np.array([0, 1]), np.array([1, 2]), np.array([1, 2]), 5, 1)
    whole = shard.complete(np.arange(n), np.array([1, 2]))
    best = np.lexsort((np.arange(n), -whole))[:5]
    assert set(best) <= set(found) and (whole[found] == score).all() and added < 100
    assert shard.search(np.array([1]), np.array([1]), np.array([0, 1]), 5, 10_000)[2] < n


@pytest.mark.parametrize("seed", range(6))
def test_shards_are_exact(seed):
    rng = np.random.default_rng(seed)
    n, width, k = 400, 30, 7
    own = [np.sort(rng.choice(width, rng.integers(1, 12), replace=False)) for _ in range(n)]
    impacts = rng.integers(0, 40, sum(len(x) for x in own)) * 1000
    shard = lexical.Shard(np.arange(n), np.concatenate([[0], np.cumsum([len(x) for x in own])]), np.concatenate(own), impacts, width)
    asked = np.sort(rng.choice(width, 9, replace=False))
    weight = np.zeros(width, np.int64)
    weight[asked] = rng.integers(1, 4, 9)
    whole = shard.complete(np.arange(n), weight)
    best = lexical.Best(1, k)
    found, score, _ = shard.search(asked, weight[asked], weight, k, 1)
    best.add(0, found, score)
    want = [i for i in np.lexsort((np.arange(n), -whole))[:k] if whole[i] > 0]
    assert best.ids[0].tolist() == want and best.scores[0].tolist() == whole[want].tolist()


def brute_draw(docs, target, percent=25):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(x.encode()) % 10_000 for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    own = [(i, *features(t)) for i, t in docs]
    source, wanted = Counter(b for *_, f in own for b in f), Counter(b for t in target for b in features(t)[1])
    big, small = sum(source.values()) + 10_000, sum(wanted.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * big / ((source[b] + 1) * small))) for b in source}
    out = []
    for i, words, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): at + 1 for at, r in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def test_draw_is_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    more = [(100 + i, " ".join(rng.choice(["a", "bb", "ccc", "d", "E", "ß"], int(rng.integers(15, 60))))) for i in range(40)]
    rows = docs.select("doc_id", "text", "rank", "score").unionByName(spark.createDataFrame([(i, t, "x", 0) for i, t in more], "doc_id long, text string, rank string, score int"))
    target = spark.createDataFrame([("bb ccc bb ccc d",), (None,), ("",)], "text string")
    found = sorted((tuple(r) for r in importance.resample(rows, target).collect()), key=str)
    assert found == brute_draw([*TEXTS, *more], ["bb ccc bb ccc d", None, ""])
    assert importance.resample(rows.where("false"), target).count() == 0


def test_ring_of_states():
    words = [b"alpha", b"b", "é".encode(), b"alpha", b"b"]
    for n in (1, 2, 3, 5):
        found, count = importance.states(iter(words), n)
        want = [zlib.crc32(b" ".join(words[i : i + k])) for i in range(5) for k in range(1, n + 1) if i + k <= 5]
        assert sorted(found) == sorted(want) and count == 5


def brute_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, doubled = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            doubled += x in seen
            seen.add(x)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    held = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(held)]


def failed(f):
    return f[0] < 50 or 100 * f[4] > 50 * f[0]


def test_base_rules_of_the_query(spark):
    docs = pd.read_parquet(f"{MID}/documents.parquet").set_index("doc_id")["text"]
    labels = pd.read_parquet(f"{MID}/labels.parquet")
    found = registry.QUERIES["op13_line_crf"](spark, MID).toPandas()
    assert len(found) == len(docs)
    for r in found.itertuples():
        want = brute_figures(docs[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want and r.base_failed == failed(want)
    judged = found[~found.base_failed].merge(labels, on="doc_id")
    out = judged[[zlib.crc32(str(i).encode()) % 4 == 2 for i in judged.doc_id]]
    assert len(out) > 40 and (out.kept == (out.quality == 1)).mean() >= 0.97


def test_line_edges(spark, docs):
    rows = lines.judge(docs, None).collect()
    assert len(rows) == len(TEXTS) and rows[0]["rank"] == "s"
    for r in rows:
        want = brute_figures(r.text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want and r.base_failed == failed(want) and r.kept == (not failed(want))
    assert lines.judge(docs.where("false"), None).count() == 0
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    assert lines.fit(docs, labels.where("false")) is None and lines.fit(docs, labels) is None
    assert lines.fit(docs, spark.createDataFrame([(4, 1), (10, 0)], "doc_id long, quality int")) is not None


def test_texts_of_any_batch_are_alike():
    texts = ["one two\n\n  \nTHREE!! FOUR!!", "", None, "a\nb", "\n\nx*** y$$$\nlast line.", "a b c"]
    field = lines.Field(np.random.default_rng(2).normal(0, 1, (lines.FEATURES, 2)), np.array([[0.5, -0.2], [0.1, 0.3]]), np.array([0.2, -0.1]))
    together = lines.figures(pa.array(texts), field)["content_share"]
    alone = [lines.figures(pa.array([t], pa.string()), field)["content_share"][0] for t in texts]
    assert together.tolist() == alone


def _all_paths(field, bins):
    e = field.emission[bins].sum(1)
    return {y: field.start[y[0]] + sum(e[i, y[i]] for i in range(len(y))) + sum(field.step[a, b] for a, b in zip(y, y[1:], strict=False)) for y in product((0, 1), repeat=len(bins))}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    field = lines.Field(rng.normal(0, 1, (lines.FEATURES, 2)), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2))
    sizes = [3, 0, 1, 7, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    bins = rng.integers(0, lines.FEATURES, (first[-1], len(lines.BINS)))
    label = lines.viterbi(field, bins, first)
    for a, b in zip(first, first[1:], strict=False):
        if a < b:
            paths = _all_paths(field, bins[a:b])
            assert tuple(label[a:b]) == max(paths, key=paths.get)


def test_gradient_is_of_the_likelihood(monkeypatch):
    """One plain step from zero goes where the summed likelihood of all paths says."""
    rng = np.random.default_rng(6)
    sizes = [4, 2, 3]
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    bins = rng.integers(0, lines.FEATURES, (9, len(lines.BINS))).astype(np.int16)
    labels = rng.integers(0, 2, 9)
    zero = lines.Field(rng.normal(0, 0.1, (lines.FEATURES, 2)), rng.normal(0, 0.1, (2, 2)), rng.normal(0, 0.1, 2))

    def loss(f):
        out = 0.0
        for a, b in zip(first, first[1:], strict=False):
            paths = _all_paths(f, bins[a:b])
            out += np.log(sum(np.exp(v) for v in paths.values())) - paths[tuple(labels[a:b].tolist())]
        return out / 9 + lines.RIDGE / 2 * sum((v**2).sum() for v in vars(f).values())

    monkeypatch.setattr(lines, "STEPS", 1)
    moved = lines.train(bins, first, labels, zero)
    for name, at in (("step", (0, 1)), ("step", (1, 1)), ("start", (0,)), ("emission", (int(bins[0, 0]), 1)), ("emission", (int(bins[8, 3]), 0))):
        up = lines.Field(**{k: v.copy() for k, v in vars(zero).items()})
        getattr(up, name)[at] += 1e-5
        slope = (loss(up) - loss(zero)) / 1e-5
        assert np.sign(getattr(zero, name)[at] - getattr(moved, name)[at]) == np.sign(slope)


def test_training_lowers_the_loss_and_marks_lines():
    good = "A plain line comes first of all.\nAnd another follows it here."
    bad = "A plain line comes first of all.\nAAA*** BBB$$$ CCC###\nDDD*** EEE%%% FFF&&&\nGGG*** HHH$$$"
    texts = [good] * 30 + [bad] * 10
    data, offsets = raw(pa.array(texts))
    found = lines.lines_of(data, offsets, *spans(data, offsets))
    field = lines.learnt(found.bins, found.first, np.array([True] * 30 + [False] * 10))
    assert lines.viterbi(field, found.bins, found.first).tolist() == [1, 1] * 30 + [1, 0, 0, 0] * 10




def test_probes_reach_their_probability(monkeypatch):
    """With many functions the first sets do not suffice; more are made until every query and table has its probability."""
    from lociwave.llm import ann

    rng = np.random.default_rng(4)
    q = rng.normal(size=(6, 16))
    counts = {}
    for functions in (6, 16, 19):
        h = ann.Hashing(16, 1.0, functions, 1.0, np.zeros(17))
        counts[functions] = [len(x) for x in h.probes(q)]
        most = max(h.made)
        assert functions == 6 or most > ann.SETS
        monkeypatch.setattr(ann, "SETS", 4 * most)
        again = ann.Hashing(16, 1.0, functions, 1.0, np.zeros(17)).probes(q)
        assert np.mean([len(np.intersect1d(a, b)) / len(b) for a, b in zip(h.probes(q), again, strict=True)]) > 0.95
        monkeypatch.setattr(ann, "SETS", 512)
    assert min(counts[19]) > ann.TABLES * 512 > max(counts[6])


def test_long_texts_leave_room_for_others(spark):
    from lociwave.llm import quality

    rows = [(i, "word " * (5000 if i % 9 == 0 else 30) + ("good one" if i % 2 else "### $$$"), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, passages_most=60)
    assert model.weights is not None and 0.3 < model.rate < 0.7
    with pytest.raises(ValueError, match="no labelled text"):
        quality.fit(docs.where("doc_id % 9 = 0"), labels, passages_most=20)
    assert quality.fit(docs, labels.where("false")).weights is None


def test_language_sample_is_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from lociwave.llm import langid

    docs = spark.createDataFrame([(f"text number {i} {'abcdef'[i % 6]}", "xy"[i % 2]) for i in range(400)] * 2, "text string, lang string")
    model = langid.fit(docs, docs_per_language=30)
    want = set()
    for lang in "xy":
        rows = docs.where(F.col("lang") == lang).select("text", F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(30).collect()
        want |= {w for r in rows for w in r.text.split() if w.isalpha()}
    found = langid.words_of(sorted(want))
    assert len(model.keys[0]) == len(want) and model.find(0, found.hashes)[1].all()
