"""The registered queries against DuckDB or brute force on the small tables; the pipeline against a plain version."""

import pandas as pd
import pytest
from compare import DATA, duck, rows
from pyspark.sql import functions as F

import corpus_pipeline
from lociwave.llm import bpe, langid, mixing, neardup, quality, registry
from lociwave.llm.common import table, written

MID = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_statement(spark, name):
    found = registry.QUERIES[name](spark, DATA).toPandas()
    assert rows(found) == rows(duck().execute(registry.ORACLES[name]).df())


def test_bpe_query(spark):
    import hashlib

    docs = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")["text"]
    for r in registry.QUERIES["op2_byte_bpe"](spark, DATA).collect():
        text = docs[r.doc_id] or ""
        ids = bpe.encoder(bpe.VOCABULARY).encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_shards_query(spark):
    import hashlib

    import numpy as np

    from lociwave.llm import binary

    docs = pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")
    ids = [[*bpe.encoder(bpe.VOCABULARY).encode_ordinary(x or ""), binary.END] for x in docs.text]
    flat = np.concatenate([np.array(x, "<u2") for x in ids])
    owner = np.repeat(docs.doc_id.to_numpy(), [len(x) for x in ids])
    n = -(-len(flat) // binary.LENGTH)
    slots = binary.permuted(np.arange(n), n)
    want = []
    for i in range(n):
        own = flat[i * binary.LENGTH : (i + 1) * binary.LENGTH]
        full = np.append(own, np.full(binary.LENGTH - len(own), binary.END)).astype("<u2")
        want.append((int(slots[i]), int(slots[i]) // binary.SHARD, len(own), list(dict.fromkeys(owner[i * binary.LENGTH : (i + 1) * binary.LENGTH].tolist())), hashlib.sha256(full.tobytes()).hexdigest()))
    assert sorted(map(tuple, registry.QUERIES["op5_feistel_shards"](spark, DATA).collect())) == sorted(want)


def test_learned_queries(spark):
    docs = pd.read_parquet(f"{MID}/documents.parquet")[["doc_id", "lang", "text"]]
    found = registry.QUERIES["op1_language_id"](spark, MID).toPandas().merge(docs, on="doc_id")
    assert len(found) == len(docs) and (found[found.held_out].lang_pred == found[found.held_out].lang).mean() >= 0.97
    labels = pd.read_parquet(f"{MID}/labels.parquet")
    found = registry.QUERIES["op6_quality_mil"](spark, MID).toPandas()
    assert len(found) == len(docs)
    found = found.merge(labels, on="doc_id")
    assert (found[found.held_out].predicted == found[found.held_out].quality).mean() >= 0.95


def test_mixing_query(spark):
    found = registry.QUERIES["op4_mixing"](spark, MID).toPandas().merge(pd.read_parquet(f"{MID}/documents.parquet")[["doc_id", "source", "text"]], on="doc_id")
    assert (found["size"] == found.text.fillna("").str.count(r"[^\x20\x09-\x0D]+")).all() and (found.taken <= 2 * found["size"]).all()
    per = found.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per.own).all() and ((per.taken - per.target).abs() <= 0.01 * per.target + 5).all()
    again = registry.QUERIES["op4_mixing"](spark, MID).toPandas()
    assert rows(again) == rows(found[again.columns])


def plain_language(model, text):
    """One text, a word and an n-gram at a time, by the model's table of frequencies."""
    import math
    import re

    import numpy as np

    def row(n, gram):
        codes = np.array([langid._HEAD if c == "^" else langid._TAIL if c == "$" else ord(c) for c in gram], np.int64)
        value = langid._values(codes)
        if n == 0:
            h = langid.run_hashes(value, np.array([0]), np.array([len(value)]))
        elif n == 1:
            h = langid.mix64(value + np.uint64(1))
        else:
            h = langid.mix64(langid.chained(value, n) + np.uint64(n))
        at, known = model.find(n, h)
        return model.tables[n][at[0]] if known[0] else None

    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    words = [w for part in words for w in "".join(c if c.isalpha() else " " for c in part).split()]
    if not words:
        return "und", 0.0
    total = np.zeros(len(model.languages))
    kept = {}
    for w in words:
        if w not in kept:
            found = row(0, w)
            for n in range(langid.LONGEST, 0, -1):
                if found is None:
                    marked = f"^{w}$" if n > 1 else w
                    rows = [r for i in range(len(marked) - n + 1) if (r := row(n, marked[i : i + n])) is not None]
                    found = np.mean(rows, axis=0) if rows else None
            kept[w] = np.zeros(len(total)) if found is None else found
        total += kept[w]
    best = int(total.argmax())
    return model.languages[best], 1 / sum(math.exp(x - total[best]) for x in total)


def test_language_query_is_the_plain_one(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in registry.QUERIES["op1_language_id"](spark, DATA).collect():
        lang, score = plain_language(model, text[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)


def test_pipeline_is_its_stages(spark):
    """Each stage's decisions, taken again one row at a time from the models and groups."""
    docs = table(spark, DATA, "documents")
    language = written(corpus_pipeline.language_id(spark, docs, DATA), "t")
    model = langid.fit(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    score = lambda text: plain_language(model, text)
    assert {r.doc_id for r in language.collect()} == {r.doc_id for r in docs.collect() if score(r.text)[0] != "und" and score(r.text)[1] >= 0.5}
    good = written(corpus_pipeline.quality_classifier(spark, language, DATA), "t")
    fitted = quality.fit(language, table(spark, DATA, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.score(language, fitted).where("score >= 0.7").collect()}

    import re

    text = {r.doc_id: r.text for r in good.collect()}
    sets = {}
    for i, x in text.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    single = written(corpus_pipeline.near_dedup(spark, good, DATA), "t")
    assert sorted(r.doc_id for r in single.collect()) == [i for i in ids if root(i) == i] and single.columns == docs.columns
    assert neardup.deduplicated(single).count() == single.count()
    mixed = written(corpus_pipeline.source_mixing(spark, single, DATA), "t")
    want = mixing.mix(single).where("mix_copies > 0").select("doc_id", "mix_copies").collect()
    assert sorted((r.doc_id, r["count"]) for r in mixed.groupBy("doc_id").count().collect()) == sorted(map(tuple, want)) and mixed.columns == docs.columns
    out = corpus_pipeline.byte_bpe(spark, mixed, DATA)
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == sorted((r.doc_id, len(bpe.encode_text(r.text))) for r in mixed.collect())
    assert rows(corpus_pipeline.run(spark, DATA).select("doc_id", "ids_sha256").toPandas()) == rows(out.select("doc_id", "ids_sha256").toPandas())
