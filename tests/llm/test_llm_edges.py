"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lociwave.llm import ann, binary, bpe, langid, licences, mixing, neardup, quality, topk, warc
from lociwave.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, labels string, key string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    long = "word " * 30_000 + "end"
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "the cat sat on the mat today", "en", None, 1), (3, "the cat sat on the mat today", "en", None, 1),
        (4, "der hund und die katze sind hier", "de", "b", 1), (5, "THE cat\tsat on\nthe mat today", None, "b", 1), (None, "une phrase de plus pour voir", "fr", "b", 1),
        (6, long, "en", "hot", 1), (7, "... 123 !!!", "en", "hot", 1), (8, "Released under the MIT License.", "en", "hot", 1), (9, "x" * 40_000, "en", "hot", 1),
    ]
    return spark.createDataFrame([(*r, "s", "l", "k", 5) for r in rows], SCHEMA).repartition(3)


def test_language_id(spark, docs):
    model = langid.fit(docs)
    rows = {(r.doc_id, r.text): r for r in langid.predict(docs, model).collect()}
    assert set(model.languages) == {"de", "en", "fr"}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in rows if k[1] is None or k[0] in (2, 7))
    assert {r.lang_pred for k, r in rows.items() if k[0] in (3, 5, 6)} == {"en"} and next(r for k, r in rows.items() if k[0] == 4).lang_pred == "de"
    empty = docs.where("false")
    none = langid.fit(empty)
    assert langid.predict(empty, none).count() == 0 and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_bpe_is_the_library(spark, docs):
    rows = bpe.decode(bpe.encode(docs, chunk_chars=200, overlap_chars=20)).collect()
    assert len(rows) == docs.count() and rows[0].score == "s"
    assert sorted((r.doc_id or 0, *r.token_ids) for r in rows) == sorted((r.doc_id or 0, *bpe.encoder(bpe.VOCABULARY).encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted(bytes(r.decoded) for r in rows) == sorted((r.text or "").encode() for r in docs.collect())
    assert bpe.encode(docs.where("false")).count() == 0


def test_bpe_chunks_resynchronise(spark):
    import random

    rng = random.Random(5)
    parts = [" ", "  ", "\n", "'ll", "'", "é", "日本", "a", "Bc", "12", "!?", "\t", "'s", " the", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 900))) for _ in range(60)] + ["a" * 500, " " * 300 + "x", "'" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.token_ids) for r in bpe.encode(df, chunk_chars=60, overlap_chars=16).collect()}
    assert got == {i: bpe.encoder(bpe.VOCABULARY).encode_ordinary(x) for i, x in enumerate(texts)}


def test_neardup(spark, docs):
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.cluster(docs).collect()]
    assert sorted(rows, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 3, 3), (3, 3, 3), (4, 3, 4), (5, 3, 3), (None, 2, None), (6, 2, 6), (7, 1, 7), (8, 1, 8), (9, 1, 9)], key=str)
    kept = neardup.deduplicated(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "3", "4", "None", "6", "7", "8", "9"]) and kept[0].key == "k"
    assert neardup.cluster(docs.where("false")).count() == 0 and neardup.deduplicated(docs.where("doc_id > 5")).count() == 4


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.mix_copies <= 2 for r in rows) and rows[0].score == "s"
    assert {r.source for r in rows} == {"a", "b", "hot", None} and all(r.mix_target == 0 for r in rows if r.source == "a")
    assert mixing.mix(docs.where("false")).count() == 0
    same = spark.createDataFrame([(1, "a", "one two")] * 999 + [(2, "b", "one")] * 1200, "doc_id long, source string, text string")
    taken = {r.source: (r.t, r.g) for r in mixing.mix(same).groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("mix_size")).alias("t"), F.first("mix_target").alias("g")).collect()}
    assert all(abs(t - g) <= 2 for t, g in taken.values())


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 40, "d": 0, None: 300}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    want, left, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if level[s] > 2 * sizes[s]]
        if not over:
            want |= level
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            free.discard(s)
    assert got == pytest.approx(want)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 1), (4, 1), (5, 1), (7, 0), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert quality.score(docs, quality.fit(docs, labels.where("false"))).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}
    assert quality.score(docs.where("false"), model).count() == 0


def test_licences(spark, docs):
    rows = {str(r.doc_id): r for r in licences.scan(docs).collect()}
    assert rows["8"].labels == "mit" and rows["8"].score == 1.0 and rows["8"].base_labels == "" and rows["8"].n_words == 5
    assert rows["1"].n_words == 0 and rows["1"].labels == "" and rows["1"].first_word is None and rows["6"].n_words == 30_001
    more = spark.createDataFrame([(1, "CC  by. cc-BY x All rights\nreserved cc-by"), (2, "accby cc b y"), (3, "K licensed Under the Apache license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(more).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (4, 0, 8, "cc-by,reserved") and got[2].n_base == 0 and got[3].n_words == 6
    assert licences.scan(more.where("false")).count() == 0


VECTORS = "vec_id long, embedding array<float>, score string"


def test_searches(spark):
    import random

    rng = random.Random(6)
    data = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (None, [1.0] * 8), (303, [0.0] * 8), (0, None), (304, [3.0] * 8), (305, [3.0] * 8)]
    data += [data[7]] * 20
    df = spark.createDataFrame([(i, v, "s") for i, v in data], VECTORS)
    ask = df.where("vec_id % 50 = 0")
    import numpy as np

    good = {(i, tuple(np.float32(v).tolist())) for i, v in data if i is not None and v is not None and all(x is not None and x == x for x in v)}
    for k, mod, search in ((5, topk, topk.search), (20, ann, ann.search)):
        for q in (0, 50, 300):
            own = [v for i, v in good if i == q]
            got = [(r.vec_id, r.score) for r in search(df, ask).where(F.col("query_id") == q).orderBy("rank").collect()]
            if not own:
                assert got == []
                continue
            ints = (lambda v: np.floor(256 * np.array(v))) if mod is topk else np.array
            want = sorted((-float(ints(v) @ ints(own[0])), i) for i, v in good if i != q and (mod is topk or any(v)))[:k]
            assert [i for i, _ in got] == [i for _, i in want] and [s for _, s in got] == pytest.approx([-s for s, _ in want])
        assert search(df.where("false"), ask.where("false")).count() == 0 and search(df.where("vec_id = 0"), ask.where("vec_id = 0")).count() == 0


def test_topk_blocks_prune_and_big_integers():
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.floor(np.repeat(rng.normal(size=(8, 16)) * 900, 200, 0) + rng.normal(size=(1600, 16)) * 20)
    v = v[topk.laid_out(v)]
    ids, q = np.arange(len(v)), v[::100]
    a, b, s, scored = topk.best_of_shard(ids, v, ids[::100], q, 5)
    x, y, t = topk.exact_ints(ids, v, ids[::100], q, 5)
    assert sorted(zip(a, b, s, strict=True)) == sorted(zip(x, y, t, strict=True))
    assert scored < len(q) * len(v) / topk.BLOCK / 2


def test_ann_recall(spark):
    import numpy as np

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.toPandas()
    v = np.stack(rows["embedding"].to_numpy()).astype(float)
    got = ann.search(df, df.where("vec_id % 20 = 0")).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    at = {i: k for k, i in enumerate(rows["vec_id"])}
    hit = []
    for r in got:
        s = v @ v[at[r.query_id]]
        s[at[r.query_id]] = -9
        hit.append(len(set(rows["vec_id"].to_numpy()[np.argsort(-s)[:20]]) & set(r.v)) / 20)
    assert len(got) == 100 and np.mean(hit) >= 0.9


def test_warc(spark):
    big = "b" * 200
    data = [(3, "http://x/ä ü\r\nz", big), (1, None, big), (1, None, big), (2, "u", None), (4, "u", "small"), (5, "u", "small"), (None, "u", big), (6, "u", "é" * 99)]
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, payload string")
    rows = warc.round_trip(df, with_payload=True).collect()
    got = sorted((str(r.id), r.payload_bytes, r.record_type, r.refers_to) for r in rows)
    assert got == sorted([("3", 200, "revisit", 1), ("1", 200, "response", None), ("1", 200, "response", None), ("2", 0, "response", None), ("4", 5, "response", None), ("5", 5, "response", None), ("None", 200, "revisit", 1), ("6", 198, "response", None)])
    assert all(r.payload_digest == hashlib.sha256(r.payload).hexdigest() for r in rows if r.record_type == "response")
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_members_and_cut_files():
    import gzip
    import io

    rows = [{"id": i, "payload": bytes([65 + i % 26]) * n, "payload_bytes": n, "payload_digest": hashlib.sha256(bytes([65 + i % 26]) * n).hexdigest(), "record_type": "response", "refers_to": None, "url": "u"} for i, n in enumerate((5, 0, 3 * warc.READ_BYTES, 300))]
    raw = [warc.record(r) for r in rows]
    for data in (gzip.compress(b"".join(raw)), b"".join(map(gzip.compress, raw)), gzip.compress(raw[0] + raw[1]) + gzip.compress(raw[2] + raw[3][:50]) + gzip.compress(raw[3][50:])):
        assert list(warc.records(io.BytesIO(data))) == raw
    assert list(warc.records(io.BytesIO(b""))) == []
    whole = gzip.compress(b"".join(raw))
    members = b"".join(map(gzip.compress, raw))
    for cut in (whole[:-3], whole[:-9], whole[: len(whole) // 2], members[:-2], members[: -len(gzip.compress(raw[3])) + 4], gzip.compress(raw[0][:-1])):
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.records(io.BytesIO(cut)))


def test_language_needs_a_letter():
    from lociwave.llm.langid import Model, scores

    import numpy as np

    empty = Model(["a", "b"], [np.zeros(0, np.uint64)] * 6, [np.zeros((0, 2), np.float32)] * 6)
    assert scores(empty, ["x² y³", "² ³", "12_", "é"])[0] == ["a", "und", "und", "a"]


def test_feistel_is_a_permutation():
    import numpy as np

    for n in (1, 2, 3, 10, 1000, 4097):
        x = np.arange(n)
        y = binary.permuted(x, n)
        assert sorted(y) == list(range(n)) and (binary.permuted(y, n, inverse=True) == x).all()
    assert (binary.permuted(np.arange(1000), 1000, 1) != binary.permuted(np.arange(1000), 1000, 2)).any()


def plain_sequences(rows, length):
    """The stream of tokens in the order of ids, cut into sequences, as (ids, documents) of each."""
    flat, docs = [], []
    for doc, _, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*bpe.encoder(bpe.VOCABULARY).encode_ordinary(text or ""), binary.END]
        flat += ids
        docs += [doc] * len(ids)
    return [(flat[i : i + length], [d for k, d in enumerate(docs[i : i + length]) if not k or docs[i + k - 1] != d]) for i in range(0, len(flat), length)]


def test_shards_hold_the_tokens_in_order(spark, docs):
    import numpy as np

    rows = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    want = plain_sequences(rows, 64)
    for parts, chunk in ((3, 2000), (7, 16_384)):
        folder = scratch_path(spark, "test-shards")
        index = binary.materialise(docs.repartition(parts, F.rand(parts)), folder, length=64, shard=16, chunk_chars=chunk)
        n = index.count()
        whole = binary.read_slots(folder, 0, n)
        assert n == len(want) and (binary.read_slots(folder, 13, 40) == whole[13:53]).all()
        slots = binary.permuted(np.arange(n), n)
        found = {r.slot: r for r in index.collect()}
        for (ids, own), slot in zip(want, slots.tolist(), strict=True):
            assert whole[slot].tolist() == ids + [binary.END] * (64 - len(ids))
            assert found[slot].n_tokens == len(ids) and found[slot].doc_ids == own and found[slot].shard == slot // 16
    assert binary.materialise(docs.where("false"), scratch_path(spark, "test-none")).count() == 0


def test_ids_beyond_two_bytes_fail(spark, docs):
    with pytest.raises(Exception, match="does not fit"):
        binary.materialise(docs.where("doc_id = 3"), scratch_path(spark, "test-wide"), end=70_000)
