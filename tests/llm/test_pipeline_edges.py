"""Every stage of the pipeline on null ids, empty tables, repeated rows, long texts and columns whose names operators use."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

CLASHING = ["lang_pred", "score", "predicted", "key", "kept", "component_id", "n_shingles", "size", "mix_size", "mix_copies", "mix_copy", "target", "decoded", "token_ids", "n_tokens", "__row"]
STAGES = dict(pipeline.STAGES)
ENGLISH = "the cat sat on the mat and looked at the birds in the garden for a while"
GERMAN = "der hund und die katze sitzen auf der bank und sehen die anderen tiere an"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with labels only, both kinds of them."""
    path = str(tmp_path_factory.mktemp("labels"))
    spark.range(1, 41).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, ENGLISH if i % 2 else GERMAN, "en" if i % 2 else "de", f"s{i % 3}") for i in range(1, 41)]
    rows = [(i, f"{text} number {i} of {i * 7} and {i * 11} in {i * 13}", lang, source) for i, text, lang, source in rows]
    rows += [(None, ENGLISH + " once more without any id", "en", None), (None, None, None, None), (50, "", "en", "s1"), (51, None, "en", "s1"), (52, "123 456 !!!", None, "s2")]
    rows += [(53, f"{ENGLISH} " * 4000, "en", "s2"), (54, "x" * 60_000, "en", "s2"), rows[0], rows[0]]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    return made.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def counted(df):
    out = {}
    for r in df.collect():
        key = (r["doc_id"], r["text"])
        out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage_keeps_rows_as_they_are(spark, docs, folder, name):
    """What a stage keeps has all columns and values of its input; nothing is made up."""
    found = STAGES[name](spark, docs, folder)
    assert found.columns == docs.columns
    assert found.schema.simpleString() == docs.schema.simpleString()
    rows, given = found.collect(), counted(docs)
    assert rows and all((r["doc_id"], r["text"]) in given for r in rows)
    assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_of_an_empty_table(spark, docs, folder, name):
    assert STAGES[name](spark, docs.where("false"), folder).count() == 0


def test_language_of_odd_texts(spark, docs, folder):
    """Texts without a letter go; a null id is judged like any other; repeated rows are judged alike."""
    kept = counted(pipeline.language_id(spark, docs, folder))
    assert not {(None, None), (50, ""), (51, None), (52, "123 456 !!!")} & set(kept)
    given = counted(docs)
    assert all(n == given[k] for k, n in kept.items())
    assert (53, f"{ENGLISH} " * 4000) in kept and any(i is None for i, _ in kept)


def test_all_stay_without_languages_or_labels(spark, docs, folder, tmp_path):
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language_id(spark, unknown, folder).count() == docs.count()
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert counted(pipeline.quality_classifier(spark, docs, str(tmp_path))) == counted(docs)


def test_quality_judges_equal_texts_alike(spark, docs, folder):
    given, kept = counted(docs), counted(pipeline.quality_classifier(spark, docs, folder))
    assert kept and all(n == given[k] for k, n in kept.items())


def test_dedup_of_odd_rows(spark, docs, folder):
    """Texts without a word stay; rows that repeat id and text become one; a long text is no copy of its parts."""
    kept = counted(pipeline.near_dedup(spark, docs, folder))
    assert kept[(50, "")] == kept[(51, None)] == kept[(None, None)] == 1
    assert (53, f"{ENGLISH} " * 4000) in kept and (54, "x" * 60_000) in kept
    assert all(n == 1 for n in kept.values())


def test_mix_takes_no_document_without_words(spark, docs, folder):
    given, taken = counted(docs), counted(pipeline.source_mixing(spark, docs, folder))
    assert not {(None, None), (50, ""), (51, None)} & set(taken)
    assert all(n <= 2 * given[k] for k, n in taken.items())


def test_tokens_of_odd_texts(spark, docs, folder):
    """Every row has its ids, also those without an id or text."""
    import hashlib

    rows = pipeline.byte_bpe(spark, docs, folder).collect()
    digest = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    assert sorted((r["doc_id"] or 0, r["decoded_sha256"]) for r in rows) == sorted((r["doc_id"] or 0, digest(r["text"])) for r in docs.collect())
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in rows) and {r["n_tokens"] for r in rows if r["decoded_sha256"] == digest("")} == {0}
