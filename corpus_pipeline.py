"""Raw documents to a mixed, tokenised corpus in five stages.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads
them again as the next one's input.

All stages take null, empty and very long texts, null ids, repeated rows, empty
tables and other columns of any name; what each does with them is said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociwave.llm import bpe, langid, mixing, neardup, quality
from lociwave.llm.common import held_out, table, written

#: Documents whose language is less certain than this go.
LANGUAGE_SCORE = 0.5


def nested(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as one column beside those that a stage reads, so that no name of an operator meets one of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; without a labelled text to learn from all stay.

    Null and empty texts and texts without a letter have none and go; repeated rows are judged alike.
    """
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    judged = langid.predict(nested(docs, "text"), model)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select("__row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier takes for good; without labels, or with one kind only, all stay.

    Null and empty texts are scored as an empty passage; rows without an id or label are judged by their text alone.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    model = quality.fit(docs.select("doc_id", "text"), labels)
    if model.weights is None:
        return docs
    return quality.score(nested(docs, "text"), model).where("predicted = 1").select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates.

    Texts without a word have no near-duplicates and stay; rows that repeat id and text become one.
    """
    return neardup.deduplicated(docs).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A document without a word is taken 0 times; a null source is one of its own; repeated rows count each for itself.
    """
    mixed = mixing.mix(nested(docs, "doc_id", "source", "text"))
    return mixed.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("__row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes they decode to; a null text has no ids."""
    tokens = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bytes_col="decoded")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return tokens.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Learnt models and tokenisation are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
