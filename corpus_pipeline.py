"""A training corpus from ``documents``: toxic documents go, one document of each near-duplicate group stays,
contaminated documents go, secrets are masked, and what is left is encoded.

``STAGES`` lists (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Each stage's results for nulls, empty and long texts, ties, repeated rows, empty tables and extra columns are those of the operator
that it calls: a document without text is not toxic, no duplicate, not contaminated, has no secrets and no tokens. Extra
columns of ``docs`` are carried.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontam, jaccard, secrets, toxicity
from foliant.llm.common import digest_of, fits, table, written

REJECT_AT = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under ``REJECT_AT``; the model is fitted to the labelled ones among ``docs``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(~toxicity.held_out(F.col("doc_id"))))
    score = f"score-{uuid.uuid4().hex}"  # no column of ``docs``
    return toxicity.score_documents(docs, model, score=score).where(F.col(f"`{score}`") < REJECT_AT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one of least id."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by ``benchmark``. The verdict hangs on the text alone, so texts are dropped by their digest, not by an id
    that may be missing or repeated."""
    digest = digest_of(F.col("text"))
    found = decontam.find_windows(docs.select(digest.alias("__gone"), "text"), table(spark, sf_dir, "benchmark"))
    gone = written(found.where(decontam.contaminated()).select("__gone").distinct(), "contaminated", size=32 * docs.count())
    return docs.join(F.broadcast(gone) if fits(gone) else gone, digest == gone["__gone"], "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted again."""
    return secrets.mask_secrets(docs).withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with their digest and that of the decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: No stage but the third can be said in SQL: the others train, sketch, decode or encode.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
