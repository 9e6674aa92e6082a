"""A corpus prepared for training: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; all but the last keep the columns of ``documents``. Results
go from stage to stage as Parquet.

- language: documents without a recognisable language (no letters, or no language
  with a pooled probability of ``LEAST``) go. One language must have half of it,
  however many there are: all clean documents of sf0.1 score above, the held-out
  ones 0.567 at least.
- quality: documents that the weak labels and the scorer together grade as bad go.
- near_duplicates: of each group of documents linked by a similarity of five-word
  shingles of 0.8 or more, the one with the smallest id stays. Repeated rows are
  copies; different texts under one id, or without one, are different documents.
- pii: each span of personal data becomes its kind in angle brackets; n_chars
  follows the text.
- packing: one row for each piece of each document with its sequence and place.

Defined for every stage: null texts and texts without a letter are rejected by
language; a later stage that is given them rejects them (quality), keeps each
(near_duplicates), leaves them as they are with n_chars null or 0 (pii), or packs
the closing token alone (packing). Texts of any length are read whole. Ties: a
language's score of exactly ``LEAST`` and a grade of exactly one half stay. Repeated
rows are decided alike, and one of them survives near_duplicates. An empty table
gives an empty table. Further columns, whatever their names, go along through all
stages but the last, whose columns are those of packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainspoke.llm import language_id, minhash_dedup, packing, pii, quality
from plainspoke.llm.common import fresh, table, written

LEAST, SIMILAR = 0.5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language_id.train(docs.where(~language_id.held_out()))
    (told,) = fresh(docs.columns, "_told")
    own = docs.withColumn(told, language_id.predict(net, F.col("text")))
    return own.where((F.col(told)["lang_pred"] != language_id.UND) & (F.col(told)["score"] >= LEAST)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (grade,) = fresh(docs.columns, "_grade")
    graded = docs.withColumn(grade, quality.graded(*quality.fitted(docs), F.col("text")))
    return graded.where(F.col(grade)["good"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.survivors(docs, threshold=SIMILAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = docs.withColumn("text", pii.redacted(pii.train(docs), F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(packing.tokenised(docs))


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("pii", personal_data), ("packing", packed)]

#: The stages' models can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
