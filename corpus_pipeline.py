"""A corpus from raw documents to packed sequences: quality, language, line dedup, near-dedup, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privloom.llm import lang_op, line_op, pack_op, quality_op, simhash_op
from privloom.llm.common import durable, table

#: Least quality that stays, and least share of a text's n-grams that its language's filter must hold.
LEAST_QUALITY, LEAST_LANGUAGE = 0.3, 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field doesn't reject. Null and empty texts have the score of the labels' mean; without labels of both kinds all
    stay. Very long texts are scored whole, and equal rows alike. Extra columns pass through."""
    field = quality_op.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_op.quality_of(spark, field, docs["text"]) >= LEAST_QUALITY)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filters know; null and empty texts, texts without letters, and those that hardly fit any language, go, and
    all if no language is known. Very long texts are read whole; of two languages alike the first by name is taken."""
    found = lang_op.language_of(spark, lang_op.fit(docs), docs["text"])
    return docs.filter(F.when(found["lang"] == lang_op.UNKNOWN, 0.0).otherwise(found["score"]) >= LEAST_LANGUAGE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; n_chars follows the text. Null texts stay null; a text of repeats alone stays as
    an empty one. The first line by doc_id and place stays; equal rows keep the same lines."""
    return line_op.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; one row of equal rows. Null and empty texts are one group."""
    return simhash_op.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a null or empty text is the end id alone, a very long one many pieces."""
    return pack_op.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("packing", pack),
]

#: No stage but the last's bookkeeping can be told in SQL; the stages are tested against brute force and held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
