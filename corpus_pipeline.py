"""A corpus pipeline of the ten operators: classify, identify, deduplicate, mix, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; between stages the rows are written as Parquet and read again.

Edge cases, for every stage: an empty table gives an empty result, texts are read whole at
any length, and extra columns are carried along (dropped by the last stage) whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import bpe, langid, mixing, neardup, quality
from ledgerlens.llm.queries import vocabulary_path
from ledgerlens.session import materialize, table

#: Words of a shingle and the similarity in percent from which documents are near duplicates.
SHINGLE, PERCENT = 5, 80
#: Calibrated probability below which a document's language counts as unknown.
REJECT_LANGUAGE = 0.4


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality discriminant rejects; learned from these documents' labels.

    A null or empty text has the statistics of an empty one and goes if those are rejected; null
    ids, sources and languages don't matter. Repeated rows stay or go together. Without labels of both
    classes the share of label 1 decides for all (0.5 without any: all stay).
    """
    model = quality.fit_quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined or too uncertain.

    Null, empty and blank texts and those without a letter go. Without any row with a language
    all go. Repeated rows stay or go together; of equally probable languages the first by name is meant.
    """
    return langid.accepted(docs, langid.fit_language_model(docs), REJECT_LANGUAGE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: that with the smallest doc_id.

    Null and blank texts are alike to nothing and stay, as do rows without a doc_id. Rows that repeat a
    doc_id are versions of one document: they stay or go together.
    """
    return neardup.deduplicated(docs, SHINGLE, PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: a row for each copy taken, written by shard and, inside it, by hashed key.

    A null source is a source of its own, the last. Texts without words have no size: they fall in
    blocks like others and come with them. Repeated rows are taken or left together.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and of the decoded text.

    A null or empty text has no ids. A null doc_id is kept. Repeated rows are encoded each.
    """
    return bpe.encode_documents(docs, vocabulary_path(), keep_ids=True)


STAGES = [
    ("quality", classify_quality),
    ("language", identify_language),
    ("neardup", drop_near_duplicates),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: SQL has no form of the learned stages; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
