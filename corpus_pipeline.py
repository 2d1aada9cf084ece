"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents, further ones too, whatever their names.

Defined for every input: an empty table gives no rows.  Rows without id or text, and empty texts that come in, pass all
stages; the last gives null tokens for a null text.  Rows that repeat another, id and all, are judged alike by the
first two stages; the third keeps one of them.  Of equal texts under several ids the least id counts as the original.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, line_dedup, quality, simhash
from tidemark.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, rejects go.

    Without labels, or with labels of one kind only, none is rejected for want of that kind.  Contradicting labels of a
    document count as the worse one.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three-line windows that occurred before go, and documents of which nothing is left.

    The first occurrence, by id, text hash and line, stays.  ``n_chars`` is counted again.
    """
    return line_dedup.clean(docs, emptied=False)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of least id, of equal ids the one of least text hash."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item or an edited copy of one go; items without text or id match nothing."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, decoded again as a check: doc_id, tokens, n_tokens, round_trip."""
    return bpe.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: the classifier, SimHash, alignment and BPE stages can't be said in SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; what each returns is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}.parquet")
        docs = table(spark, at, name)
    return STAGES[-1][1](spark, docs, sf_dir)
