"""The corpus pipeline: five operators, each on all that its predecessor kept. STAGES is what runs, in order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import read, written
from gridloom.llm.decontaminate import drop_leaks
from gridloom.llm.jaccard import keep_first
from gridloom.llm.line_dedup import drop_repeated
from gridloom.llm.packing import pack
from gridloom.llm.quality import keep_good

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier puts into class 1. Null and empty texts are scored like others; without labels of two classes every
    score is the share of class 1 (0.5 without any), which is kept from 0.5 on; repeated rows are scored each; rows with a null doc_id
    are scored too; an empty table stays empty."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like lines the occurrence with the least (doc_id, line) stays; documents that lose every line go, those whose text
    was null or empty before stay. Rows with a null doc_id are left alone; rows of one doc_id and text count as one occurrence and keep
    the same lines; an empty table stays empty."""
    return drop_repeated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the least doc_id; repeated rows of it stay all. Null and empty texts
    are like nothing; rows with a null doc_id stay; an empty table stays empty."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold nothing; repeated rows go or stay alike, whatever their doc_id; an
    empty table, or benchmark, drops nothing."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences. A null or empty text is the single token that ends a document; repeated rows are
    packed each, rows with a null doc_id too; an empty table has no pieces."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: A learnt classifier, fuzzy lines and packing are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
