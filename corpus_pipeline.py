"""A corpus pipeline: quality classifier, quality rules, near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of docs.  What a stage drops: texts that the classifier, trained on the labels of the rows it gets, scores under its
threshold; texts that the repetition rules reject; of each group of near-duplicates all but the document with the smallest
doc_id; documents with a leaked benchmark item.  The last returns (doc_id, n_tokens, ids_sha256, decoded_sha256).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsearch.llm import bpe, decontam, neardup, quality, repeats
from docsearch.llm.common import materialise, table
from docsearch.llm.queries import tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, *tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_level_bpe", tokens),
]

#: No SQL can express the classifier; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
