"""From raw documents to packed training windows: each stage works on all that the one before it kept.

``ORACLE_SQL`` is None: fingerprints, transforms and tokenisers are not expressible in SQL; the tests compare near-duplicates, repeats
and packing with brute force on the smallest table, and the other stages with their operators' own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm import packing, pii, repeats, similar, toxicity
from askwell.llm.common import removed, table, written

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, chain, prefix="__p_")
    return scored.where(F.col("__p_toxic") <= toxicity.REJECT).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return similar.one_of_each_group(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that start in a document with a smaller id."""
    return repeats.without_repeats(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms."""
    return pii.pseudonymise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder, read by the next, and removed behind it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
        if k:
            removed(before)  # the last stage has read it, too: it packs a written table of tokens
    return docs
