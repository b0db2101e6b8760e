"""A training corpus from raw documents: identified language, no copies, no near copies, no benchmark text, packed.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm import common, decontamination, exact_dedup, jaccard_join, language_id, packing, queries
from sievemark.llm.common import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those of which no learned language has half."""
    return language_id.keep_identified(docs, language_id.Mixtures(language_id.gram_counts(docs)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the largest doc_id stays, of repeated rows one.

    Null text counts as empty, a null id is the smallest. All columns stay, whatever their names.
    """
    return exact_dedup.drop_copies(docs, scratch=Scratch(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked at five-word Jaccard 0.8 the one with the smallest doc_id stays.

    Texts without words, null and empty ones link with nothing and stay, as do rows with a null id. Repeated rows share
    an id and stay together. An empty table gives an empty one.
    """
    return jaccard_join.representatives(docs, jaccard_join.jaccard_components(docs))


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item; null and empty texts and all columns stay.

    Repeated rows go or stay together. With an empty benchmark or table nothing goes.
    """
    return decontamination.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens of what is left into sequences; the columns are those of the packing query.

    Null and empty texts hold the end id alone; repeated rows are packed like any other; an empty table gives no rows.
    """
    return packing.pack_documents(docs, queries.tokenizer_path(), capacity=queries.SEQUENCE_TOKENS, end_id=queries.END_ID)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("packing", pack),
]

#: Language ID and packing have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next.

    A stage's own tables and its predecessor's result are deleted as soon as its result is there.
    """
    docs, before = queries.table(spark, sf_dir, "documents"), common.kept_roots()
    for name, stage in STAGES:
        after = Scratch(spark)
        docs = after.keep(stage(spark, docs, sf_dir), f"{name}-{uuid.uuid4().hex[:6]}")
        common.forget(spark, common.kept_roots() - before - {after.root})
    return docs
