"""From raw documents to packed windows: language ID, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessarine.llm import language_id, near_dedup, packing, secret_scan
from tessarine.llm.common import cut, table
from tessarine.llm.queries import WINDOW


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages stay; those without words or in no known language go."""
    return language_id.keep_accepted(docs, language_id.fit_on(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    return near_dedup.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values that are hard to guess in a credential context are replaced by a mask."""
    return secret_scan.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The boundary records of the packed windows."""
    return packing.pack(docs, WINDOW)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack_windows),
]

#: Language models, signatures and guess costs cannot be written in SQL; tests/llm compares
#: the stages to brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
