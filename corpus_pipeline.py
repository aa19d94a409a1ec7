"""From raw documents to training sequences, in four stages that each read what the one before kept.

language   documents of no language go (null texts, texts without a letter)
dedup      of documents linked by SimHash, the one of the least doc_id stays
benchmark  documents that hold a benchmark item go
packing    what is left, in sequences of 2048 tokens: a row per piece

Documents without an id pass all stages but the first as any others. Repeated rows are near
duplicates of each other. Without any usable label every text with a letter stays. An empty table
gives no rows. Extra columns stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import decontaminate, language, packing, simhash
from turnloom.llm.common import materialise, table
from turnloom.llm.queries import vocabulary

#: The packing stage has no SQL, so there is none for the rows of run(); tests hold it against brute force.
ORACLE_SQL = None


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. The model learns from the labelled rows of the documents that come in."""
    return language.keep_identified(docs, language.learn(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0)


STAGES = [("language", by_language), ("dedup", deduplicated), ("benchmark", decontaminated), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
