"""From raw documents to packed training sequences: five stages over the whole corpus."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from filigree.llm.common import written
from filigree.llm.decontaminate import decontaminated
from filigree.llm.jaccard import one_per_group
from filigree.llm.lines import clean_lines
from filigree.llm.packing import pack_documents
from filigree.llm.toxicity import clean_documents
from filigree.sources.tables import table

TOKENIZER, END_ID, SEQUENCE = public_tokenizers.path("word_bpe_49k.json"), 0, 2048


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't predict toxic."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line repeats."""
    return clean_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return pack_documents(docs, TOKENIZER, END_ID, SEQUENCE)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Toxicity scores and packing have no SQL form; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
