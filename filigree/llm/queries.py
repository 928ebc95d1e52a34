"""The registered queries of this subpackage, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from filigree.llm.collocations import collocations
from filigree.llm.decontaminate import contaminated
from filigree.llm.fingerprints import fingerprints
from filigree.llm.graph_ann import nearest
from filigree.llm.html_crf import main_texts
from filigree.llm.jaccard import jaccard_join
from filigree.llm.licenses import license_scan, templates
from filigree.llm.lines import line_report
from filigree.llm.packing import pack_documents
from filigree.llm.simple8b import token_file_digest
from filigree.llm.spellings import spelling_groups
from filigree.llm.substrings import substring_dedup
from filigree.llm.toxicity import toxicity
from filigree.sources.tables import table

BYTE_TOKENIZER, BYTE_END = public_tokenizers.path("byte_bpe_50k.json"), 2
WORD_TOKENIZER, WORD_END, SEQUENCE = public_tokenizers.path("word_bpe_49k.json"), 0, 2048


def op1_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_dice_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), templates(spark))


def op3_spaced_seed_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op5_crf_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op6_doubling_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_chosen_path_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op8_deletion_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op9_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, BYTE_END)


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), WORD_TOKENIZER, WORD_END, SEQUENCE)


def op11_dynamic_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_letter_count_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_peeled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_factorization_toxicity,
        op2_dice_license_scan,
        op3_spaced_seed_contamination,
        op4_pruned_graph_neighbours,
        op5_crf_html_text,
        op6_doubling_substring_dedup,
        op7_chosen_path_jaccard,
        op8_deletion_line_dedup,
        op9_simple8b_tokens,
        op10_pattern_packing,
        op11_dynamic_collocations,
        op12_letter_count_spellings,
        op13_peeled_fingerprints,
    )
}
