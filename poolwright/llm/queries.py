"""The registered queries of the training-data operators: thin calls with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ctph, html_text, jaccard_join, lang_id, mixing, packing, pii, quality_lines, substring_dedup, token_files
from .common import read_table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read_table(spark, sf_dir, "documents"))


def op2_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprints(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), percent=90, n=3)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op9_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.line_quality(read_table(spark, sf_dir, "documents"), host="source")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_index(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)


QUERIES = {
    "op1_lang_id": op1_lang_id,
    "op2_ctph": op2_ctph,
    "op3_pii": op3_pii,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_text": op5_html_text,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_quality_lines": op9_quality_lines,
    "op10_token_files": op10_token_files,
}
ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op6_jaccard_join": jaccard_join.ORACLE,
    "op9_quality_lines": quality_lines.ORACLE,
}
