"""The operators' queries over the driver's tables, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import reference_sql
from tallyloom.llm.archives import archive_pages
from tallyloom.llm.filter_audit import audit_filters
from tallyloom.llm.html_text import extract_pages
from tallyloom.llm.language_id import identify_languages
from tallyloom.llm.line_frequency import rule_documents
from tallyloom.llm.line_templates import drop_recurring_lines
from tallyloom.llm.near_duplicates import near_duplicates
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.pieces import encode_documents
from tallyloom.llm.sharding import shard_documents
from tallyloom.llm.simhash import near_prints
from tallyloom.llm.token_alignment import align_tokenizers
from tallyloom.llm.topk import exact_top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op2_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs, min_tokens=1)


def op3_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_documents(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op6_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def op7_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op9_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op10_impact_ordered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op11_postings_cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_prints(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_hilbert_sharding,
        op2_template_line_dedup,
        op3_line_frequency_rules,
        op4_harmonic_packing,
        op5_cross_parsing_language,
        op6_piece_coding,
        op7_bayesian_minhash,
        op8_arc_to_warc,
        op9_text_density,
        op10_impact_ordered_top_k,
        op11_postings_cogroup,
        op12_simhash_trie,
        op13_filter_audit,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_hilbert_sharding": reference_sql.SHARDS,
        "op3_line_frequency_rules": reference_sql.RULES,
        "op7_bayesian_minhash": reference_sql.NEAR_DUPLICATES,
        "op8_arc_to_warc": reference_sql.ARCHIVES,
        "op10_impact_ordered_top_k": reference_sql.TOP_K,
        "op13_filter_audit": reference_sql.FILTER_AUDIT,
    }
