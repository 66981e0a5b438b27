"""A corpus pipeline: quality rules, language identification, line dedup, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import materialise
from tallyloom.llm.language_id import UNKNOWN, identify_languages, labelled_samples
from tallyloom.llm.line_frequency import rule_documents, without_lines
from tallyloom.llm.line_templates import drop_recurring_lines
from tallyloom.llm.near_duplicates import near_duplicates
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.queries import tokenizer_file

#: The columns of documents, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by lines frequent in their host,
    without those lines; n_chars follows the text that is left.

    Every row has its own verdict and carries its text along, so nothing is joined back: repeated rows
    stay or go together, null text goes (it has no words), and a null doc_id does not matter.
    """
    told = rule_documents(docs.select(*COLUMNS), carry=("text", "lang", "source", "n_chars"), with_places=True).where("kept")
    cut = F.size("removed_lines") > 0
    text = F.when(cut, without_lines(F.col("text"), F.col("removed_lines"))).otherwise(F.col("text"))
    length = F.when(cut, F.length(F.col("_text")).cast("long")).otherwise(F.col("n_chars"))
    return told.withColumn("_text", text).select("doc_id", F.col("_text").alias("text"), "lang", "source", length.alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the labelled ones have; those of unknown language go.

    Decided row by row without a shuffle; lang itself stays as it is. Where nothing is labelled no
    language can be told, and all documents with a letter stay.
    """
    samples = labelled_samples(docs)
    if not samples:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    docs = docs.select(*COLUMNS).withColumn("_all", F.struct(*COLUMNS))
    told = identify_languages(docs, carry=("_all",), samples=samples)
    return told.where(F.col("lang_pred") != UNKNOWN).select("_all.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs; those left without a word go.

    n_chars follows the text that is left.
    """
    cut = drop_recurring_lines(docs.select(*COLUMNS), min_tokens=1).where(~F.col("emptied"))
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id.

    Of repeated rows of one doc_id one stays. Rows without a doc_id cannot stand for a group and go.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("line dedup", line_dedup),
    ("near duplicates", near_dedup),
    ("packing", packing),
]

#: Suffix automata, signatures and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
