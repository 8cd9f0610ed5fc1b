"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdwright.llm import bpe, chat, contamination, fingerprints, jaccard, lines, periods, quality, spelling, sql, substrings, surrogates, toxicity, warc
from holdwright.llm.tables import table

TOKENIZERS = "/opt/tokenizers"


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_back(warc.archive_pages(table(spark, folder, "pages")))


def op2_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace(docs, "a key that the owner of the corpus keeps")


def op3_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.removed_lines(table(spark, folder, "documents"))


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_components(table(spark, folder, "documents"))


def op5_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    marked = fingerprints.edited_fingerprints(table(spark, folder, "documents"))
    return fingerprints.near_counts(marked, F.col("doc_id") % 100 == 0)


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    return periods.detect(table(spark, folder, "documents"), output="digests", planted=True)


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_surrogates": op2_surrogates,
    "op3_lines": op3_lines,
    "op4_jaccard": op4_jaccard,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_fingerprints": op7_fingerprints,
    "op8_bpe": op8_bpe,
    "op9_substrings": op9_substrings,
    "op10_decontamination": op10_decontamination,
    "op11_toxicity": op11_toxicity,
    "op12_periods": op12_periods,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {
    "op1_warc": sql.OP1,
    "op4_jaccard": sql.OP4,
    "op5_chat": sql.OP5,
    "op9_substrings": sql.OP9,
    "op13_spelling": sql.OP13,
}
