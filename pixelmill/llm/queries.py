"""The registered queries of this subpackage, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import audit, bpe, decontamination, langid, licenses, line_dedup, lm, mixing, quality, sharding, simhash, suffix_dedup, trie
from pixelmill.llm.common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return counted.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("part"))
    return audit.interactions(docs, table(spark, sf_dir, "labels")).drop("letter")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.report(table(spark, sf_dir, "documents"), bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("a", "b")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_line_dedup, op3_lm_scoring, op4_simhash, op5_quality_rules, op6_decontamination, op7_suffix_dedup, op8_mixing, op9_licenses, op10_sharding, op11_filter_audit, op12_byte_bpe, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": audit.ORACLE, "op5_quality_rules": quality.ORACLE, "op6_decontamination": decontamination.ORACLE, "op8_mixing": mixing.ORACLE, "op13_conversation_trie": trie.ORACLE}
