"""From raw documents to sharded training rows, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Stages but the last
return the columns of ``documents``, and an empty table for an empty one; columns that clash with those an operator
makes stay as they were. SimHash fingerprints, consistent hashing and Wu-Manber tables have no
SQL form here (DuckDB lacks XXH64 and CRC32), so ORACLE_SQL is None and tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import decontamination, mixing, quality, sharding, simhash
from pixelmill.llm.common import table
from pixelmill.plans.storage import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null, empty and short texts are rejected; repeated rows are judged each."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    judged = quality.quality_rules(docs.select("text", row.alias("row"))).where("kept")
    return judged.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest doc_id, nulls last.

    Near copies have a Jaccard similarity of 0.8 or more over shingles of five words, checked on whole texts; texts
    without words are copies of each other. Rows with one doc_id and different texts are judged by their texts.
    """
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go, those of benchmark rows without item_id too. Null texts have none."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    found = decontamination.contamination(docs.select("text", row.alias("row")), table(spark, sf_dir, "benchmark"))
    return found.where("size(hit_spans) = 0").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or dropped so that sources meet their target weights; a null source is one source."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining row with its shard and its place there; repeated rows take places of their own."""
    return sharding.sharded_documents(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs, home = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
