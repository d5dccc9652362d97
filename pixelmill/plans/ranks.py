"""Global ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelmill.plans.storage import materialize


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rank all rows from 0 without one task seeing them all: range partitions, their counts, offsets.

    Only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_part")) if offsets else F.lit(0).cast("long")
    return dealt.withColumn(name, start + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part")


def rank_in_groups(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rank the rows of each group from 1. A group is spread over range partitions; rows with equal ``order`` get any rank.

    Only groups that go on in a further partition, one each at most, need the rows that came before.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"))
    begun = counts.withColumn("_rows", F.sum("_rows").over(earlier)).where("_rows is not null").select("_rows", F.struct(*keys, "_part").alias("_of"))
    placed = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    whole = placed.join(F.broadcast(begun), F.struct(*keys, "_part").eqNullSafe(F.col("_of")), "left")
    return whole.withColumn(name, F.col(name) + F.coalesce("_rows", F.lit(0))).drop("_rows", "_of", "_part")
