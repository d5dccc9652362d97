"""Mixing sources to target weights: repetition rates, whole copies and one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import words
from pixelmill.plans.ranks import global_rank
from pixelmill.plans.storage import materialize

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), (3, 2), 2, 23


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """``sizes(source, size)`` -> source, source_size, target.

    Sources in code-point order, null last, take the weights in turn. They share ``share`` (a fraction) of
    all sizes; where that passes ``most`` times a source's size, the target stops there and the excess is
    shared again by weight among the rest, until no target is above. Each round is one aggregate over the
    per-source table; only its sums reach the driver, however many sources there are.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()])
    turn = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int"))
    table = materialize(ranked.select("source", "source_size", turn.alias("weight")))
    num, den = share
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total, weight = (int(x or 0) for x in table.agg(F.sum("source_size"), F.sum("weight")).first())
    capped, above, scale = 0, F.lit(False), (total * num, weight * den)
    while scale[1]:
        # weight * scale[0] / scale[1] > most * source_size, in whole numbers
        above = wide("weight") * F.lit(scale[0]).cast("decimal(38,0)") > wide("source_size") * F.lit(most * scale[1]).cast("decimal(38,0)")
        count, size, left = table.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if count == capped:
            break
        capped, scale = count, (total * num - den * most * int(size or 0), int(left or 0) * den)
    shared = (wide("weight") * F.lit(scale[0]).cast("decimal(38,0)")).cast("double") / F.lit(float(scale[1] or 1))
    return table.select("source", "source_size", F.when(above, (F.col("source_size") * most).cast("double")).otherwise(shared).alias("target"))


def mix_counts(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",), **more) -> DataFrame:
    """``keep``, source, size, source_size, target and ``copies`` of every document.

    copies = floor(rate) + 1 with the probability of the rate's fraction, drawn from a hash of doc_id, so a
    rerun agrees; rows without doc_id draw by their texts. Null texts have size 0; null sources are one source; a
    source without words has target 0. Repeated rows draw alike; an empty table gives no rows; columns of ``docs``
    that aren't in ``keep`` play no part, whatever their names.
    """
    counted = materialize(sized(docs, tuple(dict.fromkeys((*keep, "source"))), seed))
    return with_copies(counted, counted, **more).select(*keep, *([] if "source" in keep else ["source"]), "size", "source_size", "target", "copies")


def sized(docs: DataFrame, keep: tuple[str, ...], seed: int) -> DataFrame:
    draw = uniform(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit(""))))), seed)
    return docs.select(*keep, F.size(words(F.col("text"))).cast("long").alias("size"), draw.alias("_draw"))


def with_copies(rows: DataFrame, sizes: DataFrame, **more) -> DataFrame:
    """``rows`` of ``sized`` with source_size, target and copies, by the totals of ``sizes``."""
    targets = source_targets(sizes, **more).withColumnRenamed("source", "_source")
    met = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = F.col("_draw") < F.col("_rate") - F.floor("_rate")
    return met.withColumn("_rate", rate).withColumn("copies", (F.floor("_rate") + extra.cast("int")).cast("long")).drop("_rate", "_draw")


def mix(docs: DataFrame, seed: int = SEED, **more) -> DataFrame:
    """The mixed documents themselves: every row as often as its copies say, columns unchanged, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    sizes = sized(docs.select("doc_id", "source", "text"), ("source",), seed)
    counted = with_copies(sized(docs.select("doc_id", "source", "text", row.alias("_row")), ("source", "_row"), seed), sizes, **more)
    out = [F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return counted.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*out)


# DuckDB: water filling in closed form; sources sorted by size per weight are capped up to some point
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS key, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, (SELECT sum(source_size) FROM s) AS total,
    coalesce(sum(source_size) OVER w, 0) AS before, sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s WINDOW w AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT 3 * total - 4 * before AS num, rest FROM o
  WHERE NOT weight * (3 * total - 4 * before) > 4 * source_size * rest ORDER BY source_size / weight, source LIMIT 1
), t AS (
  SELECT s.source, source_size, CASE WHEN weight * num > 4 * source_size * rest THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(weight * num AS DOUBLE) / CAST(2 * rest AS DOUBLE) END AS target FROM s, f
), r AS (
  SELECT d.doc_id, d.key, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  CAST(CAST('0x' || substr(md5('{SEED}:' || key), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
