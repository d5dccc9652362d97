"""Image tables derived from the given tables: small sprites from embeddings, tall images from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, WIDTH = 8, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images: one pixel per element of an embedding, clear, half clear or opaque."""
    each = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    q = each.withColumn("v", F.col("e").cast("double")).withColumn("q", F.floor((F.col("v") + 1.0) * 128.0).cast("int"))
    a = F.when(F.col("v") < -0.05, 0).when(F.col("v") < 0, 128).otherwise(255)
    return q.select(
        "image_id", (F.col("i") % SIDE).cast("int").alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), F.col("q").alias("r"), (F.col("q") * 7 % 256).alias("g"), (F.col("q") * 13 % 256).alias("b"), a.alias("a")
    )


def emb_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vec.alias("image_id"),
        F.concat(F.lit("emb-"), vec.cast("string"), F.lit(".png")).alias("origin"),
        F.when(vec % 3 == 0, F.concat(F.lit("sprite"), vec.cast("string"))).alias("name_stem"),
        F.lit(True).alias("name_auto_ext"),
        F.lit("png").alias("format"),
        F.lit(SIDE).alias("width"),
        F.lit(SIDE).alias("height"),
        F.lit(True).alias("has_alpha"),
        (vec * 37 % 1000 + 100).cast("bigint").alias("byte_len"),
        vec.cast("bigint").alias("seq"),
    )


def doc_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images 32 wide: one pixel per character of a text, clear where it is a space; clear pixels fill the last row up.

    Texts are dealt by id before they explode: what later groups or windows by image finds its pixels together,
    and only the compact form has moved.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where("text <> ''")
    whole = F.expr(f"rpad(text, (char_length(text) + {WIDTH - 1}) div {WIDTH} * {WIDTH}, ' ')")
    each = docs.repartition("doc_id").select("doc_id", F.posexplode(F.split(whole, "")).alias("i", "c")).withColumn("q", F.ascii("c"))
    return each.select(
        F.col("doc_id").alias("image_id"),
        (F.col("i") % WIDTH).cast("int").alias("x"),
        F.expr(f"cast(i div {WIDTH} as int)").alias("y"),
        (F.col("q") % 256).alias("r"),
        (F.col("q") * 7 % 256).alias("g"),
        (F.col("q") * 13 % 256).alias("b"),
        F.when(F.col("q") == 32, 0).otherwise(255).alias("a"),
    )


def doc_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("n")).where("n > 0")
    return docs.select(
        F.col("doc_id").alias("image_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".png")).alias("origin"),
        F.lit(None).cast("string").alias("name_stem"),
        F.lit(True).alias("name_auto_ext"),
        F.lit("png").alias("format"),
        F.lit(WIDTH).alias("width"),
        F.expr(f"cast((n + {WIDTH - 1}) div {WIDTH} as int)").alias("height"),
        F.lit(True).alias("has_alpha"),
        F.col("n").cast("bigint").alias("byte_len"),
        F.col("doc_id").alias("seq"),
    )


# DuckDB: the same tables as common table expressions
PX = """px AS (
  SELECT vec_id AS image_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, q AS r, (q * 7) % 256 AS g, (q * 13) % 256 AS b,
    CASE WHEN v < -0.05 THEN 0 WHEN v < 0 THEN 128 ELSE 255 END AS a
  FROM (SELECT vec_id, i, v, CAST(floor((v + 1.0) * 128.0) AS INT) AS q
    FROM (SELECT vec_id, u.i - 1 AS i, CAST(embedding[u.i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u)))"""
IM = """im AS (
  SELECT vec_id AS image_id, 'emb-' || vec_id || '.png' AS origin, CASE WHEN vec_id % 3 = 0 THEN 'sprite' || vec_id END AS name_stem, true AS name_auto_ext,
    'png' AS format, 8 AS width, 8 AS height, true AS has_alpha, CAST(vec_id * 37 % 1000 + 100 AS BIGINT) AS byte_len, CAST(vec_id AS BIGINT) AS seq FROM embeddings)"""
DPX = """dpx AS (
  SELECT doc_id AS image_id, CAST(i % 32 AS INT) AS x, CAST(i // 32 AS INT) AS y, c % 256 AS r, (c * 7) % 256 AS g, (c * 13) % 256 AS b, CASE WHEN c = 32 THEN 0 ELSE 255 END AS a
  FROM (SELECT doc_id, i, unicode(ch) AS c FROM (SELECT doc_id, unnest(chars) AS ch, unnest(range(0, len(chars))) AS i
    FROM (SELECT doc_id, string_split(text || repeat(' ', (32 - length(text) % 32) % 32), '') AS chars FROM documents WHERE text <> ''))))"""
