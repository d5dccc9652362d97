"""Per-image statistics, comparisons and plans: one aggregation or join each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelmill.functions.args import ID
from pixelmill.functions.scalars import Arg, case, col, gray_bits, min_index_bits, saturate

FLAT = 0.62  # flatness above which a video counts as animation
CRF = {"h264": 23, "h265": 26, "av1": 30, "vp9": 31}


def image_profile(pixels: DataFrame) -> DataFrame:
    """What an image uses and which encodings hold it losslessly.

    image_id, has_alpha, is_gray, colors (distinct RGBA), gray_depth (of opaque gray images), index_bits (up
    to 256 colours), encodings. Colours are grouped before they are counted, so no set of them is built.
    """
    colors = pixels.groupBy(ID, "r", "g", "b", "a").agg(F.lit(1).alias("one"))
    gray = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    base = colors.groupBy(ID).agg(
        F.bool_or(F.col("a") != 255).alias("has_alpha"),
        F.bool_and(gray).alias("is_gray"),
        F.count("*").alias("colors"),
        F.bool_and(F.col("r").isin(0, 255)).alias("_1"),
        F.bool_and(F.col("r") % 85 == 0).alias("_2"),
        F.bool_and(F.col("r") % 17 == 0).alias("_4"),
    )
    depth = F.when(F.col("is_gray") & ~F.col("has_alpha"), gray_bits(F.col("_1"), F.col("_2"), F.col("_4")))
    bits = F.when(F.col("colors") <= 256, min_index_bits(F.col("colors")))
    text = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    alpha, plain, few = F.col("has_alpha"), ~F.col("has_alpha"), F.col("index_bits").isNotNull()
    names = F.array(
        F.when(alpha, F.lit("rgba8")),
        F.when(alpha & F.col("is_gray"), F.lit("gray_alpha8")),
        F.when(plain, F.lit("rgb8")),
        F.when(plain & F.col("is_gray"), text("gray", F.col("gray_depth"))),
        F.when(few, text("indexed", F.col("index_bits"))),
    )
    return base.withColumns({"gray_depth": depth, "index_bits": bits}).withColumn("encodings", F.array_compact(names)).drop("_1", "_2", "_4")


def pixel_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id, compared, different, lossless: pixels of either side without an equal one count as different."""
    keys = [ID, "x", "y"]
    channels = lambda df, n: df.select(*keys, F.struct("r", "g", "b", "a").alias(n))
    met = channels(a, "_a").join(channels(b, "_b"), keys, "full")
    differs = ~F.col("_a").eqNullSafe(F.col("_b"))
    return met.groupBy(ID).agg(F.count("*").alias("compared"), F.count_if(differs).alias("different")).withColumn("lossless", F.col("different") == 0)


def size_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """image_id, before, after, saved (share; null without a baseline), kept_original."""
    met = before.select(ID, F.col("byte_len").alias("before")).join(after.select(ID, F.col("byte_len").alias("after")), ID, "right")
    saved = F.when(F.col("before") > 0, 1 - F.col("after") / F.when(F.col("before") > 0, F.col("before")))
    return met.select(ID, "before", "after", saved.alias("saved"), F.coalesce(F.col("after") >= F.col("before"), F.lit(False)).alias("kept_original"))


def flatness(pixels: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Share of horizontal neighbours with equal RGB, pooled over the images of a group (default: per image)."""
    keys = group or [ID]
    row = Window.partitionBy(ID, "y").orderBy("x")
    rgb = F.struct("r", "g", "b")
    pairs = pixels.withColumn("_same", (F.lag(rgb).over(row) == rgb).cast("int")).where("_same is not null")
    return pairs.groupBy(*keys).agg(F.sum("_same").alias("flat"), F.count("*").alias("pairs")).withColumn("flatness", F.col("flat") / F.col("pairs"))


def encode_plan(probes: DataFrame, preset: str = "balanced", keep_resolution: bool = False, **advanced: Arg) -> DataFrame:
    """``probes`` with codec, crf, speed, aq, audio_kbps and max_height of one of four presets.

    balanced, aggressive, auto (by height and flatness; a null flatness is no animation) or advanced, whose
    codec, crf, speed, aq, audio_kbps and max_height come from the arguments.
    """
    webm, height = F.col("container") == "webm", F.col("height")
    crf_of = lambda c: case([(c == k, v) for k, v in CRF.items()])
    none = F.lit(None).cast("int")
    if preset == "aggressive":
        codec = F.when(webm, F.lit("vp9")).otherwise(F.lit("h265"))
        out = {"codec": codec, "crf": crf_of(codec), "speed": F.lit("slow"), "aq": F.lit("variance"), "audio_kbps": F.lit(128), "max_height": none}
    elif preset == "auto":
        animation = F.coalesce(F.col("flatness") > FLAT, F.lit(False))
        codec = case([(height > 1440, "av1"), (height > 1080, "h265")], "h264")
        most = none if keep_resolution else F.when(height > 1080, F.lit(1080))
        speed = F.when(animation, F.lit("slow")).otherwise(F.lit("medium"))
        out = {"codec": codec, "crf": crf_of(codec) + F.when(animation, 2).otherwise(0), "speed": speed, "aq": F.lit("variance"), "audio_kbps": F.lit(128), "max_height": most}
    elif preset == "advanced":
        asked = col(advanced.get("codec", "auto"))
        codec = F.when(asked.isin(*CRF), asked).otherwise(F.when(webm, F.lit("vp9")).otherwise(F.lit("h264")))
        most = col(advanced.get("max_height", "keep")).cast("string")
        audio = F.greatest(F.lit(32), F.least(F.lit(512), saturate(advanced.get("audio_kbps", 128), "int")))
        crf = F.coalesce(saturate(advanced["crf"], "int"), crf_of(codec)) if "crf" in advanced else crf_of(codec)
        limit = F.when(most.isin("2160", "1440", "1080", "720", "480"), most.try_cast("int"))
        out = {"codec": codec, "crf": crf, "speed": col(advanced.get("speed", "medium")), "aq": col(advanced.get("aq", "auto")), "audio_kbps": audio, "max_height": limit}
    else:
        out = {"codec": F.lit("h264"), "crf": F.lit(CRF["h264"]), "speed": F.lit("medium"), "aq": F.lit("auto"), "audio_kbps": F.lit(128), "max_height": none}
    return probes.withColumns(out)


def bucket_mean(channel: str, weight: str | None = None) -> Column:
    """Rounded mean of a channel over a group, in whole numbers."""
    total = F.sum(F.col(channel) * F.col(weight)) if weight else F.sum(channel)
    n = F.sum(weight) if weight else F.count("*")
    return F.floor((total + F.floor(n / 2)) / n).cast("int").alias(channel)


def palette_count(pixels: DataFrame, threshold: int = 16) -> DataFrame:
    """Colours by pixel count, near ones merged by a grid: image_id, rank (from 1), r, g, b, n.

    The grid's step is ``threshold``; 0 and 1 mean exact colours. Ties go to the smaller colour.
    """
    step = max(int(threshold), 1)
    cell = [F.expr(f"{c} div {step}").alias(f"_{c}") for c in "rgb"]
    means = pixels.where("a <> 0").groupBy(ID, *cell).agg(*[bucket_mean(c) for c in "rgb"], F.count("*").alias("n"))
    order = Window.partitionBy(ID).orderBy(F.desc("n"), "r", "g", "b")
    return means.select(ID, F.row_number().over(order).alias("rank"), "r", "g", "b", "n")


def weighted_colors(pixels: DataFrame, cap: int = 4096) -> DataFrame:
    """image_id, r, g, b, n: distinct colours with counts; beyond ``cap`` per image, means of 4-bit cells."""
    exact = pixels.where("a <> 0").groupBy(ID, "r", "g", "b").agg(F.count("*").alias("n"))
    counted = exact.withColumn("_k", F.count("*").over(Window.partitionBy(ID)))
    coarse = F.col("_k") > cap
    cell = [F.when(coarse, F.shiftright(c, 4)).otherwise(F.col(c)).alias(f"_{c}") for c in "rgb"]
    return counted.groupBy(ID, *cell, "_k").agg(*[bucket_mean(c, "n") for c in "rgb"], F.sum("n").alias("n")).select(ID, "r", "g", "b", "n")
