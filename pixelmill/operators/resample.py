"""Resizing: nearest by exploding source pixels, filters by weighted sums over kernel tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelmill.functions.args import ID, sizes
from pixelmill.functions.scalars import Arg, col
from pixelmill.operators.pixels import CHANNELS, note

# fixed values: most pixels of a resized image, the channel statistics of the model input
MOST_PIXELS = 64_000_000
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
SUPPORT = {"triangle": 1.0, "catmullRom": 2.0, "gaussian": 3.0, "lanczos3": 3.0}


def _targets(images: DataFrame, w: Column, h: Column) -> DataFrame:
    return images.withColumns({"_ow": w.cast("int"), "_oh": h.cast("int")})


def resize_nearest(images: DataFrame, pixels: DataFrame, w: Arg, h: Arg) -> tuple[DataFrame, DataFrame]:
    """Output o shows source floor((o + 0.5) * in / out).

    Solved for o, each source pixel owns a run of outputs (none when shrinking past it), so pixels explode in
    place: no target grid, no shuffle of pixels for literal sizes.
    """
    to = _targets(images, col(w), col(h))
    size = to.select(ID, F.col("width").alias("_w"), F.col("height").alias("_h"), "_ow", "_oh")
    names = pixels.columns
    low = lambda s, n, out: f"cast((2 * cast({s} as bigint) * {out} + {n} - 1) div (2 * {n}) as int)"
    edges = {"_x0": low("x", "_w", "_ow"), "_x1": low("(x + 1)", "_w", "_ow"), "_y0": low("y", "_h", "_oh"), "_y1": low("(y + 1)", "_h", "_oh")}
    met = pixels.join(size, ID).withColumns({k: F.expr(v) for k, v in edges.items()}).where("_x1 > _x0 and _y1 > _y0")
    spread = met.withColumn("y", F.explode(F.expr("sequence(_y0, _y1 - 1)"))).withColumn("x", F.explode(F.expr("sequence(_x0, _x1 - 1)"))).select(*names)
    return to.withColumns({"width": F.col("_ow"), "height": F.col("_oh")}).select(*images.columns), spread


def _scaled(size: str, percent: Column) -> Column:
    return F.greatest(F.lit(1), F.round(F.col(size) * percent / 100).cast("bigint"))


def _clamped(percent: Arg) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(1600.0), col(percent).cast("double")))


def _limited(images: DataFrame, pixels: DataFrame, op: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop images whose target is too large, with a failed note."""
    large = F.col("_ow") * F.col("_oh") > MOST_PIXELS
    text = F.format_string("%d x %d is over the limit of pixels", "_ow", "_oh")
    return images.where(~large), pixels, note(images.where(large), op, "failed", text)


def upscale(images: DataFrame, pixels: DataFrame, percent: Arg = 200, filter: str = "nearest") -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: A002
    """Both sides by ``percent``, 1 to 1600; (images, pixels, notes). Unknown filters are nearest."""
    p = _clamped(percent)
    to = images.withColumns({"_p": p, "_ow": _scaled("width", p), "_oh": _scaled("height", p)})
    fits, kept, failed = _limited(to, pixels, "upscale")
    text = F.when(F.col("_p") == 100, F.lit("at 100 % nothing changes")).when(F.col("_p") < 100, F.lit("below 100 % the image shrinks"))
    notes = failed.union(note(fits.withColumn("_t", text).where("_t is not null"), "upscale", "ok", F.col("_t")))
    resize = resize_nearest if filter not in SUPPORT else lambda i, q, w, h: resize_kernel(i, q, w, h, filter)
    out, spread = resize(fits, kept, F.col("_ow"), F.col("_oh"))
    return out.select(*images.columns), spread, notes


def stretch(images: DataFrame, pixels: DataFrame, w_percent: Arg = 100, h_percent: Arg = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sides by percentages of their own, nearest; 100 and 100 change nothing."""
    if w_percent == 100 and h_percent == 100 and not isinstance(w_percent, Column) and not isinstance(h_percent, Column):
        return images, pixels, note(images.where("false"), "stretch", "ok", "")
    to = images.withColumns({"_ow": _scaled("width", _clamped(w_percent)), "_oh": _scaled("height", _clamped(h_percent))})
    fits, kept, failed = _limited(to, pixels, "stretch")
    out, spread = resize_nearest(fits, kept, F.col("_ow"), F.col("_oh"))
    return out.select(*images.columns), spread, failed


def thumbnails(images: DataFrame, pixels: DataFrame, max_dim: int = 256) -> tuple[DataFrame, DataFrame]:
    """Nearest, so that the longest side is ``max_dim`` at most; smaller images stay."""
    longest = F.greatest("width", "height")
    side = lambda c: F.when(longest <= max_dim, F.col(c)).otherwise(F.greatest(F.lit(1), F.round(F.col(c) * (F.lit(float(max_dim)) / longest)).cast("int")))
    return resize_nearest(images, pixels, side("width"), side("height"))


def kernel(name: str, x: Column) -> Column:
    """The filter's weight at distance x, in source pixels of the scale in use."""
    d = F.abs(x)
    if name == "triangle":
        return F.greatest(F.lit(0.0), F.lit(1.0) - d)
    if name == "catmullRom":
        inner, outer = 1.5 * d * d * d - 2.5 * d * d + 1.0, -0.5 * d * d * d + 2.5 * d * d - 4.0 * d + 2.0
        return F.when(d < 1, inner).when(d < 2, outer).otherwise(F.lit(0.0))
    if name == "gaussian":
        return F.exp(-2.0 * x * x) / (math.sqrt(2 * math.pi) * 0.5)
    sinc = lambda v: F.when(v == 0, F.lit(1.0)).otherwise(F.sin(v * math.pi) / F.when(v != 0, v * math.pi))
    return F.when(d < 3, sinc(x) * sinc(x / 3.0)).otherwise(F.lit(0.0))


def kernel_table(lengths: DataFrame, name: str) -> DataFrame:
    """``lengths(n_in, n_out)`` -> n_in, n_out, at_out, at_in, w: normalised weights, per pair of lengths once."""
    ratio = F.col("n_in") / F.col("n_out")
    scale = F.greatest(ratio, F.lit(1.0))
    at = lengths.distinct().withColumn("at_out", F.explode(F.expr("sequence(0, n_out - 1)"))).withColumns({"_c": (F.col("at_out") + 0.5) * ratio, "_s": scale})
    reach = F.lit(SUPPORT[name]) * F.col("_s")
    left = F.greatest(F.lit(0), F.least(F.col("n_in") - 1, F.floor(F.col("_c") - reach).cast("int")))
    edged = at.withColumn("_l", left).withColumn("_r", F.greatest(F.col("_l") + 1, F.least(F.col("n_in"), F.ceil(F.col("_c") + reach).cast("int"))))
    taps = edged.withColumn("at_in", F.explode(F.expr("sequence(_l, _r - 1)"))).withColumn("_w", kernel(name, (F.col("at_in") - (F.col("_c") - 0.5)) / F.col("_s")))
    total = F.sum("_w").over(Window.partitionBy("n_in", "n_out", "at_out"))
    return taps.select("n_in", "n_out", "at_out", "at_in", (F.col("_w") / total).alias("w")).where("w <> 0")


def resize_kernel(images: DataFrame, pixels: DataFrame, w: Arg, h: Arg, filter: str = "triangle", channels: tuple[str, ...] = CHANNELS, whole: bool = True) -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """Separable filter resize: columns first, then rows; channels are rounded and clamped at the end.

    The kernel table has one entry per pair of lengths, not per image; Spark broadcasts it while it is small.
    """
    to = _targets(images, col(w), col(h))
    size = to.select(ID, F.col("width").alias("_w"), F.col("height").alias("_h"), "_ow", "_oh")
    tall = kernel_table(size.select(F.col("_h").alias("n_in"), F.col("_oh").alias("n_out")), filter)
    wide = kernel_table(size.select(F.col("_w").alias("n_in"), F.col("_ow").alias("n_out")), filter)
    met = pixels.join(size, ID)
    down = met.join(tall, (F.col("_h") == tall["n_in"]) & (F.col("_oh") == tall["n_out"]) & (F.col("y") == tall["at_in"]))
    rows = down.groupBy(ID, "x", "at_out", "_w", "_ow").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in channels]).withColumnRenamed("at_out", "y")
    across = rows.join(wide, (F.col("_w") == wide["n_in"]) & (F.col("_ow") == wide["n_out"]) & (F.col("x") == wide["at_in"]))
    sums = across.groupBy(ID, "at_out", "y").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in channels])
    value = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.round(c, 6)).cast("int"))) if whole else F.col(c)
    out = sums.select(ID, F.col("at_out").alias("x"), "y", *[value(c).alias(c) for c in channels])
    return to.withColumns({"width": F.col("_ow"), "height": F.col("_oh")}).select(*images.columns), out


def apply_mask(images: DataFrame, pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """Stretch each mask to 0..1 (a constant one is clamped instead), scale it to the image, make it alpha."""
    span = masks.groupBy(ID).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    flat = F.col("_high") - F.col("_low") <= 1e-6
    raw = F.when(flat, F.col("value")).otherwise((F.col("value") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-6)))
    gray = masks.join(span, ID).withColumn("a", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 255).cast("int"))
    sized = masks.select(ID, "mask_w", "mask_h").distinct().join(sizes(images), ID)
    mask_images = sized.select(ID, F.col("mask_w").alias("width"), F.col("mask_h").alias("height"), "_w", "_h")
    _, scaled = resize_kernel(mask_images, gray.select(ID, "x", "y", "a"), F.col("_w"), F.col("_h"), "triangle", ("a",))
    names = pixels.columns
    return pixels.drop("a").join(scaled, [ID, "x", "y"]).select(*names)


def model_input(images: DataFrame, pixels: DataFrame, size: int = 320) -> DataFrame:
    """image_id, channel, y, x, value: resized, divided by the peak channel, normalised by mean and deviation."""
    _, small = resize_kernel(images, pixels.select(ID, "x", "y", "r", "g", "b"), size, size, "triangle", ("r", "g", "b"))
    peak = small.groupBy(ID).agg(F.greatest(F.max(F.greatest("r", "g", "b")) / 255.0, F.lit(1.1754943508222875e-38)).alias("_peak"))
    value = lambda c, i: ((F.col(c) / 255.0 / F.col("_peak") - MEAN[i]) / STD[i]).alias(str(i))
    met = small.join(peak, ID).select(ID, "x", "y", *[value(c, i) for i, c in enumerate("rgb")])
    return met.select(ID, F.expr("stack(3, 0, `0`, 1, `1`, 2, `2`) as (channel, value)"), "y", "x").select(ID, "channel", "y", "x", "value")
