"""Row-local pixel operators: projections and filters, at most a join with one row per image.

``pixels`` is dense: width * height rows per image. Operators that change sizes return (images, pixels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelmill.functions.args import ID, bind, sizes
from pixelmill.functions.scalars import IMAGE_EXTENSIONS, Arg, anchor, col, color_distance, rgba

CHANNELS = ("r", "g", "b", "a")


def note(df: DataFrame, op: str, status: Column | str, message: Column | str) -> DataFrame:
    """One row per row of ``df`` in the shape of ``notes``."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        ID, F.lit(op).alias("op"), F.lit(0).alias("seq"), text(status).alias("status"), text(message).alias("message"), F.lit(None).cast("bigint").alias("elapsed_ms")
    )


def to_rgb8(pixels: DataFrame) -> DataFrame:
    """Composite on white, opaque afterwards."""
    mixed = {c: F.expr(f"cast(({c} * a + 255 * (255 - a)) div 255 as int)") for c in "rgb"}
    return pixels.withColumns(mixed | {"a": F.lit(255)})


def to_gray8(pixels: DataFrame) -> DataFrame:
    """Luma in all three channels; alpha is dropped, not composited."""
    luma = F.expr("cast((2126 * r + 7152 * g + 722 * b) div 10000 as int)")
    return pixels.withColumns({"_l": luma}).withColumns({"r": F.col("_l"), "g": F.col("_l"), "b": F.col("_l"), "a": F.lit(255)}).drop("_l")


def convert(images: DataFrame, pixels: DataFrame, fmt: str = "png", color_mode: str = "keep") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, pixels, notes) in another format (unknown: png) and colour mode keep, rgb8 or gray8."""
    fmt = fmt if fmt in IMAGE_EXTENSIONS else "png"
    notes = note(images.where(F.col("format") == fmt), "convert", "ok", f"already {fmt}")
    changed = {"rgb8": to_rgb8, "gray8": to_gray8}.get(color_mode)
    out = images.withColumn("format", F.lit(fmt))
    if changed:
        out = out.withColumn("has_alpha", F.lit(False))
    return out, changed(pixels) if changed else pixels, notes


def remove_color(pixels: DataFrame, color: str | Column, threshold: Arg = 16, images: DataFrame | None = None) -> DataFrame:
    """Clear every pixel within ``threshold`` of the colour in each channel; RGB stays. A clear colour: no change."""
    if isinstance(color, str) and rgba(color)[3] == 0:
        return pixels
    names = pixels.columns
    pixels, arg = bind(pixels, images, color=color, threshold=threshold)
    hit = (color_distance(F.col("r"), F.col("g"), F.col("b"), arg["color"]) <= arg["threshold"]) & (arg["color"]["a"] != 0)
    return pixels.withColumn("a", F.when(hit, F.lit(0)).otherwise(F.col("a"))).select(*names)


def flip_rotate(images: DataFrame, pixels: DataFrame, flip_h: bool = False, flip_v: bool = False, rotate: int = 0) -> tuple[DataFrame, DataFrame]:
    """Flip, then rotate clockwise by 0, 90, 180 or 270 (any other angle: 0)."""
    names, w, h = pixels.columns, F.col("_w"), F.col("_h")
    x = w - 1 - F.col("x") if flip_h else F.col("x")
    y = h - 1 - F.col("y") if flip_v else F.col("y")
    turned = {90: (h - 1 - y, x), 180: (w - 1 - x, h - 1 - y), 270: (y, w - 1 - x)}.get(rotate, (x, y))
    moved = pixels.join(sizes(images), ID).withColumns({"x": turned[0].cast("int"), "y": turned[1].cast("int")}).select(*names)
    if rotate in (90, 270):
        images = images.withColumns({"width": F.col("height"), "height": F.col("width")})
    return images, moved


def crop_boxes(images: DataFrame, pixels: DataFrame, boxes: DataFrame, keys: tuple[str, ...] = (ID,)) -> tuple[DataFrame, DataFrame]:
    """Cut ``boxes(keys..., x0, y0, w, h)`` out of their images; more columns of boxes in ``keys`` stay.

    An image with several boxes (more ``keys``) meets them row by row, so a pixel meets the boxes of its row alone.
    """
    names = [*keys, *(c for c in pixels.columns if c not in keys)]
    inside, rows, on = "x >= x0 and x < x0 + w and y >= y0 and y < y0 + h", boxes, [ID]
    if len(keys) > 1:
        inside, on = "x >= x0 and x < x0 + w", [ID, "y"]
        rows = boxes.where("h > 0").withColumn("y", F.explode(F.expr("sequence(y0, y0 + h - 1)")))
    cut = pixels.join(rows, on).where(inside).withColumns({"x": F.expr("x - x0"), "y": F.expr("y - y0")}).select(*names)
    out = images.join(boxes, ID).withColumns({"width": F.col("w"), "height": F.col("h")})
    return out.select(*[c for c in keys if c not in images.columns], *images.columns), cut


def _anchored(images: DataFrame, w: Column, h: Column, where: str) -> DataFrame:
    fx, fy = anchor(where)
    at = lambda whole, part, f: F.round((whole - part) * F.lit(f)).cast("int")
    return images.withColumns({"w": w.cast("int"), "h": h.cast("int")}).select(
        ID, at(F.col("width"), F.col("w"), fx).alias("x0"), at(F.col("height"), F.col("h"), fy).alias("y0"), "w", "h"
    )


def crop_ratio(images: DataFrame, pixels: DataFrame, rw: Arg = 16, rh: Arg = 9, where: str = "center") -> tuple[DataFrame, DataFrame]:
    """The largest box of the ratio, at one of nine anchors."""
    w, h, target = F.col("width"), F.col("height"), col(rw).cast("double") / col(rh).cast("double")
    wide = w / h > target
    fit = lambda v, most: F.greatest(F.lit(1), F.least(most, F.round(v).cast("int")))
    return crop_boxes(images, pixels, _anchored(images, F.when(wide, fit(h * target, w)).otherwise(w), F.when(wide, h).otherwise(fit(w / target, h)), where))


def crop_size(images: DataFrame, pixels: DataFrame, w: Arg = 512, h: Arg = 512, where: str = "center") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A box of the size, no larger than the image; (images, pixels, notes on smaller images)."""
    w, h = F.greatest(F.lit(1), col(w)), F.greatest(F.lit(1), col(h))
    small = images.where((F.col("width") < w) | (F.col("height") < h))
    boxes = _anchored(images, F.least(w, F.col("width")), F.least(h, F.col("height")), where)
    return *crop_boxes(images, pixels, boxes), note(small, "crop", "ok", "the image is smaller than the box")


def crop_regions(images: DataFrame, pixels: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes of a table, any number per image; numbered by ``piece`` from 1 in order of (y, x, h, w, shape).

    Boxes are clamped into the image and hold a pixel at least. ``ellipse`` clears what lies outside of the
    ellipse in the box; RGB stays.
    """
    clamp = lambda v, low, high: F.greatest(low, F.least(high, v))
    met = regions.join(sizes(images), ID)
    placed = met.withColumns({"x0": clamp(F.col("x"), F.lit(0), F.col("_w") - 1), "y0": clamp(F.col("y"), F.lit(0), F.col("_h") - 1)})
    boxed = placed.withColumns({"w": clamp(F.col("w"), F.lit(1), F.col("_w") - F.col("x0")), "h": clamp(F.col("h"), F.lit(1), F.col("_h") - F.col("y0"))})
    order = Window.partitionBy(ID).orderBy("y0", "x0", "h", "w", "shape")
    boxes = boxed.select(ID, F.row_number().over(order).alias("piece"), "x0", "y0", "w", "h", "shape")
    out, cut = crop_boxes(images, pixels, boxes, (ID, "piece", "w", "h", "shape"))
    off = lambda v, size: F.pow((F.col(v) + 0.5 - F.col(size) / 2) / (F.col(size) / 2), F.lit(2.0))
    outside = (F.col("shape") == "ellipse") & (off("x", "w") + off("y", "h") > 1)
    cut = cut.withColumn("a", F.when(outside, F.lit(0)).otherwise(F.col("a"))).select(ID, "piece", *[c for c in pixels.columns if c != ID])
    return out.drop("w", "h", "shape"), cut


def pieces_as_images(images: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give each (image_id, piece) an image_id of its own; the old one is ``parent_id`` of images."""
    new = F.xxhash64(ID, "piece")
    return images.withColumns({"parent_id": F.col(ID), ID: new}).drop("piece"), pixels.withColumn(ID, new).drop("piece")


def transparency(pixels: DataFrame) -> DataFrame:
    """image_id, has_transparency, fully_opaque."""
    return pixels.groupBy(ID).agg(F.bool_or(F.col("a") != 255).alias("has_transparency"), F.bool_and(F.col("a") == 255).alias("fully_opaque"))
