"""Arguments that are a literal for all images or a column evaluated per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.scalars import col, parse_color

ID = "image_id"


def bind(pixels: DataFrame, images: DataFrame | None, **args) -> tuple[DataFrame, dict[str, Column]]:
    """Columns for the arguments: literals cost nothing, columns of ``images`` are joined by image_id.

    The argument ``color`` is text; it arrives as a struct, parsed on the driver if it is a literal.
    """
    per_image = {k: parse_color(v) if k == "color" else v for k, v in args.items() if isinstance(v, Column)}
    values = {k: parse_color(v) if k == "color" else col(v) for k, v in args.items() if k not in per_image}
    if per_image:
        if images is None:
            raise ValueError("arguments that are columns need the images table")
        pixels = pixels.join(images.select(ID, *[v.alias(f"_arg_{k}") for k, v in per_image.items()]), ID)
        values |= {k: F.col(f"_arg_{k}") for k in per_image}
    return pixels, values


def sizes(images: DataFrame) -> DataFrame:
    return images.select(ID, F.col("width").alias("_w"), F.col("height").alias("_h"))
