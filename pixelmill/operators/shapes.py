"""Whole-image operators on runs of pixels: bounds, outlines, components, flood fill, splitting."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelmill.functions.args import ID, bind, sizes
from pixelmill.functions.scalars import Arg, color_distance, rgba, saturate
from pixelmill.operators.pixels import crop_boxes, note
from pixelmill.operators.tiles import TILE, dilated
from pixelmill.plans.graph import connected_components
from pixelmill.plans.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

FEATHER = 24
MOST_RUNS = 1_000_000  # of an image, that one task sweeps
ROW = 1 << 32  # a run's id is y * ROW + x0: ids order like pixels, whatever the width


def content_bounds(pixels: DataFrame) -> DataFrame:
    """image_id, x0, y0, x1, y1 of pixels that aren't clear; images without any have no row."""
    return pixels.where("a <> 0").groupBy(ID).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def crop_content(images: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cut clear margins off; clear images and those without margins stay, with a note."""
    met = sizes(images).join(content_bounds(pixels), ID, "left")
    boxes = met.select(
        ID, F.coalesce("x0", F.lit(0)).alias("x0"), F.coalesce("y0", F.lit(0)).alias("y0"), F.coalesce(F.expr("x1 - x0 + 1"), F.col("_w")).alias("w"), F.coalesce(F.expr("y1 - y0 + 1"), F.col("_h")).alias("h")
    )
    same = met.where("x0 is null or (x0 = 0 and y0 = 0 and x1 = _w - 1 and y1 = _h - 1)")
    text = F.when(F.col("x0").isNull(), F.lit("the image is clear")).otherwise(F.lit("nothing to trim"))
    return *crop_boxes(images, pixels, boxes), note(same, "crop_content", "ok", text)


def runs(pixels: DataFrame, predicate: Column | str) -> DataFrame:
    """image_id, y, x0, x1 of maximal horizontal runs of pixels that fit."""
    island = F.col("x") - F.row_number().over(Window.partitionBy(ID, "y").orderBy("x"))
    fit = pixels.where(predicate).select(ID, "x", "y").withColumn("_i", island)
    return fit.groupBy(ID, "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")


def border(images: DataFrame, pixels: DataFrame, thickness: Arg = 1, color: str | Column = "#000000", tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, pixels, notes) with an outline: clear pixels within ``thickness`` + 0.5 of content take the colour; the canvas grows to fit it.

    Distance is a chamfer with steps 1 and sqrt(2), transformed in tiles with a halo of ``thickness`` pixels
    (``tiles.dilated``); what it paints are intervals, which pixels meet by row and tile. So neither how many rows
    move nor what a task holds grows with an image, and only the halo grows with the thickness. Notes tell of images that
    stay as they are (thickness 0, or nothing but clear pixels) and of a clear colour, which adds margins alone.
    """
    names = pixels.columns
    bounds = content_bounds(pixels)
    base, arg = bind(sizes(images).join(bounds, ID), images, thickness=thickness, color=color)
    t = F.greatest(F.lit(0), F.least(F.lit(256), saturate(arg["thickness"], "int")))
    grow = lambda margin: F.greatest(F.lit(0), F.col("_t") - margin)
    plan = base.withColumns({"_t": t, "_c": arg["color"]}).select(ID, "_w", "_h", "_t", "_c", "x0", "y0", "x1", "y1").where("_t > 0")
    plan = plan.select(
        ID, "_w", "_h", "_t", "_c", grow(F.col("x0")).alias("_left"), grow(F.col("y0")).alias("_top"), grow(F.expr("_w - 1 - x1")).alias("_right"), grow(F.expr("_h - 1 - y1")).alias("_bottom")
    )
    wide = runs(pixels, "a <> 0").join(plan, ID).select(
        ID, F.expr("y + _top").alias("y"), F.expr("x0 + _left").alias("x0"), F.expr("x1 + _left").alias("x1"), "_t", F.expr("_w + _left + _right").alias("_w"), F.expr("_h + _top + _bottom").alias("_h")
    )
    painted = dilated(wide, tile)
    moved = pixels.join(plan.select(ID, "_left", "_top"), ID, "left").withColumns({"x": F.expr("x + coalesce(_left, 0)"), "y": F.expr("y + coalesce(_top, 0)")}).select(*names)
    span = lambda low, high: F.expr(f"if({high} > {low}, sequence({low}, {high} - 1), cast(array() as array<int>))")
    beside = F.concat(span("0", "_left"), span("_left + _w", "_left + _w + _right"))
    rows = plan.withColumn("y", F.explode(F.expr("sequence(0, _h + _top + _bottom - 1)")))
    cells = rows.withColumn("x", F.explode(F.when(F.expr("y < _top or y >= _top + _h"), span("0", "_left + _w + _right")).otherwise(beside)))
    canvas = moved.unionByName(cells.select(ID, "x", "y", *[F.lit(0).alias(c) for c in "rgba"]).select(*names))
    ink = painted.join(plan.select(ID, "_c"), ID).select(F.col(ID).alias("_id"), F.col("y").alias("_y"), "_tx", "x0", "x1", "_c")
    # a row's intervals lie apart, so a pixel meets one at most
    inked = canvas.join(ink, F.expr(f"image_id = _id and y = _y and x div {tile} = _tx and a = 0 and x between x0 and x1"), "left")
    out = inked.withColumns({c: F.coalesce(F.col(f"_c.{c}"), F.col(c)) for c in "rgba"}).select(*names)
    grown = images.join(plan.select(ID, "_left", "_top", "_right", "_bottom"), ID, "left")
    bigger = grown.withColumns({"width": F.expr("width + coalesce(_left + _right, 0)"), "height": F.expr("height + coalesce(_top + _bottom, 0)")})
    sized, arg = bind(sizes(images), images, thickness=thickness, color=color)
    told = sized.select(ID, saturate(arg["thickness"], "int").alias("_t"), arg["color"]["a"].alias("_a")).join(bounds.select(ID, "x0"), ID, "left")
    text = F.when(F.col("_t") <= 0, F.lit("thickness 0: the image stays as it is")).when(F.col("x0").isNull(), F.lit("the image is clear: nothing to outline"))
    text = text.when(F.col("_a") == 0, F.lit("the colour is clear: margins alone are added"))
    return bigger.select(*images.columns), out, note(told.withColumn("_m", text).where("_m is not null"), "border", "ok", F.col("_m"))


def swept(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, near: int) -> np.ndarray:
    """Place of the first run of each run's component; runs of one image in order of (y, x0).

    Rows are swept from the top, with one finger in each of two adjacent rows.
    """
    parent = list(range(len(y)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    starts = np.r_[np.flatnonzero(np.r_[True, y[1:] != y[:-1]]), len(y)].tolist()
    ys, lows, highs = y.tolist(), x0.tolist(), x1.tolist()
    for above, row, end in zip(starts, starts[1:], starts[2:], strict=False):
        if ys[row] != ys[above] + 1:
            continue
        i, j = above, row
        while i < row and j < end:
            if lows[i] <= highs[j] + near and lows[j] <= highs[i] + near:
                p, q = root(i), root(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            if highs[i] < highs[j]:
                i += 1
            else:
                j += 1
    return np.array([root(i) for i in range(len(y))], np.int64)


def _labels(near: int):
    """mapInArrow over runs in order of (image, y, x0): one image at a time."""

    def run(batches):
        held = [np.empty(0, np.int64)] + [np.empty(0, np.int32)] * 3

        def batch(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for image, y, x0, x1 in parts:
                first = swept(y, x0, x1, near)
                for column, values in zip(out, (image, y, x0, x1, y[first].astype(np.int64) * ROW + x0[first]), strict=True):
                    column.append(values)
            kinds = (np.int64, np.int32, np.int32, np.int32, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, k), *c]).astype(k)) for c, k in zip(out, kinds, strict=True)], names=[ID, "y", "x0", "x1", "component"])

        for b in batches:
            held = [np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, (ID, "y", "x0", "x1"), strict=True)]
            cut = np.r_[0, np.flatnonzero(held[0][1:] != held[0][:-1]) + 1].tolist()
            if len(cut) > 1:
                yield batch([[h[s:e] for h in held] for s, e in zip(cut, cut[1:], strict=False)])
                held = [h[cut[-1] :] for h in held]
        if len(held[0]):
            yield batch([held])

    return run


def label_components(pixels: DataFrame, predicate: Column | str, connectivity: int = 8, most_runs: int = MOST_RUNS) -> DataFrame:
    """image_id, y, x0, x1, component of every run; component = y * 2**32 + x of its first pixel.

    Runs, not pixels, are the nodes. Those of an image are swept from the top in one task, after one shuffle.
    Images of more than ``most_runs`` runs don't fit there; their runs are linked by a window and connected by star
    rounds: runs of two adjacent rows, put in order of x0, link to the last one of the other row before them if that
    reaches them (8: or touches at a corner). As runs of a row lie apart, no earlier one can.
    """
    near = 1 if connectivity == 8 else 0
    found = materialize(runs(pixels, predicate))
    large = materialize(found.groupBy(ID).agg(F.count("*").alias("n")).where(F.col("n") > most_runs).select(ID))
    small = found.join(F.broadcast(large) if large.isEmpty() else large, ID, "left_anti").select(ID, "y", "x0", "x1")
    labels = small.repartition(ID).sortWithinPartitions(ID, "y", "x0").mapInArrow(_labels(near), "image_id bigint, y int, x0 int, x1 int, component bigint")
    if large.isEmpty():
        return labels
    wide = materialize(found.join(large, ID, "left_semi").withColumn("node", F.col("y").cast("bigint") * ROW + F.col("x0")))
    rows = wide.select(ID, "y", "x0", "x1", "node", F.lit(0).alias("_row")).union(wide.select(ID, F.col("y") - 1, "x0", "x1", "node", F.lit(1)))
    before = Window.partitionBy(ID, "y").orderBy("x0", "_row").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("_row") == k, F.struct("x1", "node")), True).over(before) for k in (1, 0)]
    met = rows.withColumns({"_of1": last[0], "_of0": last[1]}).withColumn("_other", F.when(F.col("_row") == 0, F.col("_of1")).otherwise(F.col("_of0")))
    links = met.where(F.col("_other.x1") + near >= F.col("x0")).select(ID, F.col("node").alias("a"), F.col("_other.node").alias("b"))
    parts = connected_components(links.union(wide.select(ID, F.col("node").alias("a"), F.col("node").alias("b"))), [ID])
    return labels.union(wide.join(parts, [ID, "node"]).select(ID, "y", "x0", "x1", "component"))


def component_pixels(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """image_id, x, y, component of every pixel of the runs."""
    return labels.withColumn("x", F.explode(F.sequence("x0", "x1"))).select(ID, "x", "y", "component")


def remove_background(images: DataFrame, pixels: DataFrame, color: str | Column, threshold: Arg = 16, feather: bool = False) -> DataFrame:
    """Clear what a 4-connected fill from the edges reaches through clear pixels and the colour.

    ``feather`` then thins unfilled pixels beside the fill whose colour is just past the threshold.
    """
    if isinstance(color, str) and rgba(color)[3] == 0:
        return pixels
    names = pixels.columns
    bound, arg = bind(pixels, images, color=color, threshold=threshold)
    d = color_distance(F.col("r"), F.col("g"), F.col("b"), arg["color"])
    known = bound.withColumns({"_d": d, "_thr": arg["threshold"], "_key": arg["color"]["a"] != 0})
    labels = label_components(known.where("_key").select(*names, "_d", "_thr"), "a = 0 or _d <= _thr", 4)
    edge = labels.join(sizes(images), ID).where("y = 0 or y = _h - 1 or x0 = 0 or x1 = _w - 1").select(ID, "component").distinct()
    filled = labels.join(edge, [ID, "component"], "left_semi").withColumn("x", F.explode(F.sequence("x0", "x1"))).select(ID, "x", "y", F.lit(True).alias("_in"))
    met = known.join(filled, [ID, "x", "y"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    alpha = F.when(F.col("_in"), F.lit(0)).otherwise(F.col("a"))
    if feather:
        met = feather_edge(met)
        alpha = F.when(F.col("_in"), F.lit(0)).when(F.col("_soft").isNotNull(), F.least("a", "_soft")).otherwise(F.col("a"))
    return met.withColumn("a", alpha.cast("int")).select(*names)


def feather_edge(filled: DataFrame) -> DataFrame:
    """Add ``_soft``: the alpha that an unfilled pixel beside the fill is thinned to, else null."""
    across, down = Window.partitionBy(ID, "y").orderBy("x"), Window.partitionBy(ID, "x").orderBy("y")
    beside = F.lit(False)
    for w in (across, down):
        beside = beside | F.coalesce(F.lag("_in").over(w), F.lit(False)) | F.coalesce(F.lead("_in").over(w), F.lit(False))
    edge = filled.withColumn("_beside", beside)
    soft = F.expr(f"cast((_d - _thr) * 255 as int) div {FEATHER}")
    return edge.withColumn("_soft", F.when(F.expr(f"not _in and a <> 0 and _beside and _d > _thr and _d <= least(255, _thr + {FEATHER})"), soft)).drop("_beside")


def split_components(images: DataFrame, pixels: DataFrame, connectivity: int = 8, min_pixels: Arg = 0, padding: Arg = 0) -> tuple[DataFrame, DataFrame]:
    """One piece per component of ``min_pixels`` or more: its padded box with all pixels in it.

    Pieces are numbered from 1 by (top, left, first pixel) and named ``stem-k``; images without any
    component are one unchanged piece. Returns (images, pixels), both with ``piece``.
    """
    labels, arg = bind(label_components(pixels, "a <> 0", connectivity), images, least=min_pixels)
    labels = labels.withColumn("_least", F.greatest(F.lit(1), arg["least"]))
    boxes = labels.groupBy(ID, "component").agg(
        F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.sum(F.expr("x1 - x0 + 1")).alias("area"), F.first("_least").alias("_least")
    )
    order = Window.partitionBy(ID).orderBy("y0", "x0", "component")
    kept = boxes.where("area >= _least").withColumn("piece", F.row_number().over(order))
    sized, arg = bind(sizes(images), images, pad=padding)
    placed = sized.withColumn("_pad", F.least(F.lit(1 << 30), saturate(arg["pad"], "int"))).join(kept, ID, "left")
    box = placed.select(
        ID,
        F.coalesce("piece", F.lit(1)).alias("piece"),
        F.coalesce(F.expr("greatest(0, x0 - _pad)"), F.lit(0)).alias("_l"),
        F.coalesce(F.expr("greatest(0, y0 - _pad)"), F.lit(0)).alias("_t"),
        F.coalesce(F.expr("least(_w, x1 + 1 + _pad)"), F.col("_w")).alias("_r"),
        F.coalesce(F.expr("least(_h, y1 + 1 + _pad)"), F.col("_h")).alias("_b"),
        F.col("piece").isNotNull().alias("_named"),
    ).select(ID, "piece", F.col("_l").alias("x0"), F.col("_t").alias("y0"), F.expr("_r - _l").alias("w"), F.expr("_b - _t").alias("h"), "_named")
    out, cut = crop_boxes(images, pixels, box, (ID, "piece", "_named"))
    stem = F.coalesce("name_stem", F.lit("output"))
    named = out.withColumn("name_stem", F.when(F.col("_named"), F.concat(stem, F.lit("-"), F.col("piece").cast("string"))).otherwise(F.col("name_stem")))
    return named.drop("_named"), cut.drop("_named")
