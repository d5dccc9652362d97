"""Tiles of images with a halo, so that a task holds a tile and its surroundings and never a whole image."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.args import ID

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

TILE = 512
DIAGONAL = math.sqrt(2)


def with_halo(runs: DataFrame, size: int = TILE) -> DataFrame:
    """``runs(image_id, y, x0, x1, _t, _w, _h)`` with ``_ty, _tx``: one row for each tile of the canvas (_w by _h) that a run lies
    in or within ``_t`` pixels of.

    For a halo of up to a tile that is nine rows for a short run at most, and one for most; a long run has one more for
    each further tile it crosses.
    """
    tiles = lambda low, high, end: F.expr(f"sequence(greatest(0, {low} - _t) div {size}, least({end} - 1, {high} + _t) div {size})")
    return runs.withColumn("_ty", F.explode(tiles("y", "y", "_h"))).withColumn("_tx", F.explode(tiles("x0", "x1", "_w")))


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Distance of each cell to the nearest one that is set, with steps 1 and sqrt(2): a pass down and one up.

    Within a row, steps sideways are a running minimum from either end.
    """
    d = np.where(mask, 0.0, np.inf)
    along = np.arange(d.shape[1], dtype=float)
    for rows in (d, d[::-1]):
        above = None
        for row in rows:
            if above is not None:
                np.minimum(row, above + 1, out=row)
                np.minimum(row[1:], above[:-1] + DIAGONAL, out=row[1:])
                np.minimum(row[:-1], above[1:] + DIAGONAL, out=row[:-1])
            np.minimum(row, np.minimum.accumulate(row - along) + along, out=row)
            back = row[::-1]
            np.minimum(back, np.minimum.accumulate(back - along) + along, out=back)
            above = row
    return d


def near_runs(ty: int, tx: int, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, t: int, w: int, h: int, size: int) -> tuple[np.ndarray, ...]:
    """(y, x0, x1) of the runs of a tile's pixels within ``t`` + 0.5 of the runs given, its own and those of its halo."""
    top, left = max(ty * size, int(y.min()) - t), max(tx * size, int(x0.min()) - t)
    bottom, right = min((ty + 1) * size, h, int(y.max()) + t + 1), min((tx + 1) * size, w, int(x1.max()) + t + 1)
    if top >= bottom or left >= right:
        return (np.empty(0, np.int64),) * 3
    x0, x1 = np.maximum(x0, left - t), np.minimum(x1, right - 1 + t)
    up, west = min(top, int(y.min())), min(left, int(x0.min()))
    edges = np.zeros((max(bottom, int(y.max()) + 1) - up, max(right, int(x1.max()) + 1) - west + 1), np.int32)
    np.add.at(edges, (y - up, x0 - west), 1)
    np.add.at(edges, (y - up, x1 + 1 - west), -1)
    near = chamfer(np.cumsum(edges, 1)[:, :-1] > 0)[top - up : bottom - up, left - west : right - west] <= t + 0.5
    turns = np.diff(np.pad(near, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (rows, starts), (_, ends) = np.nonzero(turns == 1), np.nonzero(turns == -1)
    return rows + top, starts + left, ends - 1 + left


def dilated(runs: DataFrame, size: int = TILE) -> DataFrame:
    """image_id, y, _tx, x0, x1: what lies within ``_t`` + 0.5 of ``runs(image_id, y, x0, x1, _t, _w, _h)``, cut at tiles.

    Distance is a chamfer with steps 1 and sqrt(2). Runs go to their tile and to those whose halo they touch, so how
    many move doesn't grow with ``_t``; a task transforms the distances of one tile at a time. Intervals of a row
    are disjoint.
    """
    names = [ID, "_ty", "_tx", "y", "x0", "x1", "_t", "_w", "_h"]

    def batch(groups: list[list[np.ndarray]]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for image, ty, tx, y, x0, x1, t, w, h in groups:
            found = near_runs(int(ty[0]), int(tx[0]), y, x0, x1, int(t[0]), int(w[0]), int(h[0]), size)
            n = len(found[0])
            for column, values in zip(out, (np.full(n, image[0]), found[0], np.full(n, tx[0]), found[1], found[2]), strict=True):
                column.append(values)
        kinds = (np.int64, np.int32, np.int32, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, k), *c]).astype(k)) for c, k in zip(out, kinds, strict=True)], names=[ID, "y", "_tx", "x0", "x1"])

    def run(batches):
        held = [np.empty(0, np.int64)] * len(names)
        for b in batches:
            held = [np.concatenate([p, b.column(c).to_numpy().astype(np.int64)]) for p, c in zip(held, names, strict=True)]
            fresh = np.logical_or.reduce([k[1:] != k[:-1] for k in held[:3]])
            cut = np.r_[0, np.flatnonzero(fresh) + 1].tolist()
            if len(cut) > 1:
                yield batch([[p[s:e] for p in held] for s, e in zip(cut, cut[1:], strict=False)])
                held = [p[cut[-1] :] for p in held]
        if len(held[0]):
            yield batch([held])

    dealt = with_halo(runs, size).select(*names).repartition(ID, "_ty", "_tx").sortWithinPartitions(ID, "_ty", "_tx")
    return dealt.mapInArrow(run, "image_id bigint, y int, _tx int, x0 int, x1 int")
