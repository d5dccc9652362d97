"""Palettes and quantisation. Colours are counted in Spark; only an image's distinct colours reach Python."""

from __future__ import annotations

import sys
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelmill.functions.args import ID
from pixelmill.functions.scalars import FROM_LAB, FROM_LMS, TO_LAB, TO_LMS, hex_color
from pixelmill.operators.analysis import weighted_colors
from pixelmill.plans.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

ROUNDS = 24
ROUNDING = 4e-6  # more than a squared distance can be off, relatively, in single precision
MOST_COLORS = 1 << 18  # of an image, that one task cuts
SEED = 0x9E3779B97F4A7C15


def to_oklab(rgb: np.ndarray) -> np.ndarray:
    v = rgb.astype(np.float32) / np.float32(255)
    linear = np.where(v <= 0.04045, v / np.float32(12.92), ((v + np.float32(0.055)) / np.float32(1.055)) ** np.float32(2.4)).astype(np.float32)
    return np.cbrt(linear @ np.array(TO_LMS, np.float32).T) @ np.array(TO_LAB, np.float32).T


def from_oklab(lab: np.ndarray) -> np.ndarray:
    linear = np.clip((lab @ np.array(FROM_LAB, np.float32).T) ** 3 @ np.array(FROM_LMS, np.float32).T, 0, 1)
    srgb = np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** np.float32(1 / 2.4) - 0.055)
    return np.floor(np.clip(srgb * 255, 0, 255) + 0.5).astype(np.int64)


def draws():
    """SplitMix64 as numbers in [0, 1) of 24 bits."""
    state, mask = SEED, (1 << 64) - 1
    while True:
        state = (state + SEED) & mask
        z = ((state ^ state >> 30) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
        yield np.float32((z ^ z >> 31) >> 40) / np.float32(1 << 24)


def squared(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    d = points - to
    return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]


def seeds(points: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """k-means++ over weighted points with fixed draws; the heaviest point (the last of ties) comes first.

    Each draw falls on a scale of the points' weighted distances, laid end to end; where it falls on a point that
    was taken before, the next free one is.
    """
    heavy, n = int(np.flatnonzero(weights == weights.max())[-1]), len(points)
    picks, gap = [heavy], squared(points, points[heavy])
    for u in islice(draws(), k - 1):
        scale = np.cumsum(gap.astype(np.float64) * weights)
        if scale[-1] <= 0:
            break
        at = int(np.searchsorted(scale, float(u) * scale[-1]))
        at = heavy if at == n else at
        picks.append(next(i % n for i in range(at, at + n) if i % n not in picks))
        gap = np.minimum(gap, squared(points, points[picks[-1]]))
    return picks


def assign(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([squared(points, c) for c in centres]).argmin(0)


def kmeans(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    centres, last = points[seeds(points, weights, k)].copy(), None
    for _ in range(ROUNDS):
        at = assign(points, centres)
        total = np.bincount(at, weights, len(centres))
        full = total > 0
        for c in range(3):
            sums = np.bincount(at, points[:, c] * weights, len(centres))
            centres[full, c] = (sums[full] / total[full]).astype(np.float32)
        if last is not None and (at == last).all():
            break
        last = at
    return centres


def central(own: np.ndarray, w: np.ndarray) -> int:
    """The point with the least weighted sum of squared distances to all, as single precision gives it; the first of ties.

    The sum is the weight times the squared distance to the mean, and what the mean itself has. So one pass shows
    which points can be least, up to rounding; distances are only summed for those.
    """
    total, exact = w.sum(), own.astype(np.float64)
    from_mean = ((exact - (w @ exact) / total) ** 2).sum(1)
    about = total * from_mean + w @ from_mean
    near = np.flatnonzero(about * (1 - ROUNDING) <= about.min() * (1 + ROUNDING))
    costs = [float((squared(own, p).astype(np.float64) * w).sum()) for p in own[near]]
    return int(near[int(np.argmin(costs))])


def kmedoids(points: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    medoids = seeds(points, weights, k)
    for _ in range(ROUNDS):
        at, before = assign(points, points[medoids]), list(medoids)
        for slot in range(len(medoids)):
            members = np.flatnonzero(at == slot)
            if len(members):
                medoids[slot] = int(members[central(points[members], weights[members].astype(np.float64))])
        if medoids == before:
            break
    return medoids


def boxes(colors: np.ndarray, counts: np.ndarray, target: int) -> list[np.ndarray]:
    """Median cut of RGBA colours (sorted): index arrays of the boxes, in the order cutting leaves them.

    The box with the largest span times weight is cut (the last of ties) on its widest axis (the last of
    ties) at the weighted median; its place is taken by the last box, the halves go to the end.
    """
    made = [np.arange(len(colors))]

    def worth(box: np.ndarray) -> int:
        c = colors[box]
        return int((c.max(0) - c.min(0)).max()) * int(counts[box].sum()) if len(box) > 1 else -1

    worths = [worth(made[0])]
    while len(made) < target and max(worths) >= 0:
        i = len(worths) - 1 - int(np.argmax(worths[::-1]))
        box = made[i]
        made[i], worths[i] = made[-1], worths[-1]
        made.pop()
        worths.pop()
        span = colors[box].max(0) - colors[box].min(0)
        axis = len(span) - 1 - int(np.argmax(span[::-1]))
        box = box[np.argsort(colors[box][:, axis], kind="stable")]
        running = np.cumsum(counts[box])
        cut = int(np.flatnonzero(2 * running >= running[-1])[0]) + 1
        cut = max(1, min(cut, len(box) - 1))
        for half in (box[:cut], box[cut:]):
            made.append(half)
            worths.append(worth(half))
    return made


def replay(nodes: dict[str, tuple[int, int]], target: int) -> list[str]:
    """Names of the final boxes, in the order in which ``boxes`` leaves them, from a tree that is cut far enough.

    ``nodes`` has (worth, colours) by name; the halves of a box are its name with 0 and 1.
    """
    made = [""]
    worth = lambda name: nodes[name][0] if nodes[name][1] > 1 else -1
    while len(made) < target and (best := max(map(worth, made))) >= 0:
        i = max(j for j, name in enumerate(made) if worth(name) == best)
        name = made[i]
        made[i] = made[-1]
        made.pop()
        made += [name + "0", name + "1"]
    return made


def cut_in_rounds(counts: DataFrame, target: int, most_rounds: int = 256) -> DataFrame:
    """``boxes`` of images of any number of colours: ``counts(image_id, r, g, b, a, n)`` -> the same with ``box`` and ``place``,
    the box's place in the order of ``boxes``.

    Each round cuts, in all images at once, every box that cutting one by one could reach: a half is worth no more than its
    whole (no wider span, less weight), so those that ``target`` - 1 known boxes surpass are left alone. A box's spans and weight come from
    histograms of its four channels, 256 bins each; its weighted median from that of the widest channel, then, as ties
    go by the channels that its wholes were cut by, the last first, from histograms of those in the median bin. So colours are only
    counted and marked, and no task holds those of an image; the tree, some times ``target`` names, is replayed last.
    """
    box, key = [ID, "box"], ["r", "g", "b", "a"]
    cells = materialize(counts.select(ID, *key, F.col("n").cast("bigint").alias("n"), F.lit("").alias("box")))
    known = cut = None
    for _ in range(most_rounds):
        fresh = cells  # those in boxes without figures
        if cut is not None:
            halves = cells.where("box <> ''").withColumn("_up", F.expr("left(box, length(box) - 1)"))
            fresh = halves.join(cut.select(ID, F.col("box").alias("_up")), [ID, "_up"], "left_semi")
        channel = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(c).alias("value")) for i, c in enumerate(key)])).alias("c")
        bins = fresh.select(*box, "n", channel).groupBy(*box, "c.axis", "c.value").agg(F.sum("n").alias("w"), F.count("*").alias("k"))
        spans = bins.groupBy(*box, "axis").agg((F.max("value") - F.min("value")).alias("span"), F.sum("w").alias("w"), F.sum("k").alias("k"))
        stats = spans.groupBy(*box).agg(F.max(F.struct("span", "axis")).alias("m"), F.max("w").alias("w"), F.max("k").alias("k"))
        worth = F.when(F.col("k") > 1, F.col("m.span") * F.col("w")).otherwise(F.lit(-1)).alias("worth")
        found = stats.select(*box, F.col("m.axis").cast("string").alias("axis"), "w", "k", worth)
        if cut is None:
            found = found.withColumn("order", F.lit("0123"))
        else:
            wholes = cut.select(ID, F.col("box").alias("_up"), F.col("by").alias("order"))
            found = found.withColumn("_up", F.expr("left(box, length(box) - 1)")).join(wholes, [ID, "_up"]).drop("_up").select(*found.columns, "order")
        known = materialize(found.withColumn("cut", F.lit(False)) if known is None else known.union(found.withColumn("cut", F.lit(False))))
        better = F.rank().over(Window.partitionBy(ID).orderBy(F.desc("worth"))) - 1
        cut = materialize(known.withColumn("_better", better).where((F.col("_better") < target - 1) & (F.col("worth") >= 0) & ~F.col("cut")).select(*box, F.expr("concat(axis, replace(order, axis, ''))").alias("by"), "w"))
        if cut.isEmpty():
            break
        known = known.join(cut.select(*box, F.lit(True).alias("_cut")), box, "left").withColumn("cut", F.coalesce("_cut", F.col("cut"))).drop("_cut")
        at = lambda i: F.element_at(F.array(*key), F.expr(f"cast(substring(by, {i}, 1) as int) + 1"))
        digits = {"d0": at(1), "d1": at(2) * 256 + at(3), "d2": at(4)}
        rows = cells.join(cut, box).withColumns(digits)
        median = cut.select(*box, "w", F.lit(0).cast("bigint").alias("before"))
        for j in range(3):
            same = rows if j == 0 else rows.join(median.select(*box, *[F.col(f"d{i}").alias(f"m{i}") for i in range(j)]), box).where(" and ".join(f"d{i} = m{i}" for i in range(j)))
            counted = same.groupBy(*box, f"d{j}").agg(F.sum("n").alias("_n"))
            upto = Window.partitionBy(*box).orderBy(f"d{j}")
            sums = counted.join(median, box).withColumn("_upto", F.col("before") + F.sum("_n").over(upto))
            kept = sums.where("2 * _upto >= w").groupBy(*box).agg(F.min(F.struct(f"d{j}", "_upto", "_n", "w", *[f"d{i}" for i in range(j)])).alias("m"))
            median = materialize(kept.select(*box, "m.w", *[f"m.d{i}" for i in range(j + 1)], F.expr("m._upto - m._n").alias("before"), F.col("m._upto").alias("upto")))
        split = median.select(*box, F.struct("d0", "d1", "d2").alias("_median"), (F.col("upto") == F.col("w")).alias("_last"))
        axes = cut.select(*box, "by").join(split, box)
        marked = cells.join(axes, box, "left").withColumn("_key", F.struct(*[v.alias(d) for d, v in digits.items()]))
        low = (F.col("_key") < F.col("_median")) | ((F.col("_key") == F.col("_median")) & ~F.col("_last"))
        half = F.when(F.col("_median").isNull(), F.lit("")).when(low, F.lit("0")).otherwise(F.lit("1"))
        cells = materialize(marked.select(ID, *key, "n", F.concat("box", half).alias("box")))
    else:
        raise RuntimeError(f"boxes were not settled in {most_rounds} rounds")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = {b: (int(w), int(k)) for b, w, k in zip(pdf["box"], pdf["worth"], pdf["k"], strict=True)}
        final = {name: i for i, name in enumerate(replay(nodes, target))}
        out = [(name, i) for name in nodes for i in [next((final[name[:d]] for d in range(len(name), -1, -1) if name[:d] in final), -1)]]
        return pd.DataFrame({ID: pdf[ID].iloc[0], "box": [n for n, _ in out], "place": [i for _, i in out]})

    places = known.groupBy(ID).applyInPandas(run, "image_id bigint, box string, place int")
    return cells.join(places, box)


def _box_means(placed: DataFrame) -> DataFrame:
    """image_id, place, weight, _r, _g, _b, _a of the boxes."""
    means = [F.expr(f"cast((sum({c} * n) + sum(n) div 2) div sum(n) as int)").alias(f"_{c}") for c in "rgba"]
    return placed.groupBy(ID, "place").agg(F.sum("n").alias("weight"), *means)


def _by_size(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(counts of images that a task can hold, counts of those of more than ``most`` colours or None)."""
    kept = materialize(counts)
    large = materialize(kept.groupBy(ID).agg(F.count("*").alias("k")).where(F.col("k") > most).select(ID))
    if large.isEmpty():
        return kept, None
    return kept.join(large, ID, "left_anti"), kept.join(large, ID, "left_semi")


def box_mean(colors: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = int(counts.sum())
    return ((colors * counts[:, None]).sum(0) + n // 2) // n


PALETTE = "image_id bigint, rank int, r int, g int, b int, weight bigint"


def _palette(image: int, rgb: np.ndarray, weights) -> pd.DataFrame:
    n = len(rgb)
    return pd.DataFrame({ID: np.full(n, image), "rank": np.arange(1, n + 1), "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2], "weight": weights})


def _dealt(colors: DataFrame) -> DataFrame:
    """Colours dealt by image over all tasks: their few bytes don't show what work Python has with them."""
    return colors.repartition(int(colors.sparkSession.conf.get("spark.sql.shuffle.partitions")), ID)


def _sample(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(["r", "g", "b"])
    rgb = pdf[["r", "g", "b"]].to_numpy(np.int64)
    return rgb, to_oklab(rgb), pdf["n"].to_numpy(np.float32)


def _clamped(k: int) -> int:
    return max(2, min(256, int(k)))


def palette_kmeans(pixels: DataFrame, k: int = 8) -> DataFrame:
    """Theme colours by weighted k-means in OKLab: image_id, rank (seeding order), r, g, b, weight (null).

    Per image at most 4096 colours meet in one task; images without visible pixels have no rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rgb, points, weights = _sample(pdf)
        return _palette(pdf[ID].iloc[0], from_oklab(kmeans(points, weights, min(_clamped(k), len(points)))), None)

    return _dealt(weighted_colors(pixels)).groupBy(ID).applyInPandas(run, PALETTE)


def palette_kmedoids(pixels: DataFrame, k: int = 8) -> DataFrame:
    """As ``palette_kmeans``, each representative a colour of the image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rgb, points, weights = _sample(pdf)
        return _palette(pdf[ID].iloc[0], rgb[kmedoids(points, weights, min(_clamped(k), len(points)))], None)

    return _dealt(weighted_colors(pixels)).groupBy(ID).applyInPandas(run, PALETTE)


def _rgba_counts(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(ID, "r", "g", "b", "a").agg(F.count("*").alias("n"))


def _rgba(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(["r", "g", "b", "a"])
    return pdf[["r", "g", "b", "a"]].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)


def palette_median_cut(pixels: DataFrame, k: int = 8, most_colors: int = MOST_COLORS) -> DataFrame:
    """Representative colours by median cut, by weight: image_id, rank, r, g, b, weight.

    An image's distinct colours, with their counts, meet in one task; images of more than ``most_colors`` are cut in
    rounds over all tasks instead (``cut_in_rounds``), with the same result.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        colors, counts = _rgba(pdf)
        found = sorted(((box_mean(colors[b], counts[b]), int(counts[b].sum())) for b in boxes(colors, counts, _clamped(k))), key=lambda x: -x[1])
        return _palette(pdf[ID].iloc[0], np.array([m for m, _ in found]), [w for _, w in found])

    small, large = _by_size(_rgba_counts(pixels.where("a <> 0")), most_colors)
    out = _dealt(small).groupBy(ID).applyInPandas(run, PALETTE)
    if large is None:
        return out
    rank = F.row_number().over(Window.partitionBy(ID).orderBy(F.desc("weight"), "place")).alias("rank")
    return out.union(_box_means(cut_in_rounds(large, _clamped(k))).select(ID, rank, *[F.col(f"_{c}").alias(c) for c in "rgb"], "weight"))


def extract_palette(pixels: DataFrame, algorithm: str = "kMeans", k: int = 8) -> DataFrame:
    """By name: kMeans, kMedoids or medianCut; unknown names are kMeans. k is clamped to 2..256."""
    return {"medianCut": palette_median_cut, "kMedoids": palette_kmedoids}.get(algorithm, palette_kmeans)(pixels, k)


def palette_lines(palette: DataFrame) -> DataFrame:
    """image_id and the palette as text, one ``#rrggbb`` per line in order of rank."""
    each = F.sort_array(F.collect_list(F.struct("rank", hex_color(F.col("r"), F.col("g"), F.col("b")).alias("hex"))))
    return palette.groupBy(ID).agg(F.array_join(F.transform(each, lambda x: x["hex"]), "\n").alias("palette"))


def quantize(pixels: DataFrame, colors: int = 64, most_colors: int = MOST_COLORS) -> DataFrame:
    """At most ``colors`` RGBA values per image, clear ones included; images that have no more stay.

    The boxes are a table of (image, colour, mean) that pixels meet in a join; an image's colours are decided
    in one task, its pixels anywhere. Images of more than ``most_colors`` distinct ones are cut in rounds over all tasks.
    """
    target, names = _clamped(colors), pixels.columns
    small, large = _by_size(_rgba_counts(pixels), max(target, most_colors))
    counted = _dealt(small).withColumn("_k", F.count("*").over(Window.partitionBy(ID))).where(F.col("_k") > target)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rgba, counts = _rgba(pdf)
        mean = np.empty_like(rgba)
        for b in boxes(rgba, counts, target):
            mean[b] = box_mean(rgba[b], counts[b])
        out = pd.DataFrame(np.c_[rgba, mean], columns=["r", "g", "b", "a", "_r", "_g", "_b", "_a"])
        out.insert(0, ID, pdf[ID].iloc[0])
        return out

    fields = ", ".join(f"{c} int" for c in ("r", "g", "b", "a", "_r", "_g", "_b", "_a"))
    table = counted.drop("_k").groupBy(ID).applyInPandas(run, f"image_id bigint, {fields}")
    if large is not None:
        placed = materialize(cut_in_rounds(large, target))
        table = table.union(placed.join(_box_means(placed), [ID, "place"]).select(ID, *"rgba", *[f"_{c}" for c in "rgba"]))
    met = pixels.join(table, [ID, "r", "g", "b", "a"], "left")
    return met.withColumns({c: F.coalesce(f"_{c}", c) for c in "rgba"}).select(*names)


def palette_collection(pixels: DataFrame, k: int = 8, seed: int = 7) -> DataFrame:
    """One palette for the whole collection: weighted k-means in OKLab over all distinct colours, on Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from pixelmill.functions.scalars import oklab, oklab_to_rgb

    colors = pixels.where("a <> 0").groupBy("r", "g", "b").agg(F.count("*").cast("double").alias("n"))
    lab = oklab(F.col("r"), F.col("g"), F.col("b"))
    points = colors.select("n", array_to_vector(F.array(lab["l"], lab["a"], lab["b"])).alias("features"))
    centres = KMeans(k=_clamped(k), seed=seed, weightCol="n", maxIter=ROUNDS).fit(points).clusterCenters()
    rows = [(i + 1, *map(float, c)) for i, c in enumerate(centres)]
    frame = pixels.sparkSession.createDataFrame(rows, "rank int, l double, a double, b double")
    rgb = oklab_to_rgb(F.struct("l", "a", "b"))
    return frame.select("rank", rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"))
