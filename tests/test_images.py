"""Golden grids and algebraic properties of the image operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import scalars
from pixelmill.operators import analysis, lists, palettes, pixels, resample, shapes, tiles
from pixelmill.plans import queries
from pixelmill.sources import files

PIXELS = "image_id long, x int, y int, r int, g int, b int, a int"
CLEAR, WHITE, RED, BLUE = (0, 0, 0, 0), (255, 255, 255, 255), (255, 0, 0, 255), (0, 0, 255, 255)


def grid(spark, *specs):
    """(images, pixels) of (width, height, background, {(x, y): colour})."""
    rows, images = [], []
    for i, (w, h, bg, cells) in enumerate(specs):
        rows += [(i, x, y, *cells.get((x, y), bg)) for y in range(h) for x in range(w)]
        images.append((i, f"/d/pic{i}.png", None, True, "png", w, h, True, 10 * w * h, i))
    schema = "image_id long, origin string, name_stem string, name_auto_ext boolean, format string, width int, height int, has_alpha boolean, byte_len long, seq long"
    return spark.createDataFrame(images, schema), spark.createDataFrame(rows, PIXELS)


def cells(df, image=0):
    return {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in df.where(F.col("image_id") == image).collect()}


def size(images, image=0):
    r = images.where(F.col("image_id") == image).first()
    return r["width"], r["height"]


def gradient(w, h):
    return w, h, CLEAR, {(x, y): (40 * x % 256, 40 * y % 256, 200, 255) for x in range(w) for y in range(h)}


def noise(w, h, seed, clear=0.5):
    rng = random.Random(seed)
    return w, h, CLEAR, {(x, y): tuple(rng.randrange(256) for _ in range(3)) + (0 if rng.random() < clear else rng.choice([128, 255]),) for x in range(w) for y in range(h)}


def test_remove_color(spark):
    ring = {(x, y): RED for x in range(1, 4) for y in range(1, 4) if (x, y) != (2, 2)}
    images, px = grid(spark, (5, 5, WHITE, ring), (2, 1, WHITE, {(1, 0): (245, 245, 245, 255)}), (3, 1, CLEAR, {(1, 0): WHITE}), (3, 1, RED, {(0, 0): WHITE, (1, 0): (240, 250, 255, 255)}))
    whole = pixels.remove_color(px, "#ffffff", 0)
    assert cells(whole)[2, 2][3] == 0 and cells(whole)[0, 0] == (255, 255, 255, 0)
    keyed = cells(pixels.remove_color(px, "#ffffff", 16), 3)
    assert [keyed[x, 0][3] for x in range(3)] == [0, 0, 255]
    assert pixels.remove_color(px, "transparent") is px
    background = shapes.remove_background(images, px, "#ffffff", 0)
    assert cells(background)[0, 0][3] == 0 and cells(background)[2, 2][3] == 255
    assert cells(background, 2)[1, 0][3] == 0  # through clear pixels
    soft = cells(shapes.remove_background(images, px, "#ffffff", 0, feather=True), 1)
    assert soft[0, 0][3] == 0 and 0 < soft[1, 0][3] < 255


def brute_border(w, h, at, t, color):
    content = [p for p in at if at[p][3]]
    if not content or not t:
        return dict(at), (w, h)
    xs, ys = [x for x, _ in content], [y for _, y in content]
    left, top, right, bottom = (max(0, t - m) for m in (min(xs), min(ys), w - 1 - max(xs), h - 1 - max(ys)))
    out = {}
    for y in range(h + top + bottom):
        for x in range(w + left + right):
            old = at.get((x - left, y - top), CLEAR)
            far = lambda p: sorted((abs(p[0] + left - x), abs(p[1] + top - y)))  # noqa: B023, E731
            near = any(b - a + math.sqrt(2) * a <= t + 0.5 for a, b in map(far, content))
            out[x, y] = color if old[3] == 0 and near else old
    return out, (w + left + right, h + top + bottom)


@pytest.mark.parametrize("t", [0, 1, 2, 5, 9])
def test_border(spark, t):
    specs = [(4, 4, WHITE, {}), (7, 7, CLEAR, {(x, y): WHITE for x in range(2, 5) for y in range(2, 5)}), (5, 5, WHITE, {(2, 2): CLEAR}), (3, 3, CLEAR, {}), noise(9, 6, 1, 0.9)]
    images, px = grid(spark, *specs)
    bigger, out, notes = shapes.border(images, px, t, "#ff0000")
    clear = {r["image_id"] for r in px.groupBy("image_id").agg(F.max("a").alias("a")).where("a = 0").collect()}
    assert {r["image_id"] for r in notes.collect()} == (clear if t else set(range(len(specs))))
    for i, (w, h, bg, at) in enumerate(specs):
        full = {(x, y): at.get((x, y), bg) for x in range(w) for y in range(h)}
        want, dims = brute_border(w, h, full, t, RED)
        assert cells(out, i) == want and size(bigger, i) == dims
    if t == 2:
        padded = cells(shapes.border(images, px, 2, "transparent")[1], 0)
        assert padded[0, 0] == CLEAR and padded[3, 3] == WHITE and len(padded) == 64


@pytest.mark.parametrize("t, tile", [(1, 3), (4, 3), (16, 5), (256, 512), (256, 100)])
def test_border_over_tiles(spark, t, tile):
    specs = [noise(11, 7, 2, 0.95), (1, 1, RED, {}), (9, 2, CLEAR, {(x, 1): BLUE for x in range(1, 9)}), (4, 5, CLEAR, {(0, 4): RED}), (3, 3, CLEAR, {})][: 4 if t > 16 else 5]
    if t > 16:
        specs = specs[1:2]
    images, px = grid(spark, *specs)
    bigger, out, _ = shapes.border(images, px, t, "#ff0000", tile)
    for i, (w, h, bg, at) in enumerate(specs):
        want, dims = brute_border(w, h, {(x, y): at.get((x, y), bg) for x in range(w) for y in range(h)}, t, RED)
        assert cells(out, i) == want and size(bigger, i) == dims


def test_halo_rows_do_not_grow_with_thickness(spark):
    _, px = grid(spark, noise(30, 20, 3, 0.5))
    found = shapes.runs(px, "a <> 0")
    spread = {t: tiles.with_halo(found.selectExpr("image_id", "y + 2000 AS y", "x0 + 2000 AS x0", "x1 + 2000 AS x1", f"{t} AS _t", "9000 AS _w", "9000 AS _h")).count() for t in (1, 16, 256)}
    assert found.count() <= spread[1] <= spread[16] <= spread[256] <= 9 * found.count()


def test_chamfer():
    rng = np.random.default_rng(4)
    for h, w in ((1, 1), (1, 9), (7, 1), (12, 15)):
        mask = rng.random((h, w)) < 0.1
        mask[0, -1] = True
        far = lambda y, x: min(max(abs(y - v), abs(x - u)) - min(abs(y - v), abs(x - u)) + math.sqrt(2) * min(abs(y - v), abs(x - u)) for v, u in np.argwhere(mask))  # noqa: E731, B023
        assert np.allclose(tiles.chamfer(mask), [[far(y, x) for x in range(w)] for y in range(h)])


def brute_labels(at, eight):
    seen, out = set(), {}
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (eight or not dx or not dy)]
    for p in sorted(at, key=lambda p: (p[1], p[0])):
        if at[p][3] and p not in seen:
            stack, root = [p], p[1] * shapes.ROW + p[0]
            seen.add(p)
            while stack:
                x, y = stack.pop()
                out[x, y] = root
                for dx, dy in steps:
                    q = (x + dx, y + dy)
                    if q in at and at[q][3] and q not in seen:
                        seen.add(q)
                        stack.append(q)
    return out


def spiral(n):
    at, x, y, dx, dy, left = {}, 0, 0, 1, 0, n - 1
    steps = [n - 1] + [k for k in range(n - 1, 0, -2) for _ in (0, 1)]
    for k in steps:
        for _ in range(k):
            at[x, y] = RED
            x, y = x + dx, y + dy
        dx, dy = -dy, dx
    at[x, y] = RED
    return n, n, CLEAR, at


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("most_runs", [shapes.MOST_RUNS, 30])
def test_components(spark, connectivity, most_runs):
    specs = [spiral(21), noise(16, 12, 4, 0.45), noise(10, 10, 5, 0.7), (3, 3, CLEAR, {}), (4, 2, RED, {})]
    _, px = grid(spark, *specs)
    found = shapes.component_pixels(px, shapes.label_components(px, "a <> 0", connectivity, most_runs)).collect()
    for i, (w, h, bg, at) in enumerate(specs):
        full = {(x, y): at.get((x, y), bg) for x in range(w) for y in range(h)}
        assert {(r["x"], r["y"]): r["component"] for r in found if r["image_id"] == i} == brute_labels(full, connectivity == 8)


def test_split(spark):
    sheet = {(x, y): RED for x in (0, 1) for y in (0, 1)} | {(x, y): BLUE for x in (4, 5) for y in (4, 5)}
    images, px = grid(spark, (6, 6, CLEAR, sheet), (2, 2, CLEAR, {}), (3, 3, RED, {}))
    out, cut = shapes.split_components(images, px, padding=1)
    boxes = {(r["image_id"], r["piece"]): (r["width"], r["height"], r["name_stem"]) for r in out.collect()}
    assert boxes == {(0, 1): (3, 3, "output-1"), (0, 2): (3, 3, "output-2"), (1, 1): (2, 2, None), (2, 1): (3, 3, "output-1")}
    second = {(r["x"], r["y"]): r["b"] for r in cut.where("image_id = 0 and piece = 2").collect()}
    assert second[0, 0] == 0 and second[1, 1] == 255
    none = shapes.split_components(images.where("image_id = 0"), px.where("image_id = 0"), min_pixels=5)[0].collect()
    assert [(r["width"], r["height"]) for r in none] == [(6, 6)]
    new, moved = pixels.pieces_as_images(out, cut)
    assert new.select("image_id").distinct().count() == 4 and moved.join(new, "image_id").count() == cut.count()


def test_crops(spark):
    images, px = grid(spark, gradient(8, 4), (8, 4, BLUE, {(0, 0): RED}), (6, 5, CLEAR, {(x, y): (10, 20, 30, 255) for x in (2, 3, 4) for y in (1, 2)}), (2, 2, CLEAR, {}))
    assert size(pixels.crop_ratio(images, px, 1, 1)[0]) == (4, 4)
    out, cut, notes = pixels.crop_size(images, px, 3, 2, "topLeft")
    assert size(out, 1) == (3, 2) and cells(cut, 1)[0, 0] == RED and {r["image_id"] for r in notes.collect()} == {3}
    out, cut, notes = shapes.crop_content(images, px)
    assert size(out, 2) == (3, 2) and size(out, 3) == (2, 2) and {r["image_id"]: r["message"] for r in notes.collect()}[3] == "the image is clear"
    again = shapes.crop_content(out, cut)[1]
    assert again.exceptAll(cut).count() == 0 and cut.exceptAll(again).count() == 0


def test_flip_rotate(spark):
    images, px = grid(spark, gradient(3, 2))
    both = pixels.flip_rotate(images, px, flip_h=True, rotate=90)
    step = pixels.flip_rotate(*pixels.flip_rotate(images, px, flip_h=True), rotate=90)
    assert size(both[0]) == (2, 3) and cells(both[1]) == cells(step[1])
    twice = pixels.flip_rotate(*pixels.flip_rotate(images, px, flip_h=True), flip_h=True)
    turned = (images, px)
    for _ in range(4):
        turned = pixels.flip_rotate(*turned, rotate=90)
    assert cells(twice[1]) == cells(px) == cells(turned[1]) and size(turned[0]) == (3, 2)
    assert cells(pixels.flip_rotate(images, px, rotate=45)[1]) == cells(px)


def test_resize(spark):
    images, px = grid(spark, gradient(2, 2), gradient(4, 4), gradient(5, 3))
    out, big, _ = resample.upscale(images, px, 400)
    source, large = cells(px), cells(big)
    assert size(out) == (8, 8) and all(large[x, y] == source[x // 4, y // 4] for x in range(8) for y in range(8))
    assert size(resample.stretch(images, px, 200, 50)[0], 1) == (8, 2)
    to, small = resample.resize_nearest(images, px, 7, 2)
    got, source = cells(small, 2), cells(px, 2)
    assert got == {(x, y): source[int((x + 0.5) * 5 / 7), int((y + 0.5) * 3 / 2)] for x in range(7) for y in range(2)}
    _, _, notes = resample.upscale(images.withColumn("width", F.lit(100_000)), px, 1600)
    assert notes.where("status = 'failed'").count() == 2  # 1600000 x 32 fits, x 64 and x 48 don't
    too_large = resample.upscale(images.withColumns({"width": F.lit(9000), "height": F.lit(9000)}), px, 100)
    assert too_large[0].count() == 0 and too_large[2].where("status = 'failed'").count() == 3
    for name in resample.SUPPORT:
        flat_images, flat = grid(spark, (5, 4, (10, 20, 30, 255), {}))
        same = resample.resize_kernel(flat_images, flat, 9, 3, name)[1]
        assert set(cells(same).values()) == {(10, 20, 30, 255)} and same.count() == 27
    assert size(resample.thumbnails(images, px, 2)[0], 2) == (2, 1)


def test_masks(spark):
    images, px = grid(spark, (8, 8, (10, 20, 30, 255), {}), (8, 8, (10, 20, 30, 255), {}))
    masks = px.select("image_id", "x", "y", F.col("image_id").cast("double").alias("value"), F.lit(8).alias("mask_w"), F.lit(8).alias("mask_h"))
    out = resample.apply_mask(images, px, masks)
    assert set(cells(out, 0).values()) == {(10, 20, 30, 0)} and set(cells(out, 1).values()) == {(10, 20, 30, 255)}


def test_palettes(spark):
    themes = [(230, 20, 20, 255), (20, 230, 20, 255), (20, 20, 230, 255)]
    images, px = grid(
        spark,
        (6, 1, RED, {(5, 0): BLUE}),
        (4, 1, RED, {(2, 0): (250, 0, 0, 255), (3, 0): BLUE}),
        (30, 10, CLEAR, {(x, y): themes[x // 10] for x in range(30) for y in range(10)}),
        (40, 25, (200, 200, 200, 255), {(x, y): RED for x in range(4) for y in range(25)}),
        noise(64, 64, 7, 0.2),
        (2, 2, CLEAR, {}),
    )
    first = [(r["r"], r["g"], r["b"]) for r in analysis.palette_count(px.where("image_id = 0"), 0).orderBy("rank").collect()]
    assert first == [RED[:3], BLUE[:3]]
    assert analysis.palette_count(px.where("image_id = 1"), 16).count() == 2
    for name in ("kMeans", "kMedoids", "medianCut"):
        found = palettes.extract_palette(px.where("image_id in (2, 5)"), name, 3)
        assert found.count() == 3 and found.where("image_id = 5").count() == 0
        if name != "kMeans":
            assert {(r["r"], r["g"], r["b"]) for r in found.collect()} == {c[:3] for c in themes}
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, palettes.extract_palette(px.where("image_id = 2").repartition(3), name, 3).collect()), key=str)
    rare = palettes.palette_kmeans(px.where("image_id = 3"), 2).collect()
    assert any(r["r"] > 200 and r["g"] < 60 for r in rare)
    small = palettes.quantize(px, 16)
    assert small.where("image_id = 4").select("r", "g", "b", "a").distinct().count() <= 16 and small.count() == px.count()
    assert cells(small, 2) == cells(px, 2)
    assert palettes.palette_lines(analysis.palette_count(px.where("image_id = 0"), 0)).first()["palette"] == "#ff0000\n#0000ff"


def test_oklab_round_trip():
    rgb = np.array([[r, g, b] for r in range(0, 256, 17) for g in range(0, 256, 51) for b in range(0, 256, 15)])
    assert (palettes.from_oklab(palettes.to_oklab(rgb)) == rgb).all()


def test_profile_and_diff(spark):
    gray = {(x, 0): (v, v, v, 255) for x, v in enumerate((0, 85, 170, 255))}
    images, px = grid(spark, (4, 1, CLEAR, gray), (2, 1, RED, {(1, 0): (9, 9, 9, 100)}), (4, 1, WHITE, {(0, 0): (17, 17, 17, 255)}))
    rows = {r["image_id"]: r for r in analysis.image_profile(px).collect()}
    assert rows[0]["gray_depth"] == 2 and rows[0]["index_bits"] == 2 and rows[0]["encodings"] == ["rgb8", "gray2", "indexed2"]
    assert rows[1]["encodings"] == ["rgba8", "indexed1"] and rows[1]["gray_depth"] is None
    assert rows[2]["gray_depth"] == 4
    assert analysis.pixel_diff(px, px).where("not lossless").count() == 0
    assert {r["image_id"]: r["different"] for r in analysis.pixel_diff(px, pixels.to_rgb8(px)).collect()} == {0: 0, 1: 1, 2: 0}
    assert analysis.size_report(images, images.withColumn("byte_len", F.lit(5).cast("long"))).where("image_id = 0").first()["saved"] == pytest.approx(1 - 5 / 40)


def test_lists(spark):
    each = lists.for_each(spark.createDataFrame([(1, [1, 2, 3]), (2, [])], "g int, l array<int>"), "l")
    assert [(r["g"], r["index"]) for r in each.orderBy("index").collect()] == [(1, 0), (1, 1), (1, 2)]
    folded = lists.fold(each, ["g"], ["index"], "element", F.lit(0), lambda s, v: s + v)
    assert folded.first()["state"] == 6
    nested = lists.for_each(each.drop("index").withColumn("m", F.array(F.lit(1), F.lit(2), F.lit(3))), "m", element="inner")
    assert nested.agg(F.sum("inner")).first()[0] == 18 and nested.first()["iter_path"] == [0, 0]
    assert lists.repeat(spark.range(1), 3).count() == 3 and lists.repeat(spark.range(1), 0).count() == 0
    rows = spark.createDataFrame([(1, 0, "ok"), (1, 1, "failed"), (1, 2, "ok"), (2, 0, "ok")], "g int, i int, status string")
    assert [(r["g"], r["i"]) for r in lists.halt_on_failure(rows, ["g"], ["i"]).orderBy("g", "i").collect()] == [(1, 0), (1, 1), (2, 0)]
    groups = spark.createDataFrame([(1,), (2,), (3,)], "g int")
    assert {r["g"] for r in lists.on_complete(groups, rows, ["g"]).collect()} == {2, 3}


def test_files(spark, tmp_path):
    images, px = grid(spark, gradient(5, 3), noise(4, 4, 2), (2, 2, RED, {}))
    named, bad = files.name_outputs(images.withColumn("name_stem", F.when(F.col("image_id") == 2, F.lit("NUL"))), f"file://{tmp_path}/out")
    assert {r["image_id"] for r in bad.collect()} == {2}
    files.write_images(named, px, f"file://{tmp_path}/out")
    (tmp_path / "out" / "junk.png").write_bytes(b"not an image")
    (tmp_path / "out" / "a.txt").write_text("héllo")
    (tmp_path / "out" / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "out" / "v.mkv").write_bytes(b"1234")
    folder = f"file://{tmp_path}/out"
    listed, notes = files.scan_images(spark, folder)
    assert [r["path"].rsplit("/")[-1] for r in listed.orderBy("seq").collect()] == ["junk.png", "pic0.png", "pic1.png"] and notes.count() == 0
    assert files.scan_images(spark, folder, limit=2)[0].count() == 2 and files.scan_images(spark, folder, limit=2)[1].count() == 1
    loaded = files.load_images(spark, folder + "/*.png")
    info, failed = files.image_info(loaded)
    assert {(r["name_stem"], r["width"], r["height"]) for r in info.collect()} == {("pic0", 5, 3), ("pic1", 4, 4)} and failed.count() == 1
    back = files.decode_pixels(loaded).join(info.select("image_id", F.substring("name_stem", 4, 1).cast("long").alias("n")), "image_id").drop("image_id").withColumnRenamed("n", "image_id").select(px.columns)
    want = px.where("image_id < 2")
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    texts, told = files.scan_texts(spark, folder)
    assert [r["text"] for r in texts.collect()] == ["héllo"] and [r["status"] for r in told.collect()] == ["skipped"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "v.mkv").write_bytes(b"1234")
    for scan in (files.scan_images, files.scan_texts):
        none, told = scan(spark, f"file://{tmp_path}/empty")
        assert none.count() == 0 and [(r["image_id"], r["status"]) for r in told.collect()] == [(None, "failed")]
    assert files.read_text(spark, folder + "/b.md")[1].count() == 1
    assert [(r["container"], r["length"]) for r in files.scan_media(spark, folder).collect()] == [("mkv", 4)]
    before = spark.createDataFrame(files.product_manifest(spark, folder).where("name in ('pic0.png', 'pic1.png', 'a.txt')").collect())
    (tmp_path / "out" / "pic1.png").write_bytes(b"edited")
    (tmp_path / "out" / "a.txt").unlink()
    status = {r["name"]: r["status"] for r in files.audit_products(before, files.product_manifest(spark, folder)).collect()}
    assert status == {"pic0.png": "owned", "pic1.png": "edited", "a.txt": "missing", "junk.png": "foreign", "b.md": "foreign", "v.mkv": "foreign"}


def test_dedupe_names(spark, monkeypatch):
    schema = "image_id long, directory string, file_name string, seq long"
    rows = [(i, "d", n, i) for i, n in enumerate(["input.png", "input.png", "input (2).png", "b.png", "b.png", "input.jpg"])]
    named = spark.createDataFrame(rows, schema)
    there = spark.createDataFrame([("d", "b.png")], "directory string, file_name string")
    got = {r["seq"]: r["file_name"] for r in files.dedupe_names(named, there, overwrite=False)[0].collect()}
    assert got == {0: "input.png", 1: "input (2).png", 2: "input (2) (2).png", 3: "b (2).png", 4: "b (3).png", 5: "input.jpg"}
    last = {r["file_name"]: r["seq"] for r in files.dedupe_names(named)[0].collect()}
    assert last["input.png"] == 1 and len(last) == 4
    monkeypatch.setattr(files, "MOST_NAMES", 2)
    long = "x" * 236 + ".png"  # valid, but not with a number
    many = spark.createDataFrame([(i, "d", n, i) for i, n in enumerate(["a.png"] * 4 + ["b (2).png"] + ["b.png"] * 3 + [long] * 2)], schema)
    kept, failed = files.dedupe_names(many, overwrite=False)
    assert {r["image_id"] for r in kept.collect()} == {0, 1, 4, 5, 8}
    assert {r["image_id"]: r["message"][:7] for r in failed.where("status = 'failed'").collect()} == {2: "no name", 3: "no name", 6: "no name", 7: "no name", 9: "invalid"}


def test_stream(spark, tmp_path):
    from pixelmill.streaming.files import process_images, watch_images

    images, px = grid(spark, (2, 2, RED, {}))
    folder = f"file://{tmp_path}/in"
    files.write_images(files.name_outputs(images, folder)[0], px, folder)
    seen = []
    query = process_images(watch_images(spark, folder), lambda p: pixels.remove_color(p, "#ff0000", 0), lambda df, epoch: seen.extend(df.collect()), f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 4 and all(r["a"] == 0 for r in seen)


def test_registry():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_border_notes(spark):
    images, px = grid(spark, (3, 3, RED, {}), (3, 3, CLEAR, {}), (3, 3, RED, {}))
    assert {r["image_id"]: r["message"][:9] for r in shapes.border(images, px, F.col("image_id"), "#000000")[2].collect()} == {0: "thickness", 1: "the image"}
    assert {r["image_id"]: r["message"][:10] for r in shapes.border(images, px, 1, "transparent")[2].collect()} == {0: "the colour", 1: "the image ", 2: "the colour"}


def test_run_report(spark):
    rows = [(i, "crop", 0, "ok", "small" if i % 2 else "", 5) for i in range(6)] + [(9, "crop", 1, "failed", "bad", 2), (9, "crop", 0, "failed", "worse", None), (1, "flip", 0, "skipped", "none", 1), (2, "flip", 0, "ok", None, None)]
    report, warnings = lists.run_report(spark.createDataFrame(rows, "image_id long, op string, seq int, status string, message string, elapsed_ms long"))
    assert {tuple(r) for r in report.collect()} == {("crop", 32, "failed", 3, "bad"), ("flip", 1, "skipped", 1, None)}
    assert {tuple(r) for r in warnings.collect()} == {("crop", "small", 3), ("flip", "none", 1)}


def mean(cells_, at):
    n = sum(cells_[c] for c in at)
    return tuple((sum(c[k] * cells_[c] for c in at) + n // 2) // n for k in range(len(at[0])))


def brute_cut(cells_, target):
    """Median cut by lists of colours: cells_ has counts by colour."""
    boxes = [sorted(cells_)]
    while len(boxes) < target:
        best, worth = None, -1
        for i, box in enumerate(boxes):
            wide = max(max(c[k] for c in box) - min(c[k] for c in box) for k in range(len(box[0])))
            if len(box) > 1 and wide * sum(cells_[c] for c in box) >= worth:
                best, worth = i, wide * sum(cells_[c] for c in box)
        if best is None:
            break
        box = boxes[best]
        boxes[best] = boxes[-1]
        boxes.pop()
        spans = [max(c[k] for c in box) - min(c[k] for c in box) for k in range(len(box[0]))]
        axis = max(range(len(spans)), key=lambda k: (spans[k], k))
        box = sorted(box, key=lambda c: c[axis])
        half, run, cut = sum(cells_[c] for c in box), 0, 0
        while 2 * run < half:
            run, cut = run + cells_[box[cut]], cut + 1
        cut = max(1, min(cut, len(box) - 1))
        boxes += [box[:cut], box[cut:]]
    return boxes


def counted(px):
    out = {}
    for r in px.collect():
        image = out.setdefault(r["image_id"], {})
        key = (r["r"], r["g"], r["b"], r["a"])
        image[key] = image.get(key, 0) + 1
    return out


def test_central_points_by_all_sums(monkeypatch):
    rng = np.random.default_rng(6)
    summed = []
    plain = palettes.squared
    monkeypatch.setattr(palettes, "squared", lambda points, to: summed.append(1) or plain(points, to))
    for n in (1, 2, 3, 10, 300):
        for scale in (1e-3, 1.0):
            own = palettes.to_oklab(rng.integers(0, 256, (n, 3))) * np.float32(scale)
            own = np.concatenate([own, own[: n // 2]])  # ties
            w = rng.integers(1, 50, len(own)).astype(np.float64)
            costs = [float((plain(own, p).astype(np.float64) * w).sum()) for p in own]
            assert palettes.central(own, w) == int(np.argmin(costs))
    assert len(summed) < 60


@pytest.mark.parametrize("k", [2, 7, 40])
def test_median_cut_in_rounds(spark, k):
    few = (6, 4, CLEAR, {(x, y): ((x % 2) * 9, y % 2, 7, 255) for x in range(6) for y in range(4)})
    tied = (8, 8, RED, {(x, y): (x * 30, y * 30, 0, 255) for x in range(8) for y in range(8)})
    _, px = grid(spark, noise(20, 15, 7, 0.1), noise(9, 9, 8, 0.0), few, tied, (3, 3, BLUE, {}), (2, 2, CLEAR, {}))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(palettes.palette_median_cut(px, k, most_colors=1)) == rows(palettes.palette_median_cut(px, k))
    assert rows(palettes.quantize(px, k, most_colors=1)) == rows(palettes.quantize(px, k))


def test_rounds_cut_what_cutting_one_by_one_does():
    rng = np.random.default_rng(2)
    for target in (2, 5, 16, 60):
        colors = np.unique(rng.integers(0, 12, (150, 4)), axis=0)
        counts = rng.integers(1, 9, len(colors))
        nodes = {}

        def grow(name, members):
            c, n = colors[members], counts[members]  # noqa: B023
            nodes[name] = (int((c.max(0) - c.min(0)).max()) * int(n.sum()) if len(c) > 1 else -1, len(c))  # noqa: B023
            if len(c) > 1:
                for half, part in zip("01", palettes.boxes(c, n, 2), strict=True):
                    grow(name + half, members[part])  # noqa: B023
            held[name] = set(members.tolist())  # noqa: B023

        held = {}
        grow("", np.arange(len(colors)))
        assert [held[name] for name in palettes.replay(nodes, target)] == [set(b.tolist()) for b in palettes.boxes(colors, counts, target)]


def test_median_cut_and_quantize_by_brute_force(spark):
    """Both registered queries over all of their images."""
    folder = "/root/testdata/sf0.001"
    images = counted(queries.emb_pixels(spark, folder))
    got = {}
    for r in queries.QUERIES["a_palette_median_cut"](spark, folder).collect():
        got.setdefault(r["image_id"], []).append((r["rank"], (r["r"], r["g"], r["b"]), r["weight"]))
    changed = {(r["image_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in queries.QUERIES["a_quantize"](spark, folder).collect()}
    source = {(r["image_id"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in queries.emb_pixels(spark, folder).collect()}
    maps = {}
    for i, cells_ in images.items():
        seen = {c: n for c, n in cells_.items() if c[3]}
        want = sorted(((mean(seen, b)[:3], sum(seen[c] for c in b)) for b in brute_cut(seen, 4)), key=lambda x: -x[1])
        assert [(c, w) for _, c, w in sorted(got.pop(i, []))] == want
        maps[i] = {c: mean(cells_, b) for b in brute_cut(cells_, 8) for c in b} if len(cells_) > 8 else {c: c for c in cells_}
    assert not got and changed == {k: maps[k[0]][v] for k, v in source.items()}


def lab(rgb):
    """OKLab of one colour, in plain floats."""
    linear = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in rgb]
    root = [math.copysign(abs(x) ** (1 / 3), x) for x in (sum(f * v for f, v in zip(row, linear, strict=True)) for row in scalars.TO_LMS)]
    return tuple(sum(f * v for f, v in zip(row, root, strict=True)) for row in scalars.TO_LAB)


def split_mix():
    state, full = 0x9E3779B97F4A7C15, 1 << 64
    step = state
    while True:
        state = (state + step) % full
        z = state
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = ((z ^ (z >> shift)) * factor) % full
        yield ((z ^ (z >> 31)) >> 40) / (1 << 24)


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def brute_clusters(weight, k, medoids):
    """Weighted k-means or k-medoids over colours, by lists and loops: weight has counts by colour."""
    colors = sorted(weight)
    points, w, k = [lab(c) for c in colors], [weight[c] for c in colors], min(k, len(weight))
    picks, draw = [max(range(len(w)), key=lambda i: (w[i], i))], split_mix()
    while len(picks) < k:
        mass = [min(gap(p, points[q]) for q in picks) * m for p, m in zip(points, w, strict=True)]
        left, at = next(draw) * sum(mass), 0
        while at < len(mass) - 1 and left - mass[at] > 0:
            left, at = left - mass[at], at + 1
        while at in picks:
            at = (at + 1) % len(points)
        picks.append(at)
    centres, last = [points[i] for i in picks], None
    for _ in range(24):
        at = [min(range(k), key=lambda c: gap(p, centres[c])) for p in points]
        for c in range(k):
            mine = [i for i, x in enumerate(at) if x == c]
            if medoids and mine:
                picks[c] = min(mine, key=lambda i: sum(gap(points[i], points[j]) * w[j] for j in mine))
                centres[c] = points[picks[c]]
            elif mine:
                total = sum(w[i] for i in mine)
                centres[c] = tuple(sum(points[i][d] * w[i] for i in mine) / total for d in range(3))
        if at == last:
            break
        last = at
    return centres


@pytest.mark.parametrize("query", ["a_palette_kmeans", "a_palette_kmedoids"])
def test_clusters_by_brute_force(spark, query):
    """The registered queries over all of their images; a handful of ties may break otherwise in double precision."""
    folder, off = "/root/testdata/sf0.001", 0
    images, got = counted(queries.emb_pixels(spark, folder)), {}
    for r in queries.QUERIES[query](spark, folder).collect():
        got.setdefault(r["image_id"], []).append((r["rank"], (r["r"], r["g"], r["b"])))
    for i, cells_ in images.items():
        weight = {}
        for c, n in cells_.items():
            if c[3]:
                weight[c[:3]] = weight.get(c[:3], 0) + n
        want = brute_clusters(weight, 4, query.endswith("medoids")) if weight else []
        mine = [c for _, c in sorted(got.pop(i, []))]
        assert len(mine) == len(want)
        off += any(gap(lab(c), w) > 4e-5 for c, w in zip(mine, want, strict=True))
    assert not got and off <= 0.01 * len(images)
