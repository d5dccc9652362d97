"""Listings made by tasks, and sizes of images from their headers."""

import struct

import pytest
from pyspark.sql import functions as F

from pixelmill.sources import files, headers


def png(w, h, color=6, extra=b""):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + extra + chunk(b"IDAT", b"x" * 50)


def jpeg(w, h, before=()):
    segments = b"".join(b"\xff\xe1" + struct.pack(">H", n + 2) + b"e" * n for n in before)
    return b"\xff\xd8" + segments + b"\xff\xff\xc2" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9


def tiff(order, w, h, samples, pad):
    at = 8 + pad
    entry = lambda tag, v: struct.pack(order + "HHIHH", tag, 3, 1, v, 0) if order == "<" else struct.pack(order + "HHIHH", tag, 3, 1, v, 0)
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at)
    return head + b"p" * pad + struct.pack(order + "H", 4) + entry(256, w) + entry(257, h) + entry(262, 2) + entry(277, samples)


TRNS = struct.pack(">I", 1) + b"tRNS" + b"\0" + b"\0\0\0\0"
GIF = lambda w, h, alpha: b"GIF89a" + struct.pack("<HHB", w, h, 0x80) + b"\0\0" + b"c" * 6 + b"\x21\xfe\x03abc\0" + b"\x21\xf9\x04" + bytes([alpha, 0, 0, 0, 0]) + b","
CASES = {
    "a.png": (png(300, 200), ("png", 300, 200, True)),
    "b.png": (png(3, 2, 2), ("png", 3, 2, False)),
    "c.png": (png(3, 2, 3, TRNS), ("png", 3, 2, True)),
    "a.jpg": (jpeg(640, 480), ("jpeg", 640, 480, False)),
    "far.jpg": (jpeg(64, 48, [65000, 65000, 65000]), ("jpeg", 64, 48, False)),
    "a.gif": (GIF(7, 9, 1), ("gif", 7, 9, True)),
    "b.gif": (GIF(7, 9, 0), ("gif", 7, 9, False)),
    "x.webp": (b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x10\0\0\0" + b"\x8f\x01\0" + b"\x2b\x01\0" + b"z" * 40, ("webp", 400, 300, True)),
    "l.webp": (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 399 | 299 << 14 | 1 << 28) + b"z" * 40, ("webp", 400, 300, True)),
    "v.webp": (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 400, 300 | 1 << 14) + b"z" * 40, ("webp", 400, 300, False)),
    "a.bmp": (b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 5, -6, 1, 24) + b"\0" * 30, ("bmp", 5, 6, False)),
    "b.bmp": (b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 108, 5, 6, 1, 32) + b"\0" * 36 + b"\0\0\0\xff" + b"\0" * 30, ("bmp", 5, 6, True)),
    "le.tif": (tiff("<", 70, 80, 4, 100_000), ("tiff", 70, 80, True)),
    "be.tiff": (tiff(">", 70, 80, 3, 20), ("tiff", 70, 80, False)),
    "a.ico": (b"\0\0\1\0\2\0" + bytes([16, 16]) + b"\0" * 14 + bytes([0, 0]) + b"\0" * 14, ("ico", 256, 256, True)),
    "a.qoi": (b"qoif" + struct.pack(">IIBB", 11, 12, 4, 0), ("qoi", 11, 12, True)),
    "a.tga": (b"\0\0\2" + b"\0" * 9 + struct.pack("<HHBB", 21, 22, 32, 8) + b"x", ("tga", 21, 22, True)),
    "a.ppm": (b"P6 # made by\n# hand\n 31\n 32 255\n" + b"\xff" * 10, ("pnm", 31, 32, False)),
    "a.pam": (b"P7\nWIDTH 4\nHEIGHT 5\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n", ("pnm", 4, 5, True)),
}
BAD = {"junk.png": b"not an image", "empty.gif": b"", "short.png": b"\x89PNG\r\n\x1a\n\0\0", "half.jpg": b"\xff\xd8\xff\xe0\0\x10", "no.bmp": b"BM", "cut.ppm": b"P5 12", "no.ico": b"\0\0\1\0\0\0", "text.tga": b"abcd"}


@pytest.mark.parametrize("name", CASES)
def test_header(name):
    data, want = CASES[name]
    read = lambda at, n: data[at : at + n]
    assert headers.header(read, name.split(".")[-1]) == want


@pytest.mark.parametrize("name", BAD)
def test_no_header(name):
    assert headers.header(lambda at, n: BAD[name][at : at + n], name.split(".")[-1]) is None


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("pictures")
    for name, data in {**{n: d for n, (d, _) in CASES.items()}, **BAD, "notes.txt": b"x", ".hidden.png": png(1, 1)}.items():
        (top / name).write_bytes(data)
    for i in range(3):
        (top / f"sub{i}" / "deep").mkdir(parents=True)
        (top / f"sub{i}" / "deep" / f"s{i}.png").write_bytes(png(i + 1, 5) + b"long body" * 100_000)
    return f"file://{top}"


def test_image_headers(spark, folder):
    info, notes = headers.image_headers(spark, folder)
    found = {r["origin"].rsplit("/", 1)[-1]: (r["format"], r["width"], r["height"], r["has_alpha"]) for r in info.collect()}
    assert found == {n: want for n, (_, want) in CASES.items()} | {".hidden.png": ("png", 1, 1, True)}
    assert {r["message"].rsplit("/", 1)[-1] for r in notes.collect()} == set(BAD)
    deep = headers.image_headers(spark, folder, recursive=True, keep=F.col("byte_len") > 500_000)[0].collect()
    assert sorted((r["name_stem"], r["width"], r["height"]) for r in deep) == [("s0", 1, 5), ("s1", 2, 5), ("s2", 3, 5)]
    none, told = headers.image_headers(spark, folder + "/nowhere")
    assert none.count() == 0 and [r["message"] for r in told.collect()] == ["no readable file"]


@pytest.mark.parametrize("shares", [1, 3])
def test_headers_as_a_source(spark, folder, shares):
    spark.dataSource.register(headers.ImageHeaders)
    load = lambda filters=False: spark.read.format("image_headers").option("path", folder).option("recursive", True).option("shares", shares).option("filters", filters).load()
    whole = headers.read_headers(headers.walk(spark, folder, True).where("path not like '%.txt'"))
    rows = lambda df: sorted(map(tuple, df.select("path", "byte_len", "format", "width", "height", "has_alpha", "bytes_read").collect()))
    assert rows(load()) == rows(whole)
    assert load().rdd.getNumPartitions() == 7 * shares  # the top, three folders and one in each
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for condition in ("byte_len > 500000", "byte_len <= 30 and path like '%.gif'", "path like '%.png' and width > 2", "format = 'tiff'", "byte_len = 0 or width is null"):
            assert rows(load(True).where(condition)) == rows(whole.where(condition))
        big = load(True).where("byte_len > 500000 and endswith(path, 's1.png')")
        assert "Filter (" not in big._jdf.queryExecution().executedPlan().toString() and big.count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_few_bytes_are_read(spark, folder):
    read = headers.read_headers(headers.walk(spark, folder, True).where("path not like '%.txt'"))
    got = {r["path"].rsplit("/", 1)[-1]: r["bytes_read"] for r in read.collect()}
    assert max(got.values()) <= headers.MOST_READ and got["far.jpg"] <= headers.FIRST_READ + 100 and got["s1.png"] == got["le.tif"] - 2 - 48 == headers.FIRST_READ


def test_cut_bodies_keep_their_size():
    whole = png(300, 200, 3)
    for cut in range(26, len(whole)):
        assert headers.header(lambda at, n: whole[:cut][at : at + n])[:3] == ("png", 300, 200)  # noqa: B023
    for cut in range(10, 20):
        assert headers.header(lambda at, n: GIF(7, 9, 0)[:cut][at : at + n])[:3] == ("gif", 7, 9)  # noqa: B023


@pytest.mark.parametrize("recursive", [False, True])
def test_listing_on_executors(spark, folder, recursive):
    for limit in (None, 4):
        ours, notes = headers.list_images(spark, folder, recursive, limit)
        theirs, told = files.scan_images(spark, folder, recursive, limit)
        shown = ours.where("path not like '%.hidden%' and byte_len > 0")  # which Spark's own listing leaves out
        if limit is None:
            rows = lambda df: [(r["path"].rsplit("/", 1)[-1], r["format"], r["byte_len"], r["image_id"]) for r in df.orderBy("seq").collect()]
            assert rows(shown) == rows(theirs) and notes.count() == told.count() == 0
        else:
            assert ours.count() == limit and "first 4 are read" in notes.first()["message"]


def test_walk(spark, folder):
    several = headers.walk(spark, [folder + "/sub0/deep", folder + "/a.png", folder[len("file://") :] + "/sub1/deep/"]).collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in several) == ["a.png", "s0.png", "s1.png"]
    assert headers.walk(spark, folder + "/none").count() == 0


def test_round_trip_sizes(spark, tmp_path):
    images = spark.createDataFrame([(1, 9, 4, "a.png")], "image_id long, width int, height int, file_name string")
    px = spark.range(36).selectExpr("1L AS image_id", "cast(id % 9 as int) AS x", "cast(id div 9 as int) AS y", "1 AS r", "2 AS g", "3 AS b", "255 AS a")
    files.write_images(images, px, f"file://{tmp_path}")
    r = headers.image_headers(spark, f"file://{tmp_path}")[0].first()
    assert (r["format"], r["width"], r["height"]) == ("png", 9, 4)
