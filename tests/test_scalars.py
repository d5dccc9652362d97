"""Scalar functions on single values."""

import pytest
from pyspark.sql import functions as F

from pixelmill.functions import scalars as sc


def values(spark, column, rows, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_number_to_text(spark):
    rows = [42.0, 3.5, 1e21, 1.5e-7, -0.0, 123456789.25, 1e7, float("nan"), float("inf"), float("-inf"), -2.5e10, 1.7976931348623157e308]
    got = values(spark, sc.number_to_text, rows, "double")
    assert got[:11] == ["42", "3.5", "1" + "0" * 21, "0.00000015", "-0", "123456789.25", "10000000", "NaN", "inf", "-inf", "-25000000000"]
    assert float(got[11]) == rows[11] and "e" not in got[11].lower()


def test_text_to_number(spark):
    rows = [" 12 ", "1e3", "1d", "0x10", ".5", "5.", "inf", "-Infinity", "", "true", "1_000", "+7"]
    assert values(spark, sc.text_to_number, rows, "string") == [12.0, 1000.0, None, None, 0.5, 5.0, float("inf"), float("-inf"), None, None, None, 7.0]


def test_arithmetic(spark):
    ops = {"add": (7, 3, 10), "subtract": (7, 3, 4), "multiply": (7, 3, 21), "divide": (7, 2, 3.5), "remainder": (7, 3, 1), "truncate": (7, 2, 3), "other": (1, 2, 3)}
    row = spark.range(1).select(*[sc.operation(k, F.lit(float(a)), F.lit(float(b))).alias(k) for k, (a, b, _) in ops.items()]).first()
    assert [row[k] for k in ops] == [v[2] for v in ops.values()]
    zero = spark.range(1).select(*[sc.operation(k, F.lit(1.0), F.lit(-0.0)).alias(k) for k in ("divide", "remainder", "truncate")]).first()
    assert list(zero) == [None] * 3
    signs = spark.range(1).select(sc.truncate(F.lit(-7.0), F.lit(2.0)).alias("t"), sc.remainder(F.lit(-7.0), F.lit(3.0)).alias("r"), sc.truncate(F.lit(1e300), F.lit(1.0)).alias("l")).first()
    assert list(signs) == [-3.0, -1.0, 1e300]


def test_file_names(spark):
    bad = ["../escape", "..\\escape", "C:escape", "NUL", "com1.png", "tail.", "tail ", "", "a\tb", "x" * 241, "é" * 121, "LPT³", "nul .txt", ".", ".."]
    good = ["a", "a.png", "console", "COM10", ".hidden", "é" * 120, "com0"]
    assert values(spark, sc.valid_file_name, bad + good, "string") == [False] * len(bad) + [True] * len(good)
    slugs = values(spark, sc.file_slug, ["a b/c", "...", "x" * 60, "界" * 40, " .a. ", ""], "string")
    assert slugs == ["abc", "node", "x" * 48, "界" * 32, "a", "node"]
    name = spark.range(1).select(sc.output_file_name(4, "my node", "png", "out", F.array(F.lit(0), F.lit(1))).alias("n")).first()["n"]
    assert name == "001-002-05-mynode-out.png"


def test_colors(spark):
    rows = ["#ff0000", "transparent", "#11223344", "\n  #0000ff\n#00ff00", "nonsense", "", "##abcdef", "#12"]
    got = [tuple(r) for r in values(spark, sc.parse_color, rows, "string")]
    assert got == [(255, 0, 0, 255), (0, 0, 0, 0), (0x11, 0x22, 0x33, 0x44), (0, 0, 255, 255), (0, 0, 0, 255), (0, 0, 0, 0), (0xAB, 0xCD, 0xEF, 255), (0, 0, 0, 255)]
    assert [sc.rgba(r) for r in rows] == got
    assert values(spark, sc.parse_palette, ["#FF0000\n\n#00ff0011", "#ff0000\nx", "", "ff0000"], "string") == [["#ff0000", "#00ff0011"], None, None, None]


@pytest.mark.parametrize(("size", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1536, "1.5 KB"), (5 * 1024**2, "5.0 MB"), (3 * 1024**4, "3072.0 GB")])
def test_human_size(spark, size, text):
    assert values(spark, sc.human_size, [size], "bigint") == [text]


def test_describe(spark):
    assert values(spark, sc.describe_text, ["a\nb", "#ff0000\n#00ff00", "x" * 30 + "y" * 30, "z" * 47], "string") == ["a b", "palette · 2 colours", "x" * 26 + "…" + "y" * 20, "z" * 47]
    assert values(spark, sc.describe_number, [3.0, 2.5, 1e15], "double") == ["3", "2.5", "1000000000000000"]


def test_formats(spark):
    assert values(spark, sc.format_from_extension, ["a.PNG", "b.jfif", "dir.png/c", "d.pam", ".png"], "string") == ["png", "jpeg", None, "pnm", None]
    heads = [b"\x89PNG\r\n\x1a\n0", b"\xff\xd8\xff\xe0", b"GIF89a", b"RIFF\0\0\0\0WEBP", b"RIFF\0\0\0\0WAVE", b"BM12", b"II*\0", b"qoif", b"P6\n", b"zz"]
    assert values(spark, sc.sniff_format, heads, "binary") == ["png", "jpeg", "gif", "webp", None, "bmp", "tiff", "qoi", "pnm", None]


def test_params(spark):
    df = spark.createDataFrame([('{"a": "3.6", "b": true, "c": "yes", "d": [1], "e": 0}',)], "p string")
    p = F.col("p")
    row = df.select(
        sc.param_integer(p, "a", 1).alias("a"), sc.param_number(p, "b", 5).alias("b"), sc.param_bool(p, "c", False).alias("c"), sc.param_text(p, "d", "x").alias("d"), sc.param_bool(p, "e", True).alias("e"), sc.param_number(p, "z", 9).alias("z"), sc.param_bool(p, "z", True).alias("f")
    ).first()
    assert list(row) == [4, 1.0, True, "x", False, 9.0, True]
    rows = ['{"k": "true"}', '{"k": "2"}', '{"k": "[a]"}', '{"k": [1]}', '{"k": null}', '{"k": 2.5}', '{"k": false}', '{"k": " YES "}', '{"k": {"a": 1}}', "{}", "no json", '{"k": 1e400}', '{"k": 12345678901234567890}']
    assert values(spark, lambda p: sc.param_number(p, "k", 7), rows, "string")[:11] == [7.0, 2.0, 7.0, 7.0, 7.0, 2.5, 0.0, 7.0, 7.0, 7.0, 7.0]
    assert values(spark, lambda p: sc.param_bool(p, "k", False), rows, "string")[:11] == [True, False, False, False, False, True, False, True, False, False, False]
    assert values(spark, lambda p: sc.param_bool(p, "k", True), rows, "string")[3:5] == [True, True]
    assert values(spark, lambda p: sc.param_text(p, "k", "x"), rows, "string")[:11] == ["true", "2", "[a]", "x", "x", "2.5", "false", " YES ", "x", "x", "x"]
    assert values(spark, lambda p: sc.param_number(p, "k", 7), rows, "string")[12] == 12345678901234567890.0


def test_integers_saturate(spark):
    cases = {'{"k":1e30}': 2**63 - 1, '{"k":"1e30"}': 2**63 - 1, '{"k":"inf"}': 2**63 - 1, '{"k":-1e30}': -(2**63), '{"k":"-inf"}': -(2**63), '{"k":"NaN"}': 0, '{"k":2.5}': 3, '{"k":-2.5}': -3, '{"k":9e18}': 9 * 10**18, "{}": 7}
    df = spark.createDataFrame(list(cases.items()), "p string, want long")
    assert all(r["got"] == r["want"] for r in df.select("want", sc.param_integer(F.col("p"), "k", 7).alias("got")).collect())
    ends = [(1e30, 2**31 - 1), (-1e30, -(2**31)), (float("nan"), 0), (float("inf"), 2**31 - 1), (5.9, 5), (-5.9, -5), (None, None), (2.0**31 - 1, 2**31 - 1), (2.0**31, 2**31 - 1)]
    assert all(r["got"] == r["n"] for r in spark.createDataFrame(ends, "x double, n long").select("n", sc.saturate(F.col("x"), "int").alias("got")).collect())
