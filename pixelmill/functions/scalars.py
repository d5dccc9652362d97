"""Scalar functions over columns: numbers, text, names, sizes, colours, formats, parameters.

All are built from SQL expressions, so they stay in generated code and work on streams too. Functions that
can fail on a value return null there; ``*_error`` companions say why.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: file extensions of each image format and video container, and of text files
IMAGE_EXTENSIONS = {
    "png": ["png", "apng"],
    "jpeg": ["jpg", "jpeg", "jpe", "jfif"],
    "gif": ["gif"],
    "webp": ["webp"],
    "bmp": ["bmp", "dib"],
    "tiff": ["tif", "tiff"],
    "ico": ["ico"],
    "qoi": ["qoi"],
    "tga": ["tga", "icb", "vda", "vst"],
    "pnm": ["pnm", "pbm", "pgm", "ppm", "pam"],
}
VIDEO_EXTENSIONS = {"mp4": ["mp4", "m4v"], "mkv": ["mkv"], "webm": ["webm"], "mov": ["mov"], "avi": ["avi"]}
# fixed values: container signatures, as hexadecimal prefixes of the content
MAGIC = [
    ("89504E470D0A1A0A", "png"),
    ("FFD8FF", "jpeg"),
    ("474946383761", "gif"),
    ("474946383961", "gif"),
    ("424D", "bmp"),
    ("49492A00", "tiff"),
    ("4D4D002A", "tiff"),
    ("00000100", "ico"),
    ("716F6966", "qoi"),
    ("5031", "pnm"),
    ("5032", "pnm"),
    ("5033", "pnm"),
    ("5034", "pnm"),
    ("5035", "pnm"),
    ("5036", "pnm"),
    ("5037", "pnm"),
]
# fixed values: characters and device names that no file name may have
RESERVED = r'/\\:*?"<>|'
DEVICES = r"CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|(COM|LPT)[1-9¹²³]"
# fixed values: the colour space matrices
TO_LMS = [(0.41222147, 0.53633254, 0.051445995), (0.2119035, 0.6806995, 0.10739696), (0.08830246, 0.28171885, 0.6299787)]
TO_LAB = [(0.21045426, 0.7936178, -0.004072047), (1.9779985, -2.4285922, 0.4505937), (0.025904037, 0.78277177, -0.80867577)]
FROM_LAB = [(1.0, 0.39633778, 0.21580376), (1.0, -0.105561346, -0.06385417), (1.0, -0.08948418, -1.2914855)]
FROM_LMS = [(4.0767417, -3.3077116, 0.23096994), (-1.268438, 2.6097574, -0.34131938), (-0.0041960863, -0.7034186, 1.7076147)]

Arg = Column | int | float | str | bool


def col(value: Arg) -> Column:
    """Columns as they are; anything else is a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def case(pairs: list[tuple[Column, Arg]], otherwise: Arg | None = None) -> Column:
    out = None
    for when, then in pairs:
        out = F.when(when, col(then)) if out is None else out.when(when, col(then))
    return out.otherwise(col(otherwise)) if otherwise is not None else out


# --- arithmetic


def _double(x: Arg) -> Column:
    return col(x).cast("double")


def add(a: Arg, b: Arg) -> Column:
    return _double(a) + _double(b)


def subtract(a: Arg, b: Arg) -> Column:
    return _double(a) - _double(b)


def multiply(a: Arg, b: Arg) -> Column:
    return _double(a) * _double(b)


def divide(a: Arg, b: Arg) -> Column:
    """Null where the divisor is 0."""
    return F.when(_double(b) != 0, _double(a) / F.when(_double(b) != 0, _double(b)))


def remainder(a: Arg, b: Arg) -> Column:
    """Takes the dividend's sign; null where the divisor is 0."""
    return F.when(_double(b) != 0, _double(a) % F.when(_double(b) != 0, _double(b)))


def truncate(a: Arg, b: Arg) -> Column:
    """The quotient cut toward zero; quotients too large to have a fraction stay as they are."""
    q = divide(a, b)
    large = (F.abs(q) >= float(1 << 53)) | F.isnan(q)
    return case([(large, q), (q < 0, F.ceil(F.when(~large, q)).cast("double"))], F.floor(F.when(~large, q)).cast("double"))


def operation_error(op: str, b: Arg) -> Column:
    return F.when((_double(b) == 0) & F.lit(op in ("divide", "remainder", "truncate")), F.lit("division by zero"))


def concat(a: Arg, b: Arg) -> Column:
    return F.concat(to_text(a), to_text(b))


def to_text(value: Arg, kind: str | None = None) -> Column:
    """Text of a text, number or bool; ``kind`` names a column's type (double, boolean or string)."""
    if isinstance(value, bool):
        return F.lit("true" if value else "false")
    if isinstance(value, int | float):
        return number_to_text(value)
    if kind == "double":
        return number_to_text(value)
    return col(value).cast("string")


OPERATIONS: dict[str, Callable[[Arg, Arg], Column]] = {
    "add": add,
    "subtract": subtract,
    "multiply": multiply,
    "divide": divide,
    "remainder": remainder,
    "truncate": truncate,
    "concat": concat,
}


def operation(op: str, a: Arg, b: Arg) -> Column:
    """One of OPERATIONS; an unknown name adds."""
    return OPERATIONS.get(op, add)(a, b)


# --- numbers and text


def saturate(value: Arg, kind: str = "bigint") -> Column:
    """A number cut toward zero to an int or bigint; those out of its range give its nearest end, NaN gives 0."""
    x, bits = _double(value), {"int": 31, "bigint": 63}[kind]
    end = lambda v: F.lit(v).cast(kind)
    return case([(F.isnan(x), end(0)), (x >= float(1 << bits), end((1 << bits) - 1)), (x <= -float(1 << bits), end(-(1 << bits)))], x.try_cast(kind))


def number_to_text(value: Arg) -> Column:
    """Shortest decimal without an exponent; whole numbers without a fraction."""
    text = _double(value).cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    bare = F.regexp_replace(text, "^-", "")
    mantissa, exponent = F.substring_index(bare, "E", 1), F.when(bare.contains("E"), F.substring_index(bare, "E", -1)).otherwise(F.lit("0")).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    size = F.length(digits)
    whole = F.concat(digits, F.repeat(F.lit("0"), F.greatest(exponent + 1 - size, F.lit(0))))
    upward = F.when(size > exponent + 1, F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, size))).otherwise(whole)
    downward = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0))), digits)
    plain = F.regexp_replace(bare, r"\.0$", "")
    return case(
        [(F.isnan(_double(value)), "NaN"), (bare == "Infinity", F.concat(sign, F.lit("inf"))), (~bare.contains("E"), F.concat(sign, plain)), (exponent >= 0, F.concat(sign, upward))],
        F.concat(sign, downward),
    )


def text_to_number(value: Arg) -> Column:
    """The trimmed text as a number, the whole of it; null if it isn't one."""
    text = F.regexp_replace(col(value), r"^[\s\u0085  -     　]+|[\s\u0085  -     　]+$", "")
    number = F.when(text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    sign = F.when(text.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return case([(text.rlike("(?i)^[+-]?inf(inity)?$"), sign * F.lit(float("inf"))), (text.rlike("(?i)^[+-]?nan$"), F.lit(float("nan")))], number)


def describe_number(value: Arg) -> Column:
    x = _double(value)
    whole = (x == F.floor(F.when(F.abs(x) < 1e15, x)).cast("double")) & (F.abs(x) < 1e15)
    return F.when(whole, F.floor(F.when(whole, x)).cast("bigint").cast("string")).otherwise(number_to_text(x))


def describe_text(value: Arg) -> Column:
    """A palette's size, or the text on one line with its middle left out beyond 47 characters."""
    text = col(value)
    flat = F.translate(text, "\n\r", "  ")
    short = F.when(F.char_length(flat) <= 47, flat).otherwise(F.concat(F.left(flat, F.lit(26)), F.lit("…"), F.right(flat, F.lit(20))))
    colors = parse_palette(text)
    return F.when(colors.isNotNull(), F.concat(F.lit("palette · "), F.size(colors).cast("string"), F.lit(" colours"))).otherwise(short)


def human_size(size: Arg) -> Column:
    """B, KB, MB or GB in steps of 1024, one decimal, ties to even."""
    x = _double(size)
    tenths = lambda div: F.bround(x * 10 / float(div), 0) / 10
    one = lambda div, unit: F.concat(F.format_string("%.1f", tenths(div)), F.lit(unit))
    return case([(x < 1024, F.concat(col(size).cast("bigint").cast("string"), F.lit(" B"))), (x < 1024.0**2, one(1024, " KB")), (x < 1024.0**3, one(1024**2, " MB"))], one(1024**3, " GB"))


# --- file names


def valid_file_name(name: Arg) -> Column:
    """A safe single path component on every platform."""
    text = col(name)
    base = F.upper(F.regexp_replace(F.substring_index(text, ".", 1), "[ .]+$", ""))
    bad = (
        (F.octet_length(text) == 0)
        | (F.octet_length(text) > 240)
        | text.rlike(r"[ .]$")
        | text.rlike(rf"[\p{{Cc}}{RESERVED}]")
        | base.rlike(f"^({DEVICES})$")
    )
    return F.coalesce(~bad, F.lit(False))


def file_slug(text: Arg) -> Column:
    """Without white space, control and reserved characters; 48 characters and 96 bytes at most."""
    kept = F.substring(F.regexp_replace(col(text), rf"[\s\u0085  -     　\p{{Cc}}{RESERVED}]", ""), 1, 48)
    # at most 48 characters, so the widest prefix within 96 bytes is found by folding over them
    fold = F.aggregate(
        F.split(kept, ""),
        F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda acc, c: F.struct(
            F.when(acc["full"] | (F.octet_length(acc["s"]) + F.octet_length(c) > 96), acc["s"]).otherwise(F.concat(acc["s"], c)).alias("s"),
            (acc["full"] | (F.octet_length(acc["s"]) + F.octet_length(c) > 96)).alias("full"),
        ),
    )["s"]
    cut = F.when(F.octet_length(kept) <= 96, kept).otherwise(fold)
    trimmed = F.regexp_replace(cut, r"^\.+|\.+$", "")
    return F.when(trimmed == "", F.lit("node")).otherwise(trimmed)


def output_file_name(position: Arg, node: Arg, extension: Arg, port: Arg | None = None, iteration: Column | None = None) -> Column:
    """``001-002-NN-node[-port].ext``; ``iteration`` holds indices from 0, ``position`` too."""
    turn = F.array_join(F.transform(iteration, lambda i: F.format_string("%03d-", (i + 1).cast("int"))), "") if iteration is not None else F.lit("")
    stem = F.concat(turn, F.format_string("%02d-", (col(position) + 1).cast("int")), file_slug(node))
    if port is not None:
        stem = F.concat(stem, F.lit("-"), file_slug(port))
    return F.concat(stem, F.lit("."), col(extension))


def file_stem(path: Arg) -> Column:
    """Last path component up to its last dot; a leading dot starts no extension."""
    name = F.regexp_extract(col(path), r"([^/]*)$", 1)
    stem = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(stem == "", name).otherwise(stem)


# --- formats


def extension(path: Arg) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(col(path), r"([^/]*)$", 1), r"^.+\.([^.]*)$", 1))


def _by_extension(path: Arg, table: dict[str, list[str]]) -> Column:
    e = extension(path)
    return case([(e.isin(*names), kind) for kind, names in table.items()])


def format_from_extension(path: Arg) -> Column:
    return _by_extension(path, IMAGE_EXTENSIONS)


def container_from_extension(path: Arg) -> Column:
    return _by_extension(path, VIDEO_EXTENSIONS)


def sniff_format(content: Column) -> Column:
    """Image format by signature; null if none fits. TGA has none."""
    head = F.hex(F.substring(content, 1, 12))
    riff = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return case([*((head.startswith(prefix), kind) for prefix, kind in MAGIC), (riff, "webp")])


def is_image(fmt: Column) -> Column:
    return fmt.isin(*IMAGE_EXTENSIONS)


def is_video(fmt: Column) -> Column:
    return fmt.isin(*VIDEO_EXTENSIONS)


# --- parameters in JSON


def _param(params: Column, key: str) -> tuple[Column, Column, Column]:
    """(kind, text, number) of a value: kind is string, number, bool, or null for all else, absent ones included."""
    value = F.try_variant_get(F.try_parse_json(params), f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    named = case([(kind == "STRING", "string"), (number, "number"), (kind == "BOOLEAN", "bool")])
    return named, F.get_json_object(params, f"$.{key}"), F.try_variant_get(value, "$", "double")


def param_text(params: Column, key: str, default: Arg) -> Column:
    """Strings, numbers and bools as text; anything else is the default."""
    kind, text, _ = _param(params, key)
    return F.when(kind.isNotNull(), text).otherwise(col(default))


def param_number(params: Column, key: str, default: Arg) -> Column:
    """Numbers, bools as 1 and 0, strings that are numbers; anything else is the default."""
    kind, text, number = _param(params, key)
    found = case([(kind == "number", number), (kind == "string", text_to_number(text)), (kind == "bool", (text == "true").cast("double"))])
    return F.coalesce(found, _double(default))


def param_integer(params: Column, key: str, default: Arg) -> Column:
    """``param_number`` rounded half away from zero; beyond the range of a bigint its nearest end, NaN is 0."""
    return saturate(F.round(param_number(params, key, default)))


def param_bool(params: Column, key: str, default: Arg) -> Column:
    """Bools; numbers are true unless 0; of strings, true, 1 and yes are. Anything else is the default."""
    kind, text, number = _param(params, key)
    return case([(kind == "bool", text == "true"), (kind == "number", number != 0), (kind == "string", F.lower(F.trim(text)).isin("true", "1", "yes"))], col(default))


def with_defaults(given: dict[str, Column], defaults: dict[str, Arg], bounds: dict[str, tuple[float, float]] | None = None) -> Column:
    """A struct of parameters: given ones over defaults, each clamped to its bounds."""
    out = []
    for name, default in defaults.items():
        value = F.coalesce(given[name], col(default)) if name in given else col(default)
        if bounds and name in bounds:
            low, high = bounds[name]
            value = F.greatest(F.lit(low), F.least(F.lit(high), value))
        out.append(value.alias(name))
    return F.struct(*out)


# --- colours


def parse_color(text: Arg) -> Column:
    """struct(r, g, b, a) of ``#rrggbb``, ``#rrggbbaa`` or ``transparent``: the first non-blank line counts.

    Empty text is transparent; anything else is opaque black.
    """
    if isinstance(text, str):
        return F.struct(*[F.lit(v).alias(n) for n, v in zip("rgba", rgba(text), strict=True)])
    line = F.coalesce(F.get(F.filter(F.transform(F.split(col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))
    h = F.regexp_replace(line, "^#+", "")
    byte = lambda at: F.conv(F.substring(h, at, 2), 16, 10).cast("int")
    clear, six, eight = (F.lower(line) == "transparent") | (line == ""), h.rlike("^[0-9a-fA-F]{6}$"), h.rlike("^[0-9a-fA-F]{8}$")
    parts = [case([(clear, 0), (six | eight, byte(at))], 0).alias(n) for n, at in (("r", 1), ("g", 3), ("b", 5))]
    return F.struct(*parts, case([(clear, 0), (eight, byte(7))], 255).alias("a"))


def rgba(text: str) -> tuple[int, int, int, int]:
    """``parse_color`` of a literal, on the driver."""
    import re

    line = next((x.strip() for x in text.splitlines() if x.strip()), "")
    if not line or line.lower() == "transparent":
        return 0, 0, 0, 0
    found = re.fullmatch(r"#*([0-9a-fA-F]{6})([0-9a-fA-F]{2})?", line)
    if not found:
        return 0, 0, 0, 255
    return *bytes.fromhex(found[1]), int(found[2] or "ff", 16)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(r * 65536 + g * 256 + b), 6, "0")))


def palette_text(colors: Column) -> Column:
    return F.array_join(colors, "\n")


def parse_palette(text: Column) -> Column:
    """Lower-case colours of a text with one on each non-blank line; null for any other text."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    fits = (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike("^#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"))
    return F.when(fits, F.transform(lines, lambda x: F.lower(x)))


def first_color(text: Column) -> Column:
    return parse_color(text)


def _apply(matrix: list[tuple], values: list[Column]) -> list[Column]:
    return [sum((F.lit(m) * v for m, v in zip(row[1:], values[1:], strict=True)), F.lit(row[0]) * values[0]) for row in matrix]


def oklab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of 8-bit sRGB channels."""

    def linear(c: Column) -> Column:
        v = c / F.lit(255.0)
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    lms = _apply(TO_LMS, [linear(c) for c in (r, g, b)])
    return F.struct(*[v.alias(n) for n, v in zip("lab", _apply(TO_LAB, [F.cbrt(v) for v in lms]), strict=True)])


def oklab_to_rgb(lab: Column) -> Column:
    """struct(r, g, b), clamped and rounded."""
    lms = [v * v * v for v in _apply(FROM_LAB, [lab["l"], lab["a"], lab["b"]])]

    def encode(v: Column) -> Column:
        v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        s = F.when(v <= 0.0031308, v * 12.92).otherwise(F.lit(1.055) * F.pow(v, F.lit(1 / 2.4)) - 0.055)
        return F.round(s * 255).cast("int")

    return F.struct(*[encode(v).alias(n) for n, v in zip("rgb", _apply(FROM_LMS, lms), strict=True)])


def color_distance(r: Column, g: Column, b: Column, color: Column) -> Column:
    """Largest difference of a channel."""
    return F.greatest(F.abs(r - color["r"]), F.abs(g - color["g"]), F.abs(b - color["b"]))


def min_index_bits(count: Column) -> Column:
    return case([(count <= 2, 1), (count <= 4, 2), (count <= 16, 4)], 8)


def gray_bits(all_1: Column, all_2: Column, all_4: Column) -> Column:
    """Depth of gray values that are all 0 or 255, multiples of 85, or of 17."""
    return case([(all_1, 1), (all_2, 2), (all_4, 4)], 8)


def jpeg_quality(loss: Arg) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(100), saturate(F.round(F.lit(100.0) - _double(loss)), "int")))


def anchor(name: str) -> tuple[float, float]:
    """Share of the leftover that lies left of and above the box, for one of nine anchors."""
    low = name.lower()
    return (0.0 if "left" in low else 1.0 if "right" in low else 0.5), (0.0 if "top" in low else 1.0 if "bottom" in low else 0.5)
