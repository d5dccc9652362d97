"""Sizes of images from their headers alone, read by tasks."""

from __future__ import annotations

import operator
import struct
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

from pixelmill.functions.args import ID
from pixelmill.functions.scalars import IMAGE_EXTENSIONS, extension, file_stem, format_from_extension
from pixelmill.operators.pixels import note
from pixelmill.plans.storage import materialize
from pixelmill.sources.files import _missing, _ordered, path_id
from pixelmill.sources.listing import listed, store_of, walk

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

MOST_READ = 65536  # bytes that are read of a file, in all
FIRST_READ = 4096
EXTENSIONS = frozenset(sum(IMAGE_EXTENSIONS.values(), []))

def list_images(spark: SparkSession, path: str | list[str], recursive: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``files.scan_images`` with hidden and empty files, which Spark's own listing leaves out. Same columns, order, cap and notes."""
    named = walk(spark, path, recursive).where(extension(F.col("path")).isin(*EXTENSIONS))
    return _ordered(materialize(named.select(path_id(F.col("path")).alias(ID), "path", format_from_extension(F.col("path")).alias("format"), "byte_len")), limit)


# --- headers

Read = Callable[[int, int], bytes]
Head = tuple[str, int, int, bool] | None  # format, width, height, has_alpha


def header(read: Read, extension: str = "") -> Head:
    """Format, size and whether there is an alpha channel, by signature; TGA, which has none, by ``extension``.

    ``read(offset, n)`` gives up to n bytes. Null if no format fits or the header itself is cut off.
    """
    head = read(0, 32)
    try:
        for signature, parse in PARSERS:
            if head.startswith(signature):
                return parse(head, read)
        return _tga(head, read) if extension in ("tga", "icb", "vda", "vst") else None
    except (struct.error, IndexError, ValueError):
        return None


def _png(head: bytes, read: Read) -> Head:
    width, height, _, color = struct.unpack(">IIBB", head[16:26])
    at, alpha = 8, color in (4, 6)
    while not alpha and at < MOST_READ:  # a tRNS chunk, if any, comes before the pixels
        size, kind = struct.unpack(">I4s", read(at, 8))
        if kind in (b"IDAT", b"IEND"):
            break
        alpha, at = kind == b"tRNS", at + size + 12
    return "png", width, height, alpha


def _png_or_cut(head: bytes, read: Read) -> Head:
    try:
        return _png(head, read)
    except struct.error:  # the chunks end early: the size stands
        width, height, _, color = struct.unpack(">IIBB", head[16:26])
        return "png", width, height, color in (4, 6)


def _jpeg(head: bytes, read: Read) -> Head:
    at = 2
    while True:  # segments are skipped by their lengths, however large they are
        mark, kind, size = struct.unpack(">BBH", read(at, 4))
        if mark != 0xFF:
            return None
        if kind == 0xFF:  # fill
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", read(at + 5, 4))
            return "jpeg", width, height, False
        elif kind == 0x01 or 0xD0 <= kind <= 0xD9:
            at += 2
        else:
            at += 2 + size


def _gif(head: bytes, read: Read) -> Head:
    """The alpha channel is that of a graphic control block before the first frame."""
    width, height, flags = struct.unpack("<HHB", head[6:11])
    at, alpha = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), False
    while (block := read(at, 8))[:1] == b"\x21":
        if block[1:2] == b"\xf9":
            alpha = bool(block[3] & 1)
        at += 2
        while size := read(at, 1)[0]:
            at += size + 1
        at += 1
    return "gif", width, height, alpha


def _gif_or_cut(head: bytes, read: Read) -> Head:
    try:
        return _gif(head, read)
    except (IndexError, struct.error):
        return "gif", *struct.unpack("<HH", head[6:10]), False


def _webp(head: bytes, read: Read) -> Head:
    if head[8:12] != b"WEBP":
        return None
    kind = head[12:16]
    if kind == b"VP8X":
        return "webp", 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(read(27, 3), "little"), bool(head[20] & 0x10)
    if kind == b"VP8L":
        (bits,) = struct.unpack("<I", head[21:25])
        return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), bool(bits >> 28 & 1)
    width, height = struct.unpack("<HH", head[26:30])
    return "webp", width & 0x3FFF, height & 0x3FFF, False


def _bmp(head: bytes, read: Read) -> Head:
    (size,) = struct.unpack("<I", head[14:18])
    if size == 12:
        return "bmp", *struct.unpack("<HH", head[18:22]), False
    width, height, _, bits = struct.unpack("<iiHH", head[18:30])
    masked = bits == 32 and size >= 56 and struct.unpack("<I", read(66, 4))[0] != 0
    return "bmp", width, abs(height), masked


def _tiff(head: bytes, read: Read) -> Head:
    order = "<" if head[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", head[4:8])
    (n,) = struct.unpack(order + "H", read(at, 2))
    entries, found = read(at + 2, 12 * n), {}
    for i in range(0, len(entries) - 11, 12):
        tag, kind, _ = struct.unpack(order + "HHI", entries[i : i + 8])
        if kind in (3, 4):
            (found[tag],) = struct.unpack(order + ("H" if kind == 3 else "I"), entries[i + 8 : i + (10 if kind == 3 else 12)])
    samples = found.get(277, 1) - (0 if found.get(262, 1) in (0, 1, 3) else 2)
    return ("tiff", found[256], found[257], samples == 2) if 256 in found and 257 in found else None


def _ico(head: bytes, read: Read) -> Head:
    """The largest picture; the first of ties. All have alpha."""
    (n,) = struct.unpack("<H", head[4:6])
    table = read(6, 16 * n)
    sizes = [((table[i] or 256), (table[i + 1] or 256)) for i in range(0, len(table) - 15, 16)]
    return ("ico", *max(sizes, key=lambda s: s[0] * s[1]), True) if sizes else None


def _qoi(head: bytes, read: Read) -> Head:
    width, height, channels = struct.unpack(">IIB", head[4:13])
    return "qoi", width, height, channels == 4


def _tga(head: bytes, read: Read) -> Head:
    kind = head[2]
    width, height, depth, flags = struct.unpack("<HHBB", head[12:18])
    return ("tga", width, height, depth == 32 or flags & 15 == 8 and depth == 16) if kind in (1, 2, 3, 9, 10, 11) else None


def _pnm(head: bytes, read: Read) -> Head:
    data, words, at = read(0, FIRST_READ), [], 2
    if head[1:2] == b"7":
        fields = dict(line.split(None, 1) for line in data.split(b"ENDHDR")[0].split(b"\n")[1:] if len(line.split(None, 1)) == 2 and not line.startswith(b"#"))
        return "pnm", int(fields[b"WIDTH"]), int(fields[b"HEIGHT"]), b"ALPHA" in fields.get(b"TUPLTYPE", b"")
    while len(words) < 2:  # numbers between blanks and comments; one that the read cuts off is an error
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while 48 <= data[end] <= 57:
                end += 1
            words.append(int(data[at:end]))
            at = end
    return "pnm", *words, False


PARSERS: list[tuple[bytes, Callable[[bytes, Read], Head]]] = [
    (b"\x89PNG\r\n\x1a\n", _png_or_cut),
    (b"\xff\xd8\xff", _jpeg),
    (b"GIF87a", _gif_or_cut),
    (b"GIF89a", _gif_or_cut),
    (b"RIFF", _webp),
    (b"BM", _bmp),
    (b"II*\0", _tiff),
    (b"MM\0*", _tiff),
    (b"\0\0\1\0", _ico),
    (b"qoif", _qoi),
    *((b"P%d" % i, _pnm) for i in range(1, 8)),
]


def ranges(store, base: str) -> tuple[Read, Callable[[], int]]:
    """(``read`` of a file that asks for the bytes it lacks, up to MOST_READ in all; how many it has asked for)."""
    file, first, asked = store.open_input_file(base), b"", 0

    def read(offset: int, n: int) -> bytes:
        nonlocal first, asked
        if not asked:
            first = file.read_at(FIRST_READ, 0)
            asked = FIRST_READ
        if offset + n <= len(first) or len(first) < FIRST_READ:
            return first[offset : offset + n]
        if asked + n > MOST_READ:
            return b""
        asked += n
        return file.read_at(n, offset)

    return read, lambda: asked


def read_headers(files: DataFrame) -> DataFrame:
    """Add ``format, width, height, has_alpha`` and ``bytes_read`` to ``files(path, ...)`` from the first bytes and, where
    the format puts its size elsewhere, a few more ranges: never more than MOST_READ of a file, whatever its length.

    Null where no header is found, or the file can't be opened. A filter on the listing before this opens no other file.
    """
    made = ["format", "width", "height", "has_alpha", "bytes_read"]
    kept = files.select(*[c for c in files.columns if c not in made])

    def run(batches):
        for b in batches:
            out = [_head(path) for path in b.column("path").to_pylist()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*b.schema.names, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]
    return kept.mapInArrow(run, ", ".join([*fields, "format string, width int, height int, has_alpha boolean, bytes_read bigint"]))


def _head(path: str) -> tuple:
    """format, width, height, has_alpha, bytes_read of a file; nulls where there is no header to be read."""
    try:
        read, asked = ranges(*store_of(path))
        return (*(header(read, path.rsplit(".", 1)[-1].lower()) or (None,) * 4), asked())
    except OSError:
        return (None,) * 5


@dataclass
class Share(InputPartition):
    """The files of a folder whose names hash to ``number`` of ``of``."""

    folder: str
    number: int
    of: int


class ImageHeaders(DataSource):
    """``spark.read.format("image_headers").option("path", uri).load()``: path, byte_len, and what ``read_headers`` adds.

    Options: ``recursive`` (false); ``shares`` (1), among how many tasks each folder's files are dealt. A folder's share
    is a partition: its task lists the folder and opens its own files. The planner keeps folders only. With the option
    ``filters`` (false), which needs ``spark.sql.python.filterPushdown.enabled``, comparisons of byte_len and what a path
    starts or ends with are pushed down: other files aren't opened.
    """

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return "path string, byte_len bigint, format string, width int, height int, has_alpha boolean, bytes_read bigint"

    def reader(self, schema) -> DataSourceReader:
        kind = FilteringReader if str(self.options.get("filters", "false")).lower() == "true" else HeadersReader
        return kind(self.options["path"], str(self.options.get("recursive", "false")).lower() == "true", int(self.options.get("shares", 1)))


class HeadersReader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, shares: int):
        self.path, self.recursive, self.shares, self.tests = path, recursive, shares, []

    def partitions(self) -> list[InputPartition]:
        folders = [self.path]
        for folder in folders:  # those below are added as they are found
            if self.recursive:
                folders += [path for path, _, inner in listed(folder) if inner]
        return [Share(folder, i, self.shares) for folder in folders for i in range(self.shares)]

    def read(self, partition: Share):
        for path, size, inner in listed(partition.folder):
            if inner or crc32(path.encode()) % partition.of != partition.number or path.rsplit(".", 1)[-1].lower() not in EXTENSIONS:
                continue
            if all(test(path, size) for test in self.tests):
                yield path, size, *_head(path)


class FilteringReader(HeadersReader):
    """Spark refuses readers that take filters where ``spark.sql.python.filterPushdown.enabled`` is not set."""

    def pushFilters(self, filters):
        compared = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
        for f in filters:
            if type(f) in compared and f.attribute == ("byte_len",):
                self.tests.append(lambda path, size, c=compared[type(f)], v=f.value: c(size, v))
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.tests.append(lambda path, size, v=f.value: path.endswith(v))
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.tests.append(lambda path, size, v=f.value: path.startswith(v))
            elif not (isinstance(f, IsNotNull) and f.attribute in (("path",), ("byte_len",))):  # these never are
                yield f


def image_headers(spark: SparkSession, path: str | list[str], recursive: bool = False, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(images; failed notes): ``image_info`` without decoding: image_id, origin, name_stem, name_auto_ext, format, width, height, has_alpha, byte_len.

    ``keep`` is a condition on path, format (by extension) and byte_len: files that don't fit aren't opened. Files are
    dealt over all tasks, so a folder of very many is no one task's work. Bodies that are cut off don't matter.
    """
    images = walk(spark, path, recursive).withColumn("format", format_from_extension(F.col("path"))).where("format is not null")
    chosen = (images if keep is None else images.where(keep)).drop("format")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = materialize(read_headers(chosen.repartition(parts, "path")).withColumn(ID, path_id(F.col("path"))))
    good = F.col("width").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0)
    info = read.where(good).select(ID, F.col("path").alias("origin"), file_stem(F.col("path")).alias("name_stem"), F.lit(True).alias("name_auto_ext"), "format", "width", "height", "has_alpha", "byte_len")
    bad = note(read.where(F.coalesce(~good, F.lit(True))), "header", "failed", F.concat(F.lit("no header: "), F.col("path")))
    return info, bad.union(_missing(read, "header"))
