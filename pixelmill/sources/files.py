"""Files as tables and back: listings, text, media, pixels, names, PNG output, manifests."""

from __future__ import annotations

import io
import json
import struct
import sys
import time
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.window import Window

from pixelmill.functions.args import ID
from pixelmill.functions.scalars import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, container_from_extension, extension, file_stem, format_from_extension, sniff_format, valid_file_name
from pixelmill.operators.pixels import note
from pixelmill.plans.ranks import global_rank, rank_in_groups
from pixelmill.plans.storage import materialize
from pixelmill.sources.listing import by_tasks, read_files, walk

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

# fixed values: extensions of files that are read as text
TEXT_EXTENSIONS = "txt md markdown json csv tsv toml yaml yml xml ini log rs js ts py sh c h cpp css html".split()
READ_CAP = 1024
MOST_NAMES = 10_000


def _listing(spark: SparkSession, path: str | list[str], recursive: bool, keep: Column | None = None, read: str = "") -> DataFrame:
    """path, length of files that aren't hidden or empty, and their ``content`` or ``checksum`` (``read``). Files that don't fit ``keep`` aren't opened.

    Tasks list folders and read files. Only paths with patterns, and those in stores that pyarrow doesn't know, are listed by Spark's own reader,
    which holds all paths on the driver.
    """
    if (paths := by_tasks(spark, path)) is None:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        found = reader.load(path).select("path", "length", F.crc32("content").alias("checksum") if read == "checksum" else "content")
        return found if keep is None else found.where(keep)
    shown = walk(spark, paths, recursive, hidden=False).where("byte_len > 0").withColumnRenamed("byte_len", "length")
    kept = shown if keep is None else shown.where(keep)
    return read_files(kept, sums=read == "checksum") if read else kept


def path_id(path: Column) -> Column:
    """Id of a file: a hash of its path, written alike by every reader (/x, file:/x and file:///x are one)."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(path, "^/+", "file:/"), "^([a-z0-9]+):/+", "$1:/"))


def _missing(found: DataFrame, op: str) -> DataFrame:
    """A failed note, without an image_id, if there is no row."""
    none = found.agg(F.count("*").alias("n")).where("n = 0")
    return note(none.select(F.lit(None).cast("bigint").alias(ID)), op, "failed", "no readable file")


def _ordered(found: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Files by path components with ``seq``; notes tell of files beyond ``limit``, which are left out, and of no file at all."""
    parts, notes = F.split("path", "/"), _missing(found, "scan")
    if limit is not None:
        total = found.count()
        found = found.orderBy(parts).limit(limit)
        if total > limit:
            notes = notes.union(note(found.limit(1), "scan", "ok", f"{total} files, the first {limit} are read"))
    return global_rank(found, [parts], "seq"), notes


def scan_images(spark: SparkSession, path: str | list[str], recursive: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(image_id, path, format, byte_len, seq; notes) of the files with an image extension. No content is read."""
    found = _listing(spark, path, recursive, extension(F.col("path")).isin(*sum(IMAGE_EXTENSIONS.values(), []))).select("path", F.col("length").alias("byte_len"))
    listed = found.select(path_id(F.col("path")).alias(ID), "path", format_from_extension(F.col("path")).alias("format"), "byte_len")
    return _ordered(listed, limit)


def scan_texts(spark: SparkSession, path: str | list[str], recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(image_id, path, text; notes) of text files. Notes tell of those that aren't valid UTF-8, which are left out, and of no text at all."""
    found = _listing(spark, path, recursive, extension(F.col("path")).isin(*TEXT_EXTENSIONS), "content").withColumn(ID, path_id(F.col("path")))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    texts = found.where(valid).select(ID, "path", F.col("content").cast("string").alias("text"))
    skipped = note(found.where(~valid), "scan", "skipped", F.concat(F.lit("not UTF-8: "), F.col("path")))
    return texts, skipped.union(_missing(found.where(valid).select(ID), "scan"))


def scan_media(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """image_id, path, container, length of video files. No content is read."""
    found = _listing(spark, path, recursive, extension(F.col("path")).isin(*sum(VIDEO_EXTENSIONS.values(), [])))
    return found.select(path_id(F.col("path")).alias(ID), "path", container_from_extension(F.col("path")).alias("container"), "length")


def read_image(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(image_id, path, format, byte_len, content; failed notes): format by signature first, extension second."""
    found = _listing(spark, path, False, read="content").select(
        path_id(F.col("path")).alias(ID), "path", F.coalesce(sniff_format(F.col("content")), format_from_extension(F.col("path"))).alias("format"), F.col("length").alias("byte_len"), "content"
    )
    return found.where("format is not null"), note(found.where("format is null"), "read", "failed", F.concat(F.lit("no image: "), F.col("path")))


def read_text(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(image_id, path, text; failed notes of files that aren't UTF-8)."""
    found = _listing(spark, path, False, read="content").withColumn(ID, path_id(F.col("path")))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return found.where(valid).select(ID, "path", F.col("content").cast("string").alias("text")), note(found.where(~valid), "read", "failed", "not UTF-8")


def load_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Spark's image reader with our ids: image_id, origin, image; unreadable files have width -1."""
    return spark.read.format("image").load(path).select(path_id(F.col("image.origin")).alias(ID), F.col("image.origin").alias("origin"), "image")


def image_info(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images; failed notes of unreadable files) of ``load_images``. ``data`` is read for has_alpha alone."""
    good = loaded.where("image.width > 0")
    info = good.select(
        ID, "origin", file_stem(F.col("origin")).alias("name_stem"), F.lit(True).alias("name_auto_ext"), format_from_extension(F.col("origin")).alias("format"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), (F.col("image.nChannels") == 4).alias("has_alpha")
    )
    return info, note(loaded.where("image.width <= 0"), "decode", "failed", F.concat(F.lit("unreadable: "), F.col("origin")))


def decode_pixels(loaded: DataFrame) -> DataFrame:
    """Dense RGBA rows of ``load_images``; gray and RGB become opaque. One image is spread over many batches."""

    def run(batches):
        for b in batches:
            for i, w, h, n, data in zip(*(b.column(c).to_pylist() for c in (ID, "w", "h", "n", "data")), strict=True):
                grid = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rgb = grid[:, :, [2, 1, 0]] if n >= 3 else np.repeat(grid[:, :, :1], 3, 2)
                alpha = grid[:, :, 3] if n == 4 else np.full((h, w), 255, np.uint8)
                step = max(1, 65536 // w)
                for top in range(0, h, step):
                    part, y = rgb[top : top + step].reshape(-1, 3), np.repeat(np.arange(top, min(top + step, h)), w)
                    columns = [np.full(len(y), i, np.int64), np.tile(np.arange(w), len(y) // w), y, *part.T, alpha[top : top + step].ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(c.astype(np.int32)) for c in columns[1:])], names=[ID, *"xyrgba"])

    good = loaded.where("image.width > 0").select(ID, F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))
    return good.mapInArrow(run, "image_id bigint, x int, y int, r int, g int, b int, a int")


# --- names and output


def name_outputs(images: DataFrame, directory: str) -> tuple[DataFrame, DataFrame]:
    """(images with directory and file_name; failed notes): name hint, else origin's stem, else ``output``.

    The extension is the actual format's, unless a hint asks to be taken as it is.
    """
    stem = F.coalesce("name_stem", F.when(F.col("origin").isNotNull(), file_stem(F.col("origin"))), F.lit("output"))
    verbatim = F.col("name_stem").isNotNull() & (F.col("name_auto_ext") == F.lit(False))
    kind = F.when(F.col("format") == "jpeg", F.lit("jpg")).otherwise(F.col("format"))
    named = images.withColumns({"directory": F.lit(directory.rstrip("/")), "file_name": F.when(verbatim, stem).otherwise(F.concat(stem, F.lit("."), kind))})
    ok = valid_file_name(F.col("file_name")) & valid_file_name(stem)
    return named.where(ok), note(named.where(~ok), "name", "failed", F.concat(F.lit("invalid file name: "), F.col("file_name")))


def _parts(name: Column) -> tuple[Column, Column]:
    stem = file_stem(name)
    return stem, F.substring(name, F.length(stem) + 1, F.length(name))


def _slot(stem: Column, most: int | None) -> tuple[Column, Column]:
    """(the stem, the number) of a stem that ends in `` (n)`` as numbering up to ``most`` gives it; null for others."""
    number = F.regexp_extract(stem, r" \(([1-9][0-9]{0,17})\)$", 1).try_cast("bigint")
    number = F.when((number >= 2) & (F.lit(True) if most is None else number <= most), number)
    return F.when(number.isNotNull(), F.regexp_replace(stem, r" \([0-9]+\)$", "")), number


def _passed(held: DataFrame, key: list[str]) -> DataFrame:
    """The ``held(*key, _slot, _before)`` slots that requests pass over, with ``_free``, the number of others below.

    ``_before`` requests come before a slot is held, so it is passed over if they don't reach it: if more slots below are
    open to requests than that. A stem's slots go by in order; nothing but the number passed over so far is kept.
    """

    def run(batches):
        at, count = None, 0
        for b in batches:
            stems, out = list(zip(*(b.column(c).to_pylist() for c in key), strict=True)), []
            for i, (stem, slot, before) in enumerate(zip(stems, b.column("_slot").to_pylist(), b.column("_before").to_pylist(), strict=True)):
                if stem != at:
                    at, count = stem, 0
                if slot - count > before:
                    count += 1
                    out.append((i, slot - count))
            kept = b.select(key).take(pa.array([i for i, _ in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([free for _, free in out], pa.int64())], names=[*key, "_free"])

    fields = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in key)
    ordered = held.select(*key, "_slot", "_before").repartition(*key).sortWithinPartitions(*key, "_slot")
    return ordered.mapInArrow(run, f"{fields}, _free bigint")


def dedupe_names(named: DataFrame, existing: DataFrame | None = None, overwrite: bool = True, endless: bool = False) -> tuple[DataFrame, DataFrame]:
    """(``named(image_id, directory, file_name, seq, ...)`` with the names that files get; failed notes).

    ``overwrite``: the last writer of a name wins. Otherwise later ones become ``stem (2).ext`` and so on past
    ``existing(directory, file_name)`` too; MOST_NAMES of a stem at most, or any number if ``endless``. ``seq`` differs from row to row.

    Files of a stem ask, in order of ``seq``, for its slots: 1 is the name itself, n is ``stem (n)``. A slot is theirs unless it
    exists, or a file whose own name it is has come before. So a stem's k-th file gets slot k, but where numbered names
    are about: there the slots that are passed over are found first, and places among both give the slots. Files of a stem
    are spread over tasks; one task takes a stem's numbered names, as a stream.
    Stems are settled before those with one number more, whose names they may have taken.
    """
    if overwrite:
        last = Window.partitionBy("directory", "file_name").orderBy(F.desc("seq"))
        return named.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n"), note(named.where("false"), "dedupe", "ok", "")
    most = None if endless else MOST_NAMES
    key, spark = ["directory", "_stem", "_suffix"], named.sparkSession
    split = lambda df: df.withColumns(dict(zip(("_stem", "_suffix"), _parts(F.col("file_name")), strict=True)))
    upto = lambda df, c: df if most is None else df.where(F.col(c) <= most)
    keyed = split(named)
    if existing is None:
        existing = spark.createDataFrame([], "directory string, file_name string")
    there = split(existing.select("directory", "file_name").distinct())
    depth = F.size(F.split(F.regexp_extract("_stem", r"(( \([0-9]+\))+)$", 1), r"\(")) - 1
    asked = materialize(upto(rank_in_groups(keyed.select(*key, F.col("seq").cast("bigint").alias("seq")), key, [F.col("seq")], "_n"), "_n").withColumn("_depth", depth))
    # slots that others hold: (stem, slot, since when, or null for always)
    always, one = F.lit(None).cast("bigint").alias("_since"), F.lit(1).cast("bigint").alias("_slot")
    parent, number = _slot(F.col("_stem"), most)
    upper = lambda df, since: df.select("directory", parent.alias("_stem"), "_suffix", number.alias("_slot"), since).where("_slot is not null")
    first = asked.where("_n = 1")
    held = materialize(there.select(*key, one, always).union(upper(there, always)).union(upper(first, F.col("seq").alias("_since"))))
    since = F.when(F.count("_since") == F.count("*"), F.min("_since")).alias("_since")
    settled, above = None, None
    for d in range((asked.agg(F.max("_depth")).first()[0] or 0) + 1):
        level, taken = asked.where(F.col("_depth") == d), held
        if above is not None:  # names that the stems before have given away
            given = above.where("_slot > 1").select("directory", F.concat("_stem", F.lit(" ("), F.col("_slot").cast("string"), F.lit(")")).alias("_stem"), "_suffix", one, F.col("seq").alias("_since"))
            taken = held.union(given)
        odd = taken.select(*key).distinct()
        slots = level.join(odd, key, "left_anti").select(*key, "seq", F.col("_n").alias("_slot"))
        hard = materialize(level.join(odd, key, "left_semi").select(*key, "seq", "_n"))
        if not hard.isEmpty():
            taken = materialize(taken.join(hard.select(*key).distinct(), key, "left_semi").groupBy(*key, "_slot").agg(since))
            both = hard.select(*key, F.col("seq").alias("_since"), F.lit(None).cast("bigint").alias("_slot")).union(taken.where("_since is not null").select(*key, "_since", "_slot"))
            of_both = rank_in_groups(both, key, [F.col("_since"), F.col("_slot")], "_all").where("_slot is not null")
            before = rank_in_groups(of_both, key, [F.col("_since"), F.col("_slot")], "_held").select(*key, "_slot", (F.col("_all") - F.col("_held")).alias("_before"))
            passed = _passed(before.union(taken.where("_since is null").select(*key, "_slot", F.lit(0).cast("bigint"))).where("_slot > _before"), key)
            # of a place that a request and a slot share, the request has the lower slot
            places = hard.select(*key, "seq", F.col("_n").alias("_at"), F.lit(0).alias("_kind")).union(passed.select(*key, F.lit(None).cast("bigint"), "_free", F.lit(1)))
            slots = slots.union(upto(rank_in_groups(places, key, [F.col("_at"), F.col("_kind"), F.col("seq")], "_slot").where("_kind = 0").select(*key, "seq", "_slot"), "_slot"))
        above = materialize(slots)
        settled = above if settled is None else settled.union(above)
    new = F.when(F.col("_slot") == 1, F.col("file_name")).when(F.col("_slot") > 1, F.concat("_stem", F.lit(" ("), F.col("_slot").cast("string"), F.lit(")"), "_suffix"))
    renamed = keyed.join(settled, [*key, "seq"], "left").withColumn("file_name", new).select(*named.columns)
    ok = F.coalesce(valid_file_name(F.col("file_name")), F.lit(False))
    failed = note(renamed.where(~ok), "dedupe", "failed", F.coalesce(F.concat(F.lit("invalid file name: "), F.col("file_name")), F.lit("no name is free")))
    return renamed.where(ok), failed


def encode_png(images: DataFrame, pixels: DataFrame) -> DataFrame:
    """image_id, content: 8-bit RGBA PNG files. One image is encoded in one task."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["_w"].iloc[0]), int(pdf["_h"].iloc[0])
        grid = np.zeros((h, w, 4), np.uint8)
        grid[pdf["y"], pdf["x"]] = pdf[["r", "g", "b", "a"]].to_numpy(np.uint8)
        rows = np.concatenate([np.zeros((h, 1), np.uint8), grid.reshape(h, w * 4)], 1)  # filter type 0 of each row
        head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
        content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
        return pd.DataFrame({ID: [pdf[ID].iloc[0]], "content": [content]})

    sized = pixels.join(images.select(ID, F.col("width").alias("_w"), F.col("height").alias("_h")), ID)
    return sized.groupBy(ID).applyInPandas(run, "image_id bigint, content binary")


class Files(DataSource):
    """``df(file_name, content).write.format("files").option("path", uri)``: one file per row, bytes untouched."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"])


@dataclass
class Staged(WriterCommitMessage):
    """Where a task put its files, and their list; not their names, which only the store holds."""

    folder: str


class FileWriter(DataSourceWriter):
    """Writes on executors, to any store that pyarrow knows by its URI: either all files of a job appear, or none.

    Tasks write to a folder of their own below ``_staging-<job>``, with a list of names, sizes and checksums. ``commit``
    moves the files of the tasks that counted to their names (an older file of that name is replaced) and then puts the job's
    manifest among those of ``_manifest``. ``abort`` removes what tasks have staged, and the directory if the job made it.
    Attempts that failed or ran twice leave nothing.
    """

    def __init__(self, path: str):
        from pyarrow.fs import FileSystem, FileType

        self.path, self.job = path, uuid.uuid4().hex
        store, base = FileSystem.from_uri(path)
        self.fresh = store.get_file_info(base).type == FileType.NotFound
        store.create_dir(self._store()[2], recursive=True)

    def _store(self):
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(self.path)
        return store, base, f"{base}/_staging-{self.job}"

    def write(self, iterator) -> WriterCommitMessage:
        store, _, staging = self._store()
        folder = f"{staging}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=False)  # an error once the job is aborted: a late task leaves nothing either
        store.create_dir(f"{folder}/files", recursive=False)
        with store.open_output_stream(f"{folder}/list") as listed:
            for row in iterator:
                name, content = row["file_name"], bytes(row["content"])
                with store.open_output_stream(f"{folder}/files/{name}") as out:
                    out.write(content)
                listed.write(json.dumps({"name": name, "size": len(content), "checksum": zlib.crc32(content)}).encode() + b"\n")
        return Staged(folder)

    def commit(self, messages) -> None:
        store, base, staging = self._store()
        store.create_dir(f"{base}/_manifest", recursive=True)
        name = f"{time.time_ns():020d}-{self.job}.json"
        with store.open_output_stream(f"{staging}/{name}") as manifest:
            for message in messages:
                if message is None:
                    continue
                with store.open_input_stream(f"{message.folder}/list") as listed:
                    for line in io.BufferedReader(listed):
                        entry = json.loads(line)
                        store.move(f"{message.folder}/files/{entry['name']}", f"{base}/{entry['name']}")
                        manifest.write(line)
        store.move(f"{staging}/{name}", f"{base}/_manifest/{name}")
        store.delete_dir(staging)

    def abort(self, messages) -> None:
        from pyarrow.fs import FileSelector, FileType

        store, base, staging = self._store()
        for _ in range(20):  # tasks may still be writing
            if store.get_file_info(staging).type != FileType.Directory:
                break
            try:
                store.delete_dir(staging)
            except OSError:
                time.sleep(0.1)
        if self.fresh and store.get_file_info(base).type == FileType.Directory and not store.get_file_info(FileSelector(base)):
            store.delete_dir(base)


def read_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """name, size, checksum of the files that committed jobs of the ``files`` sink wrote; the last job to write a name counts."""
    schema = "name string, size bigint, checksum bigint"
    each = spark.read.schema(schema).json(f"{directory.rstrip('/')}/_manifest/*.json").withColumn("_job", F.col("_metadata.file_name"))
    return each.groupBy("name").agg(F.max_by(F.struct("size", "checksum"), "_job").alias("_v")).select("name", "_v.size", "_v.checksum")


def write_images(images: DataFrame, pixels: DataFrame, directory: str) -> DataFrame:
    """Write named images (``name_outputs``, ``dedupe_names``) as PNG; returns image_id and path."""
    spark = images.sparkSession
    spark.dataSource.register(Files)
    files = images.select(ID, "file_name").join(encode_png(images, pixels), ID)
    files.select("file_name", "content").write.format("files").mode("append").option("path", directory).save()
    return images.select(ID, F.concat(F.lit(directory.rstrip("/") + "/"), "file_name").alias("path"))


def product_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """name, size, checksum (CRC32) of the files of a directory."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return _listing(spark, directory, False, read="checksum").select(name.alias("name"), F.col("length").alias("size"), "checksum")


def audit_products(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """name, status: owned (unchanged), edited, missing, or foreign (never ours). Only owned files may be reclaimed."""
    here = listing.select("name", F.col("size").alias("_size"), F.col("checksum").alias("_sum"))
    met = manifest.join(here, "name", "full")
    status = (
        F.when(F.col("size").isNull(), F.lit("foreign"))
        .when(F.col("_size").isNull(), F.lit("missing"))
        .when((F.col("size") == F.col("_size")) & (F.col("checksum") == F.col("_sum")), F.lit("owned"))
        .otherwise(F.lit("edited"))
    )
    return met.select("name", status.alias("status"))
