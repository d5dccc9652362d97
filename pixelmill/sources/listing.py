"""Listing folders and reading whole files by tasks: neither paths nor contents pass through the driver."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from pixelmill.plans.storage import located, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

LISTED = 10_000  # entries of a folder that one batch holds
MOST_HELD = 8 << 20  # bytes of files that one batch holds, but for a larger file's
ENTRY = "path string, byte_len bigint, folder boolean"


def walk(spark: SparkSession, path: str | list[str], recursive: bool = False, hidden: bool = True) -> DataFrame:
    """path, byte_len of the files in folders: listed by tasks, a level of folders at a time.

    Only the number of folders of a level reaches the driver. Files and folders that Spark takes for hidden are listed
    too, unless told not to. A path that is a file is its own listing; one that doesn't exist has none. Paths are URIs, or local.
    """
    roots = spark.createDataFrame([(p,) for p in ([path] if isinstance(path, str) else path)], "path string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = lambda batches: _entries(batches, hidden)
    found, files = materialize(roots.mapInArrow(entries, ENTRY)), []
    while True:
        files.append(found.where("not folder").select("path", "byte_len"))
        below = found.where("folder").select("path")
        if not recursive or (n := below.count()) == 0:
            break
        found = materialize(below.repartition(min(n, parts)).mapInArrow(entries, ENTRY))
    out = files[0]
    for level in files[1:]:
        out = out.union(level)
    return out


def _entries(batches: Iterator[pa.RecordBatch], hidden: bool) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        paths, sizes, folders = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(folders, pa.bool_())], names=["path", "byte_len", "folder"])

    for b in batches:
        for path in b.column("path").to_pylist():
            rows = []
            for entry in listed(path):
                if hidden or not _hidden(entry[0].rsplit("/", 1)[-1]):
                    rows.append(entry)
                if len(rows) == LISTED:
                    yield batch(rows)
                    rows = []
            yield batch(rows)


def _hidden(name: str) -> bool:
    """As Spark's own listing has it."""
    return name[:1] == "." or name.endswith("._COPYING_") or name[:1] == "_" and "=" not in name


def listed(path: str) -> Iterator[tuple[str, int | None, bool]]:
    """(path, bytes, whether it is a folder) of what is in a folder; a file is its own listing. Local folders go by as a stream."""
    from pyarrow import fs

    path = path.rstrip("/") or path
    store, base = store_of(path)
    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
    info = store.get_file_info(base)
    if info.type == fs.FileType.Directory and isinstance(store, fs.LocalFileSystem):
        with os.scandir(base) as entries:
            for entry in entries:
                if entry.is_dir():
                    yield prefix + entry.path, None, True
                elif entry.is_file():
                    yield prefix + entry.path, entry.stat().st_size, False
        return
    for entry in store.get_file_info(fs.FileSelector(base)) if info.type == fs.FileType.Directory else [info]:
        if entry.type in (fs.FileType.File, fs.FileType.Directory):
            yield prefix + entry.path, entry.size, entry.type == fs.FileType.Directory


def store_of(path: str, known: dict | None = None):
    """(store, path in it). Paths are taken as Spark does: nothing in them is decoded, blanks and signs are as they are.
    ``known`` keeps remote stores from one file to the next."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].strip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path.rstrip("/") or "/"
    scheme, rest = path.split("://", 1)
    authority, _, inner = rest.partition("/")
    root, known = f"{scheme}://{authority}/", {} if known is None else known
    if root not in known:
        known[root] = fs.FileSystem.from_uri(root)
    store, base = known[root]
    return store, f"{base.rstrip('/')}/{inner}".rstrip("/") or "/"


def by_tasks(spark: SparkSession, path: str | list[str]) -> list[str] | None:
    """The paths in full, if tasks can list them: no patterns, and in stores that pyarrow knows. An error if one doesn't exist."""
    paths, full = [path] if isinstance(path, str) else path, []
    for p in paths:
        if any(c in p for c in "*?[]{}\\"):
            return None
        whole, there = located(p, spark)
        try:
            store_of(whole)
        except (OSError, ValueError, NotImplementedError):
            return None
        if not there:
            raise FileNotFoundError(f"path does not exist: {p}")
        full.append(whole)
    return full


def read_files(files: DataFrame, sums: bool = False) -> DataFrame:
    """``files(path, ...)`` with their ``content``, or with ``checksum`` (CRC32) if ``sums``: a file's bytes then stay in its task, a piece at a time.

    Files are dealt over all tasks, whatever folder they are in.
    """

    def run(batches):
        known = {}

        def opened(path: str):
            store, base = store_of(path, known)
            return store.open_input_stream(base, compression=None)

        def summed(path: str) -> int:
            total = 0
            with opened(path) as data:
                while piece := data.read(MOST_HELD):
                    total = crc32(piece, total)
            return total

        def whole(path: str) -> bytes:
            with opened(path) as data:
                return data.read()

        def batch(b: pa.RecordBatch, values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.int64() if sums else pa.binary())], names=[*b.schema.names, "checksum" if sums else "content"])

        for b in batches:
            paths = b.column("path").to_pylist()
            if sums:
                yield batch(b, [summed(p) for p in paths])
                continue
            begin, held, size = 0, [], 0
            for i, path in enumerate(paths):
                held.append(whole(path))
                size += len(held[-1])
                if size >= MOST_HELD or i + 1 == len(paths):
                    yield batch(b.slice(begin, len(held)), held)
                    begin, held, size = i + 1, [], 0

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields]
    return files.repartition(parts, "path").mapInArrow(run, ", ".join([*fields, "checksum bigint" if sums else "content binary"]))
