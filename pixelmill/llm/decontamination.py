"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import added, keep_columns, ship
from pixelmill.plans.storage import materialize

ship(__name__)

WINDOW = 10
#: (window, item) pairs searched for at once: bounds what a task holds and what the driver sends (about 20 MB).
MAX_PAIRS = 100_000
# fixed values: bytes that belong to words are 0-9, a-z and all of 0x80 and above; the rest parts words
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# the same as a Java pattern
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WuManber:
    """Exact search for word windows of one length.

    A block is up to three words. ``shift`` says how far the window may move when its last block is the one
    seen; blocks of no pattern allow the most. A shift of zero leads to the few patterns that end in that
    block, which are compared word for word.
    """

    def __init__(self, length: int, patterns: dict[bytes, list[str]]):
        self.length, self.block = length, min(3, length)
        self.most = length - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.ends: dict[bytes, dict[bytes, list[str]]] = defaultdict(dict)
        for pattern, items in patterns.items():
            ws = pattern.split(b" ")
            for end in range(self.block, length + 1):
                key = b" ".join(ws[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.most), length - end)
            self.ends[b" ".join(ws[-self.block :])][pattern] = items

    def find(self, ws: list[bytes]):
        """(start, items) of every occurrence."""
        m, b, most, shift, at, n = self.length, self.block, self.most, self.shift, self.length, len(ws)
        join = b" ".join
        while at <= n:
            key = join(ws[at - b : at])
            step = shift.get(key, most)
            if step:
                at += step
                continue
            items = self.ends[key].get(join(ws[at - m : at]))
            if items:
                yield at - m, items
            at += 1


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (pattern, item): the items' word windows, shorter items whole; items without words have none.
    Rows without item_id are one item, whose name is null."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ws = benchmark.select(F.col("item_id").cast("string").alias("item"), F.array_remove(F.split(lowered, SEPARATORS), "").alias("ws")).where("size(ws) > 0")
    starts = ws.select("item", "ws", F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))).alias("i"))
    return starts.select("item", F.array_join(F.slice("ws", F.col("i"), window), " ").alias("pattern")).distinct()


FIELDS = "n_words bigint, hit_spans array<struct<start:int,stop:int>>, hit_items array<string>"


def _search(patterns: list[tuple[bytes, str | None]], made: list[str], every: bool):
    """A mapInArrow function over rows that end in ``_text``: the other columns and what these patterns find; rows
    with hits alone unless ``every``."""
    by_length: dict[int, dict[bytes, list[str | None]]] = defaultdict(lambda: defaultdict(list))
    for pattern, item in patterns:
        by_length[pattern.count(b" ") + 1][pattern].append(item)
    plain = {n: dict(found) for n, found in by_length.items()}
    types = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())]

    def run(batches):
        tables = [WuManber(n, found) for n, found in plain.items()]
        for batch in batches:
            rows, counts, spans, items = [], [], [], []
            for k, value in enumerate(batch.column("_text").to_pylist()):
                ws = split_words(value)
                hits = [(s, t.length, i) for t in tables for s, i in t.find(ws)]
                if hits or every:
                    rows.append(k)
                    counts.append(len(ws))
                    spans.append([{"start": a, "stop": b} for a, b in sorted({(s, s + n) for s, n, _ in hits})])
                    items.append(sorted({x for _, _, i in hits for x in i}, key=lambda x: (x is None, x or "")))
            at = pa.array(rows, pa.int64())
            kept = [batch.column(c).take(at) for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip((counts, spans, items), types, strict=True))], names=[*(c for c in batch.schema.names if c != "_text"), *made])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_pairs: int = MAX_PAIRS, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its word count, hit spans and the items found.

    Adds ``n_words``, ``hit_spans`` (array of start, stop in words), ``hit_items`` (sorted strings; null, last, for
    benchmark rows without item_id). Patterns are counted first. Beyond ``max_pairs`` they are split by hash into
    blocks of that size: rows are numbered and written once, each block scans the texts and gives the rows that it
    hits, as a table, before the next block's patterns are read; hits of all blocks meet by row. Null texts have no words; an empty benchmark hits nothing, an empty
    table gives no rows; repeated rows are searched each; clashing columns of ``docs`` are replaced.
    """
    made = ["n_words", "hit_spans", "hit_items"]
    pairs = materialize(windows(benchmark, window))
    blocks = max(1, -(-pairs.count() // max_pairs))
    keep = keep_columns(docs, made)
    # columns travel by number, so that no name of theirs can clash
    row = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep.columns)]
    narrow = docs.select(*row, F.col(f"`{text}`").cast("binary").alias("_text"))
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep.columns)]

    def chosen(k: int) -> list[tuple[bytes, str | None]]:
        some = pairs.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks)) == k).select("pattern", "item").collect()
        return [(r["pattern"].encode(), r["item"]) for r in some]

    if blocks == 1:
        return narrow.mapInArrow(_search(chosen(0), made, True), added(narrow.drop("_text").schema, FIELDS)).select(*named, *made)
    numbered = materialize(narrow.withColumn("_n", F.monotonically_increasing_id()))
    found = None
    for k in range(blocks):
        # a table: the driver holds one block's patterns at a time
        hits = materialize(numbered.select("_n", "_text").mapInArrow(_search(chosen(k), made, k == 0), "_n bigint, " + FIELDS))
        found = hits if found is None else found.union(hits)
    merged = materialize(
        found.groupBy("_n").agg(
            F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_spans")))).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items")
        )
    )
    return numbered.join(merged, "_n").select(*named, *made)


def hit_words(spans) -> F.Column:
    """Words inside any of the spans, which are sorted by start."""
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["stop"]), F.lit(0))).alias("n"), F.greatest(a["stop"], x["stop"]).alias("stop")),
    )
    return merged["n"].cast("long")


def report(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = contamination(docs.select("doc_id", "text"), benchmark, **more)
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("hit_spans")).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '{_WORD}') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '{_WORD}') AS ws FROM benchmark
), p AS (
  SELECT DISTINCT item, len(w) AS n, array_to_string(w, ' ') AS g
  FROM (SELECT item, ws[i:i + {WINDOW - 1}] AS w FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0))
), lengths AS (SELECT DISTINCT n FROM p), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lengths WHERE len(ws) >= n)
), h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN p ON dw.g = p.g AND dw.n = p.n
), cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n, unnest(range(0, n)) AS k FROM h) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
"""
