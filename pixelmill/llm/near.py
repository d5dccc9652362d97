"""Exact search for sets of word shingles of a similarity: a prefix filter over rarest shingles, checked on whole sets.

``simhash.similar_groups`` uses it for the pairs that fingerprints can't reach. Two sets of similarity s or more share
an element of the first n - ceil(s n) + 1 of each, whatever the order of all elements is, as long as it is one. Here
rare shingles come first, by a table of counts over all texts, so shared ones are few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import LOWER, has_bit, id_bits, ship
from pixelmill.plans.storage import materialize

ship(__name__)

#: Counters of the table of shingle counts, and those that one row carries. A counter is shared by shingles of one
#: slot, which only makes the order less sharp: any order gives the same groups. Its size is set here, not by the data.
SLOTS, SLICE = 1 << 22, 1 << 12
#: Bits of two fingerprints in which a similar pair may differ.
FAR = 48
LONG = 64  # shingles; smaller sets have fingerprints too rough to go by


def hash_runs(text: bytes | None, size: int):
    """64-bit hashes of a text's word shingles, some at a time; a shorter text is one; none without words."""
    from xxhash import xxh64_intdigest

    ws = text.translate(LOWER).split() if text else []
    join, n = b" ".join, max(len(ws) - size + 1, 1)
    for at in range(0, n if ws else 0, 1 << 16):
        part = ws[at : at + (1 << 16) + size - 1]
        shingles = [join(part)] if len(part) < size else map(join, zip(*(part[k:] for k in range(size)), strict=False))
        yield np.array([xxh64_intdigest(s, 42) for s in shingles], np.uint64)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    found = list(hash_runs(text, size))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - (SLOTS - 1).bit_length())).astype(np.int64)


class Tally:
    """How many texts of a task have a shingle of each slot; a task counts to 255."""

    def __init__(self):
        self.counts = np.zeros(SLOTS, np.int64)

    def add(self, sets: list[np.ndarray]) -> None:
        if sets:
            self.counts += np.bincount(slots(np.concatenate(sets)), minlength=SLOTS)

    def slices(self) -> list[tuple[int, bytes]]:
        rows = np.minimum(self.counts, 255).astype(np.uint8).reshape(-1, SLICE)
        return [(i, r.tobytes()) for i, r in enumerate(rows) if r.any()]


def levels(tallies: DataFrame) -> np.ndarray:
    """``tallies(slice, counts)`` of all tasks -> the level of every slot: a logarithm of its sum, one byte each."""

    def run(batches):
        at, total = None, np.zeros(SLICE, np.int64)
        for b in batches:
            out = []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != at:
                    if at is not None:
                        out.append((at, (4 * np.log2(total + 1)).astype(np.uint8).tobytes()))
                    at, total = i, np.zeros(SLICE, np.int64)
                total += np.frombuffer(raw, np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["slice", "levels"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(4 * np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())], names=["slice", "levels"])

    made, out = tallies.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, levels binary"), np.zeros(SLOTS, np.uint8)
    for r in made.collect():  # SLOTS bytes
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["levels"], np.uint8)
    return out


def prefix(grams: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The elements, in the common order, one of which any set of that similarity shares."""
    n = len(grams)
    return grams[np.lexsort((grams, level[slots(grams)]))][: n + (-n * percent // 100) + 1]


def text_key() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(text_key().alias("h"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def each_once(batches, most: int = 1 << 22):
    """(h, text) rows of a task's batches, a text the first time that the task sees it; about ``most`` bytes at a time."""
    seen: set[int] = set()
    hs, texts, held = [], [], 0
    for b in batches:
        column = b.column(1)
        for i, h in enumerate(b.column(0).to_pylist()):
            if h not in seen:
                seen.add(h)
                hs.append(h)
                texts.append(column[i].as_py())
                held += len(texts[-1])
                if held > most:
                    yield hs, texts
                    hs, texts, held = [], [], 0
    yield hs, texts


def prefixes(docs: DataFrame, level: np.ndarray, size: int, percent: int) -> DataFrame:
    """(g, h, n, place) for every shingle g in the prefix of the text h of n shingles; once a task, so copies in one task are one."""
    table = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        level = table.value
        for hs, texts in each_once(batches):
            keys, ids, ns, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
            for h, text in zip(hs, texts, strict=True):
                grams = shingle_set(text, size)
                first = prefix(grams, level, percent).view(np.int64) if len(grams) else np.zeros(1, np.int64)
                keys.append(first)
                ids.append(np.full(len(first), h, np.int64))
                ns.append(np.full(len(first), len(grams), np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, ids, ns, places)], names=["g", "h", "n", "place"])

    return keyed_texts(docs).mapInArrow(run, "g bigint, h bigint, n int, place int")


def buckets(rows: DataFrame) -> DataFrame:
    """``rows(g, h, n, place)`` whose g occurs again. The keys are a table of their own, so an adaptive join can split a hot one."""
    rows = materialize(rows)
    twice = materialize(rows.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"))
    return materialize(rows.join(twice, "g", "left_semi").distinct())


def apart(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of buckets whose members lie in several components so far, with their component c and the bucket's hub y:
    the member that shares most of its prefix, as the text does that the others were made of."""
    shared = rows.groupBy("h").agg(F.count("*").alias("shared"))
    named = rows.select("g", "h", "n", "place").join(shared, "h").join(parts.withColumnRenamed("node", "h"), "h", "left")
    named = materialize(named.select("g", "h", "n", "place", "shared", F.coalesce("component", "h").alias("c")))
    hub = F.min(F.struct(-F.col("shared"), "h", "n", "c")).alias("hub")
    told = named.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), hub).where("low < high")
    hubs = materialize(told.select("g", F.col("hub.h").alias("y"), F.col("hub.n").alias("y_n"), F.col("hub.c").alias("y_c")))
    return materialize(named.drop("shared").join(hubs, "g"))


def near_sizes(percent: int) -> F.Column:
    return 100 * F.least("n", "y_n") >= percent * F.greatest("n", "y_n")


def least_shared(percent: int) -> F.Column:
    """Shingles that two sets of that similarity share at least."""
    return F.ceil(percent * (F.col("n") + F.col("y_n")) / (100 + percent) - 1e-6)


def hub_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Each bucket's members with its hub, where their components differ: joins large groups by few pairs.

    Sets that share t elements share k of their first n - t + k; the prefixes say how large k may be.
    """
    rest = lambda n: F.ceil(percent * F.col(n) / 100 - 1e-6)
    need = least_shared(percent) - F.greatest(rest("n"), rest("y_n")) + 1
    made = live.where("c <> y_c").where(near_sizes(percent)).select(F.least("h", "y").alias("a"), F.greatest("h", "y").alias("b"), need.alias("need"))
    return made.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("need").alias("need")).where("k >= need").select("a", "b")


def open_pairs(live: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket whose components still differ and that can be similar.

    The first shingle that two similar sets share comes early in both: what is left from it on must hold all that they
    share. Other pairs don't leave the join, nor do those of sets of ``LONG`` shingles or more whose two fingerprints differ
    in more than ``FAR`` of 128 bits: a pair of similarity 0.8 differs in 19 on average with a deviation of 4, one of
    unrelated texts in 64.
    """
    rows = materialize(live.select("g", "h", "n", "place", "c").join(prints, "h"))
    other = rows.select("g", *[F.col(c).alias(f"y_{c}") for c in ("h", "n", "place", "c", "fingerprint", "second")])
    far = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("y_fingerprint"))) + F.bit_count(F.col("second").bitwiseXOR(F.col("y_second")))
    early = F.least(F.col("n") - F.col("place"), F.col("y_n") - F.col("y_place")) >= least_shared(percent)
    met = rows.join(other, "g").where((F.col("h") < F.col("y_h")) & (F.col("c") != F.col("y_c")) & early & ((far <= FAR) | (F.least("n", "y_n") < LONG)))
    return met.select(F.col("h").alias("a"), F.col("y_h").alias("b")).distinct()


def verified(docs: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """``found(a, b)`` with ``good``: whether the whole texts' shingle sets have that similarity (texts without words are alike)."""
    found = materialize(found)
    wanted = found.select(F.col("a").alias("h")).union(found.select("b")).distinct()

    shared = docs.sparkSession.sparkContext.broadcast(id_bits(wanted, "h"))

    def likely(batches):
        for b in batches:
            yield b.filter(pa.array(has_bit(shared.value, b.column(0).to_numpy())))

    def sets(batches):
        for hs, texts in each_once(likely(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array([shingle_set(t, size).tobytes() for t in texts], pa.binary())], names=["h", "grams"])

    def check(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                m, n = len(x) // 8, len(y) // 8
                k = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                good.append(100 * k >= percent * (m + n - k))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "good"])

    found_sets = keyed_texts(docs).mapInArrow(sets, "h bigint, grams binary")
    whole = materialize(found_sets.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("grams").alias("grams")))
    left = found.join(whole.select(F.col("h").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(whole.select(F.col("h").alias("b"), F.col("grams").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint, good boolean"))
