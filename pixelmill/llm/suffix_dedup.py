"""Repeated passages by sparse suffix arrays: suffixes at minimiser positions, sorted by words, compared with their
neighbours, and matches extended to the left."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_128_intdigest

from pixelmill.llm.common import LOWER, added, ship
from pixelmill.plans.storage import materialize, scratch

ship(__name__)


@dataclass(frozen=True)
class Config:
    """A passage counts from ``passage`` words on; positions are chosen by hashes of ``gram`` words. The ranges of the
    sort are found from ``sample`` suffixes a task, which the driver sees."""

    passage: int = 50
    gram: int = 18
    sample: int = 10

    @property
    def reach(self) -> int:
        """Grams among which the least is retained: every passage has at least one retained suffix inside."""
        return self.passage - self.gram + 1


# an odd multiplier and its inverse modulo 2**64, for position-free hashes of word runs
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Hasher:
    """64-bit hashes of every run of k words of a text, vectorised."""

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, INVERSE, np.uint64)], dtype=np.uint64)

    def prefix(self, text: bytes | None) -> np.ndarray:
        """Sums over word hashes, from which ``runs`` takes the hash of any run. One more than words."""
        from xxhash import xxh64_intdigest

        ws, known = text.translate(LOWER).split() if text else [], self.words
        if len(known) > 400_000:
            known.clear()
        values = []
        for w in ws:
            h = known.get(w)
            if h is None:
                h = known[w] = xxh64_intdigest(w)
            values.append(h)
        self.powers(len(ws) + 1)
        h = np.array(values, np.uint64)
        return np.r_[np.uint64(0), np.cumsum(h * self.down[: len(h)], dtype=np.uint64)]

    def runs(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = len(prefix) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        x = (prefix[k:] - prefix[:n]) * self.up[:n]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def owners(grams: np.ndarray, reach: int) -> np.ndarray:
    """For each passage start, the position of the least gram among the next ``reach`` ones (the first of ties)."""
    if len(grams) < reach:
        return np.empty(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(1) + np.arange(len(grams) - reach + 1)


def sparse_suffixes(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id, digest, n_words and the retained suffixes of every text: the hash of the first words, position, and
    the passages that the position stands for, as the least and the most words before it. A text that the task has
    had before has null for them."""
    suffix = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]))

    def run(batches):
        hasher, had = Hasher(), set()
        for b in batches:
            counts, found = [], []
            for digest, text in zip(b.column("digest").to_pylist(), b.column("_text").to_pylist(), strict=True):
                prefix = hasher.prefix(text)
                counts.append(len(prefix) - 1)
                if digest in had:
                    found.append(None)
                    continue
                had.add(digest)
                grams = hasher.runs(prefix, config.gram)
                owner = owners(grams, config.reach)
                at, first, times = np.unique(owner, return_index=True, return_counts=True)  # a position owns a run of starts
                high = at - first
                found.append([dict(zip(("gram", "at", "low", "high"), x, strict=True)) for x in zip(grams[at].view(np.int64).tolist(), at.tolist(), (high - times + 1).tolist(), high.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(counts, pa.int64()), pa.array(found, suffix)], names=["doc_id", "digest", "n_words", "suffixes"])

    rows = keyed(docs)
    return rows.mapInArrow(run, added(rows.drop("_text").schema, "n_words bigint, suffixes array<struct<gram:bigint,at:int,low:int,high:int>>"))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("digest"), text.alias("_text"))


def contexts(docs: DataFrame, alive: DataFrame, config: Config) -> DataFrame:
    """(digest, at, low, high, right, left) of ``alive`` suffixes: their words from ``at`` on, as many as a passage has,
    and those before it, backwards. Each word ends in a space, so bytes order as words do."""

    def once(batches):
        had = set()
        for b in batches:
            rows = [i for i, d in enumerate(b.column(0).to_pylist()) if not (d in had or had.add(d))]
            yield b.take(pa.array(rows, pa.int64()))

    def run(batches):
        names = ["digest", "at", "low", "high", "right", "left"]
        for b in batches:
            out = []
            for digest, text, live in zip(b.column("digest").to_pylist(), b.column("_text").to_pylist(), b.column("alive").to_pylist(), strict=True):
                ws = [w + b" " for w in text.translate(LOWER).split()]
                for x in live:
                    at = x["at"]
                    out.append((digest, at, x["low"], x["high"], b"".join(ws[at : at + config.passage]), b"".join(ws[max(at - config.reach + 1, 0) : at][::-1])))
                if len(out) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    types = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    texts = keyed(docs).select("digest", "_text").mapInArrow(once, "digest binary, _text binary")
    met = texts.join(alive, "digest").groupBy("digest").agg(F.first("_text").alias("_text"), F.first("alive").alias("alive"))
    return met.mapInArrow(run, "digest binary, at int, low int, high int, right binary, left binary")


def common(a: list[bytes], b: list[bytes]) -> int:
    if a == b:
        return len(a)
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


@dataclass
class Suffix:
    digest: bytes
    at: int
    low: int
    high: int
    right: list[bytes]
    left: list[bytes]
    place: int  # in its task


@dataclass
class Match:
    """Two neighbours in the order: words in common to the right and the left, and whether their texts differ."""

    right: int
    left: int
    differ: bool

    @classmethod
    def of(cls, x: Suffix, y: Suffix) -> Match:
        return cls(common(x.right, y.right), common(x.left, y.left), x.digest != y.digest)

    def offsets(self, passage: int) -> range:
        """Words before the suffix at which a passage that both have can start."""
        return range(max(passage - self.right, 0), self.left + 1 if self.differ else 0)


NONE = Match(0, 0, False)


def judged(x: Suffix, before: Match, after: Match, passage: int):
    """What the neighbours say: (first start, last start) of passages found, and passages left to look up.

    A neighbour has the most words in common to the right, but one further away may have more to the left. So the
    passages that the suffix stands for, as far as any suffix reaches to the right, are looked up by their words
    (start, key, known), but for those that the suffix before it has too, which are looked up from there.
    """
    found = []
    for m in (before, after):
        o = m.offsets(passage)
        if len(o):
            found.append((x.at - o[-1], x.at - o[0]))
    had, known, open_ = before.offsets(passage), after.offsets(passage), []
    for o in range(max(passage - max(before.right, after.right), x.low), x.high + 1):
        if o not in had:
            key = xxh3_128_intdigest(b" ".join([*x.left[:o][::-1], *x.right[: passage - o]]))
            open_.append((x.at - o, key, o in known))
    return set(found), open_


def compared(passage: int):
    """mapInArrow over suffixes in order: ``judged`` of each. A task's first two and last two rows leave as they are
    (kind 2), because the ends (known) have a neighbour in another task."""
    from pyspark import TaskContext

    kinds = [pa.int8(), pa.binary(), *[pa.int32()] * 3, *[pa.int64()] * 2, pa.bool_(), pa.binary(), pa.binary()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["kind", "digest", "a", "b", "c", "k1", "k2", "known", "right", "left"])

    def run(batches):
        part, first, last, before = TaskContext.get().partitionId(), [], [], NONE
        for b in batches:
            out = []
            for digest, at, low, high, right, left in zip(*(b.column(c).to_pylist() for c in ("digest", "at", "low", "high", "right", "left")), strict=True):
                x = Suffix(digest, at, low, high, right.split(), left.split(), last[-1].place + 1 if last else 0)
                if last:
                    after = Match.of(last[-1], x)
                    if last[-1].place:
                        out += told(last[-1], before, after, passage)
                    before = after
                if x.place < 2:
                    first.append(x)
                last = [*last[-1:], x]
            yield rows(out)
        ends = [*first, *(x for x in last if x.place > 1)]
        yield rows([(2, x.digest, x.at, x.low, x.high, part, x.place, x.place == 0 or x is last[-1], b" ".join(x.right), b" ".join(x.left)) for x in ends])

    return run


def told(x: Suffix, before: Match, after: Match, passage: int) -> list[tuple]:
    found, open_ = judged(x, before, after, passage)
    rows = [(0, x.digest, lo, hi, None, None, None, None, None, None) for lo, hi in found]
    for start, key, known in open_:
        k1, k2 = (k - (1 << 64) if k >> 63 else k for k in (key >> 64, key & (1 << 64) - 1))
        rows.append((1, x.digest, start, None, None, k1, k2, known, None, None))
    return rows


FOUND = "kind tinyint, digest binary, a int, b int, c int, k1 bigint, k2 bigint, known boolean, right binary, left binary"


def across(made: DataFrame, passage: int) -> DataFrame:
    """``judged`` of the rows at the ends of tasks, on the driver: at most four rows a task reach it."""
    rows = sorted(made.where("kind = 2").collect(), key=lambda r: (r["k1"], r["k2"]))
    line = [(r["known"], Suffix(bytes(r["digest"]), r["a"], r["b"], r["c"], bytes(r["right"]).split(), bytes(r["left"]).split(), r["k2"])) for r in rows]
    out = []
    for i, (end, x) in enumerate(line):
        if end:
            before = Match.of(line[i - 1][1], x) if i else NONE
            after = Match.of(x, line[i + 1][1]) if i + 1 < len(line) else NONE
            out += told(x, before, after, passage)
    return made.sparkSession.createDataFrame(out, FOUND)


def repeated_passages(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The table of passages of ``passage`` words or more that occur in another text too: doc_id, start, stop (in words), n_words.

    A passage is a maximal run of starts each of whose ``passage`` words another text has, in order; every run of so
    many words is found, wherever it lies. A text that several doc_ids have is one passage of each, if it is long enough.

    Suffixes are retained at minimiser positions, at least one inside every passage; those whose first words no other
    text has (by a hash) end there. The others are sorted by their words in ranges of tasks, each is compared word by
    word with its neighbours in the order, and matches are extended to the left. Where a suffix further away might
    reach further left, the passages still open are looked up by 128-bit keys; chains of neighbours that share a
    passage look it up once, so a passage of very many documents forms neither pairs nor a large group.

    Null, empty and short texts have no passages, an empty table no rows. doc_id may be of any type; rows with equal
    doc_id and text count once, rows of one text without doc_id stand behind those with one; other columns of ``docs``
    play no part, whatever their names.
    """
    with scratch() as keep:
        return keep(_repeated_passages(docs, config))


def _repeated_passages(docs: DataFrame, config: Config) -> DataFrame:
    rows = materialize(sparse_suffixes(docs.select("doc_id", "text"), config))
    classes = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n_words").alias("n")))
    several = classes.where(f"first < last and n >= {config.passage}").select("digest")
    copies = rows.join(several, "digest", "left_semi").select("doc_id", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop"), "n_words")

    occ = rows.where("suffixes is not null").select("digest", F.explode("suffixes").alias("s")).select("digest", "s.gram", F.struct("s.at", "s.low", "s.high").alias("s"))
    # the keys are a table of their own, so that an adaptive join can split the rows of a frequent one
    text = F.xxhash64("digest")
    twice = materialize(occ.groupBy("gram").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low < high").select("gram"))
    alive = materialize(occ.join(twice, "gram", "left_semi").groupBy("digest").agg(F.collect_set("s").alias("alive")))

    known = materialize(contexts(docs.select("doc_id", "text"), alive, config))
    order = ["right", "left", "digest", "at"]
    conf, name = docs.sparkSession.conf, "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    ordered = known.repartitionByRange(int(conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    usual = conf.get(name)
    conf.set(name, str(config.sample))  # the keys are long
    try:
        made = materialize(ordered.mapInArrow(compared(config.passage), FOUND))
    finally:
        conf.set(name, usual)
    made = made.where("kind < 2").union(across(made, config.passage))

    open_ = made.where("kind = 1")
    keys = materialize(open_.groupBy("k1", "k2").agg(F.min(text).alias("low"), F.max(text).alias("high"), F.bool_or("known").alias("known")).where("known or low < high").select("k1", "k2"))
    starts = made.where("kind = 0").select("digest", "a", "b").union(open_.where("not known").join(keys, ["k1", "k2"], "left_semi").select("digest", "a", F.col("a").alias("b")))
    before = Window.partitionBy("digest").orderBy("a", "b")
    fresh = starts.withColumn("_new", F.coalesce(F.col("a") > F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int"))
    runs = fresh.withColumn("_run", F.sum("_new").over(before)).groupBy("digest", "_run").agg(F.min("a").alias("start"), (F.max("b") + config.passage).alias("stop"))
    spans = runs.join(classes.where("first <=> last"), "digest").select(F.col("first").alias("doc_id"), "start", "stop", F.col("n").alias("n_words"))
    return copies.union(spans).distinct()
