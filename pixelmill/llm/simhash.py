"""SimHash near-duplicates: pigeonhole blocks, bucket search, Hamming check, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm import near
from pixelmill.llm.common import keep_columns, ship
from pixelmill.llm.near import Tally, each_once, hash_runs, shingle_set  # by name, so that they travel by value
from pixelmill.plans.graph import connected_components
from pixelmill.plans.storage import materialize, scratch

ship(__name__)

SHINGLE, DISTANCE = 4, 4
#: Words of a shingle and the similarity, in per cent, of near copies where whole texts are compared.
SIMILAR_SHINGLE, SIMILAR = 5, 80
#: Rounds in which a bucket's members are tried with a hub before all that may still be similar are.
HUBS = 1
#: Distinct fingerprints of one bucket compared in one task; larger buckets are split by further blocks.
BUCKET = 4096
#: Blocks per level; all but DISTANCE of them agree. 64 bits, then 37 or fewer, then 20 or fewer are left open.
LEVELS = (7, 8, 10)


def print_of(runs) -> int:
    """Bit i is set if it is set in over half of the hashes; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in runs:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    return print_of(hash_runs(text, size))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = SHINGLE) -> DataFrame:
    """``keep`` and the fingerprint as a signed long, one row per row of ``docs``."""
    from pyspark.sql import types as T

    docs = keep_columns(docs, ["fingerprint"])

    def run(batches):
        for b in batches:
            prints = pa.array([fingerprint(t, size) for t in b.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), prints], names=[*keep, "fingerprint"])

    narrow = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    return narrow.mapInArrow(run, T.StructType([*narrow.drop("_text").schema.fields, T.StructField("fingerprint", T.LongType())]))


def open_masks(mask: int, blocks: int, distance: int = DISTANCE) -> list[int]:
    """Parts of ``mask`` left open when it is cut into blocks and all but ``distance`` of them must agree."""
    bits = [i for i in range(64) if mask >> i & 1]
    blocks = min(blocks, len(bits))
    cut = [sum(1 << i for i in bits[len(bits) * k // blocks : len(bits) * (k + 1) // blocks]) for k in range(blocks)]
    return [sum(c) for c in combinations(cut, min(distance, blocks))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A forest over one bucket: two members get connected if links of ``distance`` bits connect them."""
    left, out = np.unique(prints).view(np.uint64), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                out += [(int(x.view(np.int64)), int(y)) for y in found.view(np.int64)]
                queue += list(found)
                left = left[~near]
    return out


def _bucket_links(distance: int, most: int):
    """mapInArrow over rows sorted by key: links of each bucket, and the members of buckets over ``most``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.int64())])

    def batch(links, hot):
        a = np.array([x[0] for x in links] + [x[0] for x in hot], np.int64)
        b = np.array([x[1] for x in links] + [0] * len(hot), np.int64)
        mask = pa.array([None] * len(links) + [x[1] for x in hot], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), mask], schema=schema)

    def run(batches):
        key, prints, masks, hot_key = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), None

        def work(k, f, m):
            """Links of whole buckets."""
            cut = np.flatnonzero(k[1:] != k[:-1]) + 1
            start, stop = np.r_[0, cut], np.r_[cut, len(k)]
            links = []
            two = start[stop - start == 2]
            near = two[np.bitwise_count((f[two] ^ f[two + 1]).view(np.uint64)) <= distance]
            links += list(zip(f[near].tolist(), f[near + 1].tolist(), strict=True))
            for s, e in zip(start[stop - start > 2], stop[stop - start > 2], strict=True):
                links += spanning_links(f[s:e], distance)
            return links

        for b in batches:
            k, f, m = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fingerprint", "open"))
            key, prints, masks = np.r_[key, k], np.r_[prints, f], np.r_[masks, m]
            hot = []
            while len(key):
                if hot_key is not None:  # a bucket that is handed on
                    n = int(np.argmax(key != hot_key)) if (key != hot_key).any() else len(key)
                    hot += list(zip(prints[:n].tolist(), masks[:n].tolist(), strict=True))
                    key, prints, masks = key[n:], prints[n:], masks[n:]
                    if not len(key):
                        break
                    hot_key = None
                cut = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
                large = np.flatnonzero(np.diff(cut) > most)
                if not len(large):
                    break
                at = cut[large[0]]
                if at:
                    yield batch(work(key[:at], prints[:at], masks[:at]), [])
                hot_key, key, prints, masks = key[at], key[at:], prints[at:], masks[at:]
            at = int(np.flatnonzero(key[1:] != key[:-1])[-1] + 1) if len(key) and (key[1:] != key[:-1]).any() else 0
            yield batch(work(key[:at], prints[:at], masks[:at]) if at else [], hot)
            key, prints, masks = key[at:], prints[at:], masks[at:]
        if len(key):
            yield batch(work(key, prints, masks), [])

    return run


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``prints(fingerprint)``, distinct -> links (a, b) whose components are those of all close pairs.

    Every print goes to one bucket for each choice of blocks that must agree; a bucket's members are compared
    in memory and give a forest, not pairs. A bucket beyond ``bucket`` members goes on to the next level,
    which cuts the bits still open into blocks anew; the last level leaves so few bits open that its buckets
    can't be larger than that.
    """
    spark = prints.sparkSession
    rows, masks, found = prints.select("fingerprint", F.lit(-1).cast("long").alias("open")), [(1 << 64) - 1], None
    for level, blocks in enumerate(levels):
        table = spark.createDataFrame([(signed(m), signed(x)) for m in masks for x in open_masks(m, blocks, distance)], "open bigint, next bigint")
        dealt = rows.join(F.broadcast(table), "open").select(
            F.xxhash64("next", F.col("fingerprint").bitwiseAND(F.bitwise_not(F.col("next")))).alias("key"), "fingerprint", F.col("next").alias("open")
        )
        if level:
            dealt = dealt.distinct()
        most = bucket if level < len(levels) - 1 else 1 << 62
        made = materialize(dealt.repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(_bucket_links(distance, most), "a bigint, b bigint, open bigint"))
        edges = made.where("open is null").select("a", "b")
        found = edges if found is None else found.union(edges)
        masks = [r["open"] % (1 << 64) for r in made.where("open is not null").select("open").distinct().collect()]  # a bounded set
        if not masks:
            break
        rows = made.where("open is not null").select(F.col("a").alias("fingerprint"), "open").distinct()
    return found.distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every document.

    component_id is the smallest doc_id reachable by links of ``distance`` bits. Texts without words have
    fingerprint 0 and link like any other; copies share one fingerprint, which is searched once. A component
    whose doc_ids are all null has a null id. An empty table gives no rows; repeated rows are listed each; columns
    of ``docs`` other than doc_id and text play no part, whatever their names.
    """
    marked = materialize(fingerprints(docs, size=size))
    classes = materialize(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(classes.select("fingerprint"), distance, bucket))
    rooted = classes.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    # a table of its own, so that an adaptive join can split a large component
    least = materialize(rooted.groupBy("component").agg(F.min("first").alias("component_id")))
    label = rooted.join(least, "component").select("fingerprint", "component_id")
    return marked.join(label, "fingerprint").select("doc_id", "fingerprint", "component_id")


def remixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits from a hash, as good as independent of it."""
    x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similar_groups(docs: DataFrame, size: int = SIMILAR_SHINGLE, percent: int = SIMILAR, distance: int = DISTANCE) -> DataFrame:
    """``docs(text)`` -> (h, component) of every distinct text, h being ``near.text_key``; a written table.

    Texts are linked if the Jaccard similarity of their shingle sets is ``percent`` or more, each link being checked
    on whole texts. Fingerprints of the sets propose first: those linked within ``distance`` bits, by blocks as above,
    are tried with the first text of their component, which joins most members of a group. Of 64 bits, though, a pair
    at 0.8 differs in 10 on average and at times in 20, more than any blocks of use can bridge; so a prefix filter over
    shingles (``near``) proposes the pairs whose components still differ: those with a bucket's least member, then
    all that two fingerprints together don't tell apart for certain. Texts without words are alike.
    An empty table gives no rows; repeated rows and copies are one text.
    """
    with scratch() as keep:
        return keep(_similar_groups(docs, size, percent, distance))


def _similar_groups(docs: DataFrame, size: int, percent: int, distance: int) -> DataFrame:
    names = ["h", "fingerprint", "second", "slice", "counts"]

    def first_pass(batches):
        tally = Tally()
        for hs, texts in each_once(batches):
            sets = [shingle_set(t, size) for t in texts]
            tally.add(sets)
            prints = [pa.array([print_of([f(s)] if len(s) else []) for s in sets], pa.int64()) for f in (lambda s: s, remixed)]
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), *prints, pa.nulls(len(hs), pa.int32()), pa.nulls(len(hs), pa.binary())], names=names)
        rows = tally.slices()
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=names)

    made = materialize(near.keyed_texts(docs).mapInArrow(first_pass, "h bigint, fingerprint bigint, second bigint, slice int, counts binary"))
    level = near.levels(made.where("slice is not null").select("slice", "counts"))
    marked = materialize(made.where("h is not null").select("h", "fingerprint", "second").distinct())
    parts = connected_components(links(marked.select("fingerprint").distinct(), distance)).withColumnRenamed("node", "fingerprint")
    rooted = materialize(marked.join(parts, "fingerprint", "left").select("h", F.coalesce("component", "fingerprint").alias("c")))
    first = materialize(rooted.groupBy("c").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("c", "a"))
    tried = near.verified(docs, rooted.join(first, "c").where("h <> a").select("a", F.col("h").alias("b")), size, percent)

    def linked(tried: DataFrame) -> DataFrame:
        return connected_components(tried.where("good").select("a", "b"))

    live = near.apart(near.buckets(near.prefixes(docs, level, size, percent)), linked(tried))
    for _ in range(HUBS):
        tried = tried.union(near.verified(docs, near.hub_pairs(live, percent).join(tried, ["a", "b"], "left_anti"), size, percent))
        live = near.apart(live, linked(tried))
    tried = tried.union(near.verified(docs, near.open_pairs(live, marked, percent).join(tried, ["a", "b"], "left_anti"), size, percent))
    return marked.select("h").join(linked(tried).withColumnRenamed("node", "h"), "h", "left").select("h", F.coalesce("component", "h").alias("component"))


def deduplicate(docs: DataFrame, size: int = SIMILAR_SHINGLE, percent: int = SIMILAR) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, nulls last, then by a hash of text and row.

    Groups are those of ``similar_groups``, so rows with one doc_id and different texts are judged by their texts, and
    rows without doc_id like all others. Copies of a text are reduced to one in each task before texts move. Columns
    of ``docs`` stay as they are, whatever their names.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = docs.select(near.text_key().alias("h"), order.alias("first"), row.alias("row")).groupBy("h").agg(F.min_by("row", "first").alias("row"))
    firsts = docs.select(near.text_key().alias("h"), order.alias("first")).groupBy("h").agg(F.min("first").alias("first"))
    grouped = firsts.join(similar_groups(docs, size, percent), "h")
    stay = materialize(grouped.groupBy("component").agg(F.min(F.struct("first", "h")).alias("m")).select(F.col("m.h").alias("h")))
    return once.join(stay, "h", "left_semi").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
