"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelmill.llm.common import literal_table
from pixelmill.plans.storage import materialize

SHARDS, VNODES, RING, SEED = 24, 64, 16384, 11
PART = 8192  # equal rows that one array holds


def ring(shards: int, vnodes: int, slots: int, seed: int = SEED) -> list[tuple[int, int]]:
    """(ring slot, shard) of every virtual node, clockwise. A shard's nodes don't depend on the others."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"{seed}:{s}:{v}".encode()).digest()[:8], "big")
    return [(p * slots >> 64, s) for p, s in sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))]


def flow(counts: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[dict]:
    """Send each ring slot's keys clockwise to the first node whose shard has room; the rest go on.

    Works on one count per ring slot, so its size is set by parameters, not by data. Returns runs: the keys
    of ``slot`` with rank in [lo, hi) go to ``shard``, where they take the places from ``base`` on.
    """
    after = list(range(len(nodes) + 1))  # union-find to the next node with room

    def find(i: int) -> int:
        root = i
        while after[root] != root:
            root = after[root]
        while after[i] != root:
            after[i], i = root, after[i]
        return root

    fill, runs, first = [0] * len(capacity), [], 0
    for slot in sorted(counts):
        while first < len(nodes) and nodes[first][0] < slot:
            first += 1
        lo, n, at = 0, counts[slot], first
        while lo < n:
            at = find(at)
            if at == len(nodes):
                at = find(0)
                if at == len(nodes):
                    raise ValueError("the shards hold fewer rows than there are")
            shard = nodes[at][1]
            take = min(n - lo, capacity[shard] - fill[shard])
            if take:
                runs.append({"slot": slot, "lo": lo, "hi": lo + take, "shard": shard, "base": fill[shard]})
                fill[shard], lo = fill[shard] + take, lo + take
            if fill[shard] == capacity[shard]:
                after[at] = at + 1
    return runs


def capacities(n: int, shards: int, epsilon: float) -> list[int]:
    """Bound of each shard: (1 + epsilon) times the mean; at 0, counts that differ by one at most."""
    if epsilon <= 0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [-int(-(1 + epsilon) * n // shards)] * shards


def shard_rows(
    docs: DataFrame, keys: list[Column], shards: int = SHARDS, vnodes: int = VNODES, slots: int = RING, epsilon: float = 0.0, seed: int = SEED
) -> DataFrame:
    """The ``keys`` of every row with its ``shard`` and gapless ``slot`` within the shard.

    Equal rows are counted before anything moves and expanded at the end, so a key that holds a third of
    the input is one row meanwhile. A row's ring slot comes from a hash of all its keys (nulls included);
    what meets in one task is one ring slot, 1/16384 of the distinct rows. Nothing of the text is shuffled.
    Empty input gives no rows; repeated rows take different places of one shard or of the next one.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = docs.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)])
    grouped = materialize(
        rows.groupBy(*names).agg(F.count("*").alias("copies")).withColumn("hash", F.xxhash64(F.lit(seed), *names)).withColumn("ring", F.pmod("hash", F.lit(slots)).cast("int"))
    )
    counts = {r["ring"]: r["n"] for r in grouped.groupBy("ring").agg(F.sum("copies").alias("n")).collect()}  # <= slots rows
    runs = flow(counts, ring(shards, vnodes, slots, seed), capacities(sum(counts.values()), shards, epsilon))
    to = literal_table(docs.sparkSession, runs, "slot int, lo bigint, hi bigint, shard int, base bigint")
    order = Window.partitionBy("ring").orderBy("hash", *names).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = grouped.withColumn("end", F.sum("copies").over(order)).withColumn("start", F.col("end") - F.col("copies"))
    met = ranked.join(F.broadcast(to), (F.col("ring") == to["slot"]) & (to["lo"] < F.col("end")) & (to["hi"] > F.col("start")))
    # equal rows are told apart some at a time, so that no array is long however many there are
    part = F.explode(F.sequence(F.greatest("start", "lo"), F.least("end", "hi") - 1, F.lit(PART).cast("bigint")))
    parts = met.select(*names, "shard", "lo", "base", part.alias("part"), F.least("end", "hi").alias("stop"))
    rank = F.explode(F.sequence("part", F.least(F.col("part") + PART, "stop") - 1))
    placed = parts.select(*names, "shard", "lo", "base", rank.alias("rank"))
    return placed.select(*names, "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS, **more) -> DataFrame:
    """doc_id, size in bytes, text_crc32, shard and slot of every document; law ``rows``: counts at most one apart.

    Null texts count as empty. The columns are made here, from doc_id and text alone: others, whatever their names, play
    no part. ``grown_shard`` is null under this law.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = shard_rows(docs, [F.col("doc_id"), (F.octet_length(text) + 8).cast("long"), F.crc32(text)], shards, **more)
    return placed.select(
        F.col("k0").alias("doc_id"), F.col("k1").alias("size"), F.col("k2").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
