"""The prefix trie of conversations: which share their first turns, and what that sharing saves."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelmill.llm.common import ship
from pixelmill.plans.storage import materialize

ship(__name__)

FAMILY = 5  # conversations c - c % FAMILY ... share their first turns when rebuilt
MOST_COPIED = 8
PIECE = 4096  # turns of a conversation that one row holds
MOST_TURNS = 1_000_000  # of the paths that a task's trie holds before it is put out
CHUNK = 512  # ids that are joined before they meet the others of their node


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that most powers of two divide."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted trie of paths; a path is the list of the hashes of its prefixes, the empty one first.

    A node stands for the edge to it: the depths (low, high] of any path through it. ``handles`` finds it by the prefix at the fattest
    depth of that edge, ``first`` by the prefix one below its parent. Paths may begin at a ``base`` below the top; each
    base prefix is a root. What is added at the ends of paths is summed upwards by ``totals``.
    """

    def __init__(self):
        self.low: list[int] = []
        self.high: list[int] = []
        self.parent: list[int] = []
        self.path: list[int] = []  # one that goes through the node
        self.sums: list[tuple[int, ...] | None] = []
        self.least: list[tuple[int, ...] | None] = []
        self.paths: list[tuple[int, list]] = []  # base and prefixes
        self.handles: dict = {}
        self.first: dict = {}
        self.roots: dict = {}
        self.turns = 0

    def key(self, node: int, depth: int):
        base, keys = self.paths[self.path[node]]
        return keys[depth - base]

    def new(self, low: int, high: int, parent: int, path: int) -> int:
        for column, value in ((self.low, low), (self.high, high), (self.parent, parent), (self.path, path), (self.sums, None), (self.least, None)):
            column.append(value)
        return len(self.low) - 1

    def place(self, node: int) -> None:
        """Let the node be found by its handle and from its parent."""
        low, high = self.low[node], self.high[node]
        self.handles[self.key(node, fattest(low, high))] = node
        self.first[self.key(node, low + 1)] = node

    def keep(self, base: int, keys: list) -> int:
        self.paths.append((base, keys))
        self.turns += len(keys)
        return len(self.paths) - 1

    def exit(self, base: int, keys: list, root: int) -> tuple[int, int]:
        """(the deepest node whose whole path these prefixes have, the node below on whose edge they leave or -1).

        Fat binary search: the depth to probe is the fattest that is left. If the trie has a node with that handle, the
        path reaches it; otherwise it leaves above, or on an edge whose handle has been missed already.
        """
        node, low, high = root, base, base + len(keys) - 1
        end = high
        while low < high:
            depth = fattest(low, high)
            found = self.handles.get(keys[depth - base])
            if found is None:
                high = depth - 1
            elif self.high[found] <= end and self.key(found, self.high[found]) == keys[self.high[found] - base]:
                node, low = found, self.high[found]
            else:
                return self.parent[found], found
        return node, self.first.get(keys[low + 1 - base], -1) if low < end else -1

    def insert(self, base: int, keys: list, sums: tuple[int, ...], least: tuple[int, ...]) -> None:
        end = base + len(keys) - 1
        root = self.roots.get((base, keys[0]))
        if root is None:
            root = self.roots[base, keys[0]] = self.new(base, base, -1, self.keep(base, keys))
        node, leaves = self.exit(base, keys, root)
        if leaves >= 0:  # the depth to which the edge agrees
            low, high = self.low[leaves] + 1, min(self.high[leaves], end)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if self.key(leaves, middle) == keys[middle - base] else (low, middle - 1)
            del self.handles[self.key(leaves, fattest(self.low[leaves], self.high[leaves]))]
            node = self.new(self.low[leaves], low, self.parent[leaves], self.path[leaves])
            self.low[leaves], self.parent[leaves] = low, node
            self.place(node)
            self.place(leaves)
        if self.high[node] < end:
            node = self.new(self.high[node], end, node, self.keep(base, keys))
            self.place(node)
        self.sums[node] = sums if self.sums[node] is None else tuple(map(sum, zip(self.sums[node], sums, strict=True)))
        self.least[node] = least if self.least[node] is None else min(self.least[node], least)

    def totals(self) -> None:
        """Add what nodes have to their parents, the deepest first."""
        for node in sorted(range(len(self.low)), key=self.high.__getitem__, reverse=True):
            above = self.parent[node]
            if above >= 0 and self.sums[node] is not None:
                had = self.sums[above]
                self.sums[above] = self.sums[node] if had is None else tuple(map(sum, zip(had, self.sums[node], strict=True)))
                self.least[above] = self.least[node] if had is None else min(self.least[above], self.least[node])

    def rows(self) -> pa.RecordBatch | None:
        """Every depth of every edge, as PARTIAL has it. Roots are rows only at the top."""
        self.totals()
        nodes = [i for i in range(len(self.low)) if self.parent[i] >= 0 or self.low[i] == 0]
        if not nodes:
            return None
        low, high, path = (np.array([c[i] for i in nodes], np.int64) for c in (self.low, self.high, self.path))
        low -= low == high  # the top is a row too
        flat = np.array([k for _, keys in self.paths for k in keys], np.int64).reshape(-1, 3)
        begins = np.cumsum([0] + [len(keys) for _, keys in self.paths])[:-1]
        base = np.array([b for b, _ in self.paths], np.int64)
        many = high - low
        of = np.repeat(np.arange(len(nodes)), many)
        depth = np.repeat(high - np.cumsum(many), many) + np.arange(1, many.sum() + 1)
        at = begins[path][of] + depth - base[path][of]
        above = np.maximum(at - 1, begins[path][of])
        sums, least = (np.array([c[i] for i in nodes], np.int64)[of] for c in (self.sums, self.least))
        columns = [depth, *flat[at].T, *flat[above].T, *sums.T, *least.T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=PARTIAL)


SUMS = ["n_convs", "total", "owned", "leaves"]
LEAST = ["conv_id", "top", "before_top", "above_top"]
PARTIAL = ["depth", "a", "b", "bytes", "a_above", "b_above", "bytes_above", *SUMS, *LEAST]
NODE = ["depth", "a", "b"]


def trie_nodes(paths: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """Nodes at every depth, with ``SUMS`` and the least ``LEAST`` of the conversations through them.

    Each task inserts the paths of its batches into a Z-fast trie and puts its edges out, depth by depth, when the trie
    is large or the task ends: prefixes that very many conversations share leave a task once. A shuffle by prefix
    then adds up what tasks have found; it is the same however paths lie.
    """

    def run(batches):
        trie = ZFastTrie()
        for b in batches:
            turns, sizes = b.column("turns"), np.diff(b.column("turns").offsets.to_numpy())
            values = turns.values.slice(turns.offsets[0].as_py(), int(sizes.sum()))
            base, *above = (b.column(c).to_numpy() for c in ("base", "a", "b", "bytes"))
            ends, flat = np.cumsum(sizes), []
            for name, start in zip(("a", "b"), above, strict=False):
                so_far = np.bitwise_xor.accumulate(values.field(name).to_numpy()) if len(values) else np.empty(0, np.int64)
                flat.append(so_far ^ np.repeat(start ^ np.r_[0, so_far][ends - sizes], sizes))
            added = np.cumsum(values.field("bytes").to_numpy())
            flat.append(added + np.repeat(above[2] - np.r_[0, added][ends - sizes], sizes))
            keys = list(zip(*(f.tolist() for f in flat), strict=True))
            tops = list(zip(*(x.tolist() for x in above), strict=True))
            sums = list(zip(*(b.column(c).to_pylist() for c in SUMS), strict=True))
            least = list(zip(*(b.column(c).to_pylist() for c in LEAST), strict=True))
            for i, (low, high) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                trie.insert(int(base[i]), [tops[i], *keys[low:high]], sums[i], least[i])
                if trie.turns > most_turns:
                    yield trie.rows()
                    trie = ZFastTrie()
        if (last := trie.rows()) is not None:
            yield last

    parts = paths.mapInArrow(run, ", ".join(f"{c} bigint" for c in PARTIAL))
    same = [F.min(c).alias(c) for c in ("bytes", "a_above", "b_above", "bytes_above")]
    return parts.groupBy(*NODE).agg(*same, *[F.sum(c).alias(c) for c in SUMS], F.min(F.struct(*LEAST)).alias("least")).select(*NODE, *PARTIAL[3:7], *SUMS, "least.*")


def _ranked(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, i, digest, bytes): turns in order from 0; (conv_id, n)).

    Turns are dealt by ranges of (conversation, turn), so a very long conversation is ranked by many tasks; only the
    counts of those that go over a range's end, one a range, are broadcast.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = materialize(conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", told.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes")))
    order, parts = [F.asc_nulls_first("turn"), F.asc("digest")], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, F.asc("conv_id"), *order).withColumn("_part", F.spark_partition_id()))
    spans = dealt.groupBy("conv_id", "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    later = spans.withColumn("before", before).where("before > 0").select("conv_id", "_part", "before")
    here = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order)) - 1
    ranked = dealt.withColumn("here", here).join(F.broadcast(later), ["conv_id", "_part"], "left")
    turns = materialize(ranked.select("conv_id", (F.col("here") + F.coalesce("before", F.lit(0))).alias("i"), "digest", "bytes"))
    return turns, spans.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, digest, bytes): turns from 1; (conv_id, depth): all conversations with their numbers of turns).

    Conversation c gets the first h turns of c - c % 5, where h = crc32(c) % 9, then its own after its first h. As in SQL,
    the remainder has the sign of c.
    """
    turns, lengths = _ranked(conversations)
    each = lengths.withColumns({"source": F.expr(f"conv_id - conv_id % {FAMILY}"), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_COPIED + 1)})
    sources = lengths.select(F.col("conv_id").alias("source"), F.col("n").alias("_n"))
    convs = materialize(each.join(sources, "source", "left").select("conv_id", "source", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("copied"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own")))
    first = turns.where(F.col("i") < MOST_COPIED).withColumnRenamed("conv_id", "source")
    copies = first.join(convs.select("source", "conv_id", "h"), "source").where("i < h").select("conv_id", F.expr("i + 1").alias("pos"), "digest", "bytes")
    own = turns.join(convs.select("conv_id", "h", "copied"), "conv_id").where("i >= h").select("conv_id", F.expr("copied + i - h + 1").alias("pos"), "digest", "bytes")
    return copies.union(own), convs.select("conv_id", F.expr("copied + own").alias("depth"))


def _paths(turns: DataFrame, convs: DataFrame, piece: int) -> tuple[DataFrame, DataFrame]:
    """((conv_id, base, a, b, bytes, turns): conversations in pieces, with what comes before; (conv_id, depth, a, b, bytes): their ends).

    A prefix's 128-bit hash is the XOR of hashes of (place, turn), so pieces of a long conversation are hashed apart.
    """
    place = F.struct("pos", F.xxhash64(F.lit(1), "pos", "digest").alias("a"), F.xxhash64(F.lit(2), "digest", "pos").alias("b"), "bytes")
    each = turns.select("conv_id", F.expr(f"(pos - 1) div {piece} * {piece}").alias("base"), place.alias("t"))
    whole = each.groupBy("conv_id", "base").agg(F.sort_array(F.collect_list("t")).alias("turns"), *[F.bit_xor(f"t.{c}").alias(c) for c in "ab"], F.sum("t.bytes").alias("bytes"))
    zero = F.lit(0).cast("bigint")
    none = convs.where("depth = 0").select("conv_id", zero.alias("base"), F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,bytes:bigint>>").alias("turns"), zero.alias("a"), zero.alias("b"), zero.alias("bytes"))
    pieces = materialize(whole.select("conv_id", "base", "turns", "a", "b", "bytes").union(none))
    long = pieces.where("base > 0").select("conv_id").distinct()
    upto = Window.partitionBy("conv_id").orderBy("base").rowsBetween(Window.unboundedPreceding, -1)
    narrow = pieces.select("conv_id", "base", "a", "b", "bytes").join(long, "conv_id", "left_semi")
    before = narrow.select("conv_id", "base", *[F.bit_xor(c).over(upto).alias(c) for c in "ab"], F.sum("bytes").over(upto).alias("bytes")).where("base > 0")
    top = pieces.where("base = 0").select("conv_id", "base", zero.alias("a"), zero.alias("b"), zero.alias("bytes"), "turns")
    rest = pieces.where("base > 0").select("conv_id", "base", "turns").join(before, ["conv_id", "base"]).select("conv_id", "base", "a", "b", "bytes", "turns")
    ends = pieces.groupBy("conv_id").agg(F.max(F.col("base") + F.size("turns")).alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("bytes").alias("bytes"))
    return top.union(rest), materialize(ends)


def _end_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: of the ids, in order, of the conversations that end at a node.

    Ids are joined in chunks within ranges of ids. A digest takes its bytes in order, so a node's chunks go to one task,
    which reads them as a stream and keeps none.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(ends.select("conv_id", *NODE).repartitionByRange(parts, "conv_id").withColumn("part", F.spark_partition_id()))
    chunk = F.expr(f"(row_number() over (partition by part, depth, a, b order by conv_id) - 1) div {CHUNK}")
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = dealt.withColumn("chunk", chunk).groupBy(*NODE, "part", "chunk").agg(text.alias("ids"))

    def run(batches):
        node, digest = None, hashlib.sha256()
        for b in batches:
            out = []
            for *at, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if at == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256()
                digest.update(ids.encode())
            yield _told(out)
        if node is not None:
            yield _told([(*node, digest.hexdigest())])

    ordered = chunks.repartition(parts, *NODE).sortWithinPartitions(*NODE, "part", "chunk")
    return ordered.mapInArrow(run, "depth bigint, a bigint, b bigint, ends_sha256 string")


def _told(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame, piece: int = PIECE, most_turns: int = MOST_TURNS) -> DataFrame:
    """One row per distinct prefix of turns: ``conv_id`` (the smallest through it), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256`` and the prefix's hash ``a, b``.

    ``turns`` has conv_id, pos from 1, digest (equal for equal turns) and bytes; ``convs`` has conv_id and depth, the number
    of its turns, 0 too. Empty tables have no node, not even a root.

    A first pass over the conversations finds the nodes and whose smallest conversation each is; these are the lower
    part of that conversation's path. So sums over a subtree are sums over the conversations through its top, which a second
    pass makes: bytes in all less bytes before the node, less the bytes of the nodes that they own. Nothing goes up the
    trie level by level, so a conversation's length costs no rounds.
    """
    paths, ends = _paths(turns, convs, piece)
    zeros = {c: F.lit(0).cast("bigint") for c in (*SUMS[1:], *LEAST[1:])}
    found = materialize(trie_nodes(paths.withColumns({"n_convs": F.lit(1).cast("bigint"), **zeros}), most_turns))
    kids = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("a_above").alias("a"), F.col("b_above").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = materialize(found.join(kids, NODE, "left").select(*NODE, "a_above", "b_above", "bytes", "bytes_above", "conv_id", F.coalesce("n_children", F.lit(0)).alias("n_children")))
    top = F.min_by(F.struct("a_above", "b_above"), "depth")
    owners = materialize(
        nodes.groupBy("conv_id").agg(
            F.min("depth").alias("top"), F.min("bytes_above").alias("before_top"), (F.max("bytes") - F.min("bytes_above")).alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaves"), top.alias("_up")
        ).select("conv_id", "top", "before_top", "owned", "leaves", (F.col("top") - 1).alias("depth"), F.col("_up.a_above").alias("a"), F.col("_up.b_above").alias("b"))
    )
    above = owners.join(nodes.select(*NODE, F.col("conv_id").alias("above_top")), NODE, "left").drop(*NODE)
    each = ends.select("conv_id", F.col("bytes").alias("total")).join(above, "conv_id", "left")
    known = each.select("conv_id", F.lit(1).cast("bigint").alias("n_convs"), "total", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (*SUMS[2:], *LEAST[1:])])
    summed = trie_nodes(paths.join(known, "conv_id"), most_turns)
    met = summed.join(nodes.select(*NODE, "n_children"), NODE).join(_end_digests(ends), NODE, "left")
    up = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above_top"))
    saved = F.expr("total - n_convs * bytes_above - owned + bytes_above - before_top")
    return met.select("conv_id", "depth", up.cast("bigint").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "a", "b")


def conversation_trie(conversations: DataFrame, piece: int = PIECE, most_turns: int = MOST_TURNS) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of ``conversations(conv_id, turn, role, text)``.

    Turns are ordered by turn, null first, ties by the SHA-256 of role and text; null role and text are empty. Rows
    without conv_id belong to no conversation and are left out. Repeated rows are turns of their own. Turns are equal
    if role and text are; prefixes are compared by 128-bit hashes. Other columns play no part.
    """
    return prefix_trie(*rebuilt(conversations), piece, most_turns)


# DuckDB: the same over the table conversations
ORACLE = """
WITH told AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS i FROM told
), conv AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS source,
    xor(list_reduce([4294967295] || [CAST(ascii(ch) AS BIGINT) FOR ch IN string_split(CAST(conv_id AS VARCHAR), '')],
      lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id
), built AS (
  SELECT c.conv_id, t.i + 1 AS pos, digest, bytes FROM conv c JOIN t ON t.conv_id = c.source AND t.i < c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(s.n, 0)) + t.i - c.h + 1, digest, bytes FROM conv c LEFT JOIN conv s ON s.conv_id = c.source JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h
), paths AS (
  SELECT conv_id, coalesce(list(digest ORDER BY pos) FILTER (pos IS NOT NULL), []) AS p, coalesce(list(bytes ORDER BY pos) FILTER (pos IS NOT NULL), []) AS b
  FROM conv LEFT JOIN built USING (conv_id) GROUP BY conv_id
), members AS (
  SELECT conv_id, d, p[1:d] AS node, p[1:d - 1] AS up, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes, d = len(p) AS last
  FROM (SELECT conv_id, p, b, unnest(range(0, len(p) + 1)) AS d FROM paths)
), nodes AS (
  SELECT node, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last) AS ids
  FROM members GROUP BY node, d
), kids AS (
  SELECT up AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up
), sums AS (
  SELECT node[1:k] AS node, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * bytes) AS saved_tokens
  FROM (SELECT node, n, bytes, n_children, unnest(range(0, d + 1)) AS k FROM nodes LEFT JOIN kids USING (node)) GROUP BY 1
)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ids, '')) AS ends_sha256
FROM nodes v JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes u ON v.d > 0 AND u.node = v.up
"""
