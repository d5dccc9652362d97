"""Near-duplicate lines by a segment-partition edit-distance join."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import added, has_bit, id_bits, ship
from pixelmill.plans.graph import connected_components
from pixelmill.plans.storage import materialize

ship(__name__)


@dataclass(frozen=True)
class Config:
    """Lines of ``least`` characters or more link at ``edits`` or fewer edits; shorter ones when equal.

    ``block`` members of a bucket are compared in one task; larger buckets are cut by a further segment, ``levels``
    times at most; ``bits`` is the size of the filter that spares most lines the join with candidate ids.
    """

    edits: int = 2
    least: int = 20
    block: int = 1024
    levels: int = 6
    bits: int = 1 << 25


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of even segments, the longer ones last."""
    short, longer = length // parts, length % parts
    out, at = [], 0
    for i in range(parts):
        n = short + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, segment length) of the substrings that a line of ``length`` looks up.

    Shorter or equally long lines are searched. A segment of a line within ``edits`` starts where both the
    edits left of it and those right of it allow (multi-match-aware selection).
    """
    out = []
    for other in range(max(length - edits, 1), length + 1):
        shift = length - other
        for i, (p, n) in enumerate(segments(other, edits + 1)):
            low = max(0, p - i, p + shift - (edits - i))
            high = min(length - n, p + i, p + shift + (edits - i))
            out += [(other, i, s, n) for s in range(low, high + 1)]
    return out


STRETCH = 64  # characters of a line


def within(a: str, b: str, edits: int) -> bool:
    """Edit distance <= ``edits``, on a band of diagonals held as bits of one integer per number of edits."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    n = len(a)
    at = 0
    step = 1 << max(n.bit_length() - 1, 0)
    while step:  # common prefix and suffix need no band
        if a[at : at + step] == b[at : at + step] and at + step <= n:
            at += step
        step >>= 1
    a, b = a[at:], b[at:]
    n, at = len(a), 0
    step = 1 << max(n.bit_length() - 1, 0)
    while step:
        end = at + step
        if end <= n and a[n - end : n - at] == b[len(b) - end : len(b) - at]:
            at = end
        step >>= 1
    a, b = a[: n - at], b[: len(b) - at]
    if not a:
        return len(b) <= edits
    # state[j] has bit d + edits set if some prefix of b of length t + d matches a's first t characters with j edits;
    # where each character is in b is known for the band of some characters of a at a time, so that no integer is long
    full = (1 << (2 * edits + 1)) - 1
    state = [((1 << (j + 1)) - 1) << edits & full for j in range(edits + 1)]
    for start in range(0, len(a), STRETCH):
        where: dict[str, int] = {}
        low = max(0, start - edits)
        for i, c in enumerate(b[low : start + STRETCH + edits], low - start + edits):
            where[c] = where.get(c, 0) | 1 << i
        for t, c in enumerate(a[start : start + STRETCH]):
            band = where.get(c, 0) >> t & full
            old, new = None, None
            for j in range(edits + 1):
                moved = state[j] & band
                if j:
                    moved |= old | old >> 1 | new << 1 & full
                old, new, state[j] = state[j], moved, moved
            if not state[edits]:
                return False
    return bool(state[edits] >> (len(b) - len(a) + edits) & 1)


def _lines(text: bytes | None):
    """(number, line) of the lines with a word."""
    if text:
        for i, line in enumerate(text.split(b"\n")):
            if line and not line.isspace():
                yield i, line


def _flush(columns: list[list], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def line_ids(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, line_no and a 64-bit id of each line with a word."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            row, no, ids = [], [], []
            for k, text in enumerate(b.column("_text").to_pylist()):
                for i, line in _lines(text):
                    row.append(k)
                    no.append(i)
                    ids.append(xxh64_intdigest(line))
            at = pa.array(row, pa.int64())
            made = [pa.array(no, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), *made], names=[*keep, "line_no", "line_id"])

    narrow = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    return narrow.mapInArrow(run, added(narrow.drop("_text").schema, "line_no int, line_id bigint"))


class Plans:
    """Where a line of each length has segments of its own and substrings to look up: (seed, start, end) of either."""

    def __init__(self, edits: int):
        self.edits, self.known = edits, {}

    def of(self, n: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        if n not in self.known:
            own = [(n * 64 + i, s, s + k) for i, (s, k) in enumerate(segments(n, self.edits + 1))]
            self.known[n] = own, [(o * 64 + i, s, s + k) for o, i, s, k in probes(n, self.edits)]
        return self.known[n]

    def keys(self, line: str, base: int = 0):
        """(key, start, end, own) of every segment and lookup, once a key and place."""
        from xxhash import xxh64_intdigest

        own, look = self.of(len(line))
        mine = {(xxh64_intdigest(line[s:e], seed ^ base), s, e) for seed, s, e in own}
        yield from ((*x, True) for x in mine)
        yield from ((*x, False) for x in {(xxh64_intdigest(line[s:e], seed ^ base), s, e) for seed, s, e in look} - mine)


SIGNATURE = ["key", "line_id", "indexed"]


def _signature_batch(keys: list[int], ids, own: list[bool]) -> pa.RecordBatch:
    return _flush([np.array(keys, np.uint64).view(np.int64), ids, own], [pa.int64(), pa.int64(), pa.bool_()], SIGNATURE)


def signatures(docs: DataFrame, config: Config) -> DataFrame:
    """(key, line_id, indexed): each line's own segments and the substrings it looks up, hashed with length and place."""

    def run(batches):
        from xxhash import xxh64_intdigest

        plans = Plans(config.edits)
        for b in batches:
            seen: set[int] = set()
            keys, ids, own = [], [], []
            for text in b.column(0).to_pylist():
                for _, raw in _lines(text):
                    if len(raw) < config.least:
                        continue
                    x = xxh64_intdigest(raw)
                    if x in seen:
                        continue
                    seen.add(x)
                    line = raw.decode("utf-8", "replace")
                    if len(line) < config.least:
                        continue
                    found = {}
                    for key, _, _, mine in plans.keys(line):
                        found[key] = found.get(key, False) or mine
                    keys += found
                    own += found.values()
                    ids += [x] * len(found)
                if len(keys) > 200_000:
                    yield _signature_batch(keys, np.array(ids, np.uint64).view(np.int64), own)
                    keys, ids, own = [], [], []
            yield _signature_batch(keys, np.array(ids, np.uint64).view(np.int64), own)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "key bigint, line_id bigint, indexed boolean")


def matched(rests: DataFrame, config: Config) -> DataFrame:
    """``rests(base, line_id, rest)`` -> (key, base, line_id, rest, start, stop, indexed): the places of all its keys."""

    def run(batches):
        plans = Plans(config.edits)
        for b in batches:
            bases, ids, rests_ = (b.column(c).to_pylist() for c in ("base", "line_id", "rest"))
            row, out = [], []
            for i, (base, rest) in enumerate(zip(bases, rests_, strict=True)):
                for found in plans.keys(rest, base % (1 << 64)):
                    row.append(i)
                    out.append(found)
            keys, starts, stops, own = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
            at = pa.array(row, pa.int64())
            made = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(own, pa.bool_())]
            yield pa.RecordBatch.from_arrays([made[0], *(b.column(c).take(at) for c in ("base", "line_id", "rest")), *made[1:]], names=["key", "base", "line_id", "rest", "start", "stop", "indexed"])

    return rests.mapInArrow(run, "key bigint, base bigint, line_id bigint, rest string, start int, stop int, indexed boolean")


def _buckets(block: int):
    """mapInArrow over rows sorted by (key, line_id): the blocks of buckets with two lines or more.

    Emits (key, block, line_id, blocks); ``blocks`` comes with a bucket's last row and is null before. Only
    one block of a bucket is held at a time.
    """
    names, types = ["key", "block", "line_id", "blocks"], [pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def run(batches):
        key = last = None
        held: list[int] = []
        done, indexed = 0, False
        out: list[list] = [[], [], [], []]

        def emit(final: bool):
            nonlocal held, done
            for i, x in enumerate(held):
                out[0].append(key)
                out[1].append(done)
                out[2].append(x)
                out[3].append(done + 1 if final and i == len(held) - 1 else None)
            held, done = [], done + 1

        def close():
            nonlocal held
            if done or (indexed and len(held) > 1):
                emit(True)
            held = []

        for b in batches:
            keys, ids, own = b.column("key").to_numpy(), b.column("line_id").to_numpy(), b.column("indexed").to_numpy(zero_copy_only=False)
            # rows alone in their bucket leave at once; the batch's first and last bucket may go on
            same = keys[1:] == keys[:-1]
            busy = np.r_[True, same] | np.r_[same, True] if len(keys) else np.zeros(0, bool)
            for k, x, o in zip(keys[busy].tolist(), ids[busy].tolist(), own[busy].tolist(), strict=True):
                if k != key:
                    close()
                    key, last, done, indexed = k, None, 0, False
                indexed |= o
                if x != last:
                    if len(held) == block:
                        emit(False)
                    held.append(x)
                    last = x
            yield _flush(out, types, names)
            out = [[], [], [], []]
        if key is not None:
            close()
            yield _flush(out, types, names)

    return run


def _verify(edits: int):
    """mapInArrow over rows sorted by (group): a forest of links within each group of lines."""

    def links(members: dict[int, str]) -> list[tuple[int, int]]:
        left, out = list(members.items()), []
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and left:
                x, text = queue.pop()
                rest = []
                for y, other in left:
                    if within(text, other, edits):
                        out.append((x, y))
                        queue.append((y, other))
                    else:
                        rest.append((y, other))
                left = rest
        return out

    def run(batches):
        group, members = None, {}
        for b in batches:
            found = []
            for g, x, line in zip(b.column("group").to_pylist(), b.column("line_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                if g != group:
                    found += links(members)
                    group, members = g, {}
                members[x] = line
            yield _flush([[a for a, _ in found], [b_ for _, b_ in found]], [pa.int64(), pa.int64()], ["a", "b"])
        found = links(members)
        yield _flush([[a for a, _ in found], [b_ for _, b_ in found]], [pa.int64(), pa.int64()], ["a", "b"])

    return run


def line_texts(docs: DataFrame, wanted: DataFrame, config: Config) -> DataFrame:
    """(line_id, line) of the wanted ids. A bitmap of their hashes, of a set size, keeps most others in the scan."""
    shared = docs.sparkSession.sparkContext.broadcast(id_bits(wanted, "line_id", config.bits))

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            lines: dict[int, bytes] = {}
            for text in b.column(0).to_pylist():
                for _, line in _lines(text):
                    if len(line) >= config.least:
                        lines.setdefault(xxh64_intdigest(line), line)
            ids = np.array(list(lines), np.uint64).view(np.int64)
            likely = has_bit(shared.value, ids, config.bits)
            texts = [t.decode("utf-8", "replace") for t, hit in zip(lines.values(), likely.tolist(), strict=True) if hit]
            yield _flush([ids[likely], texts], [pa.int64(), pa.string()], ["line_id", "line"])

    likely = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "line_id bigint, line string")
    return likely.join(wanted, "line_id", "left_semi").groupBy("line_id").agg(F.min("line").alias("line"))


def line_links(docs: DataFrame, config: Config) -> DataFrame:
    """Links (a, b) between line ids; their components are those of all pairs within the edit distance.

    A bucket's members meet once, in one task. Those of a bucket beyond ``block`` lines share a segment; without it,
    what is left of two of them is within the edit distance too, so it is cut into segments anew and dealt again,
    within the bucket. What is still too large after ``levels`` cuts meets block by block.
    """
    signed, places, parts, texts = signatures(docs, config), None, [], None
    for level in range(config.levels + 1):
        dealt = signed.repartition("key").sortWithinPartitions("key", "line_id")
        found = materialize(dealt.mapInArrow(_buckets(config.block), "key bigint, block int, line_id bigint, blocks int"))
        large = materialize(found.where("blocks > 1").select("key", "blocks"))
        parts.append(found.where("block = 0").join(large.select("key"), "key", "left_anti").select(F.xxhash64("key").alias("group"), "line_id"))
        if large.isEmpty():
            break
        if level == config.levels:
            pairs = found.drop("blocks").join(large, "key").select("key", "block", "line_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
            parts.append(pairs.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "line_id"))
            break
        if places is None:
            texts = line_texts(docs, found.join(large, "key", "left_semi").select("line_id").distinct(), config)
            places = matched(texts.select(F.lit(0).cast("bigint").alias("base"), "line_id", F.col("line").alias("rest")), config)
        hot = places.join(large.select("key"), "key", "left_semi")
        rest = F.concat(F.substring("rest", F.lit(1), F.col("start")), F.substring("rest", F.col("stop") + 1, F.length("rest")))
        rests = materialize(hot.select(F.col("key").alias("base"), "line_id", rest.alias("rest")).distinct())
        places = matched(rests, config)
        signed = places.select("key", "line_id", "indexed")
    # buckets with the same lines say the same: one of them is enough
    small = parts[0]
    for p in parts[1:]:
        small = small.union(p)
    small = materialize(small.distinct())
    sets = small.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.xxhash64("line_id").cast("decimal(38,0)")).alias("s"), F.min("line_id").alias("m"))
    once = sets.groupBy("n", "s", "m").agg(F.min("group").alias("group")).select("group")
    members = materialize(small.join(once, "group", "left_semi"))
    texts = line_texts(docs, members.select("line_id").distinct(), config)
    met = members.join(texts, "line_id").repartition("group").sortWithinPartitions("group", "line_id")
    return met.mapInArrow(_verify(config.edits), "a bigint, b bigint").distinct()


def line_classes(docs: DataFrame, config: Config = Config(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every line with a word: ``keep``, line_no, class_doc_id, class_line_no and duplicate.

    A class holds equal lines and all that is reachable by links; it is named by its first line in order of
    doc_id and line number, and every other line of it is a duplicate: of lines that tie, as those of repeated rows
    or of rows with one doc_id, one is first. Blank lines, null and empty texts give no rows, an empty table none at
    all; a null doc_id orders first, and doc_id may be of any type. Equal lines are one id throughout, so copies form
    no pairs. Other columns of ``docs`` play no part, whatever their names.
    """
    lines = materialize(line_ids(docs, keep).withColumn("_place", F.monotonically_increasing_id()))
    first = lines.groupBy("line_id").agg(F.min(F.struct("doc_id", "line_no", "_place")).alias("first"))
    parts = connected_components(line_links(docs, config)).withColumnRenamed("node", "line_id")
    rooted = materialize(first.join(parts, "line_id", "left").withColumn("component", F.coalesce("component", "line_id")))
    # tables of their own, so that adaptive joins can split a frequent line or a large class
    least = materialize(rooted.groupBy("component").agg(F.min("first").alias("named")))
    label = materialize(rooted.join(least, "component").select("line_id", "named"))
    return lines.join(label, "line_id").select(
        *keep, "line_no", F.col("named.doc_id").alias("class_doc_id"), F.col("named.line_no").alias("class_line_no"), (F.col("_place") != F.col("named._place")).alias("duplicate")
    )


def deduplicate(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """``docs`` with the duplicate lines taken out of their texts; other columns unchanged, whatever their names.

    Rows are numbered and written once, so that a line goes from the row that has it, however often a doc_id
    occurs. Null texts stay null.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    numbered = materialize(docs.select("doc_id", "text", row.alias("row"), F.monotonically_increasing_id().alias("n")))
    gone = materialize(line_classes(numbered, config, ("doc_id", "n")).where("duplicate").groupBy("n").agg(F.collect_set("line_no").alias("gone")))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    out = [F.array_join(kept, "\n").alias(c) if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return numbered.join(gone, "n", "left").select(*out)
