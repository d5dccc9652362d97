"""Byte-level BPE: texts to token ids and back, with the pieces that merging works on found by scans over arrays."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import added, keep_columns, ship

ship(__name__)

ROWS = 1 << 20  # bytes of text that one output batch holds, unless a single text has more
BLOCK = 1 << 20  # bytes that one scan covers
CACHED = 250_000  # pieces whose ids a task keeps
SHORT = 100  # bytes of a piece that is merged in a list

# classes of code points
OTHER, LETTER, NUMBER, SPACE = range(4)
# what a code point is to the scan: a letter, a number, anything else, white space before white space or the text's end,
# a blank before something else, other white space before something else, an apostrophe that 1 or 2 letters of a contraction follow
SYMBOLS = L, N, O, W, BLANK, LONE, Q1, Q2 = range(8)
FIRST = len(SYMBOLS)  # added to the symbol of a text's first code point
# what the piece before a code point is: complete, a run of letters, of numbers, of others, of white space, a blank that
# joins what follows, a contraction that lacks 1 or 2 letters
STATES = DONE, LETTERS, NUMBERS, OTHERS, SPACES, PREFIX, LACKS1, LACKS2 = range(8)
CONTRACTIONS = ("s", "t", "m", "d"), ("re", "ve", "ll")  # fixed values


def step(state: int, symbol: int) -> tuple[int, bool]:
    """(the state after a code point, whether a piece begins with it)."""
    if symbol >= FIRST:
        return step(DONE, symbol - FIRST)[0], True
    if state in (LACKS1, LACKS2):
        return (DONE if state == LACKS1 else LACKS1), False
    if symbol in (L, N, O):
        run = {L: LETTERS, N: NUMBERS, O: OTHERS}[symbol]
        return run, state not in (run, PREFIX)
    if symbol in (Q1, Q2):
        return (OTHERS, False) if state in (OTHERS, PREFIX) else (LACKS1 if symbol == Q1 else LACKS2, True)
    if symbol == W:
        return SPACES, state != SPACES
    return (PREFIX if symbol == BLANK else DONE), True


@dataclass(frozen=True)
class Machine:
    """The transition functions of all strings of symbols: there are few, so one is a number and two compose by a table.

    ``then[f, g]`` is f followed by g, ``of[symbol]`` a symbol's function, ``image[f, state]`` where it leads and
    ``begins[symbol, state]`` whether a piece begins.
    """

    then: np.ndarray
    of: np.ndarray
    image: np.ndarray
    begins: np.ndarray

    @classmethod
    def new(cls) -> Machine:
        signs = range(2 * FIRST)
        single = [tuple(step(s, c)[0] for s in STATES) for c in signs]
        known = {f: i for i, f in enumerate(dict.fromkeys(single))}
        for f in (queue := list(known)):
            for g in single:
                if (h := tuple(g[s] for s in f)) not in known:
                    known[h] = len(known)
                    queue.append(h)
        then = np.empty((len(known), len(known)), np.uint16)
        for (f, i), (g, j) in product(known.items(), known.items()):
            then[i, j] = known[tuple(g[s] for s in f)]
        begins = np.array([[step(s, c)[1] for s in STATES] for c in signs])
        return cls(then, np.array([known[f] for f in single], np.uint16), np.array(list(known), np.uint8), begins)

    def scan(self, functions: np.ndarray) -> np.ndarray:
        """Each function preceded by all before it: pairs are composed, scanned and split again."""
        n = len(functions)
        if n < 2:
            return functions
        out, even = np.empty_like(functions), n - n % 2
        pairs = self.scan(self.then[functions[0:even:2], functions[1:even:2]])
        out[0], out[1:even:2] = functions[0], pairs
        out[2::2] = self.then[pairs[: len(out[2::2])], functions[2::2]]
        return out


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id (empty: no such id), and the first code points of runs of one class with those classes."""

    tokens: list[bytes]
    starts: np.ndarray
    kinds: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a file of base64 tokens with their ranks. Executors need no copy: the vocabulary travels with the tasks.

        Classes are asked of the library whose ids these are, once, so that both follow one version of Unicode.
        """
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        points = np.r_[0:0xD800, 0xE000:0x110000]
        text, kinds = points.astype("<u4").tobytes().decode("utf-32-le"), np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            known = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            kinds[np.frombuffer(bytes(known.encode_ordinary(text)).decode().encode("utf-32-le"), "<u4")] = kind
        starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
        return cls(tokens, starts, kinds[starts])

    def classes(self) -> np.ndarray:
        return np.repeat(self.kinds, np.diff(np.r_[self.starts, 0x110000]))


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each begins) of valid UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    points = np.where(size == 1, lead, lead & (0x7F >> size))
    for k in (1, 2, 3):
        more = size > k
        points[more] = points[more] << 6 | (data[at[more] + k] & 0x3F)
    return points, at


def symbols(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """What each code point is to the scan. ``first`` marks those that begin a text; the last one ends its text."""
    kind = classes[points]
    ends = np.r_[first[1:], True]
    before_space = ends | np.r_[kind[1:] == SPACE, True]
    out = np.select([kind == LETTER, kind == NUMBER, kind != SPACE, before_space, points == 0x20], [L, N, O, W, BLANK], LONE).astype(np.uint8)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        at = [np.where(quotes + k < len(points), points[np.minimum(quotes + k, len(points) - 1)], 0) for k in (1, 2)]
        inside = ~ends[quotes]
        one = inside & np.isin(at[0], [ord(c) for c in CONTRACTIONS[0]])
        inside &= ~ends[np.minimum(quotes + 1, len(points) - 1)]
        two = inside & np.logical_or.reduce([(at[0] == ord(a)) & (at[1] == ord(b)) for a, b in CONTRACTIONS[1]])
        out[quotes[one]], out[quotes[two]] = Q1, Q2
    return out + np.where(first, FIRST, 0).astype(np.uint8)


def piece_starts(data: np.ndarray, texts: np.ndarray, classes: np.ndarray, machine: Machine, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Where pieces begin in ``data``, the bytes of several texts that begin at ``texts`` (sorted), block by block.

    The scan of a block starts in the state that the one before ended in, and looks two code points ahead.
    """
    state, low, n = DONE, 0, len(data)
    while low < n:
        high = min(n, low + max(block, 4))
        while high < n and data[high] & 0xC0 == 0x80:
            high -= 1
        ahead = min(n, high + 8)
        while ahead < n and data[ahead] & 0xC0 == 0x80:
            ahead -= 1
        points, at = code_points(data[low:ahead])
        here = texts[np.searchsorted(texts, low) : np.searchsorted(texts, ahead)] - low
        first = np.zeros(len(points), bool)
        first[np.searchsorted(at, here)] = True
        signs = symbols(points, first, classes)[: np.searchsorted(at, high - low)]
        after = machine.image[machine.scan(machine.of[signs]), state]
        yield low + at[: len(signs)][machine.begins[signs, np.r_[np.uint8(state), after[:-1]]]]
        state, low = int(after[-1]), high


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of least rank is merged, the leftmost of ties, until no pair is a token."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > SHORT:
        return merge_long(piece, ranks)
    none, get = 1 << 40, ranks.get
    bounds = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        del bounds[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[bounds[i] : bounds[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[bounds[i - 1] : bounds[i + 1]], none)
    return [ranks[piece[i:j]] for i, j in zip(bounds, bounds[1:], strict=False)]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs: n log n for a piece of n bytes."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j], before[k] = k, 0, i
        if (h := before[i]) >= 0 and (rank := ranks.get(piece[h:k])) is not None:
            heapq.heappush(heap, (rank, h, i, k))
        if k < n and (rank := ranks.get(piece[i : end[k]])) is not None:
            heapq.heappush(heap, (rank, i, k, end[k]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes Arrow arrays of texts; one a task."""

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK, cached: int = CACHED):
        self.ranks = {token: i for i, token in enumerate(vocabulary.tokens) if token}
        self.sizes = np.array([len(t) for t in vocabulary.tokens], np.int64)
        self.classes, self.machine, self.block, self.cached = vocabulary.classes(), Machine.new(), block, cached
        self.known: dict[bytes, bytes] = {}

    def ids(self, piece: bytes) -> bytes:
        """Little-endian ids of a piece, from the cache if it is there; a full cache starts anew."""
        found = self.known.get(piece)
        if found is None:
            found = np.array(merge(piece, self.ranks), "<u4").tobytes()
            if len(self.known) >= self.cached:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids, starts): of each text the ids, and the bytes before each token, both as little-endian 32-bit integers."""
        data, offsets = joined(texts)
        raw, parts, bytes_of, pending = data.tobytes(), [], [], 0
        for cuts in piece_starts(data, offsets[:-1][np.diff(offsets) > 0], self.classes, self.machine, self.block):
            edges = [pending, *cuts.tolist()]
            pending = edges[-1]
            found = [self.ids(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]
            parts.append(b"".join(found))
        if pending < len(raw):
            parts.append(self.ids(raw[pending:]))
        ids = np.frombuffer(b"".join(parts), "<u4")
        ends = np.cumsum(self.sizes[ids])
        begins = ends - self.sizes[ids]
        first = np.searchsorted(begins, offsets)  # of each text's tokens: none crosses texts
        starts = begins - np.repeat(offsets[:-1], np.diff(first))
        return packed(ids, first), packed(starts, first)


def joined(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of an array of texts or bytes; nulls are empty."""
    large = pc.fill_null(values.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    if not len(large) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(large) + 1, np.int64)
    return np.frombuffer(large.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows of little-endian 32-bit integers as binary, row i from ``first[i]`` on."""
    data = np.ascontiguousarray(values, "<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(first * 4, np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose ``column`` holds at most so many bytes, or a single row."""
    sizes = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(sizes, sizes[low] + most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", block: int = BLOCK, rows: int = ROWS, cached: int = CACHED) -> DataFrame:
    """Add ``ids`` and ``starts`` (binary) to every row: its token ids, and the bytes of text before each token, both as
    little-endian unsigned 32-bit integers.

    Pieces are those of the usual pattern (contractions, runs of letters, numbers, others and white space), found
    without it; each is merged by itself, special tokens are plain text. Null and empty texts have no token; bytes that
    aren't UTF-8 count as U+FFFD. Rows are encoded alone, whole, and in blocks, so ties, repeats and empty tables
    need no care; columns named like the new ones give way. A task keeps one block's pieces and a bounded cache.
    """
    kept = keep_columns(docs, ["ids", "starts"])
    source = "_text" + "_" * max(len(c) for c in docs.columns)
    tidy = kept.withColumn(source, F.make_valid_utf8(F.col(f"`{text}`")))

    def run(batches):
        encoder = Encoder(vocabulary, block, cached)
        for batch in batches:
            for part in slices(batch, source, rows):
                ids, starts = encoder.encode(part.column(source))
                columns = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != source]
                yield pa.RecordBatch.from_arrays([*columns, ids, starts], names=[*(n for n in part.schema.names if n != source), "ids", "starts"])

    return tidy.mapInArrow(run, added(kept.schema, "ids binary, starts binary"))


def decode(encoded: DataFrame, vocabulary: Vocabulary, rows: int = ROWS) -> DataFrame:
    """Add ``decoded`` (binary): the bytes of ``ids``, each token's put where ``starts`` says. Null ids decode to nothing.

    An id that the vocabulary lacks is an error, and so are starts that leave gaps.
    """
    kept = keep_columns(encoded, ["decoded"])

    def run(batches):
        sizes = np.array([len(t) for t in vocabulary.tokens], np.int64)
        table, places = np.frombuffer(b"".join(vocabulary.tokens), np.uint8), np.cumsum(sizes) - sizes
        for batch in batches:
            for part in slices(batch, "ids", rows):
                (ids, first), (starts, _) = ((np.frombuffer(d.tobytes(), "<u4").astype(np.int64), o // 4) for d, o in map(joined, (part.column("ids"), part.column("starts"))))
                if len(ids) and (ids.max() >= len(sizes) or not sizes[ids].all()):
                    raise ValueError("an id is not in the vocabulary")
                size = sizes[ids]
                ends = np.r_[0, np.cumsum(size)]
                offsets = ends[first]
                if not np.array_equal(starts + np.repeat(offsets[:-1], np.diff(first)), ends[:-1]):
                    raise ValueError("starts don't follow from ids")
                out = np.empty(ends[-1], np.uint8)
                for low in range(0, len(ids), BLOCK):  # the indices of a block of tokens at a time
                    t = slice(low, low + BLOCK)
                    inner = np.arange(size[t].sum()) - np.repeat(ends[:-1][t] - ends[low], size[t])
                    out[np.repeat(ends[:-1][t], size[t]) + inner] = table[np.repeat(places[ids[t]], size[t]) + inner]
                decoded = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, added(kept.schema, "decoded binary"))


def report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 digests of the ids and of what they decode to."""
    coded = decode(encode(docs.select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
