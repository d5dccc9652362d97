"""Scoring documents with a gated recurrent language model over words, trained in numpy."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import LOWER, added, hash_sample, ship
from pixelmill.llm.langid import fold
from pixelmill.plans.storage import materialize

ship(__name__)

END = b""  # the end of a text as a token
MOST = np.float32(60)  # logits above this would overflow a float32 sum


@dataclass(frozen=True)
class Config:
    """The ``vocab`` most frequent words have probabilities of their own; all others share ``bands`` by frequency and
    enter the net by one of ``buckets``, so every word of the corpus has a place, however many there are.

    ``dictionary`` words (of up to ``longest`` bytes) travel to every task with their counts, which bounds what is
    broadcast; the counts of all others are joined. A shard of about ``shard`` words trains one copy of the net in
    each of ``rounds``; the net starts from ``warm`` runs of words.
    """

    vocab: int = 1024
    classes: int = 32
    bands: int = 16
    buckets: int = 1024
    hidden: int = 16
    window: int = 16
    dictionary: int = 200_000
    longest: int = 64
    warm: int = 1024
    warm_turns: int = 4
    shard: int = 4_000_000
    rounds: int = 2
    run_windows: int = 8
    streams: int = 1024
    rate: float = 0.01
    seed: int = 5

    @property
    def run(self) -> int:
        return self.window * self.run_windows


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


class Gru:
    """One-hot GRU with a softmax factored into classes: P(class | state) P(word | class, state).

    A word's code is its rank in the vocabulary or, beyond it, ``vocab + bucket * bands + band``. Code 0 is the end
    of a text, which also starts one. Vocabulary words are sorted by frequency and cut into equal classes; a band is
    a class alone, whose words are told apart by their counts outside the net.
    """

    def __init__(self, config: Config, params: dict[str, np.ndarray]):
        self.config, self.p = config, params
        self.size = config.vocab // config.classes
        codes, v = np.arange(config.vocab + config.bands * config.buckets), config.vocab
        self.input = np.where(codes < v, codes, v + (codes - v) // config.bands).astype(np.int16)
        self.group = np.where(codes < v, codes // self.size, config.classes + (codes - v) % config.bands).astype(np.int16)
        self.place = np.where(codes < v, codes % self.size, 0).astype(np.int16)

    @classmethod
    def new(cls, config: Config, counts: np.ndarray) -> Gru:
        """counts: of the vocabulary's words, then of the bands; the softmax starts from their frequencies."""
        rng, h, c = np.random.default_rng(config.seed), config.hidden, config.classes
        net = cls(config, {})
        log = np.log(np.maximum(counts, 0.5)).astype(np.float32)[: config.vocab].reshape(c, -1)
        mass = np.log(np.maximum(np.r_[counts[: config.vocab].reshape(c, -1).sum(1), counts[config.vocab :]], 0.5))
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        net.p = {
            "x": small(config.vocab + config.buckets, 3 * h),
            "u": small(h, 3 * h) + np.tile(np.eye(h, dtype=np.float32) * 0.3, 3),
            "b": np.zeros(h, np.float32),
            "c": small(h, c + config.bands),
            "cb": (mass - mass.max()).astype(np.float32),
            "w": small(c, h, net.size),
            "wb": log - log.max(1, keepdims=True),
        }
        return net

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        n, g = self.config.hidden, h @ self.p["u"]
        zr = x[:, : 2 * n] + g[:, : 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :n], zr[:, n:]
        a = g[:, 2 * n :] + self.p["b"]
        c = np.tanh(x[:, 2 * n :] + r * a)
        return c + z * (h - c), z, r, a, c

    def log_probs(self, states: np.ndarray, codes: np.ndarray, back: bool = False):
        """Natural log P(code | state) of each row; with ``back`` also gradients of their negative sum."""
        p, k = self.p, self.group[codes]
        order = np.argsort(k, kind="stable")
        states, k, y = states[order], k[order], self.place[codes[order]]  # rows of a class lie together
        cut = np.searchsorted(k, np.arange(self.config.classes + 1))
        rows = np.arange(len(k))
        z = states @ p["c"] + p["cb"]
        np.minimum(z, MOST, out=z)
        e = np.exp(z)
        s = e @ np.ones(e.shape[1], e.dtype)
        found = z[rows, k] - np.log(s)
        grads = None
        if back:
            e /= s[:, None]
            e[rows, k] -= 1
            dh = e @ p["c"].T
            grads = {"c": states.T @ e, "cb": e.sum(0), "w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
        ones = np.ones(self.size, states.dtype)
        for i in range(self.config.classes):
            at = slice(cut[i], cut[i + 1])
            if cut[i] == cut[i + 1]:
                continue
            h, j = states[at], (np.arange(cut[i + 1] - cut[i]), y[at])
            z = h @ p["w"][i] + p["wb"][i]
            np.minimum(z, MOST, out=z)
            e = np.exp(z)
            s = e @ ones
            found[at] += z[j] - np.log(s)
            if back:
                e /= s[:, None]
                e[j] -= 1
                dh[at] += e @ p["w"][i].T
                grads["w"][i], grads["wb"][i] = h.T @ e, e.sum(0)
        out = np.empty_like(found)
        out[order] = found
        if not back:
            return out
        down = np.empty_like(dh)
        down[order] = dh
        return out, down, grads

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of whole texts (codes, the end last); state runs through all windows."""
        lengths = np.array([len(t) for t in texts])
        order, total, t = np.argsort(-lengths, kind="stable"), np.zeros(len(texts)), self.config.window
        sorted_lengths = lengths[order]
        stream = np.concatenate([*(texts[i] for i in order), np.zeros(t, np.int16)])
        inputs, start = self.input[stream], np.cumsum(sorted_lengths) - sorted_lengths
        h = np.zeros((len(texts), self.config.hidden), np.float32)
        last = np.zeros(len(texts), np.int64)
        for at in range(0, int(lengths.max(initial=0)), t):
            live = int(np.searchsorted(-sorted_lengths, -at, side="left"))
            where = (start[:live] + at)[:, None] + np.arange(t)  # past a text's end: of no account
            ids = inputs[where]
            x = self.p["x"][np.c_[last[:live], ids[:, :-1]].T]
            states, h = np.empty((t, live, self.config.hidden), np.float32), h[:live]
            for k in range(t):
                h = self.step(x[k], h)[0]
                states[k] = h
            inside = np.arange(t)[:, None] < sorted_lengths[None, :live] - at
            lp = self.log_probs(states[inside], stream[where].T[inside])
            total += np.bincount(order[np.nonzero(inside)[1]], lp, len(texts))
            last = ids[:, -1]
        return total

    def train(self, batches, adam: Adam) -> None:
        """Truncated backpropagation: ``batches`` yields (codes (n, run + 1), mask) and state runs on along a run."""
        t, n = self.config.window, self.config.hidden
        for codes, known in batches:
            inputs = self.input[codes]
            h = np.zeros((len(codes), n), self.p["b"].dtype)
            for at in range(0, codes.shape[1] - 1, t):
                src, dst, inside = inputs[:, at : at + t].T, codes[:, at + 1 : at + t + 1].T, known[:, at + 1 : at + t + 1].T
                if not inside.any():
                    break
                x, kept, states = self.p["x"][src], [], np.empty((len(src), len(codes), n), h.dtype)
                for k in range(len(src)):
                    before = h
                    h, z, r, a, c = self.step(x[k], before)
                    kept.append((before, z, r, a, c))
                    states[k] = h
                _, dh, grads = self.log_probs(states[inside], dst[inside], back=True)
                down = np.zeros_like(states)
                down[inside] = dh
                gates, du, db, carry = np.empty_like(x), np.zeros_like(self.p["u"]), np.zeros(n, h.dtype), 0
                for k in range(len(src) - 1, -1, -1):
                    before, z, r, a, c = kept[k]
                    d = down[k] + carry
                    dc = d * (1 - z) * (1 - c * c)
                    gate = gates[k]
                    gate[:, :n] = d * (before - c) * z * (1 - z)
                    gate[:, n : 2 * n] = dc * a * r * (1 - r)
                    gate[:, 2 * n :] = dc
                    inner = gate.copy()
                    inner[:, 2 * n :] *= r
                    du += before.T @ inner
                    db += inner[:, 2 * n :].sum(0)
                    carry = d * z + inner @ self.p["u"].T
                order = np.argsort(src.ravel(), kind="stable")
                ids = src.ravel()[order]
                first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                gx = np.add.reduceat(gates.reshape(-1, 3 * n)[order], first, axis=0)
                adam.step(self.p, {"u": du, "b": db, **grads}, float(inside.sum()), {"x": (ids[first], gx)})


class Adam:
    """Steps by gradients of sums over ``count`` words; of ``sparse`` ones, rows that the batch has move."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict, grads: dict, count: float, sparse: dict) -> None:
        self.t += 1
        fix = self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in [*grads.items(), *sparse.items()]:
            at, g = g if k in sparse else (slice(None), g)
            if k not in self.m:
                self.m[k], self.v[k] = np.zeros_like(params[k]), np.zeros_like(params[k])
            g = np.clip(g / np.float32(count), -1, 1)
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            params[k][at] -= fix * m / (np.sqrt(v) + 1e-8)


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, each text ending in one END; counted per batch before any row moves."""

    def run(batches):
        for b in batches:
            seen = Counter()
            for text in b.column(0).to_pylist():
                seen.update(split_words(text))
                seen[END] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    made = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, n bigint")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, config: Config) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``dictionary``, cut at a count that a histogram of counts gives."""
    short = counts.where((F.octet_length("word") <= config.longest) & (F.octet_length("word") > 0))
    level = F.floor(F.log2("n") * 16).cast("int")
    histogram = sorted(((r["level"], r["k"]) for r in short.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for at, k in histogram:
        if total + k > config.dictionary:
            break
        total, least = total + k, at
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["n"]) for r in short.where(level >= least).collect()), key=lambda x: (-x[1], x[0]))


@dataclass
class Lexicon:
    """What every task knows: codes of frequent words, their counts, the corpus totals.

    ``band_mass`` is the sum of count + 1 over a band's words; the last band has all words outside the dictionary,
    those that training never saw included.
    """

    index: dict[bytes, int]  # place among the frequent words; 0 is END
    codes: np.ndarray
    logs: np.ndarray  # log10(count + 1)
    fixed: np.ndarray  # log10 probability within the band, 0 for vocabulary words
    rare_mass: float
    total: int
    distinct: int

    @classmethod
    def of(cls, top: list[tuple[bytes, int]], total: int, distinct: int, config: Config) -> Lexicon:
        """``top``: END, then words by falling count; those beyond the vocabulary are cut into bands of about equal mass."""
        n, v = np.array([c for _, c in top], np.float64) + 1, config.vocab
        mass = np.cumsum(n[v:])
        band = np.minimum((mass - n[v:]) / max(mass[-1] if len(mass) else 1, 1) * (config.bands - 1), config.bands - 2).astype(np.int64)
        bucket = np.array([crc32(w) % config.buckets for w, _ in top[v:]], np.int64)
        codes = np.r_[np.arange(min(len(n), v)), v + bucket * config.bands + band].astype(np.int16)
        fixed = np.r_[np.zeros(min(len(n), v)), np.log10(n[v:] / np.maximum(np.bincount(band, n[v:], config.bands), 1)[band])]
        return cls({w: i for i, (w, _) in enumerate(top)}, codes, np.log10(n), fixed, max(total + distinct + 1 - float(n.sum()), 1.0), total, distinct)

    def masses(self, config: Config) -> np.ndarray:
        """Counts of the vocabulary's words, then of the bands."""
        n, v = 10**self.logs, config.vocab
        bands = np.bincount((self.codes[v:] - v) % config.bands, n[v:], config.bands)
        bands[-1] = self.rare_mass
        return np.r_[n[:v], np.zeros(max(v - len(n), 0)), bands]


def encode(docs: DataFrame, lexicon: Lexicon, config: Config, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` with the codes (16 bits each) of every whole text and what the counts of its words add up to.

    seen, sums and fixed are of the dictionary's words; ``rare`` has the others with their ``times``. A null text
    is empty: one token, its end.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(lexicon))  # plain values: executors have no copy of the class
    made = ["n_tokens", "seen", "sums", "fixed", "n_rare", "rare", "times", "codes"]
    narrow = docs.select(*keep, F.col("text").cast("binary").alias("_text"))

    def run(batches):
        lex = Lexicon(**shared.value)
        index, last = lex.index, config.bands - 1
        for b in batches:
            rows: list[list] = [[] for _ in made]
            for text in b.column("_text").to_pylist():
                ws = [*split_words(text), END]
                found = np.fromiter(map(index.get, ws, repeat(-1)), np.int64, len(ws))
                known = found >= 0
                codes, odd = lex.codes[found], {}
                if not known.all():
                    at = np.flatnonzero(~known).tolist()
                    codes[at] = [config.vocab + crc32(ws[i]) % config.buckets * config.bands + last for i in at]
                    odd = Counter(ws[i] for i in at)
                inside = found[known]
                values = (len(ws), len(inside), float(lex.logs[inside].sum()), float(lex.fixed[inside].sum()), len(ws) - len(inside), list(odd), list(odd.values()), codes.tobytes())
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], names=[*keep, *made])

    fields = "n_tokens bigint, seen bigint, sums double, fixed double, n_rare bigint, rare array<binary>, times array<int>, codes binary"
    return narrow.mapInArrow(run, added(narrow.drop("_text").schema, fields))


def runs(encoded: DataFrame, shards: int, config: Config) -> DataFrame:
    """(shard, turn, place, codes): every run of words of every text, each with the word before it.

    Where a run goes and when it is its turn comes from a hash of its text, doc_id and place, not from the tasks.
    """

    def run(batches):
        t = config.run
        for b in batches:
            row, at, out = [], [], []
            for i, raw in enumerate(b.column("codes").to_pylist()):
                codes = np.frombuffer(b"\0\0" + raw, np.int16)
                for k in range(0, len(codes) - 1, t):
                    row.append(i)
                    at.append(k)
                    out.append(codes[k : k + t + 1].tobytes())
                if len(out) > 20_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column("_h").take(pa.array(row, pa.int64())), pa.array(at, pa.int64()), pa.array(out, pa.binary())], names=["_h", "at", "codes"])
                    row, at, out = [], [], []

    cut = encoded.select(F.xxhash64("codes", "doc_id").alias("_h"), "codes").mapInArrow(run, "_h bigint, at bigint, codes binary")
    place = F.xxhash64(F.lit(config.seed), "_h", "at")
    turn = F.pmod(F.xxhash64(place), F.lit(config.rounds)).cast("int")
    return cut.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), turn.alias("turn"), place.alias("place"), "codes")


def batches(rows: list[bytes], config: Config):
    """(codes, mask) of some runs at a time."""
    for at in range(0, len(rows), config.streams):
        some = [np.frombuffer(r, np.int16) for r in rows[at : at + config.streams]]
        codes, known = np.zeros((len(some), config.run + 1), np.int16), np.zeros((len(some), config.run + 1), bool)
        for i, r in enumerate(some):
            codes[i, : len(r)], known[i, : len(r)] = r, True
        yield codes, known


PIECE = 4096  # weights that travel together


def trained(rows: DataFrame, net: Gru, rate: float) -> Gru:
    """Each shard trains a copy of the net on its ``rows`` in order of place; the copies' mean by words is returned.

    A task adds up its shards' copies, and pieces of these sums meet by their number, so what moves is one net a
    task. The mean is rounded, so that the order of sums doesn't show.
    """
    config, like = net.config, net.p
    shared = rows.sparkSession.sparkContext.broadcast(like)

    def run(batches_):
        params, total, words = shared.value, None, 0

        def shard(codes: list[bytes]) -> None:
            nonlocal total, words
            own, n = Gru(config, {k: v.copy() for k, v in params.items()}), sum(len(c) // 2 - 1 for c in codes)
            own.train(batches(codes, config), Adam(rate))
            weights = flat(own.p).astype(np.float64) * n
            total, words = weights if total is None else total + weights, words + n

        at, held = None, []
        for b in batches_:
            for s, codes in zip(b.column("shard").to_pylist(), b.column("codes").to_pylist(), strict=True):
                if s != at and held:
                    shard(held)
                    held = []
                at = s
                held.append(codes)
        if held:
            shard(held)
        if words:
            pieces = [total[k : k + PIECE].tobytes() for k in range(0, len(total), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary()), pa.array([words] * len(pieces), pa.int64())], names=["piece", "weights", "words"])

    def add(batches_):
        found: dict[int, list] = {}
        for b in batches_:
            for piece, raw, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                value = np.frombuffer(raw, np.float64)
                found[piece] = [found[piece][0] + value, found[piece][1] + n] if piece in found else [value, n]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v, _ in found.values()], pa.binary()), pa.array([n for _, n in found.values()], pa.int64())], names=["piece", "weights", "words"])

    fields = "piece int, weights binary, words bigint"
    dealt = rows.select("shard", "place", "codes").repartition("shard").sortWithinPartitions("shard", "place", "codes")
    mean = sorted(dealt.mapInArrow(run, fields).repartition("piece").mapInArrow(add, fields).collect(), key=lambda r: r["piece"])  # one net
    if not mean:
        return net
    return Gru(config, unflat(np.concatenate([np.frombuffer(r["weights"], np.float64) / r["words"] for r in mean]).round(5), like))


def fit(docs: DataFrame, encoded: Callable[[Lexicon], DataFrame], config: Config = Config()) -> tuple[Gru, Lexicon, DataFrame, DataFrame]:
    """Counts over all of ``docs``, and a net that has trained on every run of words of their texts.

    ``encoded`` gives the table of ``encode`` with ``taught``, the rows to learn from. The driver starts the net on
    ``warm`` runs, chosen by hash (a bounded start, not the training): so all shards leave from one basin. Then in
    each round all shards train copies on their runs of that turn, and the copies are averaged by words.
    """
    counts = materialize(count_words(docs))
    total, distinct, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.octet_length("word") == 0, F.col("n")))).first()
    total = int(total or 0)
    lexicon = Lexicon.of([(END, int(ends or 0)), *frequent(counts, config)], total, distinct, config)
    rows = materialize(encoded(lexicon))
    net = Gru.new(config, lexicon.masses(config))
    if total:
        every = runs(rows.where("taught"), max(1, round(total / config.shard)), config)
        warm = hash_sample(every.select(F.col("place").alias("_h"), "codes"), total // config.run, config.warm, ["codes"]).collect()
        for _ in range(config.warm_turns):
            net.train(batches([bytes(r["codes"]) for r in warm], config), Adam(config.rate))
        net = Gru(config, unflat(flat(net.p).astype(np.float64).round(5), net.p))
        for turn in range(config.rounds):
            net = trained(every.where(F.col("turn") == turn), net, config.rate / (turn + 2))
    return net, lexicon, counts, rows


def score(rows: DataFrame, net: Gru, lexicon: Lexicon, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with n_tokens, n_known, base_score and score of every row of ``encode``.

    Words of the dictionary were counted where the text is; the others meet their counts in a join, then sum up by
    row. Such words are rare in the corpus, so no join key is hot but one that training never saw, whose partition
    an adaptive join splits. Repeated rows are scored each.
    """
    spark, config = rows.sparkSession, net.config
    shared = spark.sparkContext.broadcast(net.p)
    base = math.log10(lexicon.total + lexicon.distinct + 1)
    small = ["n_tokens", "seen", "sums", "fixed", "n_rare"]

    def run(batches_):
        own = Gru(config, shared.value)
        for b in batches_:
            codes = [np.frombuffer(c, np.int16) for c in b.column("codes").to_pylist()]
            lp = np.concatenate([own.score(codes[i : i + 8192]) for i in range(0, len(codes), 8192)]) / math.log(10) if codes else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lp)], names=[*keep, "_row", *small, "net"])

    scored = rows.select(*keep, "_row", *small, "codes")
    scored = scored.mapInArrow(run, added(scored.drop("codes").schema, "net double"))
    odd = rows.where("n_rare > 0").select("_row", F.explode(F.arrays_zip("rare", "times")).alias("o")).select("_row", F.col("o.rare").alias("word"), F.col("o.times").alias("times"))
    late = odd.join(counts, "word").groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("late"), F.sum("times").alias("found"))
    whole = scored.join(late, "_row", "left").withColumn("late", F.coalesce("late", F.lit(0.0)))
    return whole.select(
        *keep,
        "n_tokens",
        (F.col("seen") + F.coalesce("found", F.lit(0))).alias("n_known"),
        (F.col("sums") + F.col("late") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("net") + F.col("fixed") + F.col("late") - F.col("n_rare") * F.lit(math.log10(lexicon.rare_mass))).alias("score"),
    )


def fit_and_score(docs: DataFrame, taught: Column, config: Config = Config()) -> DataFrame:
    """doc_id, taught, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model learns from the rows where ``taught`` holds, all of their words; every whole text is scored. Scores
    don't depend on how rows lie in tasks. Null and empty texts have one token, their end; repeated rows are scored
    each; an empty table gives no rows; columns of ``docs`` other than doc_id and text play no part, whatever their names.
    """
    narrow = docs.select("doc_id", "text", F.coalesce(taught, F.lit(False)).alias("taught"))
    numbered = lambda lexicon: encode(narrow, lexicon, config, ("doc_id", "taught")).withColumn("_row", F.monotonically_increasing_id())
    net, lexicon, counts, rows = fit(narrow.where("taught"), numbered, config)
    return score(rows, net, lexicon, counts, ("doc_id", "taught")).withColumn("train_tokens", F.lit(lexicon.total).cast("long"))


def report(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    held = fold(F.col("doc_id"), 7) == 2
    scored = fit_and_score(docs, ~held, config)
    return scored.select("doc_id", (~F.col("taught")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
