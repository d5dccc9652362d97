"""Language identification with a byte convolutional network, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pixelmill.llm.common import keep_columns, literal_table, ship
from pixelmill.plans.storage import materialize

ship(__name__)


@dataclass(frozen=True)
class Config:
    """``per_label`` and ``labels`` bound the training sample: at most their product of windows."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    per_label: int = 1000
    labels: int = 200
    epochs: int = 12
    batch: int = 64
    rate: float = 0.02
    seed: int = 7


@dataclass
class ByteConvNet:
    """Filters of several widths over one-hot bytes, the maximum of each over a window, then softmax.

    The input is one-hot, so a filter is a table of weights by (offset, byte), and a convolution is a sum of
    table rows. ``tables[j]`` holds offset j of all filters that are wider than j, widest filters first.
    """

    config: Config
    labels: list[str]
    tables: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    dense: np.ndarray | None = None
    shift: np.ndarray | None = None

    @classmethod
    def new(cls, config: Config, labels: list[str]) -> ByteConvNet:
        rng, f = np.random.default_rng(config.seed), config.filters
        sizes = [f * sum(w > j for w in config.widths) for j in range(max(config.widths))]
        tables = [rng.normal(0, 0.3, (256, n)).astype(np.float32) for n in sizes]
        return cls(config, labels, tables, np.zeros(sizes[0], np.float32), rng.normal(0, 0.3, (sizes[0], len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def convolve(self, windows: np.ndarray) -> np.ndarray:
        """(n, window) bytes -> (n, window - widest + 1, filters)."""
        span = windows.shape[1] - len(self.tables) + 1
        out = self.tables[0][windows[:, :span]]
        for j, t in enumerate(self.tables[1:], 1):
            out[:, :, : t.shape[1]] += t[windows[:, j : j + span]]
        return out

    def logits(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.convolve(windows[i : i + 64]).max(1) for i in range(0, len(windows), 64)]  # 64 windows fit a core's cache
        return np.maximum(np.concatenate(parts) + self.bias, 0) @ self.dense + self.shift

    def train(self, windows: np.ndarray, target: np.ndarray) -> None:
        """Adam on cross-entropy; only the byte runs that won a maximum receive gradient."""
        c, rng = self.config, np.random.default_rng(self.config.seed)
        params = [*self.tables, self.bias, self.dense, self.shift]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(c.epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), c.batch):
                rows = order[at : at + c.batch]
                x, y = windows[rows], target[rows]
                conv = self.convolve(x)
                best = conv.argmax(1)
                pooled = np.take_along_axis(conv, best[:, None, :], 1)[:, 0] + self.bias
                active = np.maximum(pooled, 0)
                z = active @ self.dense + self.shift
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.dense.T) * (pooled > 0)
                grads = []
                for j, t in enumerate(self.tables):
                    g, n = np.zeros_like(t), t.shape[1]
                    np.add.at(g, (np.take_along_axis(x, best[:, :n] + j, 1), np.arange(n)[None, :]), back[:, :n])
                    grads.append(g)
                grads += [back.sum(0), active.T @ p, p.sum(0)]
                step += 1
                for w, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= c.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def classify(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Label and probability of whole texts: the mean of their windows' log-probabilities."""
        w, labels, scores = self.config.window, ["und"] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and has_letter(t)]
        at = 0
        while at < len(todo):
            chosen, rows = [], 0
            while at < len(todo) and (not chosen or rows < 4096):  # some windows at a time, whatever the texts' lengths
                chosen.append(todo[at])
                rows += -(-len(texts[todo[at]]) // w)
                at += 1
            counts = [-(-len(texts[i]) // w) for i in chosen]
            data = b"".join(texts[i].ljust(n * w) for i, n in zip(chosen, counts, strict=True))
            z = self.logits(np.frombuffer(data, np.uint8).reshape(-1, w))
            z -= z.max(1, keepdims=True)
            z -= np.log(np.exp(z).sum(1, keepdims=True))
            mean = np.add.reduceat(z, np.r_[0, np.cumsum(counts)[:-1]], axis=0) / np.array(counts)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, k, s in zip(chosen, p.argmax(1), p.max(1), strict=True):
                labels[i], scores[i] = self.labels[k], float(s)
        return labels, scores


def has_letter(text: bytes) -> bool:
    """Any Unicode letter; ASCII letters are found without decoding."""
    if text.translate(None, _NO_ASCII_LETTERS):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


_NO_ASCII_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def training_windows(docs: DataFrame, config: Config) -> DataFrame:
    """One window of a text for up to ``per_label`` different windows of each label, those of the least hashes: (label, data).

    Hash and place of a window depend on the text alone, so null or equal ids don't matter and a text that is there many
    times counts once. Rows without label, text or letters teach nothing; of more labels than ``labels`` the most
    frequent count. A label's windows leave the scan below a share of all hashes that its number of different texts, by
    estimate, lets expect to be enough; labels that then have too few are read again with a larger share. So what is kept
    is bounded by parameters, and which windows it is doesn't depend on the estimate.
    """
    data = F.col("text").cast("binary")
    span = F.greatest(F.octet_length("text") - config.window + 1, F.lit(1))
    drawn = F.xxhash64(F.lit(config.seed), "text")
    labelled = docs.where("lang is not null and text rlike '\\\\p{L}'").select(F.col("lang").alias("label"), drawn.alias("_h"), F.substring(data, (F.pmod(F.hash("text", F.lit(config.seed)), span) + 1).cast("int"), F.lit(config.window)).alias("data"))
    counts = labelled.groupBy("label").agg(F.count("*").alias("_n"), F.approx_count_distinct("_h", 0.02).alias("_d")).orderBy(F.desc("_n"), "label").limit(config.labels).collect()
    share = F.col("_h") / float(1 << 64) + 0.5
    limits = {r["label"]: min(1.0, (1.5 * config.per_label + 50) / max(r["_d"], 1)) for r in counts}
    found, todo = None, dict(limits)
    while todo:
        most = literal_table(docs.sparkSession, [{"label": k, "_most": v} for k, v in todo.items()], "label string, _most double")
        some = materialize(labelled.join(F.broadcast(most), "label").where((share <= F.col("_most")) | (F.col("_most") >= 1)).select("label", "_h", "data").distinct())
        enough = {r["label"] for r in some.groupBy("label").agg(F.count("*").alias("n")).collect() if r["n"] >= config.per_label} | {k for k, v in todo.items() if v >= 1}
        kept = some.where(F.col("label").isin(*enough)) if enough else some.limit(0)
        found = kept if found is None else found.union(kept)
        todo = {k: min(1.0, 4 * v) for k, v in todo.items() if k not in enough}
    if found is None:
        return labelled.limit(0).select("label", "data")
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("_h", "data")))
    return ranked.where(F.col("_r") <= config.per_label).select("label", "data")


def fit(docs: DataFrame, config: Config = Config()) -> ByteConvNet | None:
    """Train on the labelled rows' sample; None if there is none."""
    rows = training_windows(docs, config)
    sample = rows.limit(config.per_label * config.labels).collect()  # bounded by two parameters
    if not sample:
        return None
    by = {}
    for r in sample:
        by.setdefault(r["label"], []).append(bytes(r["data"]).ljust(config.window))
    labels = sorted(by)
    x = np.frombuffer(b"".join(d for k in labels for d in sorted(by[k])), np.uint8).reshape(-1, config.window)
    y = np.array([i for i, k in enumerate(labels) for _ in by[k]])
    net = ByteConvNet.new(config, labels)
    net.train(x, y)
    return net


def identify(docs: DataFrame, net: ByteConvNet | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score`` of every whole text.

    A text that is null or has no letter is ``und`` with score 0; without a trained net every text is. Each
    row is judged alone, repeated ones alike; windows of many texts are scored together, however long one of them
    is. An empty table gives no rows; clashing columns of ``docs`` give way to the ones made here.
    """
    narrow = keep_columns(docs, ["lang_pred", "score"]).select(*keep, F.col("text").cast("binary").alias("_text"))

    def run(batches):
        for b in batches:
            texts = b.column("_text").to_pylist()
            labels, scores = net.classify(texts) if net else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([*narrow.drop("_text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return narrow.mapInArrow(run, schema)


def fold(key: Column, parts: int) -> Column:
    """Fold of a document: crc32 of its id as text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def report(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; held-out documents teach nothing."""
    held = fold(F.col("doc_id"), 4) == 2
    net = fit(docs.where(~held), config)
    return identify(docs, net).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
