"""Operators against brute force over whole texts, in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelmill.llm import common, decontamination, langid, line_dedup, lm, mixing, quality, sharding, simhash, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOW) if lower else text)


def least(links, nodes):
    """Smallest member of each node's component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


# --- quality rules


def counts(text):
    ws, lines = words(text, lower=False), [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    seen = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_quality_counts(which, request):
    docs = request.getfixturevalue(which)
    out = quality.quality_rules(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns.count("n_words") == 1
    for r in rows:
        n = counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r["kept"] == (not r["failed_rules"]) and not (r["kept"] and r["base_failed"])


def test_quality_is_one_native_projection(documents):
    plan = quality.quality_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- SimHash


def brute_print(text, size=4):
    ws = words(text)
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + size]).encode(), 42) for i in range(max(len(ws) - size + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_simhash(which, request):
    docs = request.getfixturevalue(which)
    prints = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    distinct = sorted({p for _, p in prints})
    parts = least([(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 4], distinct)
    first = {}
    for d, p in prints:
        if d is not None:
            first[parts[p]] = min(d, first.get(parts[p], d))
    got = simhash.report(docs).collect()
    assert Counter(map(tuple, got)) == Counter((d, f"{p:016x}", first.get(parts[p])) for d, p in prints)


def test_simhash_splits_large_buckets(spark):
    """Dense prints around few centres: buckets overflow at every level and still no link is lost."""
    import random

    rng, prints = random.Random(3), set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(simhash.signed(x))
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long").repartition(3)
    want = least([(a, b) for a, b in combinations(prints, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 4], prints)
    for bucket in (4096, 8):
        got = least([tuple(r) for r in simhash.links(df, bucket=bucket).collect()], prints)
        assert got == want


# --- decontamination


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_hits(docs, items):
    patterns = defaultdict(set)
    for item, text in items:
        ws = bench_words(text)
        for i in range(max(len(ws) - 9, min(len(ws), 1))):
            patterns[tuple(ws[i : i + 10])].add(item if item is None else str(item))
    out = []
    for d, text in docs:
        ws, hit, found = bench_words(text), set(), set()
        for n in {len(p) for p in patterns}:
            for i in range(len(ws) - n + 1):
                if (ids := patterns.get(tuple(ws[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(x for x in found if x is not None)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
@pytest.mark.parametrize("max_pairs", [100_000, 700])
def test_decontamination(spark, which, max_pairs, request):
    docs = request.getfixturevalue(which)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    bench = bench.union(spark.createDataFrame([(901, "One, TWO!"), (902, None), (903, ""), (904, "the"), (None, "of the"), (None, "word1 the of word2")], bench.schema))
    want = brute_hits([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in bench.collect()])
    assert Counter(map(tuple, decontamination.report(docs, bench, max_pairs=max_pairs).collect())) == want


def test_decontamination_without_benchmark(spark, odd_docs):
    got = decontamination.report(odd_docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == 11 and not any(r["contaminated"] for r in got)


# --- mixing


def test_mixing(documents, odd_docs):
    for docs in (documents, odd_docs):
        rows = mixing.mix_counts(docs).collect()
        assert len(rows) == docs.count()
        again = mixing.mix_counts(docs.repartition(7)).collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
        totals = Counter()
        for r in docs.collect():
            totals[r["source"]] += len(words(r["text"]))
        order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
        target, left, share = {}, order[:], 1.5 * sum(totals.values())
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        while True:
            rest = share - sum(target.values())
            over = [s for s in left if rest * weight[s] / sum(weight[t] for t in left) > 2 * totals[s]]
            if not over:
                break
            target |= {s: 2 * totals[s] for s in over}
            left = [s for s in left if s not in over]
        if left:
            rest, w = share - sum(target.values()), sum(weight[t] for t in left)
            target |= {s: rest * weight[s] / w for s in left}
        for r in rows:
            assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == totals[r["source"]]
            assert 0 <= r["copies"] <= 2
        assert mixing.mix(docs).count() == sum(r["copies"] for r in rows)
        assert mixing.mix(docs).columns == docs.columns


# --- sharding


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_sharding(which, request):
    docs = request.getfixturevalue(which)
    rows = sharding.sharded_documents(docs).collect()
    raw = lambda t: (t or "").encode()
    want = Counter((r["doc_id"], len(raw(r["text"])) + 8, zlib.crc32(raw(r["text"]))) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 24
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert Counter(map(tuple, rows)) == Counter(map(tuple, sharding.sharded_documents(docs.repartition(5)).collect()))


def test_flow_walks_clockwise_and_moves_little():
    nodes = sharding.ring(5, 16, 1024)
    counts_ = {s: 3 for s in range(0, 1024, 2)}
    n = sum(counts_.values())

    def where(capacity, ring):
        return {(r["slot"], k): r["shard"] for r in sharding.flow(counts_, ring, capacity) for k in range(r["lo"], r["hi"])}

    free = where([n] * 5, nodes)
    for (slot, _), shard in free.items():
        assert shard == next((s for p, s in nodes if p >= slot), nodes[0][1])
    bounded = where(sharding.capacities(n, 5, 0.25), nodes)
    assert max(Counter(bounded.values()).values()) <= 1.25 * n / 5 + 1
    exact = where(sharding.capacities(n, 5, 0), nodes)
    assert max(Counter(exact.values()).values()) - min(Counter(exact.values()).values()) <= 1
    grown = where(sharding.capacities(n, 6, 0.25), sharding.ring(6, 16, 1024))
    assert sum(grown[k] != bounded[k] for k in bounded) < 0.5 * n


def test_few_rows_move_to_a_new_shard(documents):
    """At counts one apart, 24 -> 25 shards: ideally a 25th moves."""
    docs = documents.select("doc_id", "text").unionAll(documents.selectExpr("doc_id + 100000", "text")).unionAll(documents.selectExpr("doc_id + 200000", "text"))
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.sharded_documents(docs, n).collect()} for n in (24, 25))
    assert sum(before[d] != after[d] for d in before) <= 0.12 * len(before)


# --- clashing names


def test_clashing_names(spark):
    text = "some plain words of a text that is not long"
    docs = spark.createDataFrame([(1, text, "en", "a", 1, 2, 3, 4, 5, 6, 7, 8), (1, text[::-1], "en", "b", 1, 2, 3, 4, 5, 6, 7, 8)], "doc_id long, text string, lang string, source string, _q int, fingerprint int, lang_pred int, score int, hit_spans int, `N_Words` int, copies int, `_text` int")
    bench = spark.createDataFrame([(1, "of a text")], "item_id long, text string")
    judged = quality.quality_rules(docs)
    assert "_q" in judged.columns and [c.lower() for c in judged.columns].count("n_words") == 1 and judged.count() == 2
    found = decontamination.contamination(docs, bench)
    assert sorted(len(r["hit_spans"]) for r in found.collect()) == [0, 1] and "_text" in found.columns and found.columns.count("hit_spans") == 1
    assert simhash.report(docs).count() == 2 and langid.report(docs).count() == 2 and lm.report(docs).count() == 2
    assert mixing.mix(docs).columns == docs.columns and sharding.sharded_documents(docs).count() == 2
    assert {r["doc_id"] for r in suffix_dedup.repeated_passages(docs).collect()} == set()


def test_null_ids_draw_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"text {i} of many", "a") for i in range(300)] + [(1, "x " * 300, "b")], "doc_id long, text string, source string")
    copies = Counter(r["copies"] for r in mixing.mix_counts(docs).where("source = 'a'").collect())
    assert len(copies) == 2 or set(copies) == {2}


# --- language


def test_langid(documents, odd_docs, spark):
    rows = {r["doc_id"]: r for r in langid.report(documents).collect()}
    held = [d for d in documents.collect() if rows[d["doc_id"]]["held_out"]]
    assert {r["doc_id"] for r in rows.values() if r["held_out"]} == {d for d in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.9 * len(held)
    odd = langid.report(odd_docs).collect()
    assert len(odd) == 11 and all(0 <= r["score"] <= 1 for r in odd)
    assert [r["lang_pred"] for r in odd if r["doc_id"] in (3, 4, 5)] == ["und"] * 3
    assert langid.report(odd_docs.limit(0)).collect() == []
    assert all(r["lang_pred"] == "und" for r in langid.identify(odd_docs, None).collect())


def test_langid_learns_from_repeats_and_null_ids(spark):
    en, fr = "the house and the garden of the man with a dog", "la maison et le jardin de monsieur avec un chien"
    no_ids = spark.createDataFrame([(None, f"{t} {i}", lang) for i in range(300) for t, lang in ((en, "en"), (fr, "fr"))], "doc_id long, text string, lang string")
    copies = spark.createDataFrame([(i, t, lang) for i in range(3000) for t, lang in ((en, "en"), (fr, "fr"))], "doc_id long, text string, lang string")
    for docs in (no_ids, copies, no_ids.withColumn("doc_id", F.lit(7))):
        net = langid.fit(docs)
        assert {(r["lang"], r["lang_pred"]) for r in langid.identify(docs, net, ("lang",)).distinct().select("lang", "lang_pred").collect()} == {("en", "en"), ("fr", "fr")}


@pytest.mark.parametrize("per_label", [1, 5, 40])
def test_langid_sample(spark, monkeypatch, per_label):
    """Exactly the windows of the least hashes, however wrong the estimate of different texts is."""
    rows = [(i % 7, f"{lang} text {i % n}" + " x" * (i % 90), lang) for lang, n in (("a", 3), ("b", 60), ("c", 500)) for i in range(500)] + [(1, None, "a"), (2, "123", "a"), (3, "word", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    config = langid.Config(window=16, per_label=per_label, labels=2)
    want = {}
    for r in docs.where("lang in ('a', 'b', 'c') and text <> '123'").select("lang", "text", F.xxhash64(F.lit(config.seed), "text").alias("h"), F.hash("text", F.lit(config.seed)).alias("at")).distinct().collect():
        data = r["text"].encode()
        low = r["at"] % max(1, len(data) - 15)
        want.setdefault(r["lang"], set()).add((r["h"], data[low : low + 16]))
    want = {(k, d) for k in ("a", "b") for _, d in sorted(v for v in want[k])[:per_label]}
    for wrong in (1, 1000):
        right = F.approx_count_distinct
        monkeypatch.setattr(F, "approx_count_distinct", lambda c, rsd: (right(c, rsd) * F.lit(wrong)).cast("long"))  # noqa: B023
        got = [(r["label"], bytes(r["data"])) for r in langid.training_windows(docs, config).collect()]
        monkeypatch.undo()
        assert set(got) == want


def test_langid_net_by_loops():
    """Filters, maxima and softmax of every window, one byte at a time."""
    import math

    import numpy as np

    config = langid.Config(window=12, filters=2)
    net = langid.ByteConvNet.new(config, ["a", "b", "c"])
    texts = [b"some words of a text, longer than a window", b"short", "é and more".encode(), b"12 34", None, b""]
    span = config.window - max(config.widths) + 1

    def loops(text):
        logs = []
        for at in range(0, len(text), config.window):
            part = text[at : at + config.window].ljust(config.window)
            pooled = []
            for f in range(len(net.bias)):
                wide = [t for t in net.tables if f < t.shape[1]]  # as many bytes as the filter is wide
                pooled.append(max(sum(float(t[part[i + j], f]) for j, t in enumerate(wide)) for i in range(span)) + float(net.bias[f]))
            z = [sum(max(p, 0) * float(net.dense[i, k]) for i, p in enumerate(pooled)) + float(net.shift[k]) for k in range(3)]
            total = math.log(sum(math.exp(x - max(z)) for x in z)) + max(z)
            logs.append([x - total for x in z])
        mean = [sum(x) / len(logs) for x in zip(*logs, strict=True)]
        p = [math.exp(x) / sum(map(math.exp, mean)) for x in mean]
        return net.labels[p.index(max(p))], max(p)

    labels, scores = net.classify(texts)
    for text, label, score in zip(texts[:3], labels, scores, strict=False):
        assert (label, score) == (loops(text)[0], pytest.approx(loops(text)[1], rel=1e-4))
    assert labels[3:] == ["und"] * 3 and scores[3:] == [0.0] * 3


# --- language model


def test_lm_base_and_score(documents):
    config = lm.Config(dictionary=500)
    rows = lm.report(documents, config).collect()
    texts = {r["doc_id"]: [*words(r["text"]), None] for r in documents.collect()}
    train = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in t)
    n, v = sum(train.values()), len(train)
    import math

    for r in rows:
        t = texts[r["doc_id"]]
        assert r["train_tokens"] == n and r["n_tokens"] == len(t) and r["n_known"] == sum(train[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_odd(odd_docs):
    rows = lm.report(odd_docs, lm.Config(dictionary=50)).collect()
    assert len(rows) == 11 and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5))
    assert lm.report(odd_docs.limit(0)).collect() == []


def test_lm_does_not_depend_on_tasks(documents):
    config = lm.Config(dictionary=3000, shard=60_000)
    one, other = ({r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm.report(d, config).collect()} for d in (documents, documents.repartition(7)))
    assert one.keys() == other.keys()
    assert all(other[d] == pytest.approx(x, rel=1e-5) for d, x in one.items())


def test_lm_is_a_distribution():
    import numpy as np

    config = lm.Config(vocab=64, classes=8, bands=4, buckets=8, hidden=4)
    net = lm.Gru.new(config, np.arange(1, 69, dtype=float))
    start = net.score([np.array([i], np.int16) for i in range(68)])  # the vocabulary, and a word of each band
    assert np.exp(start).sum() == pytest.approx(1, abs=1e-4)
    text = np.random.default_rng(0).integers(0, 64 + 32, 100).astype(np.int16)
    h, last, total = np.zeros((1, 4), np.float32), 0, 0.0
    for w in text:
        h = net.step(net.p["x"][[net.input[last]]], h)[0]
        total += float(net.log_probs(h, np.array([w]))[0])
        last = w
    assert net.score([text[:3], text])[1] == pytest.approx(total, rel=1e-4)


def test_lm_lexicon_shares_all_mass():
    """Within bands, probabilities of all words and of one that training never saw add up to one."""
    import numpy as np

    config = lm.Config(vocab=8, classes=2, bands=4, buckets=4)
    words_ = [(b"%d" % i, 60 - i) for i in range(40)]
    total, distinct = 50 + sum(n for _, n in words_), 41
    lex = lm.Lexicon.of([(lm.END, 50), *words_[:30]], total, distinct, config)
    band = (lex.codes[8:] - 8) % 4
    for k in range(3):
        assert (10 ** lex.fixed[8:][band == k]).sum() == pytest.approx(1)
    assert lex.rare_mass == pytest.approx(sum(n + 1 for _, n in words_[30:]) + 1)
    assert set(band.tolist()) == {0, 1, 2} and lex.masses(config).sum() == pytest.approx(total + distinct + 1)


def test_lm_runs_cover_every_word(spark):
    import numpy as np

    config = lm.Config(window=4, run_windows=2)
    texts = [np.arange(1, n + 1, dtype=np.int16) for n in (1, 8, 9, 30)]
    rows = spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(texts)], "doc_id long, codes binary")
    got = Counter()
    for r in lm.runs(rows, 3, config).collect():
        got.update(np.frombuffer(r["codes"], np.int16)[1:].tolist())
    assert got == Counter(int(x) for t in texts for x in t)


def test_lm_gradients():
    """Backpropagation against differences of the loss."""
    import numpy as np

    config = lm.Config(vocab=16, classes=4, bands=2, buckets=3, hidden=3, window=5, run_windows=1)
    net = lm.Gru.new(config, np.ones(18))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes = np.random.default_rng(1).integers(0, 16 + 6, (4, 6))
    known = np.ones_like(codes, bool)
    known[2, 4:] = False

    def loss():
        h, total = np.zeros((4, 3)), 0.0
        for k in range(5):
            h = net.step(net.p["x"][net.input[codes[:, k]]], h)[0]
            ok = known[:, k + 1]
            total -= net.log_probs(h[ok], codes[ok, k + 1]).sum()
        return total

    class Keep:
        def step(self, params, grads, count, sparse):
            x = np.zeros_like(params["x"])
            x[sparse["x"][0]] = sparse["x"][1]
            self.grads = grads | {"x": x}

    keep = Keep()
    net.train([(codes, known)], keep)
    rng = np.random.default_rng(2)
    for name, g in keep.grads.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in net.p[name].shape)
            old = net.p[name][at]
            net.p[name][at] = old + 1e-5
            up = loss()
            net.p[name][at] = old - 1e-5
            down = loss()
            net.p[name][at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=1e-3), name


# --- repeated passages


def brute_passages(docs, n=50):
    """Spans of windows that two doc_ids share; a text that another doc_id has too is a span as a whole."""
    texts, where = {}, defaultdict(set)
    for d, text in docs:
        texts.setdefault(text or "", set()).add(d)
    for text, ids in texts.items():
        ws = words(text)
        for i in range(len(ws) - n + 1):
            where[tuple(ws[i : i + n])].add(text)
    out = set()
    for text, ids in texts.items():
        ws = words(text)
        if len(ids) > 1:
            out |= {(d, 0, len(ws), len(ws)) for d in ids if len(ws) >= n}
            continue
        hits = [i for i in range(len(ws) - n + 1) if len(where[tuple(ws[i : i + n])]) > 1]
        while hits:
            start = stop = hits[0]
            while hits and hits[0] <= stop + 1:
                stop = hits.pop(0)
            out |= {(d, start, stop + n, len(ws)) for d in ids}
    return out


def test_suffix_dedup(documents, odd_docs, spark):
    for docs in (documents, odd_docs.where("doc_id is not null")):
        want = brute_passages([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert {tuple(r) for r in suffix_dedup.repeated_passages(docs).collect()} == want
    assert suffix_dedup.repeated_passages(odd_docs.limit(0)).collect() == []


def test_suffix_dedup_in_the_middle_of_a_crowd(spark):
    """Very many texts share a passage, and some of them more words to one side of it or the other."""
    import random

    rng = random.Random(8)
    fresh = lambda n: [f"{rng.getrandbits(30):x}" for _ in range(n)]
    left, middle, right, rows = fresh(60), fresh(40), fresh(60), []
    for i in range(150):
        a, b = rng.choice([0, 0, 3, 10, 30, 60]), rng.choice([0, 0, 5, 12, 35, 60])
        rows.append((f"t{i}", " ".join([*fresh(rng.randint(0, 40)), *left[60 - a :], *middle, *right[:b], *fresh(rng.randint(0, 40))])))
    rows += [("t0", " ".join(fresh(80))), (None, rows[3][1]), (None, " ".join([*fresh(5), *middle, *right])), ("t5", rows[5][1])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id string, text string, digest int, gram string").repartition(5)
    got = [tuple(r) for r in suffix_dedup.repeated_passages(docs).collect()]
    want = brute_passages([r for r in rows if r[0] is not None or r[1] != rows[3][1]])
    assert len(got) == len(set(got)) and set(got) == want


def test_suffix_dedup_extends_both_ways(spark):
    import random

    rng = random.Random(5)
    fresh = lambda n: [f"{rng.getrandbits(48):x}" for _ in range(n)]
    shared, tie = fresh(50), ["a"] * 120
    texts = [fresh(30) + shared + fresh(7), shared + fresh(70), fresh(64) + shared, fresh(200), fresh(9) + shared[:49] + fresh(20), fresh(5) + tie, tie + fresh(3)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {tuple(r)[:3] for r in suffix_dedup.repeated_passages(docs).collect()}
    assert got == {(0, 30, 80), (1, 0, 50), (2, 64, 114), (5, 5, 125), (6, 0, 120)}


def test_id_bits(spark):
    import numpy as np

    ids = [0, 1, 32767, 32768, 32769, 65535, 65536, -1, -(1 << 63), (1 << 63) - 1, 1 << 40, 12345678901]
    table = common.id_bits(spark.createDataFrame([(i,) for i in ids], "k long"), "k", 1 << 17)
    assert common.has_bit(table, np.array(ids), 1 << 17).all()
    others = np.array([i for i in range(2, 1 << 17, 61) if i not in {x % (1 << 17) for x in ids}])
    assert not common.has_bit(table, others, 1 << 17).any()


# --- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé", max_size=12), st.text("abé", max_size=12), st.integers(0, 4))
def test_within(a, b, edits):
    assert line_dedup.within(a, b, edits) == (distance(a, b) <= edits)


def brute_lines(docs, config):
    lines = [(d, i, x) for d, t in docs for i, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    distinct = sorted({x for _, _, x in lines})
    long = [x for x in distinct if len(x) >= config.least]
    close = [(a, b) for a, b in combinations(long, 2) if abs(len(a) - len(b)) <= config.edits and line_dedup.within(a, b, config.edits)]
    parts = least(close, distinct)
    first = {}
    for d, i, x in lines:
        key = (d is not None, d or 0, i)
        first[parts[x]] = min(key, first.get(parts[x], key))
    out = []
    for d, i, x in lines:
        known, cd, ci = first[parts[x]]
        cd = cd if known else None
        out.append((d, i, cd, ci, (d, i) != (cd, ci)))
    for row, n in Counter(out).items():  # of lines that tie for the first, one is
        if n > 1 and not row[4]:
            out = [r for r in out if r != row] + [row] + [(*row[:4], True)] * (n - 1)
    return Counter(out)


@pytest.mark.parametrize("block", [1024, 3])
def test_line_dedup(spark, documents, odd_docs, block):
    import random

    rng, config = random.Random(9), line_dedup.Config(block=block)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 40))) for _ in range(8)]

    def edited(x):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(x))
            x = x[:i] + rng.choice(["", "q", x[i] + "z"]) + x[i + 1 :]
        return x

    made = spark.createDataFrame([(i, "\n".join(edited(rng.choice(base)) for _ in range(4))) for i in range(40)], "doc_id long, text string")
    for docs in (made, odd_docs, *([documents] if block > 3 else [])):
        want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()], config)
        assert Counter(map(tuple, line_dedup.line_classes(docs, config).collect())) == want
    for more in (line_dedup.Config(block=block, levels=0), line_dedup.Config(block=2, levels=3, bits=1 << 15)):
        other = line_dedup.line_classes(made, more).collect()
        assert Counter(map(tuple, other)) == brute_lines([(r["doc_id"], r["text"]) for r in made.collect()], config)
    assert line_dedup.line_classes(odd_docs.limit(0), config).collect() == []


def test_line_dedup_takes_lines_out(spark):
    a, b = "a line that is long enough to link", "a line that is lung enough to link"
    docs = spark.createDataFrame([(1, f"{a}\nshort"), (2, f"x\n{b}\nshort"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs).collect()}
    assert got == {1: f"{a}\nshort", 2: "x", 3: None}


def test_line_dedup_of_repeated_ids(spark):
    """A line goes from the row that has it; clashing names stay."""
    a = "a line that is long enough to link"
    texts = [(1, a), (2, f"keep one\n{a}"), (2, "first\nother text that nobody else has"), (None, a), (None, "alone"), (2, "first\nother text that nobody else has")]
    docs = spark.createDataFrame([(*t, k, "x") for k, t in enumerate(texts)], "doc_id long, text string, _gone int, n string")
    got = line_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    rows = {r["_gone"]: r["text"] for r in got.collect()}
    assert [rows[0], rows[1], rows[3], rows[4]] == ["", "keep one", a, "alone"] and sorted([rows[2], rows[5]]) == ["", texts[2][1]]
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("0"))))
    assert line_dedup.line_classes(named).count() == 9
