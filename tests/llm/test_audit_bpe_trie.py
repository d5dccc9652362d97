"""Filter interactions, byte-level BPE and the conversation trie against plain Python."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelmill.llm import audit, bpe, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- filters


def failing(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, part in rows:
        text = text or ""
        ws = WORD.findall(text)
        fails = ["A"] * (len(ws) < 50) + ["B"] * (100 * len(set(ws)) < 65 * len(ws)) + ["C"] * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text))
        fails += ["D"] * bool(re.search(r"[#$%&*|]", text)) + ["E"] * (doc_id is not None and doc_id > first[text])
        yield doc_id, part or "", set(fails)


def audited(rows, labels):
    good, toxic = ({d for d, *flags in labels if flags[k] == 1} for k in (0, 1))
    judged = list(failing(rows))
    out = {}
    for part in {p for _, p, _ in judged}:
        docs = [(d, f) for d, p, f in judged if p == part]
        removed = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [(d, f) for d, f in left if c in f]
                left = [(d, f) for d, f in left if c not in f]
                removed[c] += len(gone)
                failed = sum(c in f for _, f in docs)
                out[part, "".join(order), step] = [len(left), len(gone), failed - len(gone), sum(f == {c} for _, f in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), c]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = removed[row[-1]]
    return out


def same_audit(spark, docs, labels):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "part").collect()]
    known = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect() if r[0] is not None]
    out = audit.interactions(docs, labels).collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[m] for m in (*audit.METRICS, "shapley")] for r in out}
    assert len(found) == len(out) and found == audited(rows, known)


def test_filter_orders(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    same_audit(spark, documents.withColumn("part", F.expr("if(source < 'src2', source, null)")), labels)


def test_filter_orders_of_odd_rows(spark, odd_docs):
    rows = [(1, 1, 0), (2, 1, 1), (2, 0, None), (None, 1, 1), (3, None, 1), (99, 1, 1)]
    same_audit(spark, odd_docs.withColumnRenamed("source", "part").withColumn("mask", F.lit("clash")), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
    empty = odd_docs.where("false").withColumn("part", F.lit("x"))
    assert audit.interactions(empty, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).count() == 0


def test_two_filters(spark):
    docs = spark.createDataFrame([(i, "x " * (60 if i % 2 else 3), "p") for i in range(10)], "doc_id long, text string, part string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = audit.interactions(docs, labels, (audit.Filter("S", lambda m: m["n_words"] < 50),)).orderBy("filter_order", "step").collect()
    assert [(r["filter_order"], r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in out] == [("ES", 2, 8, 0, 12), ("ES", 1, 1, 4, 6), ("SE", 5, 5, 0, 6), ("SE", 1, 4, 4, 12)]
    with pytest.raises(ValueError):
        audit.prefixes(docs, "ABCDEFGHI")


# --- byte-level BPE

PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoder, texts):
    return [(np.frombuffer(i, "<u4").tolist(), np.frombuffer(s, "<u4").tolist()) for i, s in zip(*(x.to_pylist() for x in encoder.encode(pa.array(texts, pa.string()))), strict=True)]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(st.one_of(st.sampled_from("absrtmdvel''  \n\t\r\x1c\x85　​0٣½漢é-!"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6), st.integers(4, 9))
def test_pieces_and_ids(texts, block):
    vocabulary, library = test_pieces_and_ids.known
    found = encoded(bpe.Encoder(vocabulary, block), [*texts, None])
    for text, (ids, starts) in zip([*texts, ""], found, strict=True):
        assert ids == library.encode_ordinary(text)
        sizes = [len(vocabulary.tokens[i]) for i in ids]
        assert starts == [sum(sizes[:k]) for k in range(len(ids))]


@pytest.fixture(autouse=True, scope="module")
def _known(vocabulary, library):
    test_pieces_and_ids.known = vocabulary, library


def test_classes_of_all_code_points(vocabulary, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["a" + "a".join(points[i : i + 4096]) + "1" + "1".join(points[i : i + 4096]) for i in range(0, len(points), 4096)]
    assert [ids for ids, _ in encoded(bpe.Encoder(vocabulary), texts)] == [library.encode_ordinary(t) for t in texts]


def test_merging_long_pieces(vocabulary):
    ranks = {t: i for i, t in enumerate(vocabulary.tokens) if t}
    rng = random.Random(3)
    for _ in range(300):
        piece = "".join(rng.choice("theandié漢") for _ in range(rng.randint(2, 60))).encode()
        if piece not in ranks:
            assert bpe.merge_long(piece, ranks) == bpe.merge(piece, ranks)


def test_scan_composes():
    machine = bpe.Machine.new()
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100, 1001):
        signs = rng.choice([bpe.L, bpe.N, bpe.O, bpe.W, bpe.BLANK, bpe.LONE, bpe.L + bpe.FIRST], n)
        state, want = bpe.DONE, []
        for s in signs:
            state = bpe.step(state, int(s))[0]
            want.append(state)
        assert machine.image[machine.scan(machine.of[signs]), bpe.DONE].tolist() == want


def test_encode_documents(spark, documents, odd_docs, vocabulary, library):
    for docs in (documents, odd_docs.withColumn("ids", F.lit(1)).withColumn("_text", F.lit("x"))):
        out = bpe.decode(bpe.encode(docs, vocabulary, block=1000, rows=50_000, cached=100), vocabulary)
        rows = out.collect()
        assert len(rows) == docs.count() and out.columns == [c for c in docs.columns if c != "ids"] + ["ids", "starts", "decoded"]
        for r in rows:
            text = r["text"] or ""
            assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(text) and r["decoded"] == text.encode()
    told = bpe.report(odd_docs, vocabulary).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in told if r["doc_id"] == 4] == [0] and all(r["ids_sha256"] == hashlib.sha256().hexdigest() for r in told if r["n_tokens"] == 0)
    assert bpe.report(odd_docs.where("false"), vocabulary).count() == 0


def test_decode_refuses(spark, vocabulary):
    pack = lambda *x: np.array(x, "<u4").tobytes()
    rows = [(pack(5), pack(1)), (pack(10**6), pack(0))]
    for row in rows:
        with pytest.raises(Exception, match="follow from ids|vocabulary"):
            bpe.decode(spark.createDataFrame([row], "ids binary, starts binary"), vocabulary).collect()
    assert bpe.decode(spark.createDataFrame([(None, None)], "ids binary, starts binary"), vocabulary).first()["decoded"] == b""


def test_bytes_that_are_no_text(spark, vocabulary, library):
    docs = spark.createDataFrame([(b"a\xff\xfe b",)], "raw binary").select(F.col("raw").cast("string").alias("text"))
    r = bpe.decode(bpe.encode(docs, vocabulary).drop("text"), vocabulary).first()
    assert r["decoded"].decode().count("�") >= 1 and np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["decoded"].decode())


# --- conversation trie


def rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, told, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    return out


def nodes_of(built):
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = []
    for path, cs in members.items():
        below, leaves, saved = [path], 0, 0
        while below:
            p = below.pop()
            leaves += not kids[p]
            saved += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
            below += kids[p]
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(path))))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def some_conversations(n, seed, most=12, long=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, rng.randint(1, most)])):
            rows.append((c * rng.choice([1, 1, 7]), t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é" * 5])))
    return rows + [(5_000, t, "user", f"x{t % 3}") for t in range(long)] + [(5_001, t, "user", f"x{t % 3}" if t < long - 2 else "y") for t in range(long)]


@pytest.mark.parametrize("piece, most_turns", [(4096, 1_000_000), (3, 20), (1, 5)])
def test_trie_of_rebuilt_conversations(spark, piece, most_turns):
    rows = some_conversations(80, 5, long=40)
    rows += [(None, 0, "user", "a"), (7, None, "user", "z"), (7, None, None, None), (10, 3, "user", "a"), (10, 3, "user", "a"), (-3, 0, "user", "a"), (-1, 1, "user", "b")]
    found = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")), piece, most_turns).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == nodes_of(rebuild(rows))


def test_trie_of_equal_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(9)]
    found = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(7)).select(*COLUMNS).collect()
    assert len(found) == 10 and sorted(map(tuple, found), key=repr) == nodes_of(rebuild(rows))


def test_trie_of_test_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = trie.conversation_trie(table).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=repr) == nodes_of(rebuild([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]))
    assert trie.conversation_trie(table.where("false")).count() == 0


def test_trie_of_turnless_conversations(spark):
    rows = [(c, 0, "user", "a") for c in range(1, 60) if c % 5]  # no conversation has its source
    found = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()
    built = rebuild(rows)
    assert any(not ts for ts in built.values()) and sorted(map(tuple, found), key=repr) == nodes_of(built)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.integers(0, 2), max_size=9), max_size=25), st.integers(0, 6))
def test_zfast_trie(paths, base):
    prefixes = {}
    keys = [[(base, 0, 0), *[prefixes.setdefault(tuple(p[:d]), (len(prefixes) + 1, 1, d)) for d in range(1, len(p) + 1)]] for p in paths]
    one = trie.ZFastTrie()
    for i, k in enumerate(keys):
        one.insert(base, k, (1,), (i,))
    for k in keys:
        node, leaves = one.exit(base, k, one.roots[base, k[0]])
        assert leaves == -1 and one.high[node] == base + len(k) - 1 and one.key(node, one.high[node]) == k[-1]
    one.totals()
    for node in range(len(one.low)):
        for depth in range(one.low[node] + 1, one.high[node] + 1):
            through = [i for i, k in enumerate(keys) if len(k) > depth - base and k[depth - base] == one.key(node, depth)]
            assert one.sums[node] == (len(through),) and one.least[node] == (min(through),)
        assert one.low[node] == one.high[node] or one.handles[one.key(node, trie.fattest(one.low[node], one.high[node]))] == node


def test_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert trie.fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)
