"""Licence scans, and the pipeline's stages against brute force."""

import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pixelmill.llm import licenses, mixing, quality, simhash
from tests.llm.test_documents import bench_words, brute_hits, counts, least


# fixed values: the licence lines that the documents hold; none of them is a template
LINES = {"MIT License": "MIT", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0", "Apache License": "Apache-2.0"}


def test_licenses(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: next((v for k, v in LINES.items() if k in r["text"]), "unknown") for r in docs.collect()}
    rows = licenses.report(docs).collect()
    assert {r["doc_id"]: r["family"] for r in rows} == want
    assert len(set(want.values())) == 5


def test_licenses_by_brute_force_counts(spark, documents):
    """Paragraphs, pieces and confirmations in plain Python."""
    config, model = licenses.Config(), licenses.fit(documents)
    words_of = lambda t: re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", t.lower().replace("-\n", "-"))
    grams_of = lambda ws: {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))}
    templates = [(f, grams_of(words_of(t))) for f, ts in licenses.TEMPLATES.items() for t in ts]
    templates = [(f, g, g - {x for o, h in templates if o != f for x in h}) for f, g in templates]
    for r, text in ((r, t["text"]) for r, t in zip(licenses.scan(documents, model).orderBy("doc_id").collect(), documents.orderBy("doc_id").collect(), strict=True)):
        paras = [p for p in re.split(r"\n(?:[ \t\x0b-\r]*\n)+", text or "") if p.split()]
        assert r["n_paragraphs"] == len(paras)
        best = (False, 0.0, "unknown")
        for p in paras:
            ws = words_of(p)
            for at in range(0, max(len(ws) - config.piece // 2, 1), config.piece // 2):
                found = grams_of(ws[at : at + config.piece])
                z = [b + sum(model.weights[g][i] for g in found if g in model.weights) for i, b in enumerate(model.bias)]
                k = max(range(len(z) - 1), key=z.__getitem__)
                prob = math.exp(z[k] - max(z)) / sum(math.exp(x - max(z)) for x in z)
                if prob >= model.threshold and found & set(model.weights):
                    family = model.classes[k]
                    best = max(best, (any(f == family and len(found & g) >= config.contained * len(g) and 2 * len(found & own) >= len(own) for f, g, own in templates), prob, family))
        assert (r["confirmed"], r["family"]) == (best[0], best[2]) and r["score"] == pytest.approx(best[1], rel=1e-9)


NOTICES_APART = [
    ("MIT", "Released under the MIT license, see the file COPYING."),
    ("MIT", "Permission is granted, free of charge, to any person obtaining a copy of this work and its associated documentation files, to deal in it without restriction"),
    ("Apache-2.0", "This module is made available by its authors under the Apache License, version 2.0; see www.apache.org/licenses/LICENSE-2.0 for a copy."),
    ("GPL-3.0", "This script is free software. You may redistribute it and modify it under the terms of version 3 of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistributions and use in source or binary forms, with or without modification, are permitted provided that these conditions are met"),
    ("CC-BY-NC-4.0", "All photographs here are shared under the Creative Commons Attribution-NonCommercial 4.0 International license."),
    ("CC-BY-4.0", "The figures may be reused under a Creative Commons Attribution 4.0 International licence."),
    ("MPL-2.0", "This file is subject to the Mozilla Public License, v. 2.0; a copy is at http://mozilla.org/MPL/2.0/ for all to read."),
]
NO_NOTICES = [
    "The license plate of the car was registered in version 2.0 of the form.",
    "She had to obtain a copy of the licence at the office before the conditions were met.",
    "Permission is granted to any person who asks, free of charge, at the door.",
    "The general public is free to use the software foundation course.",
    "A creative mind of the commons wrote the attribution.",
]


def test_licenses_held_out(spark, documents):
    """Notices in other words than the templates', wrapped at 40 columns, inside documents; and look-alikes."""
    plain = [r["text"] for r in documents.where("text is not null").orderBy("doc_id").collect() if not any(k in r["text"] for k in LINES)][:40]
    rows, want = [], {}
    for i, (family, notice) in enumerate([*NOTICES_APART, *(("unknown", t) for t in NO_NOTICES)]):
        for k in range(4):
            text = plain[(4 * i + k) % len(plain)]
            half = text.rfind(" ", 0, len(text) // 2)
            apart = "\n\n" if k % 2 else "\n"
            rows.append((1000 + 10 * i + k, f"{text[:half]}{apart}{textwrap.fill(notice, 40)}{apart}{text[half + 1 :]}"))
            want[rows[-1][0]] = family
    docs = documents.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["family"] for r in licenses.report(docs).collect() if r["doc_id"] in want}
    hit = sum(got[d] == f != "unknown" for d, f in want.items())
    assert hit >= 0.9 * sum(f != "unknown" for f in want.values())
    assert hit >= 0.9 * sum(f != "unknown" for f in got.values())


SIBLINGS_APART = [
    ("GPL-2.0", "This tool is free software; you may redistribute it or change it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
    ("LGPL", "The library may be linked under the GNU Lesser General Public License, version 2.1 or any later one."),
    ("LGPL", "You may copy this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License or later."),
    ("AGPL-3.0", "The server is offered under the GNU Affero General Public License version 3."),
    ("Apache-1.1", "Parts of it are covered by the Apache Software License, version 1.1, as given below."),
    ("CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike 4.0 International licence."),
    ("CC-BY-3.0", "Pictures may be used under a Creative Commons Attribution 3.0 Unported license."),
    ("BSD-2-Clause", "Released under the simplified BSD 2-Clause License."),
    ("EPL-2.0", "These parts are made available under the Eclipse Public License, version 2.0, by their authors."),
    ("unknown", "The old code stays under the Mozilla Public License, Version 1.1, as before."),
    ("unknown", "Drawings are shared under CC BY-ND 4.0, so nobody may change them."),
    ("unknown", "It is distributed under the Artistic License 2.0 and nothing else."),
]


def test_sibling_licenses(spark, documents):
    """Other licences of the same wording: their own family or none, and never confirmed as another."""
    plain = [r["text"] for r in documents.where("text is not null").orderBy("doc_id").collect() if not any(k in r["text"] for k in LINES)][40:80]
    rows, want = [], {}
    for i, (family, notice) in enumerate([*SIBLINGS_APART, *NOTICES_APART]):
        for k in range(3):
            text = plain[(3 * i + k) % len(plain)]
            half = text.rfind(" ", 0, len(text) // 2)
            rows.append((2000 + 10 * i + k, f"{text[:half]}\n\n{textwrap.fill(notice, 50)}\n\n{text[half + 1 :]}"))
            want[rows[-1][0]] = family
    docs = documents.select("doc_id", "text").unionAll(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in licenses.report(docs).collect() if r["doc_id"] in want}
    wrong = {(f, got[d]["family"], got[d]["confirmed"]) for d, f in want.items() if got[d]["family"] not in (f, "unknown")}
    hit = sum(got[d]["family"] == f != "unknown" for d, f in want.items())
    named = sum(r["family"] != "unknown" for r in got.values())
    assert not {w for w in wrong if w[2]}, wrong
    assert hit >= 0.9 * named and hit >= 0.9 * sum(f != "unknown" for f in want.values()), (wrong, hit, named, [(f, got[d]["family"]) for d, f in want.items() if got[d]["family"] == "unknown" != f])


def test_licenses_odd(spark, odd_docs):
    extra = spark.createDataFrame([(20, "x\n\n" + licenses.TEMPLATES["BSD-3-Clause"][2], None, None, None, None), (21, "the license is a plate of wood", None, None, None, None)], odd_docs.schema)
    model = licenses.fit(odd_docs.union(extra))
    rows = {r["doc_id"]: r for r in licenses.scan(odd_docs.union(extra), model).where("doc_id is not null").collect()}
    assert rows[20]["family"] == "BSD-3-Clause" and rows[20]["confirmed"] and rows[20]["n_paragraphs"] == 2
    assert not rows[21]["confirmed"] and rows[4]["n_paragraphs"] == 0
    assert licenses.scan(odd_docs.limit(0), model).collect() == []
    assert licenses.scan(odd_docs, model).count() == 11
    plan = licenses.scan(odd_docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shingle_sets(rows, key="doc_id"):
    out = {}
    for r in rows:
        ws = (r["text"] or "").encode().lower().split()
        out[r[key]] = {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))}
    return out


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def stages(spark, docs):
    """What each stage should keep, in plain Python."""
    rows = [r for r in docs.collect()]
    kept = {r["doc_id"] for r in quality.quality_rules(docs).where("kept").collect()}
    for r in rows:
        n = counts(r["text"])
        assert not (r["doc_id"] in kept and (n[0] < 50 or 100 * n[4] > 50 * n[0]))
    rows = [r for r in rows if r["doc_id"] in kept]
    yield sorted(r["doc_id"] for r in rows)
    sets = shingle_sets(rows)
    parts = least([(a, b) for a, b in combinations(sorted(sets), 2) if alike(sets[a], sets[b])], sorted(sets))
    rows = [r for r in rows if parts[r["doc_id"]] == r["doc_id"]]
    yield sorted(r["doc_id"] for r in rows)
    bench = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, *_, bad in brute_hits([(r["doc_id"], r["text"]) for r in rows], bench) if not bad}
    rows = [r for r in rows if r["doc_id"] in clean]
    yield sorted(r["doc_id"] for r in rows)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_counts(docs.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))).collect()}
    yield sorted(d for d, n in copies.items() for _ in range(n))


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontaminate", "mix_sources", "shard"]
    want, at = stages(spark, docs), docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, folder).collect(), docs.schema)
        assert sorted(r["doc_id"] for r in at.collect()) == next(want)
    text = {r["doc_id"]: r["text"].encode() for r in at.collect()}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in at.collect())
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_documents(spark, odd_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd_docs, "/root/testdata/sf0.001")
    if name != "shard":
        assert out.columns == odd_docs.columns
    out.collect()
    assert stage(spark, odd_docs.limit(0), "/root/testdata/sf0.001").collect() == []


def test_simhash_stage_keeps_one_of_a_group(spark, odd_docs):
    rows = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, odd_docs, "").collect()
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids


def test_near_copies_of_repeated_ids(spark):
    """Rows with one doc_id, or none, are judged by their texts; every column stays."""
    import random

    rng = random.Random(4)
    fresh = lambda: [f"{rng.getrandbits(40):x}" for _ in range(60)]
    a, b, c, d, z, y = (fresh() for _ in range(6))
    near_a = [*a[:30], "other", *a[31:]]
    texts = [(3, a), (5, a), (5, b), (7, c), (7, d), (None, near_a), (None, z), (None, z), (9, near_a), (2, y), (2, y), (None, ["x"]), (4, ["x"])]
    docs = spark.createDataFrame([(i, " ".join(t), k, "u") for k, (i, t) in enumerate(texts)] + [(8, None, 20, "v"), (None, "", 21, None)], "doc_id long, text string, h int, component string")
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], (r["text"] or "").split()) for r in rows) == sorted(
        [(False, 3, a), (False, 5, b), (False, 7, c), (False, 7, d), (True, None, z), (False, 2, y), (False, 4, ["x"]), (False, 8, [])], key=lambda x: (x[0], x[1] or 0, x[2])
    )
    again = simhash.deduplicate(docs.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_names_are_registered():
    known = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in known) for k in range(1, 11)) and "pipeline" in known
    assert bench_words("A-b C") == ["a", "b", "c"]


def test_near_copies_go_at_similarity(spark):
    docs = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("kept").select("doc_id", "text")
    base = [f"w{i}" for i in range(200)]
    ladder = [" ".join("x" if k in (20 * j for j in range(1, edits + 1)) else w for k, w in enumerate(base)) for edits in range(6)]
    docs = spark.createDataFrame([*docs.collect(), *((10_000 + i, t) for i, t in enumerate(ladder))], "doc_id long, text string")
    sets = shingle_sets(docs.collect())
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if alike(sets[a], sets[b])]
    parts = least(pairs, sorted(sets))
    got = [r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
    assert sorted(got) == sorted(d for d in sets if parts[d] == d)


def test_licenses_in_a_third_of_the_documents(spark, documents):
    marked = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^.*(?:MIT License|GNU General|CC BY-NC|Apache License).*$", "a line")
    docs = documents.select("doc_id", F.when(marked, F.concat(plain, F.lit("\nReleased under the MIT License."))).otherwise(plain).alias("text"))
    docs = docs.unionAll(docs.select((F.col("doc_id") + 3000).alias("doc_id"), F.regexp_extract("text", "[^\n]*$", 0).alias("text")))
    rows = licenses.report(docs).collect()
    assert all((r["family"] == "MIT") == (r["doc_id"] % 3 == 0) for r in rows)


def test_licenses_learn_from_every_piece(spark, documents):
    """The unknown class is every piece of the corpus, by brute force; the German "mit" is no licence in any document."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("not rlike(text, 'MIT License|GNU General|CC BY-NC|Apache License')")
    config = licenses.Config(negatives=40)
    words_of = lambda t: re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", t.lower().replace("-\n", "-"))
    grams_of = lambda ws: {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))}
    templates = [grams_of(words_of(t)) for ts in licenses.TEMPLATES.values() for t in ts]
    vocabulary, want = set().union(*templates), Counter()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(9000, "x\n\n" + licenses.NOTICES["MIT"][1]), (9001, "of CC BY-SA 4.0 or the license"), (9002, "the " * 60 + licenses.NOTICES["BSD-3-Clause"][0] + " of the" * 70)]
    for _, text in rows:
        for p in (p for p in re.split(r"\n(?:[ \t\x0b-\r]*\n)+", text) if p.split()):
            ws = words_of(p)
            parts = [grams_of(ws[at : at + config.piece]) & vocabulary for at in range(0, max(len(ws) - config.piece // 2, 1), config.piece // 2)]
            close = [any(len(found & g) >= config.contained * len(g) for g in templates) for found in parts]
            want.update(tuple(sorted(found)) for i, found in enumerate(parts) if not any(close[max(i - 1, 0) : i + 2]))
    made = licenses.negatives(spark.createDataFrame(rows, "doc_id long, text string"), sorted(vocabulary), config)
    assert Counter(tuple(sorted(r["grams"])) for r in made.collect()) == want
    assert sum(want.values()) > 5 * config.negatives
    assert licenses.scan(docs, licenses.fit(docs, config), config).where("family != 'unknown'").count() == 0


def test_upper_quantile(spark):
    """As Spark's percentile would let pass, with repeated and near scores; half at least."""
    scores = [0.1] * 50 + [0.6, 0.6, 0.9, 0.9 + 1e-8, 0.95, 0.99, 1.0]
    table = spark.createDataFrame([(p, n) for p, n in Counter(scores).items()], "p double, n long")
    for q in (0.5, 0.9, 0.93, 0.96, 0.98, 0.999):
        cut = table.select(F.percentile("p", q, F.col("n"))).first()[0]
        got = licenses.upper_quantile(table, q)
        assert sum(p >= got for p in scores) == sum(p >= max(cut, 0.5) for p in scores)
    assert licenses.upper_quantile(table.limit(0), 0.9) == 0.5
