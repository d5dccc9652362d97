"""License scans: a sparse n-gram logistic regression over paragraphs, confirmed by templates. JVM only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm.common import let, literal_table
from pixelmill.plans.storage import materialize

# fixed values: names of public licence families, and sentences of their official notices
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU LGPL"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "Apache-1.1": ["Apache Software License, Version 1.1", "Apache License, Version 1.1"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License", "Simplified BSD License"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License - v 2.0"],
}
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY-NC-4.0": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "CC-BY-4.0": ["To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "Apache-1.1": ["The end-user documentation included with the redistribution, if any, must include the following acknowledgment: This product includes software developed by the Apache Software Foundation"],
    "BSD-2-Clause": [],
    "CC-BY-3.0": ["To view a copy of this license, visit http://creativecommons.org/licenses/by/3.0/"],
    "CC-BY-SA-4.0": ["To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
}
# names of licences that are no family here: they teach the unknown class what a licence alone is
OTHERS = [
    "Mozilla Public License, Version 1.1",
    "Eclipse Public License, Version 1.0",
    "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC BY-ND 4.0",
    "CC BY-NC-SA 4.0",
    "CC0 1.0 Universal",
    "Artistic License 2.0",
    "Boost Software License, Version 1.0",
    "European Union Public License, version 1.2",
    "ISC License",
    "zlib License",
]
# what usually stands before a name; training alone uses it
FRAMES = ["{}", "licensed under {}", "licensed under the {}", "licensed under the terms of the {}", "distributed under the {}", "available under {}", "subject to the {}", "covered by the {}"]
TEMPLATES = {f: [*NAMES[f], *NOTICES[f]] for f in NAMES}
UNKNOWN = "unknown"
BLANK = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"  # between paragraphs
PART = 50_000  # rows of a task of the regression


@dataclass(frozen=True)
class Config:
    """All pieces of the corpus but those close to a template teach the unknown class, and weigh together as
    ``negatives`` / 2 lessons at most, so that the penalty means the same at any size. ``contained`` is the share of a
    template's n-grams that a piece must hold to confirm a prediction, with half of those that tell its family from
    all others (a version, "lesser", "sharealike"); ``quantile`` of the corpus's pieces, each judged by a model of the
    other half, that the calibrated threshold turns away; n-grams without a word rarer than ``common`` are no features.
    A paragraph is judged in pieces of ``piece`` words, which overlap by half, so that a notice is seen whole."""

    negatives: int = 4000
    variants: int = 24
    contained: float = 0.6
    quantile: float = 0.999
    strength: float = 0.0003
    common: float = 0.01
    piece: int = 80
    seed: int = 3


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and inner dots or hyphens, at which a line may have been wrapped."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("-\n"), F.lit("-"))), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def grams(ws: Column) -> Column:
    """Distinct words and word pairs."""

    def of(w: Column) -> Column:
        pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
        return F.array_distinct(F.concat(w, pairs))

    return let(ws, of)


def template_rows(spark: SparkSession) -> DataFrame:
    """template, family, its n-grams, and ``own``, those that no template of another family has."""
    rows = [{"template": i, "family": f, "text": t} for i, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    parsed = literal_table(spark, rows, "template int, family string, text string").select("template", "family", grams(tokens(F.col("text"))).alias("grams")).collect()
    each = [{"template": r["template"], "family": r["family"], "grams": r["grams"], "own": sorted(set(r["grams"]) - {g for o in parsed if o["family"] != r["family"] for g in o["grams"]})} for r in parsed]
    return literal_table(spark, each, "template int, family string, grams array<string>, own array<string>")


def paragraphs(docs: DataFrame) -> Column:
    """Blocks of lines with a word, parted by blank lines; how lines are wrapped doesn't matter."""
    return F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), BLANK), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def pieces(ws: Column, piece: int) -> Column:
    """Overlapping runs of a paragraph's words, one at least."""
    half = piece // 2
    last = F.greatest(F.ceil(F.size(ws) / half).cast("int") - 2, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(ws, i * half + 1, piece))


@dataclass
class Model:
    """Weights of the n-grams that the penalty left, per class; ``triggers`` has a word of each of them."""

    classes: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    triggers: list[str]
    threshold: float


def negatives(docs: DataFrame, vocabulary: list[str], config: Config = Config()) -> DataFrame:
    """h, grams of every piece of every document that isn't close to a template: its n-grams of the vocabulary, and a hash.

    One that shares words with a close piece is left out too, as it may hold the other part of the notice.
    """
    known = template_rows(docs.sparkSession).collect()
    single = [g for g in vocabulary if " " not in g]

    def met(p: Column) -> Column:  # as grams(), but pairs with an empty word aren't built
        pair = lambda x, i: F.when((x != "") & (F.get(p, i + 1) != ""), F.concat(x, F.lit(" "), F.get(p, i + 1)))
        return F.array_distinct(F.concat(F.array_remove(p, ""), F.filter(F.transform(p, pair), lambda g: g.isin(vocabulary))))

    # a piece that holds so much of a template has one of any n-grams of it that are more than it may lack
    probes, held = set(), []
    for r in known:
        needed = math.ceil(config.contained * len(r["grams"]))
        probes |= set(sorted(r["grams"], key=lambda g: (" " not in g, -len(g), g))[: len(r["grams"]) - needed + 1])
        held.append((needed, F.array(*map(F.lit, r["grams"]))))

    def close(found: Column) -> Column:
        any_held = reduce(lambda a, b: a | b, [F.size(F.array_intersect(found, part)) >= needed for needed, part in held])
        return F.when(F.exists(found, lambda g: g.isin(sorted(probes))), any_held).otherwise(False)

    def apart(parts: Column) -> Column:
        return let(F.transform(parts, close), lambda c: F.filter(parts, lambda _, i: ~(F.get(c, i) | F.coalesce(F.get(c, i - 1), F.lit(False)) | F.coalesce(F.get(c, i + 1), F.lit(False)))))

    def parts(text: Column) -> Column:  # words of no interest become empty before pieces repeat them
        ws = F.transform(tokens(text), lambda w: F.when(w.isin(single), w).otherwise(""))
        return let(let(ws, lambda x: F.transform(pieces(x, config.piece), met)), apart)

    each = docs.where("text is not null").select("doc_id", F.posexplode(F.flatten(F.transform(paragraphs(docs), parts))).alias("no", "grams"))
    return each.select(F.xxhash64(F.lit(config.seed), "doc_id", "no", "grams").alias("h"), "grams")


def fit(docs: DataFrame, config: Config = Config()) -> Model:
    """Train on notices, and on names in usual frames, whole and with n-grams left out, against every piece of the
    corpus and the names of other licences.

    Every second of these stands among the words of the pieces dealt to it, as notices do in documents. Pieces that
    hold most of a template, or share words with such a piece, are no negatives. Pieces count by their features, so that equal ones are one row with a
    weight. Two models of half of the corpus each judge the other half, which sets the probability that a family
    needs; the weights are those of a third, of the whole.
    """
    spark = docs.sparkSession
    known = template_rows(spark)
    classes = [*TEMPLATES, UNKNOWN]
    taught = [{"family": f, "text": t} for f in TEMPLATES for t in [*NOTICES[f], *(x.format(n) for n in NAMES[f] for x in FRAMES)]]
    taught += [{"family": UNKNOWN, "text": x.format(n)} for n in OTHERS for x in FRAMES]
    taught = [{"lesson": i, **r} for i, r in enumerate(taught)]
    lessons = literal_table(spark, taught, "lesson int, family string, text string").select("lesson", "family", grams(tokens(F.col("text"))).alias("grams"))
    vocabulary = sorted({g for r in lessons.select("grams").collect() for g in r["grams"]})
    negative = materialize(negatives(docs, vocabulary, config))

    # a paragraph with a feature has its rarest word; words that are frequent outside licences carry none
    total, found = negative.count(), F.explode(F.filter("grams", lambda g: ~g.contains(" "))).alias("w")
    seen = {r["w"]: r["n"] for r in negative.select(found).groupBy("w").agg(F.count("*").alias("n")).collect()}
    rarest = {g: min(g.split(" "), key=lambda w: (seen.get(w, 0), w)) for g in vocabulary}
    kept_grams = {g for g in vocabulary if seen.get(rarest[g], 0) <= max(3, config.common * total)}
    # a template whose own n-grams are all frequent keeps the rarest of them
    rows = known.collect()
    for r in rows:
        own = set(r["grams"]) - {g for o in rows if o["family"] != r["family"] for g in o["grams"]}
        if own and not own & kept_grams:
            fewest = min(seen.get(rarest[g], 0) for g in own)
            kept_grams |= {g for g in own if seen.get(rarest[g], 0) == fewest}
    vocabulary = sorted(kept_grams)

    # variants of lessons: even ones stand alone, odd ones among the pieces dealt to them, by turns in small tables
    y = F.array_position(F.array(*map(F.lit, classes)), F.col("family")).alias("y")
    kept = F.filter("grams", lambda g: g.isin(vocabulary) & ((F.col("v") < 2) | (F.pmod(F.xxhash64(g, F.col("v"), F.lit(config.seed)), F.lit(10)) >= 3)))
    alone = lessons.select("lesson", "family", "grams", F.explode(F.sequence(F.lit(0), F.lit(config.variants - 1))).alias("v"))
    alone = alone.select(y, F.col("v") % 2 == 1, (F.col("lesson") * config.variants + F.col("v")).alias("variant"), kept.alias("grams")).toDF("y", "among", "variant", "grams")
    alone = materialize(alone)
    half = config.variants // 2
    turns = math.ceil(4 * len(taught) * half / total) if 0 < total < 4 * len(taught) * half else 1
    place = F.pmod(F.xxhash64("h", "turn"), F.lit(len(taught) * half))
    variant = (F.floor(place / half) * config.variants + 2 * (place % half) + 1).cast("int").alias("variant")
    features = F.array_sort(F.filter("grams", lambda g: g.isin(vocabulary))).alias("around")
    dealt = negative.select("h", (F.pmod("h", F.lit(2))).cast("int").alias("half"), features, F.explode(F.sequence(F.lit(1), F.lit(turns))).alias("turn"))
    dealt = materialize(dealt.groupBy("half", variant, "around").agg(F.count("*").alias("n")))

    weights, bias = regression(alone, dealt, vocabulary, len(classes), turns, config)
    triggers = sorted({rarest[g] for g in weights})
    model = Model(classes, bias, weights, triggers, 0.5)
    judged = []
    for k in (0, 1):
        weights, bias = regression(alone, dealt.where(F.col("half") == 1 - k), vocabulary, len(classes), turns, config)
        other = dealt.where(F.col("half") == k).groupBy("around").agg((F.sum("n") / turns).cast("long").alias("n"))
        judged.append(probabilities(other.select(F.col("around").alias("row"), F.col("n").alias("no"), F.col("around").alias("grams")), Model(classes, bias, weights, [], 0.5)))
    model.threshold = upper_quantile(materialize(judged[0].union(judged[1]).select("p", F.col("no").alias("n"))), config.quantile)
    return model


def regression(alone: DataFrame, dealt: DataFrame, vocabulary: list[str], k: int, turns: int, config: Config) -> tuple[dict[str, list[float]], list[float]]:
    """Weights and biases from lessons and dealt pieces; each variant of a lesson weighs 1, whatever it stands among."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    pieces_of = dealt.groupBy("variant").agg(F.sum("n").alias("n_all"))
    among = alone.where("among").join(pieces_of, "variant", "left").join(dealt.select("variant", "around", "n"), "variant", "left")
    among = among.select("y", F.array_sort(F.array_union("grams", F.coalesce("around", F.array().cast("array<string>")))).alias("grams"), F.coalesce(F.col("n") / F.col("n_all"), F.lit(1.0)).alias("weight"))
    every = dealt.agg(F.sum("n")).first()[0] or 0
    share = min(every / turns, config.negatives / 2) / max(every, 1)
    plain = dealt.groupBy(F.lit(k).cast("int").alias("y"), F.col("around").alias("grams")).agg((F.sum("n") * share).alias("weight"))
    rows = alone.where("not among").select("y", "grams", F.lit(1.0).alias("weight")).union(among).union(plain)
    rows = materialize(rows.select((F.col("y") - 1).cast("double").alias("label"), "grams", "weight"))
    sparse = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    data = sparse.transform(rows.repartition(math.ceil(rows.count() / PART))).select("label", "features", "weight")
    trained = LogisticRegression(family="multinomial", regParam=config.strength, elasticNetParam=1.0, maxIter=40, standardization=False, weightCol="weight").fit(data)
    # rounded, as tasks add up in any order
    matrix, bias = trained.coefficientMatrix.toArray().round(4), [round(float(x), 4) for x in trained.interceptVector.toArray()]
    weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(vocabulary) if abs(matrix[:, i]).max() > 0}
    return weights, bias + [0.0] * (k - len(bias))


def upper_quantile(scores: DataFrame, quantile: float) -> float:
    """The quantile of ``scores(p, n)``, n being how often p occurs, or 0.5 if that is more; to 30 bits, ten at a time."""
    total = scores.agg(F.sum("n")).first()[0] or 0
    above = total - math.ceil(quantile * (total - 1))  # so many are to reach it
    place, rest = F.floor(F.col("p") * (1 << 30)).cast("bigint"), scores.where("p >= 0.5")
    for bits in (20, 10, 0):
        at = F.shiftright(place, bits)
        counts = rest.groupBy(at.alias("b")).agg(F.sum("n").alias("n")).collect()  # 1024 rows at most
        if not above or sum(r["n"] for r in counts) < above:
            return 0.5
        for r in sorted(counts, reverse=True):
            if r["n"] >= above:
                break
            above -= r["n"]
        rest = rest.where(at == r["b"])
    return float(rest.agg(F.min("p")).first()[0])


def probabilities(rows: DataFrame, model: Model) -> DataFrame:
    """``rows(row, no, grams)`` -> row, no, the best family and its probability p, for rows with any feature."""
    spark, k = rows.sparkSession, len(model.classes)
    table = literal_table(spark, [{"gram": g, "w": w} for g, w in sorted(model.weights.items())], "gram string, w array<double>")
    met = rows.select("row", "no", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    sums = met.groupBy("row", "no").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(k)])
    z = F.array(*[F.col(f"s{i}") + F.lit(model.bias[i]) for i in range(k)])
    scored = sums.select("row", "no", z.alias("z"))
    total = F.aggregate(F.transform("z", lambda x: F.exp(x - F.array_max("z"))), F.lit(0.0), lambda a, x: a + x)
    best = F.array_max(F.slice("z", 1, k - 1))
    family = F.get(F.array(*map(F.lit, model.classes)), (F.array_position("z", best) - 1).cast("int"))
    return scored.select("row", "no", family.alias("family"), (F.exp(best - F.array_max("z")) / total).alias("p"))


def scan(docs: DataFrame, model: Model, config: Config = Config(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with n_paragraphs, families (sorted), family, score, confirmed of every document.

    A piece without a word that any weight needs has the unknown class by its bias alone, so only the others are
    scored; of these, n_predicted paragraphs have one above the threshold. ``family`` is the surest of them
    (``unknown`` if none), its ``score`` the probability; ``confirmed`` says that the piece holds most of a template
    of that family, and of what is that family's alone. Null and empty texts have no paragraphs, an empty table no rows; repeated rows are judged each;
    ties go to the last family name; columns of ``docs`` other than text and ``keep`` play no part.
    """
    spark = docs.sparkSession
    triggers = F.array(*map(F.lit, model.triggers)) if model.triggers else F.array().cast("array<string>")
    numbered = F.transform(paragraphs(docs), lambda x, i: F.struct(i.alias("no"), tokens(x).alias("ws")))
    busy = F.filter(numbered, lambda x: F.arrays_overlap(x["ws"], triggers))
    runs = F.flatten(F.transform(busy, lambda x: F.transform(pieces(x["ws"], config.piece), lambda p, k: F.struct(x["no"].alias("no"), k.alias("part"), p.alias("ws")))))
    busy = F.filter(runs, lambda x: F.arrays_overlap(x["ws"], triggers))
    rows = materialize(docs.select(*keep, F.size(paragraphs(docs)).cast("long").alias("n_paragraphs"), busy.alias("busy")).withColumn("row", F.monotonically_increasing_id()))
    each = rows.where("size(busy) > 0").select("row", F.explode("busy").alias("b")).select("row", F.struct("b.no", "b.part").alias("no"), grams(F.col("b.ws")).alias("grams"))
    each = materialize(each)
    sure = materialize(probabilities(each, model).where(F.col("p") >= model.threshold))
    sized = template_rows(spark).select("template", "family", "own", F.size("grams").alias("n"), F.size("own").alias("n_own"), F.explode("grams").alias("gram"))
    parts = sized.withColumn("tells", F.array_contains("own", F.col("gram")).cast("int")).drop("own")
    shared = each.join(sure, ["row", "no"]).select("row", "no", "family", F.explode("grams").alias("gram")).join(F.broadcast(parts), ["family", "gram"])
    counted = shared.groupBy("row", "no", "template").agg(F.count("*").alias("k"), F.sum("tells").alias("k_own"), F.first("n").alias("n"), F.first("n_own").alias("n_own"))
    held = counted.where((F.col("k") >= config.contained * F.col("n")) & (2 * F.col("k_own") >= F.col("n_own"))).select("row", "no").distinct()
    judged = sure.join(held.withColumn("confirmed", F.lit(True)), ["row", "no"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    best = judged.groupBy("row").agg(
        F.sort_array(F.collect_set("family")).alias("families"), F.max(F.struct("confirmed", "p", "family")).alias("best"), F.count_distinct("no.no").alias("n_predicted")
    )
    met = rows.drop("busy").join(best, "row", "left")
    return met.select(
        *keep,
        "n_paragraphs",
        F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("best.family", F.lit(UNKNOWN)).alias("family"),
        F.coalesce("best.p", F.lit(0.0)).alias("score"),
        F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"),
    )


def report(docs: DataFrame, config: Config = Config()) -> DataFrame:
    return scan(docs, fit(docs, config), config)
