"""How filters interact: every order of a set of filters, step by step, from counts of the failures they share."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import let, words
from pixelmill.plans.storage import materialize

MOST_FILTERS = 8  # orders grow with the factorial
METRICS = "kept removed redundant unique_fails good_lost toxic_lost".split()


@dataclass(frozen=True)
class Filter:
    """A letter and the condition under which a document fails, over a struct of counts of its text.

    The struct has n_words, n_distinct, n_upper, n_chars (all int) and text.
    """

    letter: str
    fails: Callable[[Column], Column]


FILTERS = (
    Filter("A", lambda m: m["n_words"] < 50),
    Filter("B", lambda m: m["n_distinct"] * F.lit(100).cast("long") < m["n_words"] * F.lit(65).cast("long")),
    Filter("C", lambda m: m["n_upper"] * F.lit(100).cast("long") > m["n_chars"] * F.lit(5).cast("long")),
    Filter("D", lambda m: m["text"].rlike(r"[#$%&*|]")),
)
REPEATED = "E"  # fails where a row with a smaller doc_id has the same text


def text_failures(text: Column, filters: tuple[Filter, ...] = FILTERS) -> Column:
    """An int with bit i set if filter i fails; null texts count as empty."""

    def of_words(ws: Column, text: Column) -> Column:
        upper = F.char_length(text) - F.char_length(F.translate(text, string.ascii_uppercase, ""))
        counts = F.struct(F.size(ws).alias("n_words"), F.size(F.array_distinct(ws)).alias("n_distinct"), upper.alias("n_upper"), F.char_length(text).alias("n_chars"), text.alias("text"))
        bits = lambda m: [F.when(f.fails(m), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters)]
        return let(counts, lambda m: sum(bits(m), F.lit(0)))

    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda ws: of_words(ws, t)))


def mask_cells(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of a part by the set of filters they fail, as bits; the last bit is
    ``REPEATED``.

    ``docs`` has doc_id, text and part (null: empty). A row is repeated if a smaller doc_id has its text, anywhere in the table;
    rows without doc_id neither repeat others nor are repeated, rows with one doc_id don't repeat each other. A
    document is good (toxic) if any of its ``labels`` rows has quality (toxic) 1. Empty tables have no cells.
    Equal rows are counted before they meet anything; texts meet as SHA-256, and the first of each text is found by
    (text, doc_id), so a text that very many documents share is no hot key.
    """
    text = F.coalesce("text", F.lit(""))
    flagged = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("key"), F.coalesce("part", F.lit("")).alias("part"), text_failures(F.col("text"), filters).alias("mask"))
    rows = materialize(flagged.groupBy("doc_id", "key", "part", "mask").agg(F.count("*").alias("n")))
    named = rows.where("doc_id is not null")
    first = named.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    last = 1 << len(filters)
    judged = named.join(first, ["key", "doc_id"], "left").select("doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + last).alias("mask"), "n")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    met = judged.join(known, "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    none = F.lit(None).cast("boolean")
    every = met.union(rows.where("doc_id is null").select("part", "mask", "n", none.alias("good"), none.alias("toxic")))
    counted = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


# a level adds a filter to each prefix of an order; `applied` are the bits of the prefix before it
LEVELS = """
WITH RECURSIVE steps(part, prefix, letter, step, bits, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {parts}
  UNION ALL
  SELECT part, concat(prefix, l.letter), l.letter, step + 1, applied | l.bit,
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & (applied | l.bit) = 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied = 0 AND c.mask & l.bit <> 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied <> 0 AND c.mask & l.bit <> 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask = l.bit, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied = 0 AND c.mask & l.bit <> 0, c.good, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask & applied = 0 AND c.mask & l.bit <> 0, c.toxic, 0L))
  FROM (
    SELECT s.part, s.prefix, s.step, s.bits AS applied, p.cells, explode(filter(p.letters, l -> s.bits & l.bit = 0)) AS l
    FROM steps s JOIN {parts} p ON p.part = s.part
  )
)
SELECT * FROM steps LIMIT ALL
"""


def prefixes(cells: DataFrame, letters: str) -> DataFrame:
    """One row for each part and each prefix of each order: ``part, prefix, letter, step`` and the metrics of that step.

    A recursive common table expression: a level extends every prefix by each letter that it lacks and counts over the
    part's cells, of which there are at most 2 ** filters. Its rows grow with the parts, not with the documents.
    """
    spark, n = cells.sparkSession, len(letters)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    named = F.array(*[F.struct(F.lit(c).alias("letter"), F.lit(1 << i).alias("bit")) for i, c in enumerate(letters)])
    parts = materialize(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).withColumn("letters", named))
    return spark.sql(LEVELS, parts=parts).where("step > 0").select("part", "prefix", "letter", "step", *METRICS)


def interactions(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """One row per part, order of filters and step: ``part, filter_order, step``, the metrics, ``letter`` and ``shapley``.

    kept: left after this step; removed: here; redundant: failing its filter, removed earlier; unique_fails: failing no
    other filter; good_lost, toxic_lost: removed here; shapley: removed by its filter, over all orders.
    Takes what ``mask_cells`` takes; parts without documents don't exist.
    """
    letters = "".join(f.letter for f in filters) + REPEATED
    steps = materialize(prefixes(mask_cells(docs, labels, filters), letters))
    shares = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * F.factorial(F.lit(len(letters)) - F.col("step"))).alias("shapley"))
    orders = steps.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    each = orders.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("prefix", F.expr("left(filter_order, step)"))
    return each.join(steps, ["part", "prefix", "step"]).join(shares, ["part", "letter"]).select("part", "filter_order", "step", *METRICS, "shapley", "letter")


# DuckDB: the same over the tables documents and labels, parts by source
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM d GROUP BY text
), known AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flagged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM d JOIN firsts USING (text) LEFT JOIN known USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM flagged GROUP BY part, mask
), letters(letter, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), pre AS (
  SELECT '' AS prefix, '' AS letter, 0 AS step, 0 AS applied, 0 AS bit
  UNION ALL
  SELECT p.prefix || l.letter, l.letter, p.step + 1, p.applied + p.bit, l.bit FROM pre p JOIN letters l ON (p.applied + p.bit) & l.bit = 0
), steps AS (
  SELECT part, prefix, letter, step,
    sum(CASE WHEN mask & (applied + bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM pre, cells WHERE step > 0 GROUP BY part, prefix, letter, step
), shares AS (
  SELECT part, letter, sum(removed * factorial(5 - step)) AS shapley FROM steps GROUP BY part, letter
), orders AS (
  SELECT prefix AS filter_order, unnest(range(1, 6)) AS step FROM pre WHERE step = 5
)
SELECT s.part, o.filter_order, CAST(o.step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM orders o JOIN steps s ON s.prefix = o.filter_order[1:o.step] JOIN shares h ON h.part = s.part AND h.letter = s.letter
"""
