"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import keep_columns, let, words

# fixed values: frequent function words of the languages covered
STOP_WORDS = (
    "the of and to in is that it for with as was on by this be are at from or an a "
    "la le de les et des un une en que qui dans du pour par sur au "
    "der die und den das von zu mit dem ein eine sich im nicht auf ist auch als "
    "el los las y del se por con para una su al lo"
).split()

STOP_FORMS = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
METRICS = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_stop n_upper".split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= numerator / denominator <= high; an empty denominator passes."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None


BASE_RULES = (Rule("too_short", "n_words", None, low=50), Rule("repetitive", "n_repeat_words", "n_words", high=0.5))
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", high=0.1),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", high=0.5),
    Rule("stop_word_ratio", "n_stop", "n_words", low=0.02),
    Rule("upper_case_ratio", "n_upper", "word_chars", high=0.4),
)


def _repeat_words(ws: Column) -> Column:
    """Words that lie in 3-word windows found twice or more.

    Each window becomes one long: its hash in the upper bits, its position in the lower ones (as many as
    the text needs). After a native sort, equal windows are neighbours; the words themselves confirm it.
    """

    def of_hashes(wh: Column) -> Column:
        n = F.greatest(F.size(wh) - 2, F.lit(0))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1  # position bits

        def of_mask(m: Column) -> Column:
            keys = F.sort_array(
                F.transform(F.slice(wh, 1, n), lambda h, i: F.xxhash64(h, F.get(wh, i + 1), F.get(wh, i + 2)).bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))
            )

            def of_keys(s: Column) -> Column:
                def same(x: Column, y: Column) -> Column:
                    p, q = x.bitwiseAND(m).cast("int"), y.bitwiseAND(m).cast("int")
                    equal = x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(m)) == 0
                    for k in range(3):
                        equal = equal & (F.get(ws, p + k) == F.get(ws, q + k))
                    return F.coalesce(equal, F.lit(False))

                pairs = F.filter(
                    F.transform(s, lambda x, i: F.when(same(x, F.get(s, i + 1)), F.array(x.bitwiseAND(m), F.get(s, i + 1).bitwiseAND(m)))), lambda x: x.isNotNull()
                )
                places = F.sort_array(F.array_distinct(F.flatten(pairs)))
                return let(
                    places,
                    lambda p: F.aggregate(
                        F.transform(p, lambda q, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - q, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x
                    ),
                )

            return let(keys, of_keys)

        return let(low, of_mask)

    return let(F.transform(ws, lambda w: F.xxhash64(w)), of_hashes)


def metrics(text: Column) -> Column:
    """All counts of one text as a struct; null and empty texts count zero everywhere."""
    text = F.coalesce(text, F.lit(""))

    def of_words(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        stop = F.filter(ws, lambda w: w.isin(*STOP_FORMS))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(ws).alias("n_repeat_words"),
                F.size(stop).cast("long").alias("n_stop"),
                F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            ),
        )

    return let(words(text), of_words)


def passes(rule: Rule, m: Column) -> Column:
    value, base = m[rule.numerator], m[rule.denominator] if rule.denominator else F.lit(1)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= rule.low * base)
    if rule.high is not None:
        ok = ok & (value <= rule.high * base)
    return ok


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base_rules: tuple[Rule, ...] = BASE_RULES, text: str = "text") -> DataFrame:
    """Add the counts, ``base_failed``, ``kept`` and ``failed_rules`` to every row, in one projection.

    Null, empty and blank texts have zero words and fail ``too_short``. Rows are judged alone, so ties,
    repeats and empty tables need no care; clashing input columns give way to the ones made here.
    """
    made = [*METRICS, "base_failed", "kept", "failed_rules"]
    base = [r.name for r in base_rules]

    def judged(m: Column) -> Column:
        names = F.array_compact(F.array(*[F.when(~passes(r, m), F.lit(r.name)) for r in (*base_rules, *rules)]))
        counts = [m[k].alias(k) for k in METRICS]
        return let(names, lambda n: F.struct(*counts, F.exists(n, lambda x: x.isin(*base)).alias("base_failed"), (F.size(n) == 0).alias("kept"), n.alias("failed_rules")))

    # one struct binds the counts once, so that a filter on a verdict, pushed below the projection, counts once too
    q = "_q" + "_" * max(len(c) for c in docs.columns)  # no column has this name
    counted = docs.withColumn(q, let(metrics(F.col(f"`{text}`")), judged))
    out = [F.col(f"`{c}`") for c in keep_columns(docs, made).columns]
    return counted.select(*out, *[F.col(f"{q}.{k}").alias(k) for k in made])


# DuckDB: the same over the table documents (doc_id unique)
ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) o(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum([length(x) for x in ws]), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len([x for x in ws if x IN ({", ".join(f"'{s}'" for s in STOP_FORMS)})]) AS BIGINT) AS n_stop,
    CAST(length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN lines USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 15.0 * n_words AND n_symbols <= 0.1 * n_words
  AND n_dup_lines <= 0.5 * n_lines AND n_stop >= 0.02 * n_words AND n_upper <= 0.4 * word_chars AS kept
FROM b
"""
