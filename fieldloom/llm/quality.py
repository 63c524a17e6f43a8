"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each document gets counts over its whole text. Four rules compare a ratio of them with a cutoff. The cutoffs
are chosen per stratum (language) from labelled holdouts: for every rule and every cutoff of a fixed grid,
the false rejections among the good documents of the stratum are counted, and the exact lower binomial tail
tests "false rejection rate >= alpha". Cutoffs are tested from the most lenient on and the strictest one
that still passes is used, so with Bonferroni over rules and strata all cutoffs hold at once with confidence
1 - delta: in no stratum do the rules together reject more than ALPHA of the good documents. A stratum with
too few labels certifies nothing, and no rule is used there.

Defined cases: null or empty text has no words (base_failed); a null language is a stratum of its own; labels
without document, documents without label, null or repeated labels are fine (a document with any label 1 counts as
good); repeated rows are documents of their own; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACES, documents, labels, text_of
from fieldloom.session import stored

WINDOW = 5
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The rules together may reject this share of a stratum's good documents, with confidence 1 - DELTA.
ALPHA, DELTA = 0.02, 0.05
#: Fixed grids of cutoffs, lenient to strict; a document is rejected when its value is above the cutoff.
GRIDS = {
    "symbol_ratio": (2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "word_length": (40.0, 30.0, 20.0, 15.0, 12.0, 10.0),
}
#: A table of strata up to this many rows is broadcast; a larger one is joined by shuffle.
MOST_STRATA = 10_000


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of the whole text, one pass, no shuffle."""
    n = WINDOW
    text = F.col("_text")
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("stratum"), text_of().alias("_text"))
    rows = rows.select(
        "doc_id", "stratum",
        F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "").alias("_lines"),
        _without(text, SPACES).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - _without(text, UPPER)).cast("long").alias("n_upper"),
    )
    rows = rows.select(
        "doc_id", "stratum", "word_chars", "n_symbols", "n_upper",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hash"),
    )
    gram = lambda i: F.xxhash64(*[F.get(F.col("_hash"), i + k) for k in range(n)])
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("_grams", F.when(F.col("n_words") > n, F.transform(F.sequence(F.lit(0), (F.col("n_words") - n).cast("int")), gram)).otherwise(none)).drop("_hash")
    rows = rows.withColumn("_again", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    # only texts with a repeated window are sorted: equal windows become neighbours, and their places are merged
    rows = rows.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    s = F.col("_sorted")
    twice = F.filter(s, lambda e, i: (F.get(s, i - 1)["g"].eqNullSafe(e["g"])) | (F.get(s, i + 1)["g"].eqNullSafe(e["g"])))
    rows = rows.withColumn("_places", F.sort_array(F.transform(twice, lambda e: e["i"])))
    p = F.col("_places")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(n), F.coalesce(F.get(p, i + 1) - x, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(0).cast("long"))
    return rows.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        _ratio("n_symbols", "n_words").alias("symbol_ratio"), _ratio("n_upper", "word_chars").alias("upper_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), _ratio("word_chars", "n_words").alias("word_length"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed in log space; 1 where k is above the mean (such a k certifies nothing)."""
    step = lambda acc, i: F.struct(
        (acc["total"] + F.exp(acc["term"])).alias("total"),
        (acc["term"] + F.log(F.greatest(n - i, F.lit(1)).cast("double")) - F.log((i + 1).cast("double")) + F.lit(math.log(p / (1 - p)))).alias("term"),
    )
    first = F.struct(F.lit(0.0).alias("total"), (n * F.lit(math.log1p(-p))).alias("term"))
    return F.when(k <= n * p, F.aggregate(F.sequence(F.lit(0).cast("long"), k), first, step)["total"]).otherwise(1.0)


def cutoffs(feature_rows: DataFrame, quality: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum that has labels: the certified cutoff of each rule, null where none is certified."""
    good = quality.groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("quality")).filter("quality = 1")
    held = feature_rows.filter(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("l_id"), "left_semi")
    tests = [(rule, cut) for rule, grid in GRIDS.items() for cut in grid]
    per = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), F.count_if(F.col(r) > c).alias("k")) for r, c in tests]).alias("tests"),
    )
    strata = per.agg(F.count(F.lit(1)).alias("strata"))
    each = per.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata", F.inline("tests"))  # one row: the number of strata
    tail = binomial_tail(F.col("n"), F.col("k"), alpha / len(GRIDS))
    passed = each.filter(tail <= F.lit(delta / len(GRIDS)) / F.col("strata"))
    return passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cut"))).alias(f"max_{r}") for r in GRIDS])


def judged(docs: DataFrame, quality: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The features of every document and `kept`."""
    rows = stored(features(docs))
    cuts = stored(cutoffs(rows, quality, alpha, delta)).withColumnRenamed("stratum", "c_stratum")
    small = cuts.count() <= MOST_STRATA
    joined = rows.join(F.broadcast(cuts) if small else cuts, F.col("stratum") == F.col("c_stratum"), "left")
    rejected = F.lit(False)
    for r in GRIDS:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), labels(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    a, m = ALPHA / len(GRIDS), len(GRIDS)
    tests = ", ".join(f"('{r}', CAST({c} AS DOUBLE))" for r, g in GRIDS.items() for c in g)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in GRIDS) + " END"
    tail = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln(1 - {a}))))"
    over = " OR ".join(f"coalesce({r} > (SELECT min(cut) FROM passed WHERE passed.stratum = b.stratum AND rule = '{r}'), false)" for r in GRIDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT u, i, array_to_string(ws[i : i + 4], ' ') AS gram FROM (SELECT u, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT u, i, lead(i) OVER (PARTITION BY u ORDER BY i) AS nxt FROM (SELECT u, i, count(*) OVER (PARTITION BY u, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT u, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n FROM r GROUP BY u),
f AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper, len(ls) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (u)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length FROM f),
held AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
k AS (SELECT stratum, rule, cut, count(*) AS n, count(*) FILTER ({value} > cut) AS k FROM held, (VALUES {tests}) AS c(rule, cut) GROUP BY ALL),
passed AS (SELECT * FROM k WHERE k <= n * {a} AND {tail} <= {DELTA / m} / (SELECT count(DISTINCT stratum) FROM held))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM b
"""


OP5_SQL = _sql()
