"""Source divergence audit: how far the term distributions of a language's sources lie apart, from an inverted index.

1. Terms are counted in tasks (bytes translated and split, one slice at a time) and sent pre-added, with the number of
   their documents; a language keeps the terms of at least LEAST_DOCS documents.
2. With N the group's count over kept terms and V their number, a count c has the smoothed share
   p = 1 + floor(SCALE * (c + PRIOR) / (N + PRIOR * V)), in whole numbers.
3. Pairs: all V terms of a pair of sources start at the shares z and z' of count zero, V * |z - z'|. Only postings (counts
   above zero) correct that. What a source's own postings add against z' alone is a function of z' and the source's
   histogram of shares: a running sum over both in order gives it for all other sources at once. A term that both
   sources hold emits what is left, |p - p'| - |p - z'| - |p' - z| + |z - z'|, if that isn't zero. So a pair costs its
   common terms, and terms that one or none of the two hold cost nothing.
4. Terms: postings above the language's own share are ranked by window, and the first MOST_TERMS of a group stay.

Defined cases: null text, lang and source count as empty text; a group without terms has only zero counts; a language without kept
terms has values of 0 and no term rows; a language with one source has no pair rows; repeated rows are documents of
their own; doc_id isn't read; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded, documents, text_of
from fieldloom.operators.joins import split_join
from fieldloom.session import stored

LEAST_DOCS, PRIOR, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Distinct terms that a task holds before it sends them on, and bytes of text that it splits at once.
HELD_TERMS, SLICE = 200_000, 1 << 20

#: Letters and all bytes beyond ASCII make terms; capital letters become small; other bytes divide.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, by slices."""
    raw = text.encode().translate(_FOLD)
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            cut = raw.rfind(b" ", at, end)
            end = cut if cut > at else (raw.find(b" ", end) % (len(raw) + 1))
        yield raw[at:end].split()
        at = end


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sent() -> pd.DataFrame:
        rows = [(lang, source, t.decode(), n, docs[t]) for (lang, source), (all_, docs) in counts.items() for t, n in all_.items()]
        rows += [(lang, source, "", 0, 0) for lang, source in counts]  # the group itself, also without terms
        counts.clear()
        return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            all_, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for terms in terms_of(text):
                all_.update(terms)
                own.update(terms)
            docs.update(own)
            if len(text) >= SLICE and sum(len(c) for c, _ in counts.values()) > HELD_TERMS:
                yield sent()
        if sum(len(c) for c, _ in counts.values()) > HELD_TERMS:
            yield sent()
    if counts:
        yield sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it); the term '' has n 0 and stands for the group."""
    bounded(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(empty("lang"), empty("source"), text_of().alias("text")).mapInPandas(_counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count, in whole numbers; decimals, as SCALE times a count exceeds a long from nine thousand million on."""
    wide = lambda c: c.cast("decimal(19,0)")
    scaled = F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR)
    over = wide(total + PRIOR * terms)
    return F.lit(1).cast("long") + F.call_function("div", scaled, over).cast("long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the parts `pair` and `term`."""
    counted = stored(term_counts(docs))
    each = Window.partitionBy("lang", "term")
    kept = counted.filter("term <> ''").withColumns({"l_docs": F.sum("docs").over(each), "l_n": F.sum("n").over(each)})
    kept = stored(kept.filter(F.col("l_docs") >= least_docs).select("lang", "source", "term", "n", "l_n"))

    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("l_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("postings"))
    groups = counted.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "postings", "v", "l_total")}
    groups = groups.withColumns(zero).withColumn("z", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(0))
    groups = stored(groups)

    table = groups.select("lang", "source", "total", "v", "l_total", "z", F.col("postings").alias("n_met"))
    posted = split_join(kept, table, ["lang", "source"], "n_met", kept.count())
    posted = stored(posted.select("lang", "source", "term", "z", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("l_n"), F.col("l_total"), F.col("v")).alias("q")))
    return pairs(groups, posted).unionByName(distinctive(posted, most_terms))


def pairs(groups: DataFrame, posted: DataFrame) -> DataFrame:
    """All pairs of sources of a language, which is the result's own size: both directions of each."""
    a = groups.select("lang", "source", "z", "v", "postings")
    b = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    both = stored(a.join(b, "lang").filter(F.col("source") != F.col("item")))
    # one-sided: sum over the source's postings of |p - y| - |z - y|, from running counts and sums of p up to y
    marks = posted.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * F.col("p")).alias("s")).withColumn("item", F.lit(None).cast("string"))
    asked = both.filter("postings > 0").select("lang", "source", F.col("y").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), "item")
    whole = Window.partitionBy("lang", "source")
    upto = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ran = marks.select(asked.columns).unionByName(asked).withColumns({"n_all": F.sum("n").over(whole), "s_all": F.sum("s").over(whole), "n_low": F.sum("n").over(upto), "s_low": F.sum("s").over(upto)})
    far = F.col("s_all") - 2 * F.col("s_low") + F.col("at") * (2 * F.col("n_low") - F.col("n_all"))
    alone = ran.filter("item is not null").select("lang", "source", "item", far.alias("far"))
    base = F.col("v") * F.abs(F.col("z") - F.col("y"))
    one = both.join(alone, ["lang", "source", "item"], "left").select("lang", "source", "item", base.alias("base"), F.coalesce(F.col("far") - F.col("postings") * F.abs(F.col("z") - F.col("y")), F.lit(0)).alias("own"))
    # a pair's own sums meet from both directions; the base counts once
    back = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "own")
    low = lambda x, y: F.least(F.col(x), F.col(y))
    left = posted.select("lang", "term", F.col("source").alias("s1"), F.col("p").alias("p1"), F.col("z").alias("z1"))
    right = posted.select("lang", "term", F.col("source").alias("s2"), F.col("p").alias("p2"), F.col("z").alias("z2"))
    rest = F.abs(F.col("p1") - F.col("p2")) - F.abs(F.col("p1") - F.col("z2")) - F.abs(F.col("p2") - F.col("z1")) + F.abs(F.col("z1") - F.col("z2"))
    common = left.join(right, ["lang", "term"]).filter(F.col("s1") < F.col("s2")).withColumn("rest", rest).filter("rest <> 0").groupBy("lang", "s1", "s2").agg(F.sum("rest").alias("rest"))
    summed = one.select("lang", "source", "item", (F.col("base") + F.col("own")).alias("value")).unionByName(back.select("lang", "source", "item", F.col("own").alias("value")))
    summed = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumns({"s1": low("source", "item"), "s2": F.greatest("source", "item")})
    value = (F.col("value") + F.coalesce("rest", F.lit(0))).cast("long")
    out = summed.join(common, ["lang", "s1", "s2"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def distinctive(posted: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """Each group's terms above the language's share, the first `most` by distance. Spark cuts before it shuffles, too."""
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = posted.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return above.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS u, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT u, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT u) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) USING (lang, source, term)),
m AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v,
  sum(n) OVER (PARTITION BY lang, term) AS l_n, sum(n) OVER (PARTITION BY lang) AS l_total FROM c),
p AS (SELECT lang, source, term, n, CAST(1 + CAST({SCALE} AS HUGEINT) * (n + {PRIOR}) // (total + {PRIOR} * v) AS BIGINT) AS p,
  CAST(1 + CAST({SCALE} AS HUGEINT) * (l_n + {PRIOR}) // (l_total + {PRIOR} * v) AS BIGINT) AS q FROM m),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s1, y.source AS s2, sum(abs(x.p - y.p)) AS s FROM p x JOIN p y USING (lang, term) GROUP BY ALL) f ON f.lang = a.lang AND s1 = a.source AND s2 = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
