"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are sorted by key in ranges of the
key space, prefix sums of their sizes run range by range, and the sequence is cut at the source's exact
budget; a budget above the source's size repeats the whole sequence (epochs) before the cut. The document on
the cut is taken in part, so a source's taken words equal its budget.

Nothing is collected and no range holds more than a bounded share of a source: a source with a third of
all rows is spread over as many ranges as its row count asks for.

Defined cases: null or empty text has size 0 and is taken 0 times; a null source is a source of its own,
last in order; a null id counts as the empty text; repeated rows are documents of their own (rows equal in id and text
share a key, and so a range); an empty table gives an empty result; a table whose sizes are all 0 has targets 0. All other columns,
whatever their names, are carried through by `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, documents, text_of, whole_row
from fieldloom.operators.joins import split_join
from fieldloom.session import stored

#: Weights by the source's place in code point order, repeating; fixed by the contract.
WEIGHTS = (5, 2, 1)
#: A target stops at this many times its source's size.
MAX_EPOCHS = 3
#: Rows a range of a source's key space holds on average.
RANGE_ROWS = 20_000
#: The key is a 60-bit number: the first fifteen hexadecimal digits of the MD5 of the id and the text.
KEY_BITS = 60
#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
MOST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_key() -> Column:
    """From the id and the text, so that rows without id don't share one key."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text_of())
    return F.conv(F.substring(F.md5(F.encode(own, "UTF-8")), 1, 15), 16, 10).cast("long")


def source_key() -> Column:
    """The source as a text that is never null and differs for null and empty ones."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: rows, size, weight, target (double) and budget (whole words).

    Water-filling in closed form: with sources sorted by cap/weight, the capped ones are a prefix, so the
    level is found from running sums instead of by repeated resharing. Works on the table of sources only.
    """
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    per = (
        per.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("capped", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
        .withColumn("level_left", F.first(F.when(~F.col("capped"), F.col("left")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("level_open", F.first(F.when(~F.col("capped"), F.col("open")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    share = F.col("level_left") * F.col("weight")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double") / F.col("level_open"))
    budget = F.when(F.col("capped"), F.col("cap")).otherwise(F.floor(F.least(target, F.col("cap").cast("double")))).cast("long")
    return per.select("source", "rows", "source_size", "weight", target.alias("target"), budget.alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs (whole takes) and cut (words of a last partial take)."""
    sized = stored(docs.select("doc_id", "source", word_count(text_of()).alias("size"), hash_key().alias("key")))  # texts are read once
    plan = stored(source_targets(sized, weights, most).withColumn("ranges", F.ceil(F.col("rows") / range_rows).cast("long")))
    # a source's rows meet its plan by split_join: a hot source stays spread
    plan = plan.select(source_key(), "source_size", "target", "budget", "ranges", F.col("rows").alias("n_rows"))
    keyed = split_join(sized.withColumn("source_key", source_key()), plan, "source_key", "n_rows", sized.count()).drop("source_key")
    keyed = keyed.withColumn("range", F.floor(F.col("key") / (F.lit(float(1 << KEY_BITS)) / F.col("ranges"))).cast("long"))
    at = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size")).select(
        F.col("source").alias("s_source"), F.col("range").alias("s_range"),
        F.coalesce(F.sum("range_size").over(at), F.lit(0)).alias("range_start"),
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner_start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range"))
    )
    some = F.col("source_size") > 0
    epochs = F.when(some, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("range_start") - F.col("inner_start"))).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("cut", cut)
    return placed.select(
        "doc_id", "source", "key", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("cut")).cast("long").alias("taken"), "epochs", "cut",
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself with the columns of docs: a row per whole take, and one with the first `cut` words for a partial take.

    A source's cut is one place in the order of its keys, so the texts needn't move: each row is held against
    its source's cut. Rows that equal the document on the cut in id and size are all taken as that one is.
    """
    taken = mix(docs, **options)
    last = F.max(F.when(F.col("cut") > 0, F.struct("key", "size", "cut")))
    cuts = stored(taken.groupBy(F.col("source").alias("c_source")).agg(F.max("epochs").alias("epochs"), last.alias("last")))
    small = cuts.count() <= MOST_SOURCES
    rows = docs.select(whole_row(docs), "source", "text", word_count(text_of()).alias("size"), hash_key().alias("key"))
    rows = rows.join(F.broadcast(cuts) if small else cuts, F.col("source").eqNullSafe(F.col("c_source")))
    own, at = F.struct("key", "size"), F.struct(F.col("last.key").alias("key"), F.col("last.size").alias("size"))
    on_cut = F.coalesce(own == at, F.lit(False))
    inside = F.coalesce(own < at, F.lit(False)) | on_cut & (F.col("last.cut") == F.col("size"))
    none = F.array().cast("array<bigint>")
    whole = F.array_repeat(F.lit(0).cast("long"), (F.col("epochs") + inside.cast("long")).cast("int"))
    takes = F.concat(whole, F.when(on_cut & ~inside, F.array("last.cut")).otherwise(none))
    rows = rows.withColumn("take", F.explode(F.when(F.col("size") > 0, takes)))
    # each piece is a word with the white space before it, so the first pieces are the text up to a word's end
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(pieces, 1, F.col("take").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("take") > 0, head).otherwise(F.col("text")))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("take") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight
      FROM s GROUP BY source),
q AS (SELECT *, 3 * source_size AS cap,
        CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
        CAST(sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_open FROM p),
l AS (SELECT arg_min(rest, rest) AS lr, arg_min(w_open, rest) AS lw FROM
        (SELECT rest, w_open FROM q WHERE cap * w_open > rest * weight ORDER BY 3.0 * cap / weight, source NULLS LAST LIMIT 1)),
t AS (SELECT source, source_size, CASE WHEN cap * w_open <= rest * weight THEN CAST(cap AS DOUBLE) ELSE CAST(lr * weight AS DOUBLE) / lw END AS target FROM q LEFT JOIN l ON true),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM t),
d AS (SELECT s.*, b.source_size, b.target, b.budget,
        CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
      FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - begins)) END AS BIGINT) AS taken
FROM d
"""
