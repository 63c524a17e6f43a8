"""What the text operators share: the documents table, the word rule, exact ids, bounded batches and a size-based block count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside these six; fixed by the contracts.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch of whole texts, about.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds (a null id counts as empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % folds


def id_text(column: str = "doc_id") -> Column:
    """The id as decimal text. pandas holds text beside nulls exactly; longs beside nulls would become floats."""
    return F.col(column).cast("long").cast("string").alias(column)


def with_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Ids that went through pandas as text, as longs again."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def bounded(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Arrow batches of this session hold at most about batch_bytes, however long the rows are; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).rstrip("bB")
    if not now.isdigit() or int(now) > batch_bytes:
        spark.conf.set(name, str(batch_bytes))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct named `row`: working columns beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def blocks_for(df: DataFrame, target_bytes: int, column: str = "text") -> int:
    """How many blocks of about target_bytes of text the table fills; one aggregate pass over one column."""
    total = df.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // target_bytes))
