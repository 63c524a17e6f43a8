"""Token counts from flat token files by a separator scan.

A token file is a run of equal blocks of ids (little-endian, 2 or 4 bytes), one after the other, with nothing but an
end-of-document id between documents: no index, no lengths, and documents lie across block borders. Blocks are scanned on
their own, in any order: a vectorised search finds the separators, which gives the lengths of the documents that
end inside the block, the ids before its first separator and those after its last. A prefix scan over the blocks'
summaries then numbers the documents and adds what earlier blocks hold of each block's first document.

Token files are kept as Parquet rows (file, block, data), so that any store that Spark reads can hold them.

Defined cases: an empty document is a lone separator and counts 1; ids after the last separator of a file (a
cut-off file) are a last document without separator; a file without ids has no documents; null or empty text is
an empty document; a null id, repeated ids and rows are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded, documents, id_text, text_of
from fieldloom.llm.tokens import default_tokenizer, encoder
from fieldloom.session import stored

SEPARATOR = 50256
#: Ids in a block.
BLOCK = 1 << 18
BLOCKS = "file int, block long, data binary"
#: Blocks whose summaries one group of the prefix scan adds up.
SCAN_GROUP = 4096


def _written(tokenizer: str, separator: int, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, file = encoder(tokenizer), TaskContext.get().partitionId()
        end, pending, held, number, doc = np.array([separator], dtype=enc.dtype), [], 0, 0, 0
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                for ids in enc.encode(part["text"].tolist()):
                    pending += [ids, end]
                    held += len(ids) + 1
                if held >= block:
                    flat = np.concatenate(pending)
                    n = len(flat) // block
                    yield pd.DataFrame({"kind": "tokens", "file": file, "block": range(number, number + n), "data": [flat[i * block : (i + 1) * block].tobytes() for i in range(n)], "doc_id": None})
                    pending, held, number = [flat[n * block :]], len(flat) - n * block, number + n
            yield pd.DataFrame({"kind": "order", "file": file, "block": np.arange(doc, doc + len(batch)), "data": None, "doc_id": batch["doc_id"]})
            doc += len(batch)
        if held:
            yield pd.DataFrame({"kind": "tokens", "file": file, "block": [number], "data": [np.concatenate(pending).tobytes()], "doc_id": None})

    return run


def write_tokens(docs: DataFrame, tokenizer: str | None = None, separator: int = SEPARATOR, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Token files of all texts, one for each partition of docs, and the order of the documents in them (file, place, doc_id)."""
    bounded(docs.sparkSession)
    rows = docs.select(id_text(), text_of().alias("text"))
    kinds = "kind string, file int, block long, data binary, doc_id string"
    both = stored(rows.mapInPandas(_written(tokenizer or default_tokenizer(), separator, block), kinds), "kind")
    order = both.filter("kind = 'order'").select("file", F.col("block").alias("place"), F.col("doc_id").cast("long").alias("doc_id"))
    return both.filter("kind = 'tokens'").select("file", "block", "data"), order


FOUND = "file int, block long, ids long, separators long, head long, tail long, lengths array<long>"


def _scanned(separator: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, block, data in zip(batch["file"], batch["block"], batch["data"], strict=True):
                ids = np.frombuffer(data, dtype=f"<u{width}")
                at = np.flatnonzero(ids == separator)
                head, tail = (int(at[0]) + 1, len(ids) - 1 - int(at[-1])) if len(at) else (0, len(ids))
                rows.append((file, block, len(ids), len(at), head, tail, np.diff(at)))
            yield pd.DataFrame(rows, columns=["file", "block", "ids", "separators", "head", "tail", "lengths"])

    return run


def scan(tokens: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """file, place (from 0 in its file), start (ids before it in its file) and n_tokens of each document, its separator included."""
    found = stored(tokens.mapInPandas(_scanned(separator, width), FOUND))
    blocks = found.drop("lengths")
    # prefix scan in two levels: within groups of consecutive blocks, then over the groups of a file
    blocks = blocks.withColumn("group", F.floor(F.col("block") / SCAN_GROUP))
    inner = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    last = F.when(F.col("separators") > 0, F.col("end") - F.col("tail"))  # ids of the group up to its last separator so far
    inside = (
        blocks.withColumn("ids_in", F.coalesce(F.sum("ids").over(inner), zero))
        .withColumn("docs_in", F.coalesce(F.sum("separators").over(inner), zero))
        .withColumn("end", F.col("ids_in") + F.col("ids"))
        .withColumn("open_in", F.max(last).over(inner))
    )
    groups = blocks.groupBy("file", "group").agg(F.sum("ids").alias("g_ids"), F.sum("separators").alias("g_docs"))
    ends = inside.groupBy("file", "group").agg(F.max(last).alias("g_last"))
    groups = groups.join(ends, ["file", "group"])
    groups = groups.withColumn("ids_before", F.coalesce(F.sum("g_ids").over(outer), zero)).withColumn("docs_before", F.coalesce(F.sum("g_docs").over(outer), zero))
    groups = groups.withColumn("open_before", F.coalesce(F.max(F.col("ids_before") + F.col("g_last")).over(outer), zero))
    placed = inside.join(groups, ["file", "group"]).select(
        "file", "block", "ids", "separators", "head", "tail",
        (F.col("ids_before") + F.col("ids_in")).alias("at"), (F.col("docs_before") + F.col("docs_in")).alias("place"),
        F.coalesce(F.col("ids_before") + F.col("open_in"), F.col("open_before")).alias("opened"),
    )
    rows = placed.join(found.select("file", "block", "lengths"), ["file", "block"])
    first = F.struct(F.col("place").alias("place"), F.col("opened").alias("start"), (F.col("at") + F.col("head") - F.col("opened")).alias("n_tokens"))
    heads = rows.filter("separators > 0").select("file", "block", first.alias("d")).select("file", "d.place", "d.start", "d.n_tokens")
    each = rows.filter("separators > 1").select("file", "block", "place", (F.col("at") + F.col("head")).alias("from"), F.posexplode("lengths").alias("k", "n_tokens"))
    within = Window.partitionBy("file", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inner_docs = each.select("file", (F.col("place") + 1 + F.col("k")).alias("place"), (F.col("from") + F.coalesce(F.sum("n_tokens").over(within), zero)).alias("start"), "n_tokens")
    total = rows.groupBy("file").agg(F.sum("ids").alias("n"), F.sum("separators").alias("place"), F.max(F.when(F.col("separators") > 0, F.col("at") + F.col("ids") - F.col("tail"))).alias("last"))
    cut_off = total.select("file", "place", F.coalesce("last", zero).alias("start"), (F.col("n") - F.coalesce("last", zero)).alias("n_tokens")).filter("n_tokens > 0")
    return heads.unionByName(inner_docs).unionByName(cut_off)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens (its separator included) of every document, with its token file and start there."""
    tokens, order = write_tokens(documents(spark, sf_dir))
    return scan(tokens).join(order, ["file", "place"]).select("doc_id", "n_tokens", "file", "start")
