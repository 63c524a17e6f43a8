"""MinHash fingerprints of whole texts.

A text's word shingles go through COUNT universal hash functions in vectorised numpy; the least value of each, cut
to 16 bits, is the fingerprint (hexadecimal). The share of equal values of two fingerprints estimates the Jaccard
similarity of the texts. `near_duplicates` cuts signatures into bands, joins equal bands in Spark and verifies the
similarity exactly.

For the query every text also meets its successor by ascending doc_id: the rows are range-partitioned and sorted by Spark and each
partition is read as a stream, so no task holds more than a batch. A partition's first and last text come out beside its
results, and the last one meets the first of the next partition in a join of two rows a partition.

Defined cases: null or empty text has the fingerprint of no shingles; two such texts have likeness 1; a text of fewer
words than a shingle has one shingle of all its words; a null id sorts first, rows of equal id by the MD5 of their text; the
only document of a table is its own successor; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import blocks_for, bounded, documents, id_text, text_of, with_ids
from fieldloom.llm.jaccardjoin import linked_documents
from fieldloom.llm.shingles import WORDS, minhash, shingles
from fieldloom.session import stored

#: Hash functions; BANDS bands of as many values each are joined in `near_duplicates`.
COUNT, BANDS = 128, 32
#: Bytes of text in a range of ids, about, and ranges at most.
RANGE_BYTES, MOST_RANGES = 6 << 20, 20_000


def signatures(texts: list[str], count: int = COUNT, k: int = WORDS) -> np.ndarray:
    """uint16 [texts, count]."""
    out = [minhash(values, offsets, count).astype(">u2") for _, values, offsets in shingles(texts, k)]
    return np.concatenate(out) if out else np.zeros((0, count), ">u2")


def fingerprints(docs: DataFrame, count: int = COUNT, k: int = WORDS) -> DataFrame:
    """doc_id and fingerprint of every row, one pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [s.tobytes().hex() for s in signatures(b["text"].tolist(), count, k)]})

    bounded(docs.sparkSession)
    return with_ids(docs.select(id_text(), text_of().alias("text")).mapInPandas(run, "doc_id string, fingerprint string"), "doc_id")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: bands of these fingerprints joined in Spark, each pair that they give verified exactly.

    With 32 bands of four values a pair at similarity 0.8 escapes with probability 5e-8.
    """
    return linked_documents(docs, threshold=threshold, tolerance=None, rows=COUNT // BANDS, bands=BANDS)


#: Kinds of rows: a result, a partition's first text, and its last one, which waits for its successor.
RESULT, FIRST, LAST = 0, 1, 2
LIKENESS = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list[str | None], texts: list[str], follow: list[str]) -> pd.DataFrame:
    """The columns of LIKENESS for texts and their successors."""
    halves = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + nxt[:h] for t, nxt, h in zip(texts, follow, halves, strict=True)]
    chained = follow[:-1] == texts[1:]
    sig = signatures([*texts, follow[-1]] if chained else texts)
    after = sig[1:] if chained else signatures(follow)
    sig, edited_sig = sig[: len(texts)], signatures(edited)
    return pd.DataFrame({
        "doc_id": ids, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [s.tobytes().hex() for s in sig], "edited_fingerprint": [s.tobytes().hex() for s in edited_sig],
        "near_edited": (sig == edited_sig).mean(axis=1), "near_next": (sig == after).mean(axis=1),
    })


NAMES = [c.split()[0] for c in LIKENESS.split(", ")]


def _end(kind: int, part: int, text: str, doc_id: str | None = None) -> pd.DataFrame:
    return pd.DataFrame({"kind": [kind], "part": [part], "text": [text], **{c: [None] for c in NAMES}, "doc_id": [doc_id]})


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted partition: the results of all rows but the last, which comes out as it is, as the first one does."""
    part, last = TaskContext.get().partitionId(), None
    for b in batches:
        ids, texts = b["doc_id"].tolist(), b["text"].tolist()
        if not texts:
            continue
        if last is None:
            yield _end(FIRST, part, texts[0])
        else:
            ids, texts = [last[0], *ids], [last[1], *texts]
        last = ids[-1], texts[-1]
        if len(texts) > 1:
            yield _compared(ids[:-1], texts[:-1], texts[1:]).assign(kind=RESULT, part=part, text=None)
    if last is not None:
        yield _end(LAST, part, last[1], last[0])


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            yield _compared(b["doc_id"].tolist(), b["text"].tolist(), b["follow"].tolist())


def edited_likeness(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The columns of LIKENESS for every row: the text against its half-replaced edit and against the next document."""
    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).withColumn("tie", F.md5("text"))
    ranges = min(MOST_RANGES, blocks_for(rows, range_bytes))
    order = [F.col("id").asc_nulls_first(), F.col("tie").asc()]
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(id_text("id").alias("doc_id"), "text")
    out = stored(ranged.mapInPandas(_streamed, "kind int, part int, text string, " + LIKENESS))
    # every partition that has rows has one FIRST and one LAST row; after the last partition comes the first
    firsts, lasts = out.filter(F.col("kind") == FIRST), out.filter(F.col("kind") == LAST).select("part", "doc_id", "text")
    around = Window.orderBy("part")  # one number a partition
    after = firsts.select("part").withColumn("next", F.coalesce(F.lead("part").over(around), F.first("part").over(around)))
    met = lasts.join(after, "part").join(firsts.select(F.col("part").alias("next"), F.col("text").alias("follow")), "next")
    ends = met.select("doc_id", "text", "follow").mapInPandas(_met, LIKENESS)
    return with_ids(out.filter(F.col("kind") == RESULT).select(*NAMES).unionByName(ends), "doc_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(documents(spark, sf_dir))
