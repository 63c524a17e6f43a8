"""Best-fit packing with certified bin counts.

Documents become pieces of at most `capacity` tokens; pieces are spread over partitions and each partition is
packed by best-fit decreasing. Dual feasible functions give a lower bound on the bins that a partition's
pieces need; where it equals the bins used, the partition is certified. Bins that are full are final. Those with gaps are
exchanged: whole bins of different partitions meet in half as many partitions as before,
where their documents are packed again by best-fit decreasing, and the better of the two packings stays, so no
round uses more sequences than the one before. It ends when the bound for all pieces together certifies the whole, when no
bin has a gap, when one partition has held all that is open, or when a round has saved no sequence.

Defined cases: null or empty text is its end id alone; a document longer than the capacity is cut into
pieces of exactly `capacity` tokens, but for the first, which holds the remainder; repeated ids and rows are documents
of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded, documents, id_text, text_of, with_ids
from fieldloom.llm.tokens import default_tokenizer, encoder
from fieldloom.session import stored

CAPACITY = 1024
#: Pieces a partition holds about in the first round; in a later one at most twice as many as in the one before.
PARTITION_PIECES = 50_000
PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                rows = []
                for doc_id, ids in zip(part["doc_id"], enc.encode(part["text"].tolist()), strict=True):
                    ids = np.append(ids, end_id).astype("<u4")
                    first = len(ids) % capacity or capacity
                    ends = range(first, len(ids) + 1, capacity)
                    begin = 0
                    for k, end in enumerate(ends):
                        rows.append((doc_id, k, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())))
                        begin = end
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    bounded(docs.sparkSession)
    rows = docs.select(id_text(), text_of().alias("text"))
    return with_ids(rows.mapInPandas(_pieces(tokenizer or default_tokenizer(), end_id, capacity), PIECES), "doc_id")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that pieces need at least; counts[n] is the number of pieces of length n.

    The largest of: the volume; the functions that for k <= capacity/2 count pieces over capacity-k as whole,
    those of k..capacity-k at their length and the rest as nothing; and the rounding functions floor((k+1)x/c)/k.
    """
    n = np.arange(capacity + 1)
    volume = counts * n
    best = -(-int(volume.sum()) // capacity)
    whole, inner = np.cumsum(counts[::-1])[::-1], np.cumsum(volume)
    for k in range(1, capacity // 2 + 1):
        mid = int(inner[capacity - k] - inner[k - 1])
        above = int(whole[capacity - k + 1])
        best = max(best, above + -(-mid // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * n
        exact = scaled % capacity == 0
        best = max(best, -(-int((counts * np.where(exact, n * k, scaled // capacity * capacity)).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each length, and the space left in each bin.

    Open bins stand in stacks by the space they have left; one bit for each stack finds the tightest that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, left = 0, []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = stacks[space].pop()
            if not stacks[space]:
                open_ &= ~(1 << space)
        else:
            b, space = len(left), capacity
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        left[b] = rest = space - n
        if rest:
            stacks[rest].append(b)
            open_ |= 1 << rest
    return bins, offsets, np.array(left, np.int64)


#: What a round works on: the piece's number and length, its sequence so far and its place there.
OPEN = "row long, length long, sequence_id long, offset long"
PACKED = OPEN + ", certified boolean, full boolean"


def _pack(capacity: int, round_: int):
    """A partition's pieces packed anew, or as they were if that takes no fewer sequences."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True])
        lengths = rows["length"].to_numpy()
        bins, offsets, left = best_fit(lengths, capacity)
        was = rows["sequence_id"].nunique() if round_ else len(rows) + 1
        # numbers: round, partition and bin; a partition has fewer bins than pieces, far below 2**28
        new = rows.assign(sequence_id=(round_ << 58) + (int(key[0]) << 28) + bins, offset=offsets, full=left[bins] == 0)
        if round_ and len(left) >= was:
            held = rows.groupby("sequence_id")["length"].transform("sum")
            new = rows.assign(full=held == capacity)
        used = min(was, len(left))
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return new.assign(certified=bound == used)[[c.split()[0] for c in PACKED.split(", ")]]

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset. items: the columns of PIECES. rounds: at most so many, if given."""
    items = stored(items.withColumn("row", F.monotonically_increasing_id()))  # tells repeated rows apart
    groups = max(1, -(-items.count() // partition_pieces))
    start = items.select("row", "length", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = start.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
    least, settled, done, before = bound_for(items, capacity), 0, None, None
    for k in count():
        packed = stored(rest.groupBy("part").applyInPandas(_pack(capacity, k), PACKED))
        bins = packed.groupBy("full").agg(F.count_distinct("sequence_id").alias("bins"), F.count(F.lit(1)).alias("n"))
        per = {r["full"]: (r["bins"], r["n"]) for r in bins.toLocalIterator()}  # two rows at most
        (full, _), (gaps, n) = per.get(True, (0, 0)), per.get(False, (0, 0))
        used = settled + full + gaps
        last = not n or groups == 1 or used in (least, before) or k + 1 == rounds
        before = used
        settled += full
        kept = (packed if last else packed.filter("full")).select("row", "sequence_id", "offset", "certified")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        groups = min(-(-groups // 2), max(1, -(-n // partition_pieces)))
        rest = packed.filter(~F.col("full")).select(*[c.split()[0] for c in OPEN.split(", ")]).withColumn("part", F.pmod(F.xxhash64(F.lit(k), "sequence_id"), F.lit(groups)))
    return items.join(done, "row").drop("row")


def bound_for(items: DataFrame, capacity: int = CAPACITY) -> int:
    """The dual feasible lower bound on any packing of all pieces together, from the counts of at most `capacity` lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        counts[r["length"]] = r["n"]
    return lower_bound(counts, capacity)


def bounds(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences used and the lower bound on them."""
    return packed.agg(F.count_distinct("sequence_id").alias("sequences"), F.lit(bound_for(packed, capacity)).cast("long").alias("lower_bound"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir)))
