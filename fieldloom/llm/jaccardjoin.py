"""Near-duplicate join on the Jaccard similarity of word shingles, with Bayesian candidate pruning.

1. Equal texts become one class (by the 128-bit MD5 of the text); only classes are compared, copies are counted.
2. A class gets ROWS * BANDS MinHash values. Classes that agree in a whole band are candidates; classes that hang
   together by such agreements form a candidate component (edges are stars, linear in a band's members).
3. A component is compared in one task, or, above BLOCK classes or BLOCK_BYTES of text, as pairs of blocks of about that size in
   as many tasks. A candidate pair's MinHash values are compared a few at a time, and the pair is dropped once the posterior
   probability that its similarity reaches the threshold is below TOLERANCE (uniform prior: a binomial tail).
4. What is left is verified exactly on the shingle sets. Links are counted and joined to groups in the task; no table of
   pairs is made. A document's class_id is the least doc_id of its group of linked texts and copies.

With six rows and forty bands a pair at the threshold 0.8 escapes candidate search with probability 5e-6, and
pruning loses less than 1e-5 of such pairs.

Defined cases: null text is the empty text; texts without words are linked to their exact copies only; a text of fewer
words than a shingle has one shingle of all its words; a null id joins its group like any other (a group of null ids
has a null class_id); repeated rows are copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded, documents, id_text, text_of, whole_row, with_ids
from fieldloom.llm.shingles import WORDS, minhash, mixed, shingles
from fieldloom.llm.tokens import forget
from fieldloom.operators.components import components
from fieldloom.operators.joins import split_join
from fieldloom.session import stored

THRESHOLD = 0.8
ROWS, BANDS = 6, 40
#: MinHash values compared between two looks at the posterior, and the probability below which a pair is dropped.
STEP, TOLERANCE = 24, 1e-7
#: Classes in a block of a large component, and bytes of their texts, about.
BLOCK, BLOCK_BYTES = 512, 4 << 20


def text_key() -> Column:
    """The MD5 of the text, null read as empty."""
    return F.unhex(F.md5(F.encode(text_of(), "UTF-8")))


def _signed(k: int, rows: int, bands: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for b in batches:
            again = b["key"].duplicated()  # a copy in the batch needs no signature of its own
            own = b[~again]
            for first, values, offsets in shingles(own["text"].tolist(), k):
                sigs = minhash(values, offsets, rows * bands).astype(np.uint16)
                n = np.diff(offsets)
                part = own.iloc[first : first + len(n)]
                yield pd.DataFrame({"doc_id": part["doc_id"], "key": part["key"], "bytes": [len(t.encode()) for t in part["text"]], "sig": [s.tobytes() if c else b"" for s, c in zip(sigs, n, strict=True)]})
            if len(own) < len(b):
                yield b[again][["doc_id", "key"]].assign(bytes=None, sig=None)

    return run


def classes(docs: DataFrame, k: int = WORDS, rows_: int = ROWS, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, key) of all rows, (classes: cid, key, rep, copies, bytes, sig) one row for each distinct text."""
    bounded(docs.sparkSession)
    rows = docs.select(id_text(), text_of().alias("text"), text_key().alias("key"))
    signed = stored(with_ids(rows.mapInPandas(_signed(k, rows_, bands), "doc_id string, key binary, bytes long, sig binary"), "doc_id"))
    per = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bytes", True).alias("bytes"), F.first("sig", True).alias("sig"))
    return signed.select("doc_id", "key"), stored(per.withColumn("cid", F.monotonically_increasing_id()))


def band_keys(sigs: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    wide = sigs.reshape(len(sigs), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), wide.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r])
    return key


def _banded(rows: int, bands: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                keys = band_keys(np.frombuffer(b"".join(part["sig"]), np.uint16).reshape(len(part), -1), rows, bands)
                yield pd.DataFrame({"band": keys.astype(np.int64).ravel(), "cid": np.repeat(part["cid"].to_numpy(), bands)})

    return run


def candidates(per_class: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """node (a class id) and component of all classes that agree in a band with another."""
    banded = per_class.filter(F.length("sig") > 0).select("cid", "sig").mapInPandas(_banded(rows, bands), "band long, cid long")
    shared = banded.groupBy("band").agg(F.min("cid").alias("least"), F.max("cid").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most").drop("most")
    met = split_join(banded, shared, "band", "n", bands * per_class.count())
    edges = met.filter("cid <> least").select(F.col("cid").alias("a"), F.col("least").alias("b"))
    return stored(components(edges))


def least_matches(threshold: float, tolerance: float, values: int, step: int) -> dict[int, int]:
    """For n compared values, the matches below which P(similarity >= threshold) is under tolerance.

    With a uniform prior and k matches the posterior is Beta(k+1, n-k+1), so that P = P(Bin(n+1, threshold) <= k).
    """
    out = {}
    for n in range(step, values + 1, step):
        tail, k = 0.0, 0
        while True:
            tail += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
            if tail >= tolerance:
                break
            k += 1
        out[n] = k
    return out


LINKS = "cid long, partners long, links long, root long"


def _compared(threshold: float, tolerance: float | None, k: int, rows: int, bands: int):
    """Links inside a unit: all pairs of its one block, or those between its two blocks."""
    floor = least_matches(threshold, tolerance, rows * bands, STEP) if tolerance else {}

    def run(key: tuple, unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values(["side", "cid"]).reset_index(drop=True)
        m, split = len(unit), int((unit["side"] == 0).sum())
        crossed = split < m
        sigs = np.frombuffer(b"".join(unit["sig"]), np.uint16).reshape(m, -1)
        keys = band_keys(sigs, rows, bands)
        cid, copies = unit["cid"].to_numpy(), unit["copies"].to_numpy()
        sets: list[np.ndarray] = []
        for _, values, offsets in shingles(unit["text"].tolist(), k):
            sets += [np.unique(values[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]
        sizes = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        marked = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        partners, links, parent = np.zeros(m, np.int64), np.zeros(m, np.int64), list(range(m))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for p in range(split if crossed else m):
            from_ = split if crossed else p + 1
            q = np.flatnonzero((keys[from_:] == keys[p]).any(axis=1)) + from_
            matches = np.zeros(len(q), np.int64)
            for n, least in floor.items():
                if not len(q):
                    break
                matches += (sigs[q, n - STEP : n] == sigs[p, n - STEP : n]).sum(axis=1)
                q, matches = q[matches >= least], matches[matches >= least]
            if not len(q):
                continue
            marked[ids[begin[p] : begin[p + 1]]] = 1
            both = np.array([marked[ids[begin[j] : begin[j + 1]]].sum() for j in q])
            marked[ids[begin[p] : begin[p + 1]]] = 0
            for j in q[both >= threshold * (sizes[p] + sizes[q] - both) - 1e-9].tolist():
                partners[p] += 1
                partners[j] += 1
                links[p] += copies[j]
                links[j] += copies[p]
                a, b = root(p), root(j)
                parent[max(a, b)] = min(a, b)
        return pd.DataFrame({"cid": cid, "partners": partners, "links": links, "root": [cid[root(i)] for i in range(m)]})

    return run


def grouped(
    docs: DataFrame, threshold: float = THRESHOLD, tolerance: float | None = TOLERANCE, k: int = WORDS, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, key), (groups: key, rep, copies, class_id, lead, partners, links); lead marks one class of each group.

    links counts the documents of other texts that are linked to the class's text, partners those texts.
    """
    members, per_class = classes(docs, k, rows, bands)
    found = candidates(per_class, rows, bands)
    near = stored(per_class.join(found, F.col("cid") == F.col("node")).drop("node"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("bytes") / block_bytes)).alias("blocks")
    sizes = stored(near.groupBy("component").agg(blocks, F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all_bytes")))
    known = sizes.agg(F.sum("n").alias("n"), F.sum(F.col("blocks") * F.col("all_bytes")).alias("bytes")).first()
    met = split_join(near, sizes.drop("all_bytes"), "component", "n", known["n"] or 0).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    # one row of each class brings its text: one whose id is the class's least
    texts = docs.select(F.col("doc_id").cast("long").alias("t_id"), text_key().alias("t_key"), text_of().alias("text"))
    met = met.join(texts, (F.col("key") == F.col("t_key")) & F.col("rep").eqNullSafe(F.col("t_id"))).dropDuplicates(["key", "rep"])
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = met.select("cid", "copies", "sig", "text", "component", "own", other.alias("other")).select(
        "cid", "copies", "sig", "text", "component",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    units = units.repartition(max(1, -(-(known["bytes"] or 0) // block_bytes)), "component", "i", "j")
    linked = stored(units.groupBy("component", "i", "j").applyInPandas(_compared(threshold, tolerance, k, rows, bands), LINKS))
    per = linked.groupBy("cid").agg(F.sum("partners").alias("partners"), F.sum("links").alias("links"))
    joined = components(linked.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    zero = F.lit(0).cast("long")
    all_ = (
        per_class.drop("sig", "bytes")
        .join(per.withColumnRenamed("cid", "p_cid"), F.col("cid") == F.col("p_cid"), "left")
        .join(joined, F.col("cid") == F.col("node"), "left")
        .select("cid", "key", "rep", "copies", F.coalesce("component", "cid").alias("group"), F.coalesce("partners", zero).alias("partners"), F.coalesce("links", zero).alias("links"))
    )
    all_ = stored(all_)
    lead = all_.groupBy("group").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "cid")).alias("lead"), F.count(F.lit(1)).alias("n"))
    groups = split_join(all_, lead, "group", "n", all_.count())
    return members, groups.select("key", "rep", "copies", F.col("lead.rep").alias("class_id"), (F.col("cid") == F.col("lead.cid")).alias("lead"), "partners", "links")


def linked_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links (other documents that reach the threshold, copies included), n_copies of every row."""
    members, groups = grouped(docs, **options)
    groups = groups.select("key", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), F.col("copies").alias("n"))
    return split_join(members, groups, "key", "n", members.count()).select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near duplicates: of each group a row with the least id stays."""
    _, groups = grouped(docs, **options)
    keep = groups.filter("lead").select(F.col("key").alias("keep_key"), F.col("rep").alias("keep_rep"))
    rows = docs.select(whole_row(docs), text_key().alias("key"), F.col("doc_id").cast("long").alias("id"))
    met = rows.join(keep, (F.col("key") == F.col("keep_key")) & F.col("id").eqNullSafe(F.col("keep_rep")))
    return met.dropDuplicates(["key", "id"]).select("row.*")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(documents(spark, sf_dir))
