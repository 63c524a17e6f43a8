"""Context-tree weighting over bytes: a code length for every text.

Bytes are decomposed into eight binary decisions; each decision has a tree of contexts, the last 0 to DEPTH bytes
before it. A node's counts of zeros and ones give a Krichevsky-Trofimov estimate, and nodes of all depths are mixed: a
node's weighted probability is half its own estimate and half the product of its children's, so the mixture is
exact for the counts of the training texts. A text's score is the log10 probability that the mixture, with these counts
fixed, gives to its bytes and its end; over the bytes' number it is the code length per byte.

How it is spread: texts are dealt into blocks of bounded size; a block sends its distinct byte strings of DEPTH+1
bytes (and its distinct words, for the word base) to buckets that hold all strings with the same last two context bytes,
as sorted arrays. Blocks are joined to groups: for each bucket a group's counts are added up in one task and the groups'
sums in another, which weighs the bucket's subtrees and knows a number for each distinct string; a copy of these numbers goes to each group,
which answers its blocks. So no task reads a bucket's rows from all blocks, and rows are at most MOST_BUCKETS a block. The two levels
above the subtrees are one table of at most 256 * 255 nodes, broadcast. No task sees the whole model, and what is gathered grows with the corpus.

Defined cases: null or empty text is its end alone; texts are compared after A-Z are lower-cased; the fold of a null
id is that of the empty text; repeated ids and rows are texts of their own; with no training text every bit has
probability one half, N is 0 and every token unknown; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import blocks_for, bounded, documents, fold, id_text, text_of, with_ids
from fieldloom.llm.shingles import word_hashes

DEPTH = 5
#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Buckets of strings: one for 64 blocks, but at least and at most so many; and groups of blocks at most.
BUCKETS, MOST_BUCKETS, MOST_GROUPS = 64, 4096, 256
FOLDS, HELD = 7, 2
#: Stands before a text and for its end; never a byte of UTF-8.
EDGE = 0xFF
_END_WORD = np.uint64(0x454E44)


def strings(raw: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and the end of each text: its context, nearest byte first, and the byte itself, in one number; offsets."""
    edge = bytes([EDGE])
    b = np.frombuffer(edge * depth + b"".join(t + edge * (depth + 1) for t in raw), np.uint8).astype(np.uint64)
    n = len(b) - depth
    key = np.zeros(n, np.uint64)
    for d in range(1, depth + 1):
        key = (key << np.uint64(8)) | b[depth - d : depth - d + n]
    key = (key << np.uint64(8)) | b[depth : depth + n]
    sizes = np.array([len(t) + 1 for t in raw], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]]).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)
    return key[place], offsets


def bucket_of(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    two = keys >> np.uint64(8 * (depth - 1))
    return ((two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def _tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words with one end after each text, and their offsets."""
    words, offsets = word_hashes(raw)
    n = len(raw)
    ends = offsets[1:] + np.arange(n)
    out = np.full(len(words) + n, _END_WORD, np.uint64)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = words
    return out, np.concatenate([[0], ends + 1])


def packed(x: np.ndarray) -> bytes:
    """The bytes of an array's numbers by their place, the lowest of all numbers first, so that runs of zeros compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


BLOBS = "bucket int, part int, block long, keys binary, counts binary"


def _counted(depth: int, buckets: int, groups: int):
    """A block's distinct strings and words, by bucket, with their counts in training texts."""

    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        raw = [t.encode().lower() for t in docs["text"]]
        train = (~docs["held_out"]).to_numpy()
        rows = []
        for kind, (flat, offsets) in enumerate((strings(raw, depth), _tokens(raw))):
            learnt = np.repeat(train, np.diff(offsets))
            keys = np.unique(flat)
            known, times = np.unique(flat[learnt], return_counts=True)
            counts = np.zeros(len(keys), np.uint32)
            counts[np.searchsorted(keys, known)] = times
            where = bucket_of(keys, depth, buckets) if kind == 0 else (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(buckets + 1))
            for i in range(buckets):
                own = order[cut[i] : cut[i + 1]]
                if len(own):
                    rows.append((kind * buckets + i, key[0] % groups, key[0], packed_keys(keys[own]), packed(counts[own])))
        return pd.DataFrame(rows, columns=["bucket", "part", "block", "keys", "counts"])

    return run


_HALVES = np.array([math.lgamma(n + 0.5) for n in range(64)])
_WHOLES = np.array([0.0] + [math.lgamma(n) for n in range(1, 66)])


def _log_gamma(z: np.ndarray, table: np.ndarray, index: np.ndarray) -> np.ndarray:
    small = index < len(table)
    big = np.where(small, 64.0, z)
    series = (big - 0.5) * np.log(big) - big + 0.9189385332046727 + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(small, table[np.minimum(index, len(table) - 1)], series)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    ia, ib = a.astype(np.int64), b.astype(np.int64)
    n = ia + ib + 1
    return _log_gamma(a + 0.5, _HALVES, ia) + _log_gamma(b + 0.5, _HALVES, ib) - _log_gamma(n.astype(float), _WHOLES, n) - math.log(math.pi)


def weighted(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's log weighted probability and the posterior weight of its own estimate."""
    total = np.logaddexp(own, below) - math.log(2)
    return total, np.exp(own - math.log(2) - total)


class Subtrees:
    """The nodes of depths 2 to `depth` under one bucket's contexts; keys sorted, counts of training texts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, least: int = 2) -> None:
        x = (keys & np.uint64(255)).astype(np.int64)
        level = np.arange(8)
        self.heap = ((1 << level) | (x[:, None] >> (8 - level))).ravel().astype(np.uint64)
        self.bit = ((x[:, None] >> (7 - level)) & 1).ravel()
        n = np.repeat(counts.astype(np.float64), 8)
        context = np.repeat(keys >> np.uint64(8), 8)
        self.levels = []
        below = None
        for d in range(depth, least - 1, -1):
            node, inverse = np.unique(((context >> np.uint64(8 * (depth - d))) << np.uint64(8)) | self.heap, return_inverse=True)
            ones = np.bincount(inverse, n * self.bit, len(node))
            zeros = np.bincount(inverse, n, len(node)) - ones
            own = log_kt(zeros, ones)
            if below is None:
                total, weight = own, np.ones(len(node))
            else:
                deeper, value = below
                up = ((deeper >> np.uint64(16)) << np.uint64(8)) | (deeper & np.uint64(255))
                sums = np.bincount(np.searchsorted(node, up), value, len(node))
                total, weight = weighted(own, sums)
            self.levels.append((inverse, zeros, ones, weight))
            below = (node, total)
        self.nodes, self.total = below
        self.zeros, self.ones = zeros, ones

    def bits(self) -> np.ndarray:
        """The mixed probability of each string's eight bits, over depths `least` to `depth`."""
        p = None
        for inverse, zeros, ones, weight in self.levels:
            kt = np.where(self.bit == 1, ones[inverse], zeros[inverse])
            kt = (kt + 0.5) / (zeros[inverse] + ones[inverse] + 1)
            p = kt if p is None else weight[inverse] * kt + (1 - weight[inverse]) * p
        return p


def _merged(rows: pd.DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all rows, ascending, and the sums of their counts."""
    keys, inverse = np.unique(np.concatenate([unpacked_keys(k) for k in rows["keys"]]), return_inverse=True)
    counts = np.concatenate([unpacked(c, kind) for c in rows["counts"]])
    return keys, np.bincount(inverse, counts.astype(float), len(keys)).astype(np.int64)


PARTS = "bucket int, keys binary, counts binary"


def _added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's counts in one group of blocks."""
    keys, counts = _merged(rows, np.uint32)
    return pd.DataFrame({"bucket": [key[0]], "keys": [packed_keys(keys)], "counts": [packed(counts)]})


#: Nodes of the levels of one context byte; the row of context -1 holds a word bucket's tokens and distinct words.
TOP = "context int, node int, zeros double, ones double, below double"


def _tops(depth: int, buckets: int):
    """What the two levels above a bucket's subtrees need of it: a row for each nearest byte and binary node."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows, np.int64)
        if key[0] >= buckets:
            return pd.DataFrame({"context": [-1], "node": [0], "zeros": [float(counts.sum())], "ones": [float((counts > 0).sum())], "below": [0.0]})
        tree = Subtrees(keys, counts, depth)
        seen = tree.zeros + tree.ones > 0
        at = ((tree.nodes >> np.uint64(16)) << np.uint64(8)) | (tree.nodes & np.uint64(255))
        node, inverse = np.unique(at[seen], return_inverse=True)
        sums = [np.bincount(inverse, x[seen], len(node)) for x in (tree.zeros, tree.ones, tree.total)]
        return pd.DataFrame({"context": (node >> np.uint64(8)).astype(int), "node": (node & np.uint64(255)).astype(int), "zeros": sums[0], "ones": sums[1], "below": sums[2]})

    return run


ROOF = "roof binary, tokens long, distinct long"


def _roof(rows: pd.DataFrame) -> pd.DataFrame:
    """One row from at most 256 * 255 nodes: zeros, ones and the weight of the own estimate of each node of depth one, then of depth none."""
    word, node = rows[rows["context"] < 0], rows[rows["context"] >= 0]
    zeros, ones, below = np.zeros((3, 256 * 256))
    i = (node["context"] * 256 + node["node"]).to_numpy()
    zeros[i], ones[i], below[i] = node["zeros"], node["ones"], node["below"]
    total, w1 = weighted(log_kt(zeros, ones), below)
    z0, o0 = zeros.reshape(256, 256).sum(0), ones.reshape(256, 256).sum(0)
    _, w0 = weighted(log_kt(z0, o0), total.reshape(256, 256).sum(0))
    flat = np.concatenate([zeros, ones, w1, z0, o0, w0])
    return pd.DataFrame({"roof": [flat.tobytes()], "tokens": [int(word["zeros"].sum())], "distinct": [int(word["ones"].sum())]})


VALUES = "bucket int, keys binary, value binary, tokens long, distinct long"


def _valued(depth: int, buckets: int):
    """A number for each distinct string or word of a bucket: its bits' log10 probability, or its count."""

    def run(key: tuple, rows: pd.DataFrame, roof: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[c.split()[0] for c in VALUES.split(", ")])
        keys, counts = _merged(rows, np.int64)
        value = counts
        if key[0] < buckets:
            tree = Subtrees(keys, counts, depth)
            p = tree.bits()
            flat = np.frombuffer(roof["roof"].iloc[0], float)
            one, none = flat[: 3 * 65536].reshape(3, -1), flat[3 * 65536 :].reshape(3, -1)
            heap = tree.heap.astype(np.int64)
            near = np.repeat((keys >> np.uint64(8 * depth)).astype(np.int64), 8) * 256 + heap
            for (z, o, w), i in ((one, near), (none, heap)):
                kt = (np.where(tree.bit == 1, o[i], z[i]) + 0.5) / (z[i] + o[i] + 1)
                p = w[i] * kt + (1 - w[i]) * p
            value = np.log10(p).reshape(-1, 8).sum(1).astype(np.float32)
        return pd.DataFrame({"bucket": [key[0]], "keys": [packed_keys(keys)], "value": [value.tobytes()], "tokens": [roof["tokens"].iloc[0]], "distinct": [roof["distinct"].iloc[0]]})

    return run


ANSWERS = "bucket int, block long, value binary, tokens long, distinct long"


def _answered(buckets: int):
    """The numbers of a group's blocks, in the order of their own strings."""

    def run(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["bucket", "block", "value", "tokens", "distinct"])
        keys, value = unpacked_keys(known["keys"].iloc[0]), np.frombuffer(known["value"].iloc[0], np.float32 if key[0] < buckets else np.int64)
        each = [value[np.searchsorted(keys, unpacked_keys(k))].tobytes() for k in rows["keys"]]
        return pd.DataFrame({"bucket": key[0], "block": rows["block"], "value": each, "tokens": known["tokens"].iloc[0], "distinct": known["distinct"].iloc[0]})

    return run


SCORES = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _scored(depth: int, buckets: int):
    def run(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=[c.split()[0] for c in SCORES.split(", ")])
        raw = [t.encode().lower() for t in docs["text"]]
        answers = answers.sort_values("bucket")
        word_rows = answers["bucket"].to_numpy() >= buckets
        n, v = int(answers["tokens"].iloc[0]), int(answers["distinct"].iloc[0])
        out = {"doc_id": docs["doc_id"], "held_out": docs["held_out"], "train_tokens": n, "n_bytes": [len(t) for t in raw]}
        for kind, (flat, offsets) in enumerate((strings(raw, depth), _tokens(raw))):
            keys, inverse = np.unique(flat, return_inverse=True)
            where = bucket_of(keys, depth, buckets) if kind == 0 else (keys % np.uint64(buckets)).astype(np.int64)
            own = answers["value"][word_rows == bool(kind)]
            value = np.empty(len(keys), np.float64)
            value[np.argsort(where, kind="stable")] = np.frombuffer(b"".join(own), np.float32 if kind == 0 else np.int64)
            each = value[inverse]
            if kind == 0:
                out["score"] = np.add.reduceat(each, offsets[:-1])
            else:
                known = np.add.reduceat((each > 0).astype(np.int64), offsets[:-1])
                out |= {"n_tokens": np.diff(offsets), "n_known": known, "base_score": np.add.reduceat(np.log10(each + 1) - math.log10(n + 1 * (v + 1)), offsets[:-1])}
        return pd.DataFrame(out)[[c.split()[0] for c in SCORES.split(", ")]]

    return run


def score_texts(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """Scores of every text by the mixture that the texts outside the held-out fold give. 2 <= depth <= 7.

    A string's number is kept as a 32-bit float; all terms of a score have one sign, so its relative error stays below 1e-7.
    """
    bounded(docs.sparkSession)
    blocks = blocks_for(docs, block_bytes)
    buckets = buckets or min(MOST_BUCKETS, max(BUCKETS, blocks // 64))
    groups = min(MOST_GROUPS, -(-blocks // buckets))
    rows = docs.select(id_text(), text_of().alias("text"), (fold("doc_id", FOLDS) == HELD).alias("held_out"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    rows = rows.repartition(blocks, "block")  # one exchange of the texts, used for counting and for scoring
    sent = rows.groupBy("block").applyInPandas(_counted(depth, buckets, groups), BLOBS).repartition(max(blocks, 2 * buckets), "bucket", "part")
    parts = sent.groupBy("bucket", "part").applyInPandas(_added, PARTS).repartition(2 * buckets, "bucket")
    tops = parts.groupBy("bucket").applyInPandas(_tops(depth, buckets), TOP).groupBy("context", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    roof = tops.groupBy().applyInPandas(_roof, ROOF)  # one row of 1.6 MB, from at most 256 * 255 nodes
    each = docs.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("bucket")).crossJoin(F.broadcast(roof))
    values = parts.groupBy("bucket").cogroup(each.groupBy("bucket")).applyInPandas(_valued(depth, buckets), VALUES)
    copies = values.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    answers = sent.groupBy("bucket", "part").cogroup(copies.groupBy("bucket", "part")).applyInPandas(_answered(buckets), ANSWERS)
    return with_ids(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_scored(depth, buckets), SCORES), "doc_id")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
