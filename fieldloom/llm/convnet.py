"""A byte-level convolutional network in numpy that scores the quality of whole texts.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over the
embedded bytes of a chunk and are max-pooled; a chunk's pooled activations are averaged over all chunks
and a logistic unit turns them into one probability. Everything is trained here by Adam, in one task, on the whole texts of a
bounded sample of labelled documents: the first SAMPLE of each class in the order of a hash of the id, as many as fit in half
of SAMPLE_BYTES for each class. A text of more than a quarter of a class's bytes isn't learnt from; it doesn't keep others out.

Defined cases: null or empty text is one chunk of padding and gets a score; labels null or repeated: a document with
any label 1 counts as good, one without label isn't learnt from; with labels of one class or none the score is the
share of good ones (1 without labels); a null id belongs to the fold of the empty text; repeated rows are scored
alike, and of rows with one id the least text is learnt from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from fieldloom.llm.common import bounded, documents, fold, labels, text_of, whole_row
from fieldloom.llm.tokens import forget
from fieldloom.session import stored

CHUNK, STEP = 256, 224
WIDTH, STRIDE, DIM, FILTERS = 12, 2, 6, 32
#: Labelled documents of each class that are learnt from, at most, and bytes of all their texts, at most.
SAMPLE, SAMPLE_BYTES = 1500, 64 << 20
#: Chunks that are trained on at once.
SLICE = 512
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: A clean document that is lost counts as much as this many junk ones that stay.
GOOD_WEIGHT = 4
FOLDS, HELD = 4, 2
CUTOFF = 0.7


def chunks_of(data: bytes) -> np.ndarray:
    """Overlapping chunks that cover data, padded with zero bytes."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Net:
        f = np.float32
        return cls(
            rng.normal(0, 0.5, (256, DIM)).astype(f), rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(f),
            np.zeros(FILTERS, f), rng.normal(0, 0.1, FILTERS).astype(f), np.zeros(1, f),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled, rectified activations of each chunk and the windows they come from."""
        x = self.embed[chunks].reshape(len(chunks), CHUNK * DIM)
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]
        n, w = windows.shape[:2]
        act = (np.ascontiguousarray(windows).reshape(n * w, -1) @ self.filters).reshape(n, w, FILTERS)
        return np.maximum(act.max(axis=1) + self.bias, 0), act

    def score(self, texts: list[bytes]) -> np.ndarray:
        """A probability for each text, in slices of bounded size."""
        sums, counts = np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
        queue, owners, held = [], [], 0

        def flush() -> None:
            all_chunks, who = np.concatenate(queue), np.repeat(owners, [len(q) for q in queue])
            for at in range(0, len(all_chunks), 256):
                got, _ = self.pooled(all_chunks[at : at + 256])
                np.add.at(sums, who[at : at + 256], got)

        for i, data in enumerate(texts):
            own = chunks_of(data)
            counts[i] = len(own)
            queue.append(own)
            owners.append(i)
            held += len(own)
            if held >= 4096:
                flush()
                queue, owners, held = [], [], 0
        if held:
            flush()
        z = (sums / np.maximum(counts, 1)[:, None]) @ self.out.astype(float) + float(self.out_bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def gradients(net: Net, texts: list[bytes], good: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted mean log loss over whole texts, for the parts of the net; chunks are taken SLICE at a time."""
    own = [chunks_of(t) for t in texts]
    n = np.array([len(c) for c in own])
    chunks, doc = np.concatenate(own), np.repeat(np.arange(len(own)), n)
    slices = [slice(at, at + SLICE) for at in range(0, len(chunks), SLICE)]
    kept, mean = None, np.zeros((len(texts), FILTERS), np.float32)
    for part in slices:
        kept = net.pooled(chunks[part])
        np.add.at(mean, doc[part], kept[0])
    mean /= n[:, None]
    p = 1 / (1 + np.exp(-np.clip(mean @ net.out + net.out_bias[0], -30, 30)))
    dz = ((p - good) * weight / len(texts)).astype(np.float32)
    d_embed, d_filters, d_bias = np.zeros_like(net.embed), np.zeros_like(net.filters), np.zeros_like(net.bias)
    for part in slices:
        pooled, act = kept if len(slices) == 1 else net.pooled(chunks[part])
        d_pooled = (dz / n)[doc[part]][:, None] * net.out * (pooled > 0)
        best = act.argmax(axis=1) * STRIDE  # only the winning window of a filter learns
        byte = chunks[part][np.arange(len(pooled))[:, None, None], best[:, :, None] + np.arange(WIDTH)]
        d_filters += np.einsum("cfk,cf->kf", net.embed[byte].reshape(len(pooled), FILTERS, -1), d_pooled)
        spread = d_pooled[:, :, None, None] * net.filters.T.reshape(FILTERS, WIDTH, DIM)[None]
        for k in range(DIM):
            d_embed[:, k] += np.bincount(byte.ravel(), spread[..., k].ravel(), 256)
        d_bias += d_pooled.sum(0)
    return [d_embed, d_filters, d_bias, mean.T @ dz, dz.sum(keepdims=True)]


def trained(texts: list[bytes], good: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Net:
    """Fit on whole texts and their labels (0 or 1), the classes weighted GOOD_WEIGHT to 1."""
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng)
    share = {1: GOOD_WEIGHT / max(1, good.sum()), 0: 1 / max(1, (1 - good).sum())}
    weight = np.where(good == 1, share[1], share[0]) * len(good) / (1 + GOOD_WEIGHT)
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = RATE * (0.5 ** (epoch / 2))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            step += 1
            for x, g, a, b in zip(net.parts(), gradients(net, [texts[i] for i in pick], good[pick], weight[pick]), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, quality: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Net | float:
    """Learn from labelled documents outside the held-out fold; a plain share where there is nothing to tell apart."""
    known = quality.filter((fold("doc_id", FOLDS) != HELD) & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("good"))
    # the sample: the first of each class in the order of a hash of the id
    key = F.xxhash64("l_id")
    picks = [known.filter(F.col("good") == g).orderBy(key, "l_id").limit(sample) for g in (0, 1)]
    chosen = picks[0].unionByName(picks[1])
    met = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # at most 2 * sample rows
    per = stored(met.groupBy("l_id").agg(F.first("good").cast("int").alias("good"), F.min("text").alias("text")))
    # at most sample rows a class: in the order of a hash, as many as fit beside each other
    most = sample_bytes // 2
    order = per.select("l_id", "good", F.octet_length("text").alias("bytes")).filter(F.col("bytes") <= most // 4)
    order = order.withColumn("held", F.sum("bytes").over(Window.partitionBy("good").orderBy(key, "l_id")))
    rows = per.join(F.broadcast(order.filter(F.col("held") <= most).select("l_id")), "l_id")
    learnt = rows.select("good", "text").groupBy().applyInPandas(_learnt, "share double, net binary").first()  # the bounded sample, in one task
    if learnt is None:
        return 1.0
    return learnt["share"] if learnt["net"] is None else Net(*np.load(io.BytesIO(learnt["net"])).values())


def _learnt(sample: pd.DataFrame) -> pd.DataFrame:
    """The share of good texts of the sample, and the net's arrays unless its labels are all alike."""
    got = sorted((int(g), t.encode()) for g, t in zip(sample["good"], sample["text"], strict=True))
    good = np.array([g for g, _ in got], np.float32)
    held = None
    if good.min() != good.max():
        held = io.BytesIO()
        np.savez(held, *trained([t for _, t in got], good).parts())
    return pd.DataFrame({"share": [float(good.mean())], "net": [held and held.getvalue()]})


def with_score(docs: DataFrame, net: Net | float, name: str = "score") -> DataFrame:
    """docs with the probability (0 to 1) of every whole text in the column `name`."""
    if not isinstance(net, Net):
        return docs.withColumn(name, F.lit(float(net)))

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        forget()
        return pd.Series(net.score([t.encode() for t in texts]))

    bounded(docs.sparkSession)
    return docs.withColumn(name, score(text_of()))


def accepted(docs: DataFrame, quality: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    rows = docs.select(whole_row(docs), "text")
    return with_score(rows, fit(docs, quality)).filter(F.col("score") >= cutoff).select("row.*")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = with_score(docs.select("doc_id", "text"), fit(docs, labels(spark, sf_dir)))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
