"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.joins import split_join
from fieldloom.session import stored


def _pointed(edges: DataFrame, count: int, both_ways: bool) -> DataFrame:
    """One star step: each node's neighbours point at the least of them and the node itself."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.unionByName(flipped) if both_ways else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("least", F.least("least", "a"))
    met = split_join(near, least, "a", "n", 2 * count)
    if both_ways:
        return met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b the least node of each one's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Edges that one task finishes (16 MB); more go through rounds until so few are left or they have settled.
FEW = 1_000_000


def _finished(edges: DataFrame) -> DataFrame:
    """node, component of at most `FEW` edges, in one task instead of a job for each round."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts))
        nodes, place = np.unique(rows[["a", "b"]].to_numpy(np.int64), return_inverse=True)
        ends = place.reshape(-1, 2)
        yield pd.DataFrame({"node": nodes, "component": nodes[least_labels(len(nodes), ends[:, 0], ends[:, 1])]})

    return edges.repartition(1).mapInPandas(run, "node long, component long")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and component (its least node) of every node of an edge (a, b), both long; edges with a = b are ignored.

    Every round is written to the shared folder, so a lost executor costs a round at most. The rounds needed
    grow with the logarithm of the longest path. A hub's edges stay spread: see `split_join`. `FEW` edges take no rounds.
    """
    now = stored(edges.filter("a <> b").select("a", "b").distinct())
    mark = _mark(now)
    for _ in range(most_rounds):
        if 0 < mark[0] <= FEW:
            return stored(_finished(now))
        step = _pointed(now, mark[0], True).filter("a <> b").distinct()
        now = stored(_pointed(step, mark[0], False).filter("a <> b").distinct())
        mark, last = _mark(now), mark
        if mark == last:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError("components didn't settle")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
