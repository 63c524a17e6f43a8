"""Hard and fuzzy clustering of feature tables (row, col, f1..f5).

Centres are K x 5 numbers, so they travel as literals and distances stay in generated code; each iteration is one
aggregate that returns K rows. The kernels of Ward's and spectral clustering are here, `linkage` runs them on all points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.zones import NAMES, sample

Centres = list[tuple[float, ...]]


def squared_distance(centre: tuple[float, ...], columns: tuple[str, ...] = NAMES) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre, strict=True)])


def nearest_centre(points: DataFrame, centres: Centres) -> DataFrame:
    """Adds label (ties to the lesser) and d2."""
    d = F.array(*[squared_distance(c) for c in centres])
    return points.withColumn("_d", d).withColumn("d2", F.array_min("_d")).withColumn("label", (F.array_position("_d", F.col("d2")) - 1).cast("int")).drop("_d")


def quantile_init(points: DataFrame, k: int) -> Centres:
    """Centre i takes the (i + 1/2)/k quantile of each feature."""
    row = points.agg(*[F.percentile(c, F.array(*[F.lit((i + 0.5) / k) for i in range(k)])).alias(c) for c in NAMES]).first()
    return [tuple(round(row[c][i], 8) for c in NAMES) for i in range(k)]


def tolerance(points: DataFrame, share: float = 1e-4) -> float:
    """The sum of squared moves at which K-means stops: a share of the features' mean variance."""
    total = points.agg(reduce(lambda a, b: a + b, [F.var_pop(c) for c in NAMES]).alias("v")).first()["v"]
    return share * (total or 0.0) / len(NAMES)


def moved(before: Centres, after: Centres) -> float:
    """Sum of the centres' squared moves."""
    return sum((a - b) ** 2 for x, y in zip(before, after, strict=True) for a, b in zip(x, y, strict=True))


def lloyd(points: DataFrame, k: int, iterations: int = 300, init: Centres | None = None) -> Centres:
    """K-means by Lloyd's iterations until the centres' moves are within `tolerance`; an emptied cluster keeps its centre.

    Centres are rounded to 8 places each time.
    """
    centres, enough = init or quantile_init(points, k), tolerance(points)
    for _ in range(iterations):
        rows = nearest_centre(points, centres).groupBy("label").agg(*[F.avg(c).alias(c) for c in NAMES]).collect()  # k rows
        found = {r["label"]: tuple(round(r[c], 8) for c in NAMES) for r in rows}
        before, centres = centres, [found.get(i, c) for i, c in enumerate(centres)]
        if moved(before, centres) <= enough:
            break
    return centres


def mini_batch(points: DataFrame, k: int, batches: int = 10, share: float = 0.1, init: Centres | None = None) -> Centres:
    """Mini-batch K-means: each batch is a hash slice of the points, centres move by their running counts. Ten of a tenth are all points."""
    centres, seen = list(init or quantile_init(points, k)), [0] * k
    slice_ = F.pmod(F.xxhash64("row", "col"), F.lit(max(1, round(1 / share))))
    for b in range(batches):
        part = points.filter(slice_ == b % max(1, round(1 / share)))
        for r in nearest_centre(part, centres).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in NAMES]).collect():
            i, n = r["label"], r["n"]
            seen[i] += n
            centres[i] = tuple(c + (r[f] - c) * n / seen[i] for c, f in zip(centres[i], NAMES, strict=True))
    return centres


def gaussian_mixture(points: DataFrame, k: int, seed: int = 123, once: DataFrame | None = None) -> DataFrame:
    """Adds label by a full-covariance mixture, fitted to all points: once, if known, has the distinct ones with the number `_n` of their rows."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(NAMES), outputCol="_v")
    ready = vectors.transform(points)
    method = GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol="label", probabilityCol="_p")
    model = method.fit(ready) if once is None else method.setWeightCol("_n").fit(vectors.transform(once))
    return model.transform(ready).drop("_v", "_p")


def ward(x: np.ndarray, k: int, size: np.ndarray | None = None) -> np.ndarray:
    """Labels of agglomerative clustering by Ward's criterion (nearest-neighbour chains); size: how many points each row stands for."""
    n = len(x)
    centre, size, alive = x.astype(float).copy(), np.ones(n) if size is None else size.astype(float), np.ones(n, bool)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            d = ((centre - centre[a]) ** 2).sum(1) * size * size[a] / (size + size[a])
            d[~alive] = np.inf
            d[a] = np.inf
            b = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                merges.append((d[b], a, b))
                chain = chain[:-2]
                centre[b] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
                size[b] += size[a]
                alive[a] = False
                break
            chain.append(b)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges)[: n - k]:
        parent[root(a)] = root(b)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def spectral(x: np.ndarray, k: int, neighbours: int = 10, seed: int = 0) -> np.ndarray:
    """Labels by the normalised Laplacian of the symmetric nearest-neighbour graph."""
    near = np.concatenate([np.argsort(((x[at : at + 256, None] - x[None]) ** 2).sum(-1), axis=1, kind="stable")[:, : neighbours + 1] for at in range(0, len(x), 256)])
    return spectral_of(np.repeat(np.arange(len(x)), near.shape[1]), near.ravel(), len(x), k, seed)


#: Nodes of a graph whose eigenvectors are found at once.
DENSE = 1000


def spectral_of(a: np.ndarray, b: np.ndarray, n: int, k: int, seed: int = 0) -> np.ndarray:
    """Labels of the nodes 0..n-1 of a graph, each with an edge to itself; an edge a-b counts half, one that both ends have whole."""
    cells, times = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
    rows, cols = cells // n, cells % n
    scale = 1 / np.sqrt(np.bincount(rows, times / 2, n))
    weight = times / 2 * scale[rows] * scale[cols]
    if n <= DENSE:
        graph = np.zeros((n, n))
        graph[rows, cols] = weight
        vectors = np.linalg.eigh(np.eye(n) - graph)[1][:, :k]
    else:
        vectors = leading(cols, np.searchsorted(rows, np.arange(n)), weight, n, k, seed)
    vectors = vectors * scale[:, None]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    centres = vectors[:1]
    while len(centres) < k:
        centres = np.vstack([centres, vectors[((vectors[:, None] - centres[None]) ** 2).sum(-1).min(1).argmax()]])
    for _ in range(100):
        label = ((vectors[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        moved = np.array([vectors[label == i].mean(0) if (label == i).any() else centres[i] for i in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return label


def leading(cols: np.ndarray, starts: np.ndarray, weight: np.ndarray, n: int, k: int, seed: int = 0, spare: int = 9, degree: int = 40, enough: float = 1e-6, most: int = 100) -> np.ndarray:
    """The eigenvectors of the k greatest eigenvalues of a symmetric matrix with eigenvalues in [-1, 1], given by rows (none empty).

    Subspace iteration: Chebyshev's polynomials damp what lies below the least value of the k + `spare` vectors kept.
    """

    def times(v: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(weight * x[cols], starts) for x in v])

    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, k + spare)))[0].T.copy()
    low = 0.0
    for _ in range(most):
        before, now = v, (2 * times(v) - (low - 1) * v) / (low + 1)
        for _ in range(degree - 1):
            before, now = now, 2 * (2 * times(now) - (low - 1) * now) / (low + 1) - before
            size = np.abs(now).max()  # only ratios count
            before, now = before / size, now / size
        v = np.linalg.qr(now.T)[0].T.copy()
        turned = times(v)
        values, mix = np.linalg.eigh(v @ turned.T)
        mix = mix[:, ::-1].T
        v, turned, values = mix @ v, mix @ turned, values[::-1]
        if np.abs(turned[:k] - values[:k, None] * v[:k]).max() < enough * np.abs(v[:k]).max():
            break
        low = min(max(float(values[-1]), -0.9), 1 - 1e-9)
    return v[:k].T


def memberships(points: DataFrame, centres: Centres, m: float = 2.0) -> DataFrame:
    """Adds u: fuzzy memberships, which sum to 1. A point on a centre belongs to it alone."""
    d = [F.col(f"_d{i}") for i in range(len(centres))]
    each = [F.col(f"_i{i}") for i in range(len(centres))]
    power = 1.0 / (m - 1.0)
    total = reduce(lambda a, b: a + b, each)
    touched = reduce(lambda a, b: a + b, [(x == 0).cast("int") for x in d])
    # one column a centre, so that all stays in generated code
    out = points.withColumns({f"_d{i}": squared_distance(c) for i, c in enumerate(centres)}).withColumn("_on", touched)
    out = out.withColumns({f"_i{i}": F.when(F.col("_on") == 0, F.pow(x, F.lit(-power)) if m != 2.0 else 1.0 / x) for i, x in enumerate(d)})
    u = [F.when(F.col("_on") > 0, F.when(x == 0, 1.0).otherwise(0.0) / F.col("_on")).otherwise(i / total) for x, i in zip(d, each, strict=True)]
    return out.withColumn("u", F.when(F.col("_on").isNotNull(), F.array(*u))).drop("_on", *[f"_{n}{i}" for n in "di" for i in range(len(centres))])


def fuzzy_means(points: DataFrame, k: int, m: float = 2.0, iterations: int = 100, error: float = 0.005, init: Centres | None = None) -> tuple[Centres, int]:
    """Fuzzy C-means centres and the iterations taken; stops when no centre moves by `error`. Centres are rounded to 8 places.

    A point counts `_n` times, if there is such a column."""
    centres = init or quantile_init(points, k)
    for step in range(1, iterations + 1):
        w = [F.pow(F.col("u")[i], F.lit(float(m))) if m != 2.0 else F.col("u")[i] * F.col("u")[i] for i in range(k)]
        w = [x * F.col("_n") for x in w] if "_n" in points.columns else w
        row = memberships(points, centres, m).agg(*[(F.sum(w[i] * F.col(c)) / F.sum(w[i])).alias(f"{c}_{i}") for i in range(k) for c in NAMES]).first()
        after = [tuple(round(row[f"{c}_{i}"], 8) for c in NAMES) for i in range(k)]
        furthest = max(abs(a - b) for x, y in zip(after, centres, strict=True) for a, b in zip(x, y, strict=True))
        centres = after
        if furthest < error:
            return centres, step
    return centres, iterations


def by_first(centres: Centres) -> Centres:
    """Centres in the order of their first feature (the index), so that label i is zone i + 1."""
    return sorted(centres)


def fit_labels(points: DataFrame, method: str, k: int) -> DataFrame:
    """Adds label by the named method, fitted to all points."""
    from fieldloom.operators.linkage import spectral_labels, ward_labels
    from fieldloom.operators.seeding import best_of_starts, distinct, parallel_seeds

    if method in ("ward", "spectral"):
        labels = {"ward": ward_labels, "spectral": spectral_labels}[method](distinct(points), k)
        return points.join(labels, list(NAMES), "left")
    if method == "gmm":
        return gaussian_mixture(points, k, once=distinct(points))
    if method == "fuzzy":
        centres = fuzzy_means(distinct(points), k, init=quantile_init(points, k))[0]
        return memberships(points, centres).withColumn("label", (F.array_position("u", F.array_max("u")) - 1).cast("int")).drop("u")
    fits = {"kmeans": lambda: best_of_starts(points, k), "minibatch": lambda: mini_batch(points, k, init=[tuple(map(float, c)) for c in parallel_seeds(points, k, 1)[0]])}
    return nearest_centre(points, fits[method]()).drop("d2")


METHODS = ("kmeans", "minibatch", "gmm", "ward", "spectral", "fuzzy")


def fit_all(points: DataFrame, k: int, methods: tuple[str, ...] = METHODS) -> dict[str, DataFrame]:
    """Labels by each method; one that fails is left out, none at all is an error. The first that worked is the primary one."""
    out, errors = {}, []
    for name in methods:
        try:
            out[name] = fit_labels(points, name, k)
        except Exception as e:  # a method that can't run on this data mustn't stop the others
            errors.append(f"{name}: {e}")
    if not out:
        raise RuntimeError("no method worked: " + "; ".join(errors))
    return out


def farthest_points(table: DataFrame, x: str, y: str, n: int, pool: int = 5000) -> DataFrame:
    """rank and row, col of n points, each the farthest from those before it; the first is the first in hash order.

    Runs in one task on a pool of at most `pool` rows (the first in hash order).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).reset_index(drop=True)
        if not len(rows):
            return
        xy, picked = rows[["_x", "_y"]].to_numpy(float), [int(rows["_order"].argmin())]
        near = ((xy - xy[picked[0]]) ** 2).sum(1)
        order = np.lexsort((rows["col"], rows["row"]))
        while len(picked) < min(n, len(rows)):
            best = int(order[near[order].argmax()])
            picked.append(best)
            near = np.minimum(near, ((xy - xy[best]) ** 2).sum(1))
        yield rows.loc[picked, ["row", "col"]].assign(rank=range(1, len(picked) + 1))

    from fieldloom.sources.raster import hash_order

    pooled = sample(table, pool).select("row", "col", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), hash_order().alias("_order"))
    return pooled.repartition(1).mapInPandas(run, "row int, col int, rank int")
