"""Quality of clusterings and zone maps."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import morphology, pairs
from fieldloom.operators.clustering import Centres, squared_distance
from fieldloom.operators.zones import NAMES, sample
from fieldloom.session import stored


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _moments(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in NAMES for n, f in (("mean", F.avg), ("var", F.var_pop))])


def variance_reduction(labelled: DataFrame) -> DataFrame:
    """vri: share of the features' variance that the labels explain, in per cent."""
    total = labelled.agg(_sum([F.var_pop(c) for c in NAMES]).alias("total"), F.count(F.lit(1)).alias("all"))
    within = _moments(labelled).agg(F.sum(F.col("n") * _sum([F.col(f"var_{c}") for c in NAMES])).alias("within"))
    return within.crossJoin(total).select(((1 - F.col("within") / F.col("all") / F.col("total")) * 100).alias("vri"))  # one row each


def calinski_harabasz(labelled: DataFrame) -> DataFrame:
    total = labelled.agg(F.count(F.lit(1)).alias("all"), *[F.avg(c).alias(f"all_{c}") for c in NAMES])
    per = _moments(labelled).crossJoin(F.broadcast(total))  # one row
    between = F.sum(F.col("n") * _sum([F.pow(F.col(f"mean_{c}") - F.col(f"all_{c}"), 2) for c in NAMES]))
    within = F.sum(F.col("n") * _sum([F.col(f"var_{c}") for c in NAMES]))
    return per.agg((between / (F.count(F.lit(1)) - 1) / (within / (F.max("all") - F.count(F.lit(1))))).alias("ch"))


def davies_bouldin(labelled: DataFrame) -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / distance_ij."""
    centre = labelled.groupBy("label").agg(*[F.avg(c).alias(f"c_{c}") for c in NAMES])
    met = labelled.join(F.broadcast(centre), "label")  # a row for each cluster
    spread = met.groupBy("label").agg(F.avg(F.sqrt(_sum([F.pow(F.col(c) - F.col(f"c_{c}"), 2) for c in NAMES]))).alias("s"), *[F.first(f"c_{c}").alias(f"c_{c}") for c in NAMES])
    other = spread.select(*[F.col(c).alias(f"o_{c}") for c in spread.columns])
    pairs = spread.join(other, F.col("label") != F.col("o_label"))  # clusters by clusters
    apart = F.sqrt(_sum([F.pow(F.col(f"c_{c}") - F.col(f"o_c_{c}"), 2) for c in NAMES]))
    return pairs.groupBy("label").agg(F.max((F.col("s") + F.col("o_s")) / apart).alias("r")).agg(F.avg("r").alias("db"))


def inertia(points: DataFrame, centres: Centres) -> DataFrame:
    return points.agg(F.sum(F.array_min(F.array(*[squared_distance(c) for c in centres]))).alias("inertia"))


def silhouette(labelled: DataFrame, most: int | None = None) -> DataFrame:
    """silhouette, n: mean Euclidean silhouette of all points, or of the first `most` in hash order.

    Each distinct point is held against all others by pairs of blocks, with its number of rows; so the work grows with the square of the
    distinct points, and with no more.
    """
    rows = (labelled if most is None else sample(labelled, most)).select("label", *NAMES)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cluster
    ids, total = sorted(sizes), sum(sizes.values())
    if not total:
        return labelled.sparkSession.createDataFrame([(None, 0)], "silhouette double, n long")
    once = rows.groupBy("label", *NAMES).agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.xxhash64("label", *NAMES)).withColumn("label", F.col("label").cast("long"))
    once = stored(once.withColumns({c: F.col(c).cast("double") for c in NAMES}))
    count, every, kinds = once.count(), np.array([sizes[i] for i in ids]), pairs.kinds_of(once)

    def weights(block: pairs.Block) -> np.ndarray:
        return (block["label"][:, None] == np.array(ids)) * block["n"][:, None].astype(float)

    def met(a: pairs.Block, b: pairs.Block | None) -> tuple[bytes, bytes | None]:
        # the sums of distances to each cluster's points in the other block
        other = a if b is None else b
        of_a, of_b, by_a, by_b = [], np.zeros((len(other["n"]), len(ids))), weights(a), weights(other)
        for part in pairs.slices_of(a):
            d = pairs.squares(a, other, NAMES, part)
            np.sqrt(d, out=d)
            of_a.append(d @ by_b)
            if b is not None:
                of_b += d.T @ by_a[part]
        return np.concatenate(of_a).tobytes(), None if b is None else of_b.tobytes()

    def both(block: pairs.Block, told: list[bytes]) -> pa.Table:
        d = np.sum([np.frombuffer(t).reshape(-1, len(ids)) for t in told], axis=0)
        own, i = np.searchsorted(ids, block["label"]), np.arange(len(d))
        near, mean = d[i, own] / np.maximum(every[own] - 1, 1), d / every
        mean[i, own] = np.inf
        other = mean.min(1)
        most = np.maximum(near, other)
        each = np.divide(other - near, most, out=np.zeros(len(d)), where=(every[own] > 1) & (most > 0))
        return pa.table({"s": [float((each * block["n"]).sum())]})

    told = pairs.over_pairs(pairs.packed(once, count, "id"), count, kinds, met, both, "s double")
    return told.agg((F.sum("s") / total).alias("silhouette"), F.lit(total).cast("long").alias("n"))


def balance(zones: DataFrame, k: int) -> DataFrame:
    """balance (least by greatest zone), with empty zones, and entropy in bits, of zones 1..k."""
    per = zones.filter("zone > 0").groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    all_ = zones.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("zone")).join(per, "zone", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return all_.withColumn("p", p).agg((F.min("n") / F.max("n")).alias("balance"), (-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("entropy"))


def zone_parts(zones: DataFrame) -> DataFrame:
    """The runs of the zones' 8-connected components, which `fragmentation` and `compactness` can share if stored."""
    return morphology.label_runs(zones.filter("zone > 0").select("zone", "row", "col"), "zone", diagonal=True)


def _areas(parts: DataFrame) -> DataFrame:
    return parts.groupBy("zone", "component").agg(F.sum(F.col("c1") - F.col("c0") + 1).cast("long").alias("area"))


def fragmentation(zones: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """per_zone: mean over zones of 8-connected components by pixels; per_1000: 4-connected components for 1000 canopy pixels. parts: `zone_parts`, if known."""
    veg = zones.filter("zone > 0").select("zone", "row", "col")
    eight = _areas(zone_parts(zones) if parts is None else parts).groupBy("zone").agg((F.count(F.lit(1)) / F.sum("area")).alias("f")).agg(F.avg("f").alias("per_zone"))
    four = morphology.component_sizes(veg, "zone").agg((1000 * F.count(F.lit(1)) / F.sum("size")).alias("per_1000"))
    return eight.crossJoin(four)  # one row each


#: Rows and columns of a block whose pixels one task looks at, with a rim of their neighbours.
BLOCK = 512


def _by_blocks(zones: DataFrame, reach: int, found: Callable[[np.ndarray, int, int], pd.DataFrame], schema: str) -> DataFrame:
    """found(zones of a block and `reach` pixels round it, row, column of the first) of every block with canopy; 0 is soil or no pixel."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / BLOCK), F.floor((F.col(c) + reach) / BLOCK)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        row, col = [int(b) * BLOCK - reach for b in key]
        flat = np.zeros((BLOCK + 2 * reach, BLOCK + 2 * reach), np.int32)
        flat[rows["row"].to_numpy() - row, rows["col"].to_numpy() - col] = rows["zone"].to_numpy()
        return found(flat, row, col)

    veg = zones.filter("zone > 0").select("row", "col", "zone").withColumn("b_row", span("row")).withColumn("b_col", span("col"))
    return veg.groupBy("b_row", "b_col").applyInPandas(run, schema)


def _moved(flat: np.ndarray, by_row: int, by_col: int) -> np.ndarray:
    """The neighbours, so many rows and columns away, of all but the outermost pixels."""
    return flat[1 + by_row : len(flat) - 1 + by_row, 1 + by_col : len(flat) - 1 + by_col]


#: Weights of border pixels by the pattern of border pixels around them (own 10, sides 2 and corners 10 as set by a 3 x 3 sum).
_STEP, _DIAGONAL = 1.0, 2**0.5
PERIMETER_WEIGHTS = {**dict.fromkeys((5, 7, 15, 17, 25, 27), _STEP), **dict.fromkeys((21, 33), _DIAGONAL), **dict.fromkeys((13, 23), (1 + _DIAGONAL) / 2)}


def compactness(zones: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Mean over zones of the mean over 8-connected components of 4 pi area / perimeter^2 (perimeter by border patterns). parts: `zone_parts`, if known."""
    sides = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    corners = [(a, b) for a in (-1, 1) for b in (-1, 1)]
    weight = np.zeros(1 + 2 * len(sides) + 10 * len(corners) + 1)
    for code, w in PERIMETER_WEIGHTS.items():
        weight[code] = w

    def border_weights(flat: np.ndarray, row: int, col: int) -> pd.DataFrame:
        # neighbours of one zone are of one component
        zone = _moved(flat, 0, 0)
        border = (zone > 0) & ~np.logical_and.reduce([_moved(flat, *d) == zone for d in sides])
        own = _moved(zone, 0, 0)
        code = np.ones(own.shape, np.int64)
        for w, places in ((2, sides), (10, corners)):
            for d in places:
                code += w * (_moved(border, *d) & (_moved(zone, *d) == own))
        each = np.where(_moved(border, 0, 0), weight[code], 0.0)
        r, c = np.nonzero(each)
        return pd.DataFrame({"row": r + row + 2, "col": c + col + 2, "w": each[r, c]})

    parts = stored(zone_parts(zones)) if parts is None else parts
    cells = parts.select("component", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    length = cells.join(_by_blocks(zones, 2, border_weights, "row int, col int, w double"), ["row", "col"]).groupBy("component").agg(F.sum("w").alias("perimeter"))
    per = _areas(parts).join(length, "component")
    return per.groupBy("zone").agg(F.avg(4 * F.pi() * F.col("area") / F.pow("perimeter", F.lit(2))).alias("c")).agg(F.avg("c").alias("compactness"))


def smoothness(zones: DataFrame) -> DataFrame:
    """1 - border pixels / canopy pixels; a pixel is inner if its whole 3 x 3 square is of its zone."""

    def inner_pixels(flat: np.ndarray, row: int, col: int) -> pd.DataFrame:
        own = _moved(flat, 0, 0)
        same = np.logical_and.reduce([_moved(flat, a, b) == own for a in (-1, 0, 1) for b in (-1, 0, 1)])
        return pd.DataFrame({"inner": [int((same & (own > 0)).sum())]})

    inner = _by_blocks(zones, 1, inner_pixels, "inner long").agg(F.coalesce(F.sum("inner"), F.lit(0)).alias("inner"))
    return zones.filter("zone > 0").agg(F.count(F.lit(1)).alias("n")).crossJoin(inner).select((F.col("inner") / F.col("n")).alias("smoothness"))  # one row each


def fuzzy_indices(fuzzy: DataFrame, centres: Centres, uncertain: float = 0.35, transition: float = 0.30, crisp: float = 0.70) -> DataFrame:
    """pc, pe, xb, mean uncertainty, and shares (per cent) of uncertain, transition and crisp pixels."""
    k = len(centres)
    u = [F.col("u")[i] for i in range(k)]
    apart = min(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for i, x in enumerate(centres) for y in centres[:i])
    top, second = F.array_max("u"), F.element_at(F.array_sort("u"), -2)
    return fuzzy.agg(
        F.avg(_sum([x * x for x in u])).alias("pc"), F.avg(-_sum([x * F.log(x + 1e-12) for x in u])).alias("pe"),
        (F.avg(_sum([x * x * squared_distance(c) for x, c in zip(u, centres, strict=True)])) / (apart + 1e-12)).alias("xb"),
        F.avg(1 - top).alias("uncertainty"), (100 * F.avg((1 - top > uncertain).cast("double"))).alias("pct_uncertain"),
        (100 * F.avg((second > transition).cast("double"))).alias("pct_transition"), (100 * F.avg((top > crisp).cast("double"))).alias("pct_crisp"),
    )


def soft_zone_stats(fuzzy: DataFrame) -> DataFrame:
    """zone, feature, mean, std weighted by membership."""
    each = fuzzy.select(F.posexplode("u").alias("i", "w"), *NAMES)
    long = each.select((F.col("i") + 1).cast("int").alias("zone"), "w", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in NAMES])).alias("v"))
    per = long.groupBy("zone", "v.feature").agg((F.sum(F.col("w") * F.col("v.x")) / F.sum("w")).alias("mean"), (F.sum(F.col("w") * F.col("v.x") * F.col("v.x")) / F.sum("w")).alias("_sq"))
    return per.select("zone", "feature", "mean", F.sqrt(F.greatest(F.col("_sq") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"))


def hard_zone_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in NAMES for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
