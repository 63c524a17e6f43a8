"""Zone maps: thresholds, targets, statistics, percentiles, sampling order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.raster import hash_order

VEGETATION = 0.1
CUTS = (0.40, 0.48)
FEATURES = {"script": ("ndre", "ndvi", "nir", "r", "nir"), "notebook": ("ndre", "ndvi", "nir", "r", "g")}
NAMES = ("f1", "f2", "f3", "f4", "f5")


def canopy(pixels: DataFrame, threshold: float = VEGETATION) -> DataFrame:
    return pixels.filter(F.col("ndre") > threshold)


def threshold_zones(pixels: DataFrame, cuts: tuple[float, ...] = CUTS, threshold: float = VEGETATION) -> DataFrame:
    """Adds zone: 0 is soil, then one more for each cut that ndre is above."""
    above = sum((F.col("ndre") > c).cast("int") for c in cuts)
    return pixels.withColumn("zone", F.when(F.col("ndre") > threshold, 1 + above).otherwise(0).cast("int"))


def features(pixels: DataFrame, kind: str = "script") -> DataFrame:
    """row, col, f1..f5."""
    return pixels.select("row", "col", *[F.col(c).alias(n) for c, n in zip(FEATURES[kind], NAMES, strict=True)])


def fit_min_max(table: DataFrame, columns: tuple[str, ...] = NAMES) -> DataFrame:
    """One row: least and greatest of each column."""
    return table.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def min_max(table: DataFrame, params: DataFrame | None = None, columns: tuple[str, ...] = NAMES) -> DataFrame:
    """Columns scaled to the fitted range (their own, unless params are given); a constant column is 0."""
    met = table.crossJoin(F.broadcast(params if params is not None else fit_min_max(table, columns)))  # one row
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")), F.lit(0.0)) for c in columns}
    return met.withColumns(scaled).select(*table.columns)


def stretched(pixels: DataFrame, columns: tuple[str, ...], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Columns clipped between two percentiles of all pixels and scaled to [0, 1]."""
    cut = pixels.agg(*[F.percentile(c, F.lit(q)).alias(f"{n}_{c}") for c in columns for n, q in (("lo", low), ("hi", high))])
    met = pixels.crossJoin(F.broadcast(cut))  # one row
    out = {c: F.least(F.greatest((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1e-6), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return met.withColumns(out).select("row", "col", *columns)


def target(zones: DataFrame, rule: str) -> DataFrame:
    """Pixels to treat. water: all zones; nitrogen: all but the highest zone present."""
    if rule == "water":
        return zones.filter("zone >= 1")
    top = zones.agg(F.max("zone").alias("top"))
    return zones.crossJoin(F.broadcast(top)).filter("zone >= 1 and zone < top").drop("top")  # one row


def percentile_target(pixels: DataFrame, value: str = "ndre", q: float = 0.8, by: str | None = None) -> DataFrame:
    """Pixels at or above the percentile of their group (of all, without one)."""
    if by is None:
        cut = pixels.agg(F.percentile(value, F.lit(q)).alias("threshold"))
        return pixels.crossJoin(F.broadcast(cut)).filter(F.col(value) >= F.col("threshold"))  # one row
    cut = pixels.groupBy(by).agg(F.percentile(value, F.lit(q)).alias("threshold"))
    return pixels.join(cut, by).filter(F.col(value) >= F.col("threshold"))


def zone_table(zones: DataFrame, k: int, pixel_m: float = 1.0) -> DataFrame:
    """One row for each zone 1..k: pixels, hectares, share of the canopy, mean and spread of both indices."""
    per = zones.filter("zone > 0").groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("ndre", "ndvi") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    all_zones = zones.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("zone"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return all_zones.join(per, "zone", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).select(
        "zone", "n", (F.col("n") * pixel_m * pixel_m / 1e4).alias("area_ha"), (100.0 * F.col("n") / whole).alias("pct"),
        "mean_ndre", "std_ndre", "mean_ndvi", "std_ndvi",
    )


def histogram(zones: DataFrame, k: int) -> DataFrame:
    """Pixels of each zone 0..k, zeros kept."""
    per = zones.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    return zones.sparkSession.range(0, k + 1).select(F.col("id").cast("int").alias("zone")).join(per, "zone", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def side_stats(pixels: DataFrame, by: str, value: str, cell_m2: float = 1.0) -> DataFrame:
    """Per side: cells, share, spread of a layer, its P80 and the area at or above it."""
    per = pixels.groupBy(by).agg(
        F.count(F.lit(1)).alias("cells"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.max(value).alias("greatest"), F.percentile(value, F.lit(0.8)).alias("p80"),
    )
    hit = percentile_target(pixels, value, 0.8, by).groupBy(by).agg((F.count(F.lit(1)) * cell_m2).alias("target_area"))
    return per.join(hit, by).withColumn("share", F.col("cells") / F.sum("cells").over(Window.partitionBy(F.lit(1))))


def order_labels(labelled: DataFrame, value: str = "ndre") -> DataFrame:
    """label and zone: labels numbered from 1 by the mean of value, ties by label. A row for each label."""
    means = labelled.groupBy("label").agg(F.avg(value).alias("mean"))
    return means.select("label", F.row_number().over(Window.orderBy("mean", "label")).alias("zone"))


def map_labels(labelled: DataFrame, mapping: DataFrame, default: int | None = 1) -> DataFrame:
    """Adds zone from a table of labels; a label without one gets the default, or is an error where that is None."""
    m = F.broadcast(mapping.select(F.col("label").alias("_l"), "zone"))  # a row for each cluster
    if default is not None:
        return labelled.join(m, F.col("label") == F.col("_l"), "left").withColumn("zone", F.coalesce("zone", F.lit(default))).drop("_l")
    met = labelled.join(m, F.col("label") == F.col("_l"), "left").drop("_l")
    return met.withColumn("zone", F.coalesce("zone", F.raise_error(F.concat(F.lit("no zone for label "), F.col("label"))).cast("int")))


def sample(table: DataFrame, n: int) -> DataFrame:
    """n rows in the order of a hash of the place: a random sample that repeats."""
    return table.orderBy(hash_order(), "row", "col").limit(n)


def box_summary(zones: DataFrame, value: str) -> DataFrame:
    """Quartiles and whiskers (within 1.5 of the box) of a layer for each zone."""
    q = zones.filter("zone > 0").groupBy("zone").agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    met = zones.filter("zone > 0").join(q, "zone")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return met.groupBy("zone").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value))).alias("low"), F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value))).alias("high"),
    )


def bins_2d(table: DataFrame, x: str, y: str, n: int = 50) -> DataFrame:
    """Counts on an n x n grid over the ranges of two columns."""
    r = table.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    bin_ = lambda c, a, b: F.least(F.floor((F.col(c) - F.col(a)) / (F.col(b) - F.col(a)) * n), F.lit(n - 1)).cast("int")
    return table.crossJoin(F.broadcast(r)).groupBy(bin_(x, "x0", "x1").alias("bx"), bin_(y, "y0", "y1").alias("by")).agg(F.count(F.lit(1)).alias("n"))


def contour_levels(pixels: DataFrame, levels: int = 15) -> DataFrame:
    """Pixels with a valid height on each of `levels` bands between its least and greatest."""
    valid = pixels.filter("elev > 0")
    r = valid.agg(F.min("elev").alias("low"), F.max("elev").alias("high"))
    level = F.least(F.floor((F.col("elev") - F.col("low")) / (F.col("high") - F.col("low")) * levels), F.lit(levels - 1)).cast("int")
    return valid.crossJoin(F.broadcast(r)).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("elev").alias("least"), F.max("elev").alias("greatest"))


def modal_bin(table: DataFrame, angle: Column, bins: int = 180) -> DataFrame:
    """Left edge of the fullest of `bins` bins of angles over [-90, 90); ties to the lower one."""
    b = F.least(F.floor((angle + 90) / (180 / bins)), F.lit(bins - 1)).cast("int")
    per = table.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max_by(F.col("bin"), F.struct("n", -F.col("bin"))).alias("bin")).select((F.col("bin") * (180 / bins) - 90).cast("double").alias("angle"))
