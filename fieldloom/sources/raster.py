"""Rasters as pixel tables: one row a pixel, keyed by (row, col), with a column for each band.

`table_raster` builds the fixture raster from the order tables; the other functions read, crop, align, tile and decimate
any pixel table. All of them are plain DataFrame plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.session import measured_broadcasts

#: Pixels in a row of the fixture raster, and the stripes that are canopy: the first CANOPY of every STRIPE rows.
WIDTH, STRIPE, CANOPY = 100, 8, 5
EPS = 1e-6
BANDS = ("nir", "re", "r", "g")


def table_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, nir, re, r, g, elev: an order is a pixel and its lines' averages are its bands."""
    measured_broadcasts(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("dd"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tt"),
        F.count(F.lit(1)).alias("n"),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    mean = lambda c, other, by: F.coalesce(F.col(c).cast("double") / F.col("n"), F.lit(other)) / by
    b = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.floor(F.col("o_orderkey") / WIDTH).cast("int").alias("row"), (F.col("o_orderkey") % WIDTH).cast("int").alias("col"),
        mean("q", 25.0, 50.0).alias("a"), mean("dd", 5.0, 10.0).alias("e"), mean("tt", 4.0, 8.0).alias("t"), "o_totalprice",
    )
    canopy = F.col("row") % STRIPE < CANOPY
    return b.select(
        "row", "col",
        F.when(canopy, 0.45 + 0.4 * F.col("a")).otherwise(0.22 + 0.05 * F.col("a")).alias("nir"),
        (0.20 + 0.10 * F.col("e")).alias("re"),
        F.when(canopy, 0.08 + 0.10 * F.col("t")).otherwise(0.20 + 0.05 * F.col("t")).alias("r"),
        (0.10 + 0.15 * F.col("e")).alias("g"),
        (100 + 0.05 * F.col("row") + 0.02 * F.col("col") + F.col("o_totalprice") / 1e6).alias("elev"),
    )


#: The same raster for DuckDB, with indices (f) and threshold zones (z).
PX_SQL = """li AS (SELECT l_orderkey k, sum(CAST(l_quantity AS BIGINT)) q, sum(CAST(round(l_discount*100) AS BIGINT)) dd,
  sum(CAST(round(l_tax*100) AS BIGINT)) tt, count(*) n FROM lineitem GROUP BY l_orderkey),
b AS (SELECT CAST(floor(o_orderkey/100) AS INT) "row", CAST(o_orderkey % 100 AS INT) col, coalesce(CAST(q AS DOUBLE)/n,25.0)/50.0 a,
  coalesce(CAST(dd AS DOUBLE)/n,5.0)/10.0 e, coalesce(CAST(tt AS DOUBLE)/n,4.0)/8.0 t, (floor(o_orderkey/100) % 8) < 5 canopy, o_totalprice FROM orders LEFT JOIN li ON o_orderkey=k),
px AS (SELECT "row", col, CASE WHEN canopy THEN 0.45+0.4*a ELSE 0.22+0.05*a END nir, 0.20+0.10*e re,
  CASE WHEN canopy THEN 0.08+0.10*t ELSE 0.20+0.05*t END r, 0.10+0.15*e g, 100+0.05*"row"+0.02*col+o_totalprice/1e6 elev FROM b),
f AS (SELECT *, (nir-re)/(nir+re+1e-6) ndre, (nir-r)/(nir+r+1e-6) ndvi FROM px),
z AS (SELECT *, CASE WHEN ndre > 0.1 THEN 1 + CAST(ndre > 0.40 AS INT) + CAST(ndre > 0.48 AS INT) ELSE 0 END zone FROM f)"""


def ratio_index(a: str, b: str, eps: float = EPS) -> Column:
    """(a - b) / (a + b + eps); null where the sum is 0 and eps is 0."""
    return F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b) + eps)


def with_indices(pixels: DataFrame) -> DataFrame:
    """Adds ndre and ndvi, both guarded against a zero sum."""
    return pixels.withColumn("ndre", ratio_index("nir", "re")).withColumn("ndvi", ratio_index("nir", "r"))


def notebook_ndre() -> Column:
    """The unguarded index; what has no value (0/0) is 0."""
    return F.coalesce(ratio_index("nir", "re", 0.0), F.lit(0.0))


def stack_bands(*bands: DataFrame) -> DataFrame:
    """Single-band tables (row, col, value) to one pixel table: the extent that all share."""
    out = bands[0]
    for b in bands[1:]:
        out = out.join(b, ["row", "col"])
    return out


def smallest_extent(*bands: DataFrame) -> DataFrame:
    """One row: height and width that all bands have."""
    sizes = [b.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")) for b in bands]
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out.agg(F.min("h").alias("height"), F.min("w").alias("width"))


def decimate_average(pixels: DataFrame, step: int, columns: tuple[str, ...] = BANDS) -> DataFrame:
    """Block averages of step x step pixels; rows and columns beyond the last whole block are cropped."""
    size = pixels.agg((F.floor((F.max("row") + 1) / step)).alias("h"), (F.floor((F.max("col") + 1) / step)).alias("w"))
    blocks = pixels.groupBy(F.floor(F.col("row") / step).cast("int").alias("row"), F.floor(F.col("col") / step).cast("int").alias("col"))
    means = blocks.agg(*[F.avg(c).alias(c) for c in columns])
    return means.join(F.broadcast(size), (F.col("row") < F.col("h")) & (F.col("col") < F.col("w"))).drop("h", "w")  # one row


def decimate_nearest(pixels: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column."""
    kept = pixels.filter((F.col("row") % step == 0) & (F.col("col") % step == 0))
    return kept.withColumn("row", (F.col("row") / step).cast("int")).withColumn("col", (F.col("col") / step).cast("int"))


def with_tiles(pixels: DataFrame, size: int = 2048) -> DataFrame:
    """Adds tile_row, tile_col of square tiles; edge tiles are clipped by themselves."""
    return pixels.withColumn("tile_row", F.floor(F.col("row") / size).cast("int")).withColumn("tile_col", F.floor(F.col("col") / size).cast("int"))


def skip_sparse_tiles(pixels: DataFrame, valid: Column, least: int = 10, size: int = 2048) -> DataFrame:
    """Rows of tiles with at least `least` valid pixels."""
    tiled = with_tiles(pixels, size)
    full = tiled.groupBy("tile_row", "tile_col").agg(F.count_if(valid).alias("valid_px")).filter(F.col("valid_px") >= least)
    return tiled.join(full, ["tile_row", "tile_col"])


def training_sample(pixels: DataFrame, valid: Column, grid: int = 6, tile: int = 512, least: int = 50, every: int = 10, most: int = 15000) -> DataFrame:
    """A grid of windows spread over the raster; every `every`-th valid pixel in row-major order of windows with more than `least`,
    then the first `most` in the order of a hash of the place."""
    size = pixels.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    step = lambda n: F.greatest(F.lit(1), F.floor(F.col(n) / grid))
    placed = pixels.filter(valid).crossJoin(F.broadcast(size))  # one row
    placed = placed.withColumn("window_row", F.floor(F.col("row") / step("h")).cast("int")).withColumn("window_col", F.floor(F.col("col") / step("w")).cast("int"))
    inside = (F.col("window_row") < grid) & (F.col("window_col") < grid) & (F.col("row") - F.col("window_row") * step("h") < tile) & (F.col("col") - F.col("window_col") * step("w") < tile)
    by = Window.partitionBy("window_row", "window_col")
    numbered = placed.filter(inside).withColumn("n", F.count(F.lit(1)).over(by)).withColumn("rn", F.row_number().over(by.orderBy("row", "col")))
    kept = numbered.filter((F.col("n") > least) & ((F.col("rn") - 1) % every == 0))
    return kept.orderBy(hash_order(), "row", "col").limit(most).drop("h", "w", "n", "rn")


def hash_order() -> Column:
    """A fixed shuffle of the pixels, the same in any engine."""
    return F.md5(F.concat_ws(",", F.col("row"), F.col("col")))


def split_orthophoto(pixels: DataFrame) -> DataFrame:
    """A four-band photo (bands array: red, green, nir, red edge) to named bands and NDVI."""
    b = lambda i: F.col("bands")[i]
    return pixels.select("row", "col", b(2).alias("nir"), b(3).alias("re"), b(0).alias("r"), b(1).alias("g")).withColumn("ndvi", ratio_index("nir", "r"))


def align_bilinear(source: DataFrame, target: DataFrame, scale_row: float, scale_col: float, shift_row: float = 0.0, shift_col: float = 0.0, value: str = "elev") -> DataFrame:
    """`value` of source at the places of target: a target pixel's centre is mapped affinely and its four neighbours weighted.
    Neighbours outside or null don't count; a pixel without any neighbour is null."""
    return bilinear_at(source, target.select("row", "col", ((F.col("row") + 0.5) * scale_row + shift_row - 0.5).alias("y"), ((F.col("col") + 0.5) * scale_col + shift_col - 0.5).alias("x")), value)


def bilinear_at(source: DataFrame, at: DataFrame, value: str = "elev") -> DataFrame:
    """row, col, `value` of source at the places (y, x: rows and columns of its pixels' centres) of each row, col of `at`."""
    near = at.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (0, 1) for j in (0, 1)])).alias("d"))
    near = near.withColumn("s_row", (F.floor("y") + F.col("d.dy")).cast("int")).withColumn("s_col", (F.floor("x") + F.col("d.dx")).cast("int"))
    weight = (1 - F.abs(F.col("y") - F.col("s_row"))) * (1 - F.abs(F.col("x") - F.col("s_col")))
    src = source.filter(F.col(value).isNotNull()).select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), F.col(value).alias("_v"))
    met = near.withColumn("_w", weight).join(src, ["s_row", "s_col"], "left")
    total = F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")))
    return met.groupBy("row", "col").agg(F.when(total > 0, F.sum(F.col("_w") * F.col("_v")) / total).alias(value))


def resample_risk(cells: DataFrame, points: DataFrame, resolution: float = 0.5) -> DataFrame:
    """Mean risk of the points (x, y, risk) in each cell (row, col), clipped to [0, 1]; a cell without data has risk 1."""
    per = points.groupBy(F.floor(F.col("y") / resolution).cast("int").alias("row"), F.floor(F.col("x") / resolution).cast("int").alias("col")).agg(F.avg("risk").alias("risk"))
    return cells.join(per, ["row", "col"], "left").withColumn("risk", F.least(F.greatest(F.coalesce("risk", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))


def crop(pixels: DataFrame, inside: DataFrame, value: str) -> DataFrame:
    """row, col (from 0 in the box of the inside cells) and `value`, 0 in cells of the box that aren't inside."""
    box = inside.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    boxed = pixels.crossJoin(F.broadcast(box)).filter(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))  # one row
    met = boxed.join(inside.select("row", "col", F.lit(True).alias("in")).distinct(), ["row", "col"], "left")
    return met.select((F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), F.when(F.col("in"), F.col(value)).otherwise(0.0).alias(value))


def rgb_preview(pixels: DataFrame, bands: list[str], step: int) -> DataFrame:
    """row, col, red, green, blue: at most three bands (one band serves for all three), decimated, clipped to their joint 2nd and 98th percentile."""
    names = [*bands, *[bands[0]] * 2][:3] if len(bands) == 1 else bands[:3]
    small = decimate_nearest(pixels.select("row", "col", *dict.fromkeys(names)), step)
    values = small.select(F.explode(F.array(*names)).alias("v")).agg(F.percentile("v", F.lit(0.02)).alias("p2"), F.percentile("v", F.lit(0.98)).alias("p98"))
    met = small.crossJoin(F.broadcast(values))  # one row
    stretched = [F.least(F.greatest((F.col(n) - F.col("p2")) / (F.col("p98") - F.col("p2") + 1e-6), F.lit(0.0)), F.lit(1.0)) for n in names]
    return met.select("row", "col", *[c.alias(n) for c, n in zip(stretched, ("red", "green", "blue"), strict=False)])


def valid_elevation() -> Column:
    return F.when(F.col("elev") > 0, F.col("elev"))
