"""Queries on the fixture raster: indices, scaling, decimation, percentiles, zones and morphology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import morphology as M
from fieldloom.operators import zones as Z
from fieldloom.plans.registry import query
from fieldloom.sources import raster as R


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_indices(R.table_raster(spark, sf_dir))


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.threshold_zones(pixels(spark, sf_dir))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster in two sides of even and odd stripes of 200 rows."""
    return pixels(spark, sf_dir).withColumn("side_id", (1 + F.floor(F.col("row") / 8) % 2).cast("int"))


@query('SELECT "row", col, ndre, ndvi, CASE WHEN nir + re = 0 THEN 0 ELSE (nir - re) / (nir + re) END AS ndre_plain FROM f')
def band_indices(spark, sf_dir):
    return pixels(spark, sf_dir).select("row", "col", "ndre", "ndvi", R.notebook_ndre().alias("ndre_plain"))


@query("""SELECT zone, n, round(n * 4.0 / 1e4, 6) AS area_ha, round(100.0 * n / sum(n) OVER (), 6) AS pct, round(a, 6) AS mean_ndre, round(b, 6) AS std_ndre, round(c, 6) AS mean_ndvi, round(d, 6) AS std_ndvi
 FROM (SELECT zone, count(*) n, avg(ndre) a, stddev_pop(ndre) b, avg(ndvi) c, stddev_pop(ndvi) d FROM z WHERE zone > 0 GROUP BY zone)""")
def canopy_zone_stats(spark, sf_dir):
    return rounded(Z.zone_table(zoned(spark, sf_dir), 3, 2.0), "area_ha", "pct", "mean_ndre", "std_ndre", "mean_ndvi", "std_ndvi")


@query("SELECT zone, count(*) AS n FROM z GROUP BY zone")
def zone_histogram(spark, sf_dir):
    return Z.histogram(zoned(spark, sf_dir), 3)


_MM = ", ".join(f"round(coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0), 9) AS f{i + 1}" for i, c in enumerate(("ndre", "ndvi", "nir", "r", "nir")))


@query(f'SELECT "row", col, {_MM} FROM f WHERE ndre > 0.1')
def minmax_features(spark, sf_dir):
    return rounded(Z.min_max(Z.features(Z.canopy(pixels(spark, sf_dir)))), *Z.NAMES, places=9)


@query(f'SELECT "row", col, {_MM.replace("nir - min(nir) OVER ()) / nullif(max(nir) OVER () - min(nir) OVER (), 0), 0), 9) AS f5", "g - min(g) OVER ()) / nullif(max(g) OVER () - min(g) OVER (), 0), 0), 9) AS f5")} FROM f WHERE ndre > 0.1')
def minmax_features_notebook(spark, sf_dir):
    return rounded(Z.min_max(Z.features(Z.canopy(pixels(spark, sf_dir)), "notebook")), *Z.NAMES, places=9)


@query('SELECT max(ndre) AS ndre_max, max(nir) AS nir_max, CAST(1 AS DOUBLE) AS ndre_scaled_max, CAST(1 AS DOUBLE) AS nir_scaled_max FROM f WHERE ndre > 0.1')
def scaling_effect(spark, sf_dir):
    veg = Z.canopy(pixels(spark, sf_dir))
    raw = veg.agg(F.max("ndre").alias("ndre_max"), F.max("nir").alias("nir_max"))
    return raw.crossJoin(Z.min_max(Z.features(veg)).agg(F.max("f1").alias("ndre_scaled_max"), F.max("f3").alias("nir_scaled_max")))


@query("""SELECT CAST("row" // 7 AS INT) AS "row", CAST(col // 7 AS INT) AS col, round(avg(nir), 9) AS nir, round(avg(re), 9) AS re, round(avg(r), 9) AS r, round(avg(g), 9) AS g FROM f
 WHERE "row" // 7 < (SELECT (max("row") + 1) // 7 FROM f) AND col // 7 < (SELECT (max(col) + 1) // 7 FROM f) GROUP BY 1, 2""")
def decimate_average(spark, sf_dir):
    return rounded(R.decimate_average(pixels(spark, sf_dir), 7), *R.BANDS, places=9)


@query('SELECT CAST("row" / 3 AS INT) AS "row", CAST(col / 3 AS INT) AS col, zone FROM z WHERE "row" % 3 = 0 AND col % 3 = 0')
def decimate_nearest(spark, sf_dir):
    return R.decimate_nearest(zoned(spark, sf_dir), 3).select("row", "col", "zone")


_FC = ", ".join(f"round(least(greatest(({c} - quantile_cont({c}, 0.02) OVER ()) / (quantile_cont({c}, 0.98) OVER () - quantile_cont({c}, 0.02) OVER () + 1e-6), 0), 1), 9) AS {c}" for c in ("nir", "r", "g"))


@query(f'SELECT "row", col, {_FC} FROM f')
def false_colour_stretch(spark, sf_dir):
    return rounded(Z.stretched(pixels(spark, sf_dir), ("nir", "r", "g")), "nir", "r", "g", places=9)


@query('SELECT "row", col, ndre FROM f WHERE ndre > 0.1 AND ndre >= (SELECT quantile_cont(ndre, 0.8) FROM f WHERE ndre > 0.1)')
def p80_global(spark, sf_dir):
    return Z.percentile_target(Z.canopy(pixels(spark, sf_dir))).select("row", "col", "ndre")


_SIDED = ' s AS (SELECT *, CAST(1 + ("row" // 8) % 2 AS INT) side_id FROM f), t AS (SELECT side_id, quantile_cont(ndvi, 0.8) p80 FROM s GROUP BY 1)'


@query('SELECT side_id, "row", col, ndvi FROM s JOIN t USING (side_id) WHERE ndvi >= p80', _SIDED)
def p80_sidewise(spark, sf_dir):
    return Z.percentile_target(sided(spark, sf_dir), "ndvi", 0.8, "side_id").select("side_id", "row", "col", "ndvi")


@query("""SELECT side_id, count(*) AS cells, round(count(*) / sum(count(*)) OVER (), 6) AS share, min(ndvi) AS least, round(avg(ndvi), 6) AS mean, quantile_cont(ndvi, 0.5) AS median,
 max(ndvi) AS greatest, any_value(p80) AS p80, count(*) FILTER (ndvi >= p80) * 0.25 AS target_area FROM s JOIN t USING (side_id) GROUP BY side_id""", _SIDED)
def side_stats(spark, sf_dir):
    return rounded(Z.side_stats(sided(spark, sf_dir), "side_id", "ndvi", 0.25), "share", "mean")


@query('SELECT "row", col, zone FROM z WHERE zone >= 1 AND zone < (SELECT max(zone) FROM z)')
def nitrogen_target(spark, sf_dir):
    return Z.target(zoned(spark, sf_dir), "nitrogen").select("row", "col", "zone")


@query('SELECT "row", col, zone FROM z WHERE zone >= 1')
def water_target(spark, sf_dir):
    return Z.target(zoned(spark, sf_dir), "water").select("row", "col", "zone")


@query('SELECT "row", col, tile_row, tile_col FROM (SELECT *, CAST("row" // 32 AS INT) tile_row, CAST(col // 32 AS INT) tile_col, count(*) FILTER (ndre > 0.45) OVER (PARTITION BY "row" // 32, col // 32) n FROM f) WHERE n >= 200')
def sparse_tiles_skipped(spark, sf_dir):
    return R.skip_sparse_tiles(pixels(spark, sf_dir), F.col("ndre") > 0.45, 200, 32).select("row", "col", "tile_row", "tile_col")


@query("""SELECT "row", col FROM (SELECT "row", col, row_number() OVER (PARTITION BY wr, wc ORDER BY "row", col) rn, count(*) OVER (PARTITION BY wr, wc) n FROM
 (SELECT "row", col, "row" // sh wr, col // sw wc, "row" % sh dr, col % sw dc FROM f, (SELECT greatest(1, (max("row") + 1) // 6) sh, greatest(1, (max(col) + 1) // 6) sw FROM f) WHERE ndre > 0.1)
 WHERE wr < 6 AND wc < 6 AND dr < 512 AND dc < 512) WHERE n > 50 AND (rn - 1) % 10 = 0 ORDER BY md5(CAST("row" AS VARCHAR) || ',' || CAST(col AS VARCHAR)), "row", col LIMIT 15000""")
def training_sample(spark, sf_dir):
    return R.training_sample(pixels(spark, sf_dir), F.col("ndre") > 0.1).select("row", "col")


@query("""SELECT zone, round(q1, 9) AS q1, round(m, 9) AS median, round(q3, 9) AS q3, min(ndvi) FILTER (ndvi >= q1 - 1.5 * (q3 - q1)) AS low, max(ndvi) FILTER (ndvi <= q3 + 1.5 * (q3 - q1)) AS high
 FROM z JOIN (SELECT zone, quantile_cont(ndvi, 0.25) q1, quantile_cont(ndvi, 0.5) m, quantile_cont(ndvi, 0.75) q3 FROM z WHERE zone > 0 GROUP BY zone) USING (zone) GROUP BY zone, q1, m, q3""")
def zone_boxplots(spark, sf_dir):
    return rounded(Z.box_summary(zoned(spark, sf_dir), "ndvi"), "q1", "median", "q3", places=9)


@query("""SELECT CAST(least(floor((ndre - x0) / (x1 - x0) * 50), 49) AS INT) AS bx, CAST(least(floor((ndvi - y0) / (y1 - y0) * 50), 49) AS INT) AS by, count(*) AS n
 FROM f, (SELECT min(ndre) x0, max(ndre) x1, min(ndvi) y0, max(ndvi) y1 FROM f) GROUP BY 1, 2""")
def feature_hexbins(spark, sf_dir):
    return Z.bins_2d(pixels(spark, sf_dir), "ndre", "ndvi")


@query("""SELECT CAST(least(floor((elev - lo) / (hi - lo) * 15), 14) AS INT) AS level, count(*) AS n, round(min(elev), 6) AS least, round(max(elev), 6) AS greatest
 FROM f, (SELECT min(elev) lo, max(elev) hi FROM f WHERE elev > 0) WHERE elev > 0 GROUP BY 1""")
def elevation_contours(spark, sf_dir):
    return rounded(Z.contour_levels(pixels(spark, sf_dir)), "least", "greatest")


@query("""SELECT "row", col, round(sum(w * v) / sum(w), 4) AS elev FROM (SELECT t."row", t.col, s.elev v, (1 - abs(y - s."row")) * (1 - abs(x - s.col)) w FROM
 (SELECT "row", col, ("row" + 0.5) * 0.5 - 0.5 y, (col + 0.5) * 0.5 - 0.5 x FROM f) t JOIN f s ON s."row" BETWEEN floor(y) AND floor(y) + 1 AND s.col BETWEEN floor(x) AND floor(x) + 1) GROUP BY 1, 2""")
def dem_alignment(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return rounded(R.align_bilinear(px, px, 0.5, 0.5), "elev", places=4)


@query("""SELECT "row", col, round(least(greatest(coalesce(m, 1), 0), 1), 9) AS risk FROM (SELECT DISTINCT CAST("row" // 2 AS INT) "row", CAST(col // 2 AS INT) col FROM f) c
 LEFT JOIN (SELECT CAST("row" // 2 AS INT) "row", CAST(col // 2 AS INT) col, avg(ndvi * 1.3 - 0.2) m FROM f WHERE "row" % 5 <> 0 AND col > 3 GROUP BY 1, 2) p USING ("row", col)""")
def risk_resample(spark, sf_dir):
    px = pixels(spark, sf_dir)
    cells = px.select(F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).distinct()
    points = px.filter("row % 5 <> 0 and col > 3").select((F.col("col") / 4).alias("x"), (F.col("row") / 4).alias("y"), (F.col("ndvi") * 1.3 - 0.2).alias("risk"))
    return rounded(R.resample_risk(cells, points, 0.5), "risk", places=9)


_D8 = """SELECT DISTINCT p."row", p.col FROM f p JOIN (SELECT "row", col FROM f WHERE ndre > 0.55) t ON t."row" BETWEEN p."row" - 8 AND p."row" + 8 AND t.col BETWEEN p.col - 8 AND p.col + 8 AND abs(p."row" - t."row") + abs(p.col - t.col) <= 8"""


@query(_D8)
def diamond_dilation(spark, sf_dir):
    mask = pixels(spark, sf_dir).select("row", "col", (F.col("ndre") > 0.55).alias("m"))
    return M.diamond(mask, 8).filter("m").select("row", "col")


_CLOSE = """ m0 AS (SELECT "row", col, ndre > 0.42 m FROM f),
 m1 AS (SELECT "row", col, max(m) OVER (PARTITION BY "row" ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) m FROM m0),
 m2 AS (SELECT "row", col, max(m) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) m FROM m1),
 cl AS (SELECT p."row", p.col FROM m2 p JOIN m2 q ON q."row" BETWEEN p."row" - 2 AND p."row" + 2 AND q.col BETWEEN p.col - 2 AND p.col + 2 GROUP BY 1, 2 HAVING bool_and(q.m) AND count(*) = 25)"""


@query('SELECT "row", col FROM cl', _CLOSE)
def closing_5x5(spark, sf_dir):
    return M.close(pixels(spark, sf_dir).select("row", "col", (F.col("ndre") > 0.42).alias("m"))).filter("m").select("row", "col")


@query('SELECT "row", col FROM (SELECT p."row", p.col FROM z p JOIN z q ON q."row" BETWEEN p."row" - 1 AND p."row" + 1 AND q.col BETWEEN p.col - 1 AND p.col + 1 GROUP BY 1, 2 HAVING bool_and(q.zone > 0) AND count(*) = 9)')
def erosion_3x3(spark, sf_dir):
    return M.erode(zoned(spark, sf_dir).select("row", "col", (F.col("zone") > 0).alias("m")), 1).filter("m").select("row", "col")


def _components(cells: str, reach: int) -> str:
    return f""" cells AS ({cells}), isl AS (SELECT grp, "row", col, col - row_number() OVER (PARTITION BY grp, "row" ORDER BY col) k FROM cells),
 rn AS (SELECT grp, "row", min(col) c0, max(col) c1, CAST("row" AS BIGINT) * 4294967296 + min(col) run FROM isl GROUP BY grp, "row", k),
 ed AS (SELECT a.grp, a.run a, b.run b FROM rn a JOIN rn b ON a.grp = b.grp AND abs(a."row" - b."row") = 1 AND a.c0 <= b.c1 + {reach} AND b.c0 <= a.c1 + {reach}),
 re AS (SELECT grp, run node, run root FROM rn UNION SELECT re.grp, ed.b, re.root FROM re JOIN ed ON ed.grp = re.grp AND ed.a = re.node AND re.root < ed.b),
 comp AS (SELECT grp, node, min(root) root FROM re GROUP BY grp, node), cs AS (SELECT c.grp, c.root, sum(rn.c1 - rn.c0 + 1) size FROM comp c JOIN rn ON rn.grp = c.grp AND rn.run = c.node GROUP BY 1, 2)"""


_ZONE_CELLS = 'SELECT zone grp, "row", col FROM z WHERE zone > 0'


@query("SELECT grp AS zone, count(*) AS components, CAST(max(size) AS BIGINT) AS largest FROM cs GROUP BY grp", _components(_ZONE_CELLS, 0), True)
def zone_components(spark, sf_dir):
    veg = zoned(spark, sf_dir).filter("zone > 0").select("zone", "row", "col")
    return M.component_sizes(veg, "zone").groupBy("zone").agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))


@query("SELECT grp AS zone, count(*) AS components, CAST(max(size) AS BIGINT) AS largest FROM cs GROUP BY grp", _components(_ZONE_CELLS, 1), True)
def zone_components_8(spark, sf_dir):
    veg = zoned(spark, sf_dir).filter("zone > 0").select("zone", "row", "col")
    return M.component_sizes(veg, "zone", diagonal=True).groupBy("zone").agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))


@query('SELECT rn.grp AS zone, rn."row", CAST(unnest(range(rn.c0, rn.c1 + 1)) AS INT) AS col FROM comp JOIN cs ON cs.grp = comp.grp AND cs.root = comp.root JOIN rn ON rn.grp = comp.grp AND rn.run = comp.node WHERE size >= 12', _components(_ZONE_CELLS, 0), True)
def small_objects_removed(spark, sf_dir):
    return M.large_cells(zoned(spark, sf_dir).filter("zone > 0").select("zone", "row", "col"), 12, "zone")


@query("""SELECT "row", col FROM z WHERE ndre > 0.42 UNION ALL SELECT rn."row", CAST(unnest(range(rn.c0, rn.c1 + 1)) AS INT) FROM comp JOIN rn ON rn.run = comp.node WHERE root NOT IN
 (SELECT root FROM comp JOIN rn ON rn.run = comp.node, (SELECT max("row") h, max(col) w FROM z) WHERE "row" IN (0, h) OR c0 = 0 OR c1 = w)""", _components('SELECT 0 grp, "row", col FROM z WHERE NOT ndre > 0.42', 0), True)
def filled_holes(spark, sf_dir):
    return M.fill_holes(pixels(spark, sf_dir).select("row", "col", (F.col("ndre") > 0.42).alias("m"))).filter("m").select("row", "col")


_CASP = _components(_ZONE_CELLS, 0) + """, kp AS (SELECT rn.grp zone, rn."row", unnest(range(rn.c0, rn.c1 + 1)) col FROM comp JOIN cs ON cs.grp = comp.grp AND cs.root = comp.root JOIN rn ON rn.grp = comp.grp AND rn.run = comp.node WHERE size >= 12),
 nr AS (SELECT d."row", d.col, arg_min(kp.zone, (kp."row" - d."row") ** 2 + (kp.col - d.col) ** 2 + kp."row" / 1e5 + kp.col / 1e9) near FROM (SELECT "row", col FROM z WHERE zone > 0 EXCEPT SELECT "row", col FROM kp) d
  JOIN kp ON abs(kp."row" - d."row") <= 30 AND abs(kp.col - d.col) <= 30 GROUP BY 1, 2)"""


@query('SELECT z."row", z.col, CAST(CASE WHEN z.zone = 0 THEN 0 ELSE coalesce(near, z.zone) END AS INT) AS zone FROM z LEFT JOIN nr ON nr."row" = z."row" AND nr.col = z.col', _CASP, True)
def islands_smoothed(spark, sf_dir):
    return M.smooth_zones(zoned(spark, sf_dir), 12)


_FIELD = """ m0 AS (SELECT "row", col, zone > 0 m FROM z),
 m1 AS (SELECT "row", col, max(m) OVER (PARTITION BY "row" ORDER BY col RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) m FROM m0),
 m2 AS (SELECT "row", col, max(m) OVER (PARTITION BY col ORDER BY "row" RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) m FROM m1),
 cl AS (SELECT p."row", p.col FROM m2 p JOIN m2 q ON q."row" BETWEEN p."row" - 2 AND p."row" + 2 AND q.col BETWEEN p.col - 2 AND p.col + 2 GROUP BY 1, 2 HAVING bool_and(q.m) AND count(*) = 25),
""" + _components('SELECT 0 grp, "row", col FROM z WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl."row" = z."row" AND cl.col = z.col)', 0).lstrip() + """,
 fm AS (SELECT "row", col FROM cl UNION ALL SELECT rn."row", CAST(unnest(range(rn.c0, rn.c1 + 1)) AS INT) FROM comp JOIN rn ON rn.run = comp.node WHERE root NOT IN
 (SELECT root FROM comp JOIN rn ON rn.run = comp.node, (SELECT max("row") h, max(col) w FROM z) WHERE "row" IN (0, h) OR c0 = 0 OR c1 = w))"""


@query('SELECT "row", col FROM fm', _FIELD, True)
def field_mask(spark, sf_dir):
    return M.field_mask(zoned(spark, sf_dir)).filter("m").select("row", "col")


@query('SELECT "row", col, CASE WHEN zone = 0 THEN 1.0 ELSE 2.5 END::DOUBLE AS cost FROM fm JOIN z USING ("row", col) WHERE zone = 0 OR zone = (SELECT max(zone) FROM z)', _FIELD, True)
def nitrogen_costs(spark, sf_dir):
    return M.cost_grid(zoned(spark, sf_dir), "nitrogen")


_KERNEL = """ kn AS (SELECT k, exp(-0.5 * k * k / 2.25) / sum(exp(-0.5 * k * k / 2.25)) OVER () w FROM (SELECT unnest(range(-6, 7)) k)), sz AS (SELECT max("row") + 1 h, max(col) + 1 n FROM f),
 g1 AS (SELECT p."row", p.col, sum(w * CASE WHEN q.ndre > 0.1 THEN q.ndre ELSE 0 END) s, sum(w * CASE WHEN q.ndre > 0.1 THEN 1 ELSE 0 END) d FROM f p, sz, kn JOIN f q ON q."row" = p."row" AND q.col = CASE WHEN p.col + k < 0 THEN -1 - p.col - k WHEN p.col + k >= n THEN 2 * n - 1 - p.col - k ELSE p.col + k END GROUP BY 1, 2),
 g2 AS (SELECT p."row", p.col, sum(w * q.s) s, sum(w * q.d) d FROM g1 p, sz, kn JOIN g1 q ON q.col = p.col AND q."row" = CASE WHEN p."row" + k < 0 THEN -1 - p."row" - k WHEN p."row" + k >= h THEN 2 * h - 1 - p."row" - k ELSE p."row" + k END GROUP BY 1, 2)"""


@query('SELECT g2."row", g2.col, round(s / greatest(d, 1e-6), 8) AS ndre FROM g2 JOIN f ON f."row" = g2."row" AND f.col = g2.col WHERE f.ndre > 0.1', _KERNEL)
def gaussian_smoothing(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("veg", F.col("ndre") > 0.1)
    return rounded(M.gaussian(px.select("row", "col", "ndre", "veg"), ("ndre",), 1.5, F.col("veg")).filter("veg").select("row", "col", "ndre"), "ndre", places=8)


_SLOPE = """ kn AS (SELECT k, exp(-0.5 * k * k / 4.0) / sum(exp(-0.5 * k * k / 4.0)) OVER () w FROM (SELECT unnest(range(-8, 9)) k)), sz AS (SELECT max("row") + 1 h, max(col) + 1 n FROM f),
 g1 AS (SELECT p."row", p.col, sum(w * q.elev) s FROM f p, sz, kn JOIN f q ON q."row" = p."row" AND q.col = CASE WHEN p.col + k < 0 THEN -1 - p.col - k WHEN p.col + k >= n THEN 2 * n - 1 - p.col - k ELSE p.col + k END GROUP BY 1, 2),
 g2 AS (SELECT p."row", p.col, sum(w * q.s) v FROM g1 p, sz, kn JOIN g1 q ON q.col = p.col AND q."row" = CASE WHEN p."row" + k < 0 THEN -1 - p."row" - k WHEN p."row" + k >= h THEN 2 * h - 1 - p."row" - k ELSE p."row" + k END GROUP BY 1, 2),
 sl AS (SELECT "row", col, degrees(atan(sqrt(gy * gy + gx * gx))) slope FROM (SELECT "row", col, coalesce((lead(v) OVER y - lag(v) OVER y) / 2, lead(v) OVER y - v, v - lag(v) OVER y, 0) gy,
  coalesce((lead(v) OVER x - lag(v) OVER x) / 2, lead(v) OVER x - v, v - lag(v) OVER x, 0) gx FROM g2 WINDOW y AS (PARTITION BY col ORDER BY "row"), x AS (PARTITION BY "row" ORDER BY col)))"""


@query('SELECT "row", col, round(slope, 6) AS slope FROM sl', _SLOPE)
def slope_degrees(spark, sf_dir):
    return rounded(M.slope(pixels(spark, sf_dir), 1.0), "slope")


@query("SELECT round(quantile_cont(slope, 0.5), 5) AS median, round(quantile_cont(slope, 0.9), 5) AS p90, round(max(slope), 5) AS greatest FROM sl JOIN z USING (\"row\", col) WHERE zone > 0", _SLOPE)
def slope_summary(spark, sf_dir):
    met = M.slope(pixels(spark, sf_dir), 1.0).join(zoned(spark, sf_dir).filter("zone > 0").select("row", "col"), ["row", "col"])
    return met.agg(F.round(F.percentile("slope", F.lit(0.5)), 5).alias("median"), F.round(F.percentile("slope", F.lit(0.9)), 5).alias("p90"), F.round(F.max("slope"), 5).alias("greatest"))
