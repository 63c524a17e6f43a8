"""Queries on outlines, previews, experiments' documents and comparisons of methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fieldloom.operators import clustering as C
from fieldloom.operators import metrics as Q
from fieldloom.operators import missions as P
from fieldloom.operators import morphology as M
from fieldloom.operators import sidewise as S
from fieldloom.operators import zones as Z
from fieldloom.plans.clusters import K, points
from fieldloom.plans.missions import _ROUTE, _SWATHS, HOLE, OUTER, patch_route, rings
from fieldloom.plans.rasters import pixels, rounded, sided, zoned
from fieldloom.plans.registry import query
from fieldloom.session import stored
from fieldloom.sources import files, geodesy
from fieldloom.sources import raster as R


def _inside_sql() -> str:
    rows = [(*a, *b) for ring in (OUTER, HOLE) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    values = ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in r) + ")" for r in rows)
    return f""" pe AS (SELECT * FROM (VALUES {values}) e(x1, y1, x2, y2)),
 pin AS (SELECT "row", col FROM f JOIN pe ON "row" + 0.5 >= least(y1, y2) AND "row" + 0.5 < greatest(y1, y2)
  WHERE x1 + ("row" + 0.5 - y1) / (y2 - y1) * (x2 - x1) > col + 0.5 GROUP BY "row", col HAVING count(*) % 2 = 1)"""


@query('SELECT CAST(1 AS INT) AS patch_id, "row", col FROM pin', _inside_sql())
def cells_in_polygon(spark, sf_dir):
    """Cells of the raster whose centre lies in the outline and not in its hole."""
    inside = S.cells_in_rings(rings(spark, sf_dir), 1.0, "patch_id")
    return inside.join(pixels(spark, sf_dir).select("row", "col"), ["row", "col"], "left_semi").select("patch_id", "row", "col")


@query("""SELECT CAST(f."row" - r0 AS INT) AS "row", CAST(f.col - c0 AS INT) AS col, CASE WHEN pin.col IS NULL THEN 0.0 ELSE nir END AS nir FROM f
 JOIN (SELECT min("row") r0, max("row") r1, min(col) c0, max(col) c1 FROM pin) b ON f."row" BETWEEN r0 AND r1 AND f.col BETWEEN c0 AND c1
 LEFT JOIN pin ON pin."row" = f."row" AND pin.col = f.col""", _inside_sql())  # fmt: skip
def cropped_raster(spark, sf_dir):
    """A band cropped to the outline's box, 0 outside the outline."""
    return R.crop(pixels(spark, sf_dir).select("row", "col", "nir"), cells_in_polygon(spark, sf_dir), "nir")


@query("""SELECT "row", col, least(greatest((v - p2) / (p98 - p2 + 1e-6), 0), 1) AS red FROM (SELECT CAST("row" // 3 AS INT) AS "row", CAST(col // 3 AS INT) AS col, r v FROM f WHERE "row" % 3 = 0 AND col % 3 = 0),
 (SELECT quantile_cont(v, 0.02) p2, quantile_cont(v, 0.98) p98 FROM (SELECT unnest([r, g, nir]) v FROM f WHERE "row" % 3 = 0 AND col % 3 = 0))""")
def rgb_preview(spark, sf_dir):
    """The first of three bands, decimated, under a stretch that all bands share."""
    return R.rgb_preview(pixels(spark, sf_dir), ["r", "g", "nir"], 3).select("row", "col", "red")


def experiment_documents(spark, sf_dir):
    """The experiments' documents as their producers write them: JSON with a list of fields and a list of comparisons."""
    per = sided(spark, sf_dir).groupBy("side_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ndvi"), 6).alias("v"), F.round(F.avg("ndre"), 6).alias("e"))
    field, n, v, e = F.concat(F.lit("field_"), F.col("side_id").cast("string")).alias("field_id"), F.col("n"), F.col("v"), F.col("e")
    a = F.struct(field, n.alias("target_area_m2"), (n % 7).alias("swath_count"), (n * 2).alias("path_length_m"), v.alias("coverage_ratio"), F.lit(0.0).alias("outside_safe_area_m"))
    b = F.struct(field, n.alias("baseline_length_m"), (n + 5).alias("risk_aware_length_m"), F.lit(5.0).alias("length_change_m"), v.alias("baseline_mean_risk"),
                 e.alias("risk_aware_mean_risk"), F.round(v - e, 6).alias("risk_reduction"), F.lit(True).alias("feasible"))
    return per.agg(F.to_json(F.struct(F.collect_list(a).alias("fields"), F.collect_list(b).alias("comparison"))).alias("doc"))  # two fields


FIELDS = "fields array<struct<field_id:string,target_area_m2:bigint,swath_count:bigint,path_length_m:bigint,coverage_ratio:double,outside_safe_area_m:double>>"
COMPARISON = """comparison array<struct<field_id:string,baseline_length_m:bigint,risk_aware_length_m:bigint,length_change_m:double,
 baseline_mean_risk:double,risk_aware_mean_risk:double,risk_reduction:double,feasible:boolean>>"""
_PER_SIDE = ' ps AS (SELECT CAST(1 + ("row" // 8) % 2 AS INT) side_id, count(*) n, round(avg(ndvi), 6) v, round(avg(ndre), 6) e FROM f GROUP BY 1)'


@query("SELECT 'field_' || side_id AS field, n AS area, n % 7 AS swaths, n * 2 AS length, v AS coverage, 0.0::DOUBLE AS outside FROM ps", _PER_SIDE)
def experiment_geometry(spark, sf_dir):
    """The geometry-only experiment: a list of fields as rows, its six columns renamed."""
    d = experiment_documents(spark, sf_dir).select(F.from_json("doc", FIELDS).alias("d"))
    return d.select(F.inline("d.fields")).toDF("field", "area", "swaths", "length", "coverage", "outside")


@query("SELECT 'field_' || side_id AS field, n AS baseline_m, n + 5 AS risk_aware_m, 5.0::DOUBLE AS change_m, v AS baseline_risk, e AS risk_aware_risk, round(v - e, 6) AS reduction, true AS feasible FROM ps", _PER_SIDE)
def experiment_risk(spark, sf_dir):
    """Baseline against risk-aware routes: a list of comparisons as rows, its eight columns renamed."""
    d = experiment_documents(spark, sf_dir).select(F.from_json("doc", COMPARISON).alias("d"))
    return d.select(F.inline("d.comparison")).toDF("field", "baseline_m", "risk_aware_m", "change_m", "baseline_risk", "risk_aware_risk", "reduction", "feasible")


@query("SELECT side_id AS field_id, count(*) AS lines, count(DISTINCT patch_id) AS patches, round(sum(abs(x2 - x1)), 6) AS length_m, CAST(min(least(x1, x2)) AS DOUBLE) AS west, CAST(max(greatest(x1, x2)) AS DOUBLE) AS east FROM rt GROUP BY side_id", _ROUTE, True)
def mission_layers(spark, sf_dir):
    """The map's layers by field: swaths, patches, length and extent."""
    s = patch_route(spark, sf_dir)[0].groupBy(F.col("side_id").alias("field_id"))
    per = s.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("patch_id").alias("patches"), F.sum(F.abs(F.col("x2") - F.col("x1"))).alias("length_m"),
                F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"))
    return rounded(per, "length_m")


@query("SELECT 'swath' AS segment_type, count(*) AS n, round(sum(x_to - x), 6) AS length_m FROM sg", _SWATHS, True)
def swath_totals(spark, sf_dir):
    """Number and metres of the swaths of the assembled routes, which run at the rows' angle: routing round corners mustn't change them."""
    from fieldloom.plans.missions import whole_route

    s = whole_route(spark, sf_dir).filter("segment_type = 'swath'")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return rounded(s.groupBy("segment_type").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("length_m")), "length_m")


def _places(spark, sf_dir):
    """row, col of the whole raster, stored for all methods."""
    return stored(pixels(spark, sf_dir).select("row", "col"))


def _zones_of(places, labelled):
    """All places with the zones of labelled canopy pixels; soil is 0."""
    z = Z.map_labels(labelled, Z.order_labels(labelled, "f1"), None).select("row", "col", "zone")
    return stored(places.join(z, ["row", "col"], "left").withColumn("zone", F.coalesce("zone", F.lit(0))))


@query()
def method_missions(spark, sf_dir):
    """Segments and metres of the nitrogen mission on each clustering method's zones."""
    p, places = points(spark, sf_dir), _places(spark, sf_dir)
    # every method labels the whole canopy, so all maps have one field
    canopy = places.join(p.select("row", "col", F.lit(1).alias("zone")), ["row", "col"], "left").fillna(0, ["zone"])
    field = stored(M.field_mask(canopy))
    out = [P.mission(_zones_of(places, t), name, "nitrogen", field=field).select("mission", "x1", "y1", "x2", "y2") for name, t in C.fit_all(p, K).items()]
    return P.path_length(reduce(lambda a, b: a.unionByName(b), out))


@query()
def full_comparison(spark, sf_dir):
    """Quality, balance and variance reduction before and after smoothing of fuzzy C-means, K-Means and the mixture, rounded."""
    p, places, out = points(spark, sf_dir), _places(spark, sf_dir), []
    for name, t in C.fit_all(p, K, ("fuzzy", "kmeans", "gmm")).items():
        t = stored(t)
        zone_map = _zones_of(places, t)
        smooth = M.smooth_zones(zone_map, 12).filter("zone > 0").select("row", "col", (F.col("zone") - 1).alias("label"))
        after = Q.variance_reduction(p.join(smooth, ["row", "col"])).withColumnRenamed("vri", "vri_smoothed")
        one = Q.silhouette(t).drop("n").crossJoin(Q.davies_bouldin(t)).crossJoin(Q.calinski_harabasz(t)).crossJoin(Q.variance_reduction(t)).crossJoin(after)  # one row each
        out.append(rounded(one.crossJoin(Q.balance(zone_map, K)), "silhouette", "db", "ch", places=3).withColumns({c: F.round(c, 2) for c in ("vri", "vri_smoothed")}).withColumn("method", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), out)


@query()
def fuzziness_zone_maps(spark, sf_dir):
    """Zone maps for each fuzziness m: fitted, ordered by the index, smoothed, every tenth row and column."""
    p, places, out = points(spark, sf_dir), _places(spark, sf_dir), []
    for m in (1.5, 2.0, 2.5, 3.0):
        u = C.memberships(p, C.by_first(C.fuzzy_means(p, K, m, 100)[0]), m)
        labelled = u.withColumn("label", (F.array_position("u", F.array_max("u")) - 1).cast("int")).drop("u")
        smooth = M.smooth_zones(_zones_of(places, labelled), 12)
        out.append(R.decimate_nearest(smooth, 10).select("row", "col", "zone", F.lit(m).alias("m")))
    return reduce(lambda a, b: a.unionByName(b), out)


@query()
def artifact_inventory(spark, sf_dir):
    """The input tables by name: whether each is there, and its size in KB to one place."""
    return files.inventory(spark, sf_dir, [f"{n}.parquet" for n in ("orders", "lineitem", "embeddings", "no_such_table")])


#: Corner and step, in degrees, of a geographic grid for the raster.
LAT, LON, STEP = 38.7, -9.1, 0.00002


def _degrees(spark, sf_dir):
    return pixels(spark, sf_dir).select("row", "col", (LAT - F.col("row") * STEP).alias("lat"), (LON + F.col("col") * STEP).alias("lon"))


_DEGREES = f""" dg AS (SELECT "row", col, {LAT!r}::DOUBLE - "row" * {STEP!r}::DOUBLE lat, {LON!r}::DOUBLE + col * {STEP!r}::DOUBLE lon FROM f),
 el AS (SELECT 6378137.0::DOUBLE a, 1 / 298.257223563::DOUBLE fl)"""


@query(f"""SELECT "row", round(6378137.0::DOUBLE * radians({STEP!r}::DOUBLE) * cos(radians(lat)) / sqrt(1 - fl * (2 - fl) * sin(radians(lat)) ** 2), 6) AS east_m,
 round(2 * abs(0.6::DOUBLE), 6) AS projected_m FROM dg, el WHERE col = 0""", _DEGREES)
def pixel_metres(spark, sf_dir):
    """Width in metres of a pixel of each row on a geographic grid, and of a pixel of 0.6 m decimated by two on a projected one."""
    d = _degrees(spark, sf_dir).filter("col = 0")
    return rounded(d.select("row", geodesy.step_size(F.lit(STEP), True, F.col("lat"), F.col("lon")).alias("east_m"), geodesy.step_size(F.lit(-0.6), False, F.col("lat"), F.col("lon"), 2).alias("projected_m")), "east_m", "projected_m")


@query("""SELECT "row", col, round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS easting,
 round(r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS northing FROM
 (SELECT *, atan2(t, cos(off)) xi, atanh(sin(off) / sqrt(1 + t * t)) eta FROM (SELECT *, sinh(atanh(sin(radians(lat))) - k * atanh(k * sin(radians(lat)))) t, radians(lon + 9) off FROM
 (SELECT dg.*, 0.9996::DOUBLE * a / (1 + n) * (1 + n * n / 4 + n ** 4 / 64) r, 2 * sqrt(n) / (1 + n) k, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 a2, 61 * n ** 3 / 240 a3
  FROM dg, (SELECT a, fl / (2 - fl) n FROM el))))""", _DEGREES)
def utm_points(spark, sf_dir):
    """The pixels' centres in metres of the metric grid."""
    east, north = geodesy.utm(F.col("lat"), F.col("lon"))
    return rounded(_degrees(spark, sf_dir).select("row", "col", east.alias("easting"), north.alias("northing")), "easting", "northing", places=3)


@query()
def rotated_mission(spark, sf_dir):
    """The older mission on the map turned to a row direction of 20 degrees, and turned back."""
    z = stored(zoned(spark, sf_dir).select("row", "col", "zone"))
    return P.rotated_mission(z, "water", "water", 20.0)
