"""Queries on contour lines, densities, hexagonal bins and a raster warped to metres."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import surfaces as V
from fieldloom.plans.rasters import pixels, rounded, zoned
from fieldloom.plans.registry import query
from fieldloom.session import stored
from fieldloom.sources import geodesy

#: The fixture as a raster in degrees, and the metric grid that it is brought to: corners and pixels (see geodesy.warp_to_metric).
DEGREES, METRES = (-8.0, 41.2, 1e-5, 1e-5), (583847.0, 4561441.0, 0.9)

_LEVELS = f""" lr AS (SELECT min(elev) lo, max(elev) hi FROM f WHERE elev > 0), lw AS (SELECT lo, hi, (hi - lo) / 16 raw FROM lr),
 ls AS (SELECT lo, hi, min(s * pow(10.0, floor(log10(raw)))) st FROM lw, (SELECT unnest({list(V.NICE)})::DOUBLE s) WHERE s * pow(10.0, floor(log10(raw))) >= raw * (1 - 1e-12) GROUP BY ALL),
 lv AS (SELECT CAST(row_number() OVER (ORDER BY z) - 1 AS INT) level, z FROM (SELECT lo, hi, unnest(range(CAST(floor(lo / st) AS BIGINT) + 1, CAST(ceil(hi / st) AS BIGINT))) * st z FROM ls) WHERE z > lo AND z < hi),
 sq AS (SELECT a."row" r, a.col c, a.elev v, b.elev w, d.elev t, e.elev s FROM f a JOIN f b ON b."row" = a."row" AND b.col = a.col + 1 JOIN f d ON d."row" = a."row" + 1 AND d.col = a.col + 1
  JOIN f e ON e."row" = a."row" + 1 AND e.col = a.col WHERE least(a.elev, b.elev, d.elev, e.elev) > 0),
 mq AS (SELECT *, v >= z hv, w >= z hw, t >= z ht, s >= z hs, (v + w + t + s) / 4 >= z hi, (z - v) / (w - v) nx, (z - w) / (t - w) ey, (z - s) / (t - s) sx, (z - v) / (s - v) wy FROM sq JOIN lv ON least(v, w, t, s) < z AND greatest(v, w, t, s) >= z),
 ed AS (SELECT *, hv <> hw n, hw <> ht e, ht <> hs b, hs <> hv l, sqrt((1 - nx) ** 2 + ey ** 2) ne, sqrt((nx - sx) ** 2 + 1) ns, sqrt(nx ** 2 + wy ** 2) nw, sqrt((1 - sx) ** 2 + (1 - ey) ** 2) es, sqrt(1 + (ey - wy) ** 2) ew, sqrt(sx ** 2 + (1 - wy) ** 2) sw FROM mq),
 pl AS (SELECT level, (n::INT + e::INT + b::INT + l::INT) // 2 pieces, CASE WHEN n AND e AND b AND l THEN CASE WHEN hv = hi THEN ne + sw ELSE nw + es END
  WHEN n AND e THEN ne WHEN n AND b THEN ns WHEN n AND l THEN nw WHEN e AND b THEN es WHEN e AND l THEN ew ELSE sw END len FROM ed),
 ee AS (SELECT level, k, count(*) m FROM (SELECT level, (r, c, 0) k FROM ed WHERE n UNION ALL SELECT level, (r, c + 1, 1) FROM ed WHERE e UNION ALL SELECT level, (r + 1, c, 0) FROM ed WHERE b UNION ALL SELECT level, (r, c, 1) FROM ed WHERE l) GROUP BY ALL)"""


def _pieces(spark, sf_dir):
    px = pixels(spark, sf_dir)
    r = px.filter("elev > 0").agg(F.min("elev").alias("low"), F.max("elev").alias("high")).first()
    levels = V.nice_levels(r["low"], r["high"]) if r["low"] is not None else []
    return stored(V.contour_segments(px, levels)), levels


@query("""SELECT level, any_value(round(z, 6)) AS height, CAST(sum(pieces) AS BIGINT) AS pieces, round(sum(len), 5) AS length_px, (SELECT count(*) FROM ee WHERE m = 1 AND ee.level = pl.level) AS open_ends
 FROM pl JOIN lv USING (level) GROUP BY level""", _LEVELS)
def contour_totals(spark, sf_dir):
    """Pieces, length in pixels and loose ends of the contour lines of each level."""
    pieces, levels = _pieces(spark, sf_dir)
    table = F.create_map(*[F.lit(x) for i, z in enumerate(levels) for x in (i, float(z))]) if levels else F.lit(None).cast("map<int,double>")
    ends = pieces.select("level", F.explode(F.array("tail", "head")).alias("id")).groupBy("level", "id").agg(F.count(F.lit(1)).alias("m")).groupBy("level").agg(F.count_if(F.col("m") == 1).alias("open_ends"))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    met = pieces.groupBy("level").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(length), 5).alias("length_px")).join(ends, "level")
    return met.select("level", F.round(table[F.col("level")], 6).alias("height"), "pieces", "length_px", "open_ends")


@query()
def contour_lines(spark, sf_dir):
    """Every contour line: its level, pieces, whether it is closed, and its length in pixels."""
    lines = V.contour_lines(_pieces(spark, sf_dir)[0])
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return lines.groupBy("level", "line", "closed").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(length), 6).alias("length_px"))


@query("""SELECT zone, CAST(place AS INT) AS place, round(lo + (hi - lo) * place / 99, 6) AS "at", round(sum(c * exp(-0.5 * o * o)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM
 (SELECT zone, place, c, n, h, lo, hi, (lo + (hi - lo) * place / 99 - mean) / h o FROM kc JOIN ks USING (zone), (SELECT unnest(range(100)) place)) GROUP BY zone, place, lo, hi""",
       """ ks AS (SELECT zone, min(ndre) lo, max(ndre) hi, count(*) n, stddev_samp(ndre) * pow(count(*), -0.2) h FROM z WHERE zone > 0 GROUP BY 1),
 kc AS (SELECT zone, least(floor((ndre - lo) / (hi - lo) * 512), 511) bin, count(*) c, avg(ndre) mean FROM z JOIN ks USING (zone) GROUP BY 1, 2)""")
def zone_densities(spark, sf_dir):
    return rounded(V.kernel_density(zoned(spark, sf_dir).filter("zone > 0"), "zone", "ndre"), "at", "density")


@query("""SELECT round(x0 + hx * sx, 6) AS x, round(y0 + hy * sy, 6) AS y, count(*) AS n FROM (SELECT *, CASE WHEN a < b THEN floor(ix + 0.5) ELSE floor(ix) + 0.5 END hx, CASE WHEN a < b THEN floor(iy + 0.5) ELSE floor(iy) + 0.5 END hy FROM
 (SELECT *, (ix - floor(ix + 0.5)) ** 2 + 3 * (iy - floor(iy + 0.5)) ** 2 a, (ix - floor(ix) - 0.5) ** 2 + 3 * (iy - floor(iy) - 0.5) ** 2 b FROM
 (SELECT x0, y0, sx, sy, (ndre - x0) / sx ix, (ndvi - y0) / sy iy FROM f, (SELECT min(ndre) x0, min(ndvi) y0, (max(ndre) - min(ndre)) / 50 sx, (max(ndvi) - min(ndvi)) / 28 sy FROM f)))) GROUP BY x0, y0, sx, sy, hx, hy""")
def hexagon_counts(spark, sf_dir):
    return rounded(V.hexagons(pixels(spark, sf_dir), "ndre", "ndvi"), "x", "y")


def _inverse_sql() -> str:
    """The grid's places as rows and columns of the raster in degrees, written out for DuckDB."""
    n = geodesy.FLATTENING / (2 - geodesy.FLATTENING)
    radius = geodesy.UTM_SCALE * geodesy.AXIS_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    bend = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    num = lambda v: f"{v!r}::DOUBLE"
    hyp = lambda e, sign: f"((exp({e}) {sign} exp(-({e}))) / 2)"
    up = "xi" + "".join(f" - {num(b)} * sin({2 * j} * xi) * {hyp(f'{2 * j} * eta', '+')}" for j, b in enumerate(back, 1))
    side = "eta" + "".join(f" - {num(b)} * cos({2 * j} * xi) * {hyp(f'{2 * j} * eta', '-')}" for j, b in enumerate(back, 1))
    lat = "chi" + "".join(f" + {num(d)} * sin({2 * j} * chi)" for j, d in enumerate(bend, 1))
    (left, top, dx, dy), (east, north, cell) = DEGREES, METRES
    return f""" w1 AS (SELECT "row" r, col c, ({north} - ("row" + 0.5::DOUBLE) * {cell}) / {num(radius)} xi, ({east} + (col + 0.5::DOUBLE) * {cell} - {geodesy.FALSE_EASTING_M}) / {num(radius)} eta FROM f),
 w2 AS (SELECT r, c, {up} u, {side} d FROM w1), w3 AS (SELECT r, c, asin(sin(u) / {hyp('d', '+')}) chi, degrees(atan2({hyp('d', '-')}, cos(u))) + {6 * geodesy.ZONE - 183} lon FROM w2),
 w4 AS (SELECT r, c, ({top} - degrees({lat})) / {num(dy)} - 0.5 y, (lon - {num(left)}) / {num(dx)} - 0.5 x FROM w3),
 w5 AS (SELECT r, c, CAST(floor(y) + i AS INT) sr, CAST(floor(x) + j AS INT) sc, (1 - abs(y - floor(y) - i)) * (1 - abs(x - floor(x) - j)) wt FROM w4, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))"""


@query("""SELECT w5.r AS "row", w5.c AS col, round(CASE WHEN sum(wt) FILTER (elev IS NOT NULL) > 0 THEN sum(wt * elev) / sum(wt) FILTER (elev IS NOT NULL) END, 3) AS elev
 FROM w5 LEFT JOIN f ON f."row" = sr AND f.col = sc GROUP BY w5.r, w5.c""", _inverse_sql())
def warped_elevation(spark, sf_dir):
    """The heights, taken as a raster in degrees, at the pixels of a metric grid."""
    px = pixels(spark, sf_dir)
    return rounded(geodesy.warp_to_metric(px.select("row", "col", "elev"), px, DEGREES, METRES), "elev", places=3)
