"""Queries on sweeps, missions, side-wise plans and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.operators import geometry as G
from fieldloom.operators import missions as P
from fieldloom.operators import morphology as M
from fieldloom.operators import routing
from fieldloom.operators import sidewise as S
from fieldloom.operators import zones as Z
from fieldloom.plans.rasters import _FIELD, pixels, rounded, sided, zoned
from fieldloom.plans.registry import query
from fieldloom.session import scratch, stored
from fieldloom.sources import files
from fieldloom.sources import raster as R

_SWEEP = """ sw AS (SELECT min(col) x1, "row" y1, max(col) x2, "row" y2 FROM (SELECT "row", col, col - row_number() OVER (PARTITION BY "row" ORDER BY col) k FROM f WHERE ndre > 0.42 AND "row" % 4 = 0) GROUP BY "row", k HAVING count(*) > 3)"""


def swept(spark, sf_dir):
    return P.sweep(pixels(spark, sf_dir).filter("ndre > 0.42"), 4)


@query("SELECT * FROM sw", _SWEEP)
def sweep_segments(spark, sf_dir):
    return swept(spark, sf_dir)


@query("SELECT CAST(seq AS INT) AS seq, CASE WHEN seq % 2 = 1 THEN x2 ELSE x1 END AS x1, y1, CASE WHEN seq % 2 = 1 THEN x1 ELSE x2 END AS x2, y2 FROM (SELECT *, row_number() OVER (ORDER BY y1, x1) - 1 seq FROM sw)", _SWEEP)
def snake_flip(spark, sf_dir):
    return P.snake(P.numbered(swept(spark, sf_dir)))


_VINE = """ vr AS (SELECT min(col) x1, "row" y1, max(col) x2, "row" y2 FROM (SELECT "row", col, col - row_number() OVER (PARTITION BY "row" ORDER BY col) k FROM z WHERE ndre > 0.25 AND zone > 0 AND "row" % 4 = 0) GROUP BY "row", k HAVING count(*) > 3)"""


def vines(spark, sf_dir):
    """Zones with gaps in the rows: weak canopy counts as soil."""
    return zoned(spark, sf_dir).withColumn("zone", F.when(F.col("ndre") > 0.25, F.col("zone")).otherwise(0))


@query("""SELECT x1, y1, x2, y2 FROM vr WHERE EXISTS (SELECT 1 FROM need WHERE "row" = y1 AND col BETWEEN x1 AND x2)
 OR EXISTS (SELECT 1 FROM need WHERE "row" = y1 AND col < x1) AND (EXISTS (SELECT 1 FROM need WHERE "row" = y1 AND col > x2) OR x2 = (SELECT max(col) FROM z))""",
       _VINE + ', need AS (SELECT "row", col FROM z WHERE ndre > 0.25 AND zone >= 1 AND zone < 3)')
def vine_sweeps_nitrogen(spark, sf_dir):
    return P.vine_sweep(vines(spark, sf_dir), 4, "nitrogen")


@query("SELECT * FROM vr", _VINE)
def vine_sweeps_water(spark, sf_dir):
    return P.vine_sweep(vines(spark, sf_dir), 4, "water")


_CORRIDOR = _FIELD + """, cr AS (SELECT z."row", z.col FROM z JOIN fm ON fm."row" = z."row" AND fm.col = z.col WHERE zone = 0 AND EXISTS (SELECT 1 FROM z t WHERE t.zone > 0 AND t."row" BETWEEN z."row" - 8 AND z."row" + 8 AND abs(t."row" - z."row") + abs(t.col - z.col) <= 8))"""


@query('SELECT "row", col FROM cr', _CORRIDOR, True)
def corridor_mask(spark, sf_dir):
    z = zoned(spark, sf_dir)
    return P.corridor(z, Z.target(z, "water"), 8)


_RUNS = "SELECT min(col) AS x1, \"row\" AS y1, max(col) AS x2, \"row\" AS y2 FROM (SELECT \"row\", col, col - row_number() OVER (PARTITION BY \"row\" ORDER BY col) k FROM {} WHERE \"row\" % 4 = 0{}) GROUP BY \"row\", k HAVING count(*) > 3"


@query("SELECT * FROM ca WHERE (SELECT count(*) FROM ca) >= 3 UNION ALL SELECT * FROM ta WHERE (SELECT count(*) FROM ca) < 3", f"{_CORRIDOR}, ca AS ({_RUNS.format('cr', '')}), ta AS ({_RUNS.format('z', ' AND zone > 0')})", True)
def zone_swaths(spark, sf_dir):
    return P.swaths(zoned(spark, sf_dir), "water")


@query()
def nn_chain(spark, sf_dir):
    return P.chained(swept(spark, sf_dir).withColumn("mission", F.lit("water")))


@query("SELECT 'water' AS mission, count(*) AS segments, CAST(round(sum(x2 - x1) * 2.0, 6) AS DOUBLE) AS length_m FROM sw", _SWEEP)
def swath_length(spark, sf_dir):
    return rounded(P.path_length(swept(spark, sf_dir).withColumn("mission", F.lit("water")), 2.0), "length_m")


@query()
def water_mission(spark, sf_dir):
    return P.mission(stored(zoned(spark, sf_dir)), "water")


@query()
def slope_aware_mission(spark, sf_dir):
    """Nitrogen mission whose connectors avoid steep and high-vigour pixels."""
    z = stored(zoned(spark, sf_dir))
    slopes = M.slope(z, 1.0)
    return P.mission(z, "nitrogen", cost=stored(M.cost_grid(z, "nitrogen", slopes)))


@query()
def astar_transitions(spark, sf_dir):
    z = stored(zoned(spark, sf_dir))
    chain = stored(P.chained(P.swaths(z, "water").withColumn("mission", F.lit("water"))))
    return P.connected(chain, stored(M.cost_grid(z, "nitrogen")))


def far_legs(spark, sf_dir):
    """The legs and the cost grid of `far_connectors`."""
    px = stored(pixels(spark, sf_dir))
    chain = stored(P.chained(P.swaths(stored(Z.threshold_zones(px)), "water").withColumn("mission", F.lit("water"))))
    w = Window.partitionBy("mission").orderBy("seq")
    legs = chain.select("mission", "seq", F.col("x2").alias("ax"), F.col("y2").alias("ay"), F.lead("x1", 5).over(w).alias("bx"), F.lead("y1", 5).over(w).alias("by")).filter("bx is not null")
    cost = stored(px.filter("ndre < 0.5").select("row", "col", (1 + 4 * F.greatest("ndre", F.lit(0.0))).alias("cost")))
    return legs, cost


@query()
def far_connectors(spark, sf_dir):
    """Paths from each swath of the water mission's chain to the fifth after it, by tiles of 64 pixels: dense canopy is closed, other pixels
    cost more the denser they are. Steps and cost of each."""
    legs, cost = far_legs(spark, sf_dir)
    hops = routing.far_paths(legs, cost, P.DIAGONAL, 64)
    paid = hops.join(cost.select(F.col("row").cast("double").alias("y2"), F.col("col").cast("double").alias("x2"), "cost"), ["x2", "y2"], "left")
    step = F.col("cost") * F.when((F.col("x1") == F.col("x2")) | (F.col("y1") == F.col("y2")), 1.0).otherwise(P.DIAGONAL)
    return paid.groupBy("mission", "seq", "routed").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum(F.when(F.col("routed"), step)), 6).alias("cost"))


@query("""SELECT CAST(round((SELECT sum(x2 - x1) FROM sg)) AS DOUBLE) AS length_m, round(100.0 * count(*) FILTER (EXISTS (SELECT 1 FROM sg WHERE y1 BETWEEN z."row" - 8 AND z."row" + 8 AND abs(y1 - z."row") + greatest(x1 - z.col, z.col - x2, 0) <= 8)) / count(*), 1) AS served_pct FROM z WHERE zone >= 1""",
       f"{_CORRIDOR}, ca AS ({_RUNS.format('cr', '')}), ta AS ({_RUNS.format('z', ' AND zone > 0')}), sg AS (SELECT * FROM ca WHERE (SELECT count(*) FROM ca) >= 3 UNION ALL SELECT * FROM ta WHERE (SELECT count(*) FROM ca) < 3)", True)
def mission_coverage(spark, sf_dir):
    z = stored(zoned(spark, sf_dir))
    return P.served(P.swaths(z, "water"), Z.target(z, "water"), z)


@query()
def mission_comparison(spark, sf_dir):
    """Segments and metres of each rule's mission, simple and slope-aware, and of the older snake."""
    z = stored(zoned(spark, sf_dir))
    field, slopes, out = stored(M.field_mask(z)), stored(M.slope(z, 1.0)), []
    for rule in ("water", "nitrogen"):
        chain = P.ordered(z, rule, rule, field=field)  # both modes drive the same swaths in the same order
        out.append(P.joined_up(chain))
        out.append(P.joined_up(chain.withColumn("mission", F.lit(f"{rule}_slope")), stored(M.cost_grid(z, rule, slopes, field=field))))
    out.append(P.snake_mission(z, "nitrogen").select(F.lit("snake").alias("mission"), "x1", "y1", "x2", "y2"))
    return P.path_length(reduce(lambda a, b: a.unionByName(b), [t.select("mission", "x1", "y1", "x2", "y2") for t in out]))


@query()
def p80_mission(spark, sf_dir):
    z = stored(zoned(spark, sf_dir))
    return P.mission(z, "p80", target=Z.percentile_target(z.filter("zone > 0"), "ndre"))


@query()
def row_direction(spark, sf_dir):
    return P.row_angle(pixels(spark, sf_dir))


_SIDE_PATCH = """ s AS (SELECT *, CAST(1 + ("row" // 8) % 2 AS INT) side_id FROM f), t AS (SELECT side_id, quantile_cont(ndvi, 0.8) p80 FROM s GROUP BY 1),
 cells AS (SELECT side_id grp, "row", col FROM s JOIN t USING (side_id) WHERE ndvi >= p80), isl AS (SELECT grp, "row", col, col - row_number() OVER (PARTITION BY grp, "row" ORDER BY col) k FROM cells),
 rn AS (SELECT grp, "row", min(col) c0, max(col) c1, CAST("row" AS BIGINT) * 4294967296 + min(col) run FROM isl GROUP BY grp, "row", k),
 ed AS (SELECT a.grp, a.run a, b.run b FROM rn a JOIN rn b ON a.grp = b.grp AND abs(a."row" - b."row") = 1 AND a.c0 <= b.c1 AND b.c0 <= a.c1),
 re AS (SELECT grp, run node, run root FROM rn UNION SELECT re.grp, ed.b, re.root FROM re JOIN ed ON ed.grp = re.grp AND ed.a = re.node AND re.root < ed.b),
 comp AS (SELECT grp, node, min(root) root FROM re GROUP BY grp, node),
 pc AS (SELECT c.grp, c.root, rn."row", unnest(range(rn.c0, rn.c1 + 1)) col FROM comp c JOIN rn ON rn.grp = c.grp AND rn.run = c.node),
 pn AS (SELECT grp, root, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, min("row" * 100000 + col)) patch_id FROM pc GROUP BY grp, root)"""


def side_patches(spark, sf_dir, survey=None):
    return S.patches(S.side_targets((sided(spark, sf_dir) if survey is None else survey).withColumn("priority", F.col("ndvi"))))


@query('SELECT pc.grp AS side_id, CAST(patch_id AS INT) AS patch_id, "row", CAST(col AS INT) AS col FROM pc JOIN pn ON pn.grp = pc.grp AND pn.root = pc.root', _SIDE_PATCH, True)
def sidewise_patches(spark, sf_dir):
    return side_patches(spark, sf_dir).select("side_id", "patch_id", "row", "col")


#: The rows' angle on the map, in degrees; a survey brings its own.
ANGLE = 17.0
#: The borders of the patches' cells, one side a metre, with the patch to the left.
_BORDER = """, pp AS (SELECT pc.grp side_id, pn.patch_id, "row" r, col c FROM pc JOIN pn ON pn.grp = pc.grp AND pn.root = pc.root),
 bo AS (SELECT side_id, patch_id, c x1, r y1, c + 1 x2, r y2 FROM pp a WHERE NOT EXISTS (SELECT 1 FROM pp b WHERE b.side_id = a.side_id AND b.patch_id = a.patch_id AND b.r = a.r - 1 AND b.c = a.c)
  UNION ALL SELECT side_id, patch_id, c + 1, r + 1, c, r + 1 FROM pp a WHERE NOT EXISTS (SELECT 1 FROM pp b WHERE b.side_id = a.side_id AND b.patch_id = a.patch_id AND b.r = a.r + 1 AND b.c = a.c)
  UNION ALL SELECT side_id, patch_id, c, r + 1, c, r FROM pp a WHERE NOT EXISTS (SELECT 1 FROM pp b WHERE b.side_id = a.side_id AND b.patch_id = a.patch_id AND b.r = a.r AND b.c = a.c - 1)
  UNION ALL SELECT side_id, patch_id, c + 1, r, c + 1, r + 1 FROM pp a WHERE NOT EXISTS (SELECT 1 FROM pp b WHERE b.side_id = a.side_id AND b.patch_id = a.patch_id AND b.r = a.r AND b.c = a.c + 1))"""
_SWATHS = _SIDE_PATCH + _BORDER + f""", ce AS (SELECT side_id, patch_id, avg(c + 0.5) cx, avg(r + 0.5) cy FROM pp GROUP BY 1, 2),
 tu AS (SELECT bo.side_id, bo.patch_id, cx, cy, cx + (x1 - cx) * cos(radians({ANGLE})) + (y1 - cy) * sin(radians({ANGLE})) x1, cy - (x1 - cx) * sin(radians({ANGLE})) + (y1 - cy) * cos(radians({ANGLE})) y1,
  cx + (x2 - cx) * cos(radians({ANGLE})) + (y2 - cy) * sin(radians({ANGLE})) x2, cy - (x2 - cx) * sin(radians({ANGLE})) + (y2 - cy) * cos(radians({ANGLE})) y2 FROM bo JOIN ce USING (side_id, patch_id)),
 ba AS (SELECT side_id, patch_id, floor(min(least(y1, y2)) / 1.2) base FROM tu GROUP BY 1, 2),
 ht AS (SELECT *, x1 + (k * 1.2 - y1) / (y2 - y1) * (x2 - x1) x FROM (SELECT *, unnest(range(CAST(ceil(least(y1, y2) / 1.2) AS BIGINT), CAST(ceil(greatest(y1, y2) / 1.2) AS BIGINT))) k FROM tu)),
 pr AS (SELECT *, lead(x) OVER w x_to, row_number() OVER w i FROM ht WINDOW w AS (PARTITION BY side_id, patch_id, k ORDER BY x)),
 sg AS (SELECT pr.*, k - base row_index, row_number() OVER (PARTITION BY pr.side_id, pr.patch_id ORDER BY k, x) segment_id FROM pr JOIN ba USING (side_id, patch_id) WHERE i % 2 = 1 AND x_to - x >= 1.0)"""


def patch_corners(spark, sf_dir):
    """The rings of the side patches' outlines; cells are a metre wide."""
    return G.traced(_target(spark, sf_dir), 1.0, "side_id", "patch_id")


def row_swaths(spark, sf_dir, cells=None):
    """Swaths at the rows' angle on the traced outlines of the side patches."""
    middle = lambda c: F.avg(F.col(c) + 0.5)
    cells = _target(spark, sf_dir) if cells is None else cells
    centres = cells.groupBy("side_id", "patch_id").agg(middle("col").alias("cx"), middle("row").alias("cy"))
    sides = G.cell_borders(cells, 1.0, "side_id", "patch_id")
    return S.row_swaths(sides, centres, ANGLE, "side_id", "patch_id")


@query(f"""SELECT side_id, CAST(patch_id AS INT) AS patch_id, CAST(row_index AS INT) AS row_index, CAST(segment_id AS INT) AS segment_id, round(x_to - x, 6) AS length_m,
 round(cx + (x - cx) * cos(radians({ANGLE})) - (k * 1.2 - cy) * sin(radians({ANGLE})), 6) AS x1, round(cy + (x - cx) * sin(radians({ANGLE})) + (k * 1.2 - cy) * cos(radians({ANGLE})), 6) AS y1 FROM sg""", _SWATHS, True)
def scanline_swaths(spark, sf_dir):
    s = row_swaths(spark, sf_dir).withColumn("length_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return rounded(s.select("side_id", "patch_id", "row_index", "segment_id", "length_m", "x1", "y1"), "length_m", "x1", "y1")


@query("""SELECT side_id, CAST(patch_id AS INT) AS patch_id, CAST(2 - (ou - re) // 4 AS BIGINT) AS rings, ou + re AS corners, CAST(sides AS BIGINT) AS border_m, CAST(n AS DOUBLE) AS area_m2 FROM
 (SELECT side_id, patch_id, count(*) FILTER (d) AS ou, count(*) FILTER (NOT d) AS re FROM
   (SELECT a.side_id, a.patch_id, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) > 0 d FROM bo a JOIN bo b ON a.side_id = b.side_id AND a.patch_id = b.patch_id AND a.x2 = b.x1 AND a.y2 = b.y1
    WHERE (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) <> 0
    AND ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) > 0 OR (SELECT count(*) FROM bo o WHERE o.side_id = a.side_id AND o.patch_id = a.patch_id AND o.x1 = a.x2 AND o.y1 = a.y2) = 1)) GROUP BY 1, 2)
 JOIN (SELECT side_id, patch_id, count(*) sides FROM bo GROUP BY 1, 2) USING (side_id, patch_id) JOIN (SELECT side_id, patch_id, count(*) n FROM pp GROUP BY 1, 2) USING (side_id, patch_id)""", _SIDE_PATCH + _BORDER, True)
def patch_rings(spark, sf_dir):
    """Outer rings and holes of each patch: left corners less right ones are four for an outer ring and minus four for a hole."""
    keys = ["side_id", "patch_id"]
    corners = stored(patch_corners(spark, sf_dir))
    sides = G.corner_sides(corners, *keys).groupBy(*keys).agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).cast("long").alias("border_m"))
    per = corners.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("n"), F.first("signed_m2").alias("m2")).groupBy(*keys).agg(F.count(F.lit(1)).alias("rings"), F.sum("n").alias("corners"), F.sum("m2").alias("area_m2"))
    return per.join(sides, keys)


#: A field's outline for each side, from the table: a triangle over its cells.
_TRIANGLE = """ fo AS (SELECT side_id, min(col) * 1.0 x0, max(col) + 1.0 x1, min("row") * 1.0 y0, max("row") + 1.0 y1, avg(col) xa FROM s GROUP BY side_id)"""


def side_triangles(spark, sf_dir):
    """side_id and the sides of a triangle: the lower corners of the side's box and a point at its top over the mean column."""
    box = sided(spark, sf_dir).groupBy("side_id").agg(F.min("col").cast("double").alias("x0"), (F.max("col") + 1.0).alias("x1"), F.min("row").cast("double").alias("y0"), (F.max("row") + 1.0).alias("y1"), F.avg("col").alias("xa"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return G.ring_sides(box.select("side_id", F.array(point("x0", "y0"), point("x1", "y0"), point("xa", "y1")).alias("points")), "side_id")


def patch_triangles(spark, sf_dir):
    """side_id, patch_id and the sides of the side's triangle, for every patch."""
    patches = _target(spark, sf_dir).select("side_id", "patch_id").distinct()
    return patches.join(F.broadcast(side_triangles(spark, sf_dir)), "side_id")  # three sides for each of two fields


# a run's part of the triangle is linear between the heights where its sides meet the run's ends
@query("""SELECT side_id, CAST(patch_id AS INT) AS patch_id, round(a, 5) AS inside_m2, round(n - a, 5) AS outside_m2, round(n + t - a, 5) AS union_m2 FROM
 (SELECT side_id, patch_id, sum(n) n, sum(a) a FROM
   (SELECT side_id, patch_id, "row", c0, c1, any_value(c1 - c0) n, coalesce(sum((w + w_to) / 2 * (y_to - y)), 0) a FROM
     (SELECT *, greatest(least(x1 + (y - y0) / (y1 - y0) * (xa - x1), c1) - greatest(x0 + (y - y0) / (y1 - y0) * (xa - x0), c0), 0) w,
        greatest(least(x1 + (y_to - y0) / (y1 - y0) * (xa - x1), c1) - greatest(x0 + (y_to - y0) / (y1 - y0) * (xa - x0), c0), 0) w_to FROM
       (SELECT *, lead(y) OVER (PARTITION BY side_id, patch_id, "row", c0 ORDER BY y) y_to FROM
         (SELECT DISTINCT *, unnest(["row", "row" + 1.0] || [least(greatest(v, "row"), "row" + 1.0) FOR v IN [y0 + (c0 - x0) / nullif(xa - x0, 0) * (y1 - y0), y0 + (c1 - x0) / nullif(xa - x0, 0) * (y1 - y0), y0 + (c0 - x1) / nullif(xa - x1, 0) * (y1 - y0), y0 + (c1 - x1) / nullif(xa - x1, 0) * (y1 - y0)] IF v IS NOT NULL]) y
          FROM (SELECT ru.side_id, ru.patch_id, ru.r "row", ru.c0 * 1.0 c0, ru.c1 + 1.0 c1, x0, x1, y0, y1, xa FROM ru JOIN fo USING (side_id)))))
    GROUP BY side_id, patch_id, "row", c0, c1) GROUP BY side_id, patch_id)
 JOIN (SELECT side_id, (x1 - x0) * (y1 - y0) / 2 t FROM fo) USING (side_id)""",
       _SIDE_PATCH + ", pp AS (SELECT pc.grp side_id, pn.patch_id, \"row\" r, col c FROM pc JOIN pn ON pn.grp = pc.grp AND pn.root = pc.root), ru AS (SELECT side_id, patch_id, r, min(c) c0, max(c) c1 FROM (SELECT *, c - row_number() OVER (PARTITION BY side_id, patch_id, r ORDER BY c) k FROM pp) GROUP BY side_id, patch_id, r, k)," + _TRIANGLE, True)
def patch_overlay(spark, sf_dir):
    """Area of each patch inside and outside its field's outline, and of both together, from the overlay of the traced rings."""
    keys = ["side_id", "patch_id"]
    rings = stored(G.corner_sides(patch_corners(spark, sf_dir), *keys))
    fields = stored(patch_triangles(spark, sf_dir))
    areas = [G.area(G.overlay(rings, fields, keep, *keys), *keys).withColumnRenamed("area_m2", name) for keep, name in (("and", "inside_m2"), ("minus", "outside_m2"), ("or", "union_m2"))]
    met = areas[2].join(areas[0], keys, "left").join(areas[1], keys, "left").fillna(0.0)
    return rounded(met.select(*keys, "inside_m2", "outside_m2", "union_m2"), "inside_m2", "outside_m2", "union_m2", places=5)


#: An outline with a hole, in metres, for the polygon queries.
OUTER, HOLE = ((2.0, 1.0), (28.0, 3.0), (30.0, 17.0), (16.0, 9.0), (4.0, 18.0)), ((20.0, 5.0), (25.0, 6.0), (24.0, 9.0))


def rings(spark, sf_dir):
    rows = [(1, i, [{"x": x, "y": y} for x, y in ring]) for i, ring in enumerate((OUTER, HOLE))]
    return spark.createDataFrame(rows, "patch_id int, ring_id int, points array<struct<x:double,y:double>>")


def patch_route(spark, sf_dir):
    """Swaths of the side patches' rows in snake order with straight connectors; cells are a metre wide."""
    r = M.runs(side_patches(spark, sf_dir), "side_id", "patch_id").filter("c1 > c0")
    keys = Window.partitionBy("side_id", "patch_id")
    s = r.select("side_id", "patch_id", F.col("row").alias("row_index"), (F.row_number().over(keys.orderBy("row", "c0")) - 1).alias("segment_id"),
                 (F.col("c0") + 0.5).alias("x1"), (F.col("row") + 0.5).alias("y1"), (F.col("c1") + 0.5).alias("x2"), (F.col("row") + 0.5).alias("y2"))
    swaths = stored(S.snake_rows(s, "side_id", "patch_id"))
    return swaths, S.connectors(swaths, "side_id", "patch_id")


def planned(spark, sf_dir, target=None):
    """The route of every patch over its row-aligned swaths, connectors straight where the patch covers them and by a path inside it elsewhere; and
    the connectors without any. target: the patches' cells, if known."""
    keys = ("side_id", "patch_id")
    target = _target(spark, sf_dir) if target is None else target
    swaths = stored(S.snake_rows(row_swaths(spark, sf_dir, target), *keys))
    judged = stored(S.routed_connectors(S.connectors(swaths, *keys), target, 1.0, *keys))
    return stored(S.patch_routes(swaths, judged, *keys)), judged.filter("status = 'failed'")


def whole_route(spark, sf_dir):
    return planned(spark, sf_dir)[0]


_ROUTE = _SIDE_PATCH + """, pp AS (SELECT pc.grp side_id, pn.patch_id, "row", col FROM pc JOIN pn ON pn.grp = pc.grp AND pn.root = pc.root),
 ru AS (SELECT side_id, patch_id, "row", min(col) c0, max(col) c1 FROM (SELECT *, col - row_number() OVER (PARTITION BY side_id, patch_id, "row" ORDER BY col) k FROM pp) GROUP BY side_id, patch_id, "row", k HAVING count(*) > 1),
 od AS (SELECT *, (dense_rank() OVER (PARTITION BY side_id, patch_id ORDER BY "row") - 1) % 2 = 1 odd FROM ru),
 rt AS (SELECT side_id, patch_id, row_number() OVER (PARTITION BY side_id, patch_id ORDER BY "row", CASE WHEN odd THEN -c0 ELSE c0 END) o, CASE WHEN odd THEN c1 ELSE c0 END + 0.5 x1, "row" + 0.5 y1, CASE WHEN odd THEN c0 ELSE c1 END + 0.5 x2 FROM od)"""


@query("SELECT side_id, CAST(patch_id AS INT) AS patch_id, CAST(o AS INT) AS mission_order, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2 FROM rt", _ROUTE, True)
def snake_rows(spark, sf_dir):
    return patch_route(spark, sf_dir)[0].select("side_id", "patch_id", "mission_order", "x1", "y1", "x2")


@query("""SELECT side_id, CAST(patch_id AS INT) AS patch_id, count(*) AS points, round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y FROM (SELECT side_id, patch_id, x1 + i / n * (x2 - x1) x, y1 y FROM
 (SELECT *, unnest(range(0, CAST(n AS BIGINT) + 1)) i FROM (SELECT *, greatest(1, ceil(abs(x2 - x1) / 0.5)) n FROM rt))) GROUP BY 1, 2""", _ROUTE, True)
def waypoint_totals(spark, sf_dir):
    w = S.waypoints(patch_route(spark, sf_dir)[0], S.WAYPOINT_M, "side_id", "patch_id")
    return rounded(w.groupBy("side_id", "patch_id").agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y")), "sum_x", "sum_y")


@query()
def waypoints_heading(spark, sf_dir):
    return S.waypoints(whole_route(spark, sf_dir), S.WAYPOINT_M, "side_id", "patch_id")


def _surveyed(spark, sf_dir):
    """row, col, side_id, ndvi and zone of the raster, stored: all tables of a measured mission come from it."""
    return stored(Z.threshold_zones(sided(spark, sf_dir)).select("row", "col", "side_id", "ndvi", "zone"))


def _target(spark, sf_dir, survey=None):
    return stored(side_patches(spark, sf_dir, survey).select("side_id", "patch_id", "row", "col"))


def _measured(spark, sf_dir, survey, target, *keys):
    """Metrics of all patches by these keys, against the sides' own pixels as safe area and the zones above 0 as crop."""
    route, failed = planned(spark, sf_dir, target)
    safe = survey.select(*[c for c in ("side_id", "row", "col") if c != "side_id" or "patch_id" not in keys])
    return S.route_metrics(route, target, safe, survey.filter("zone > 0"), failed, 1.0, *keys)


@query()
def patch_metrics(spark, sf_dir):
    survey = _surveyed(spark, sf_dir)
    name = F.format_string("%s_patch_%02d", S.side_name(F.col("side_id")), F.col("patch_id"))
    per = _measured(spark, sf_dir, survey, _target(spark, sf_dir, survey), "side_id", "patch_id")
    return per.withColumn("side_name", S.side_name(F.col("side_id"))).withColumn("mission_name", name)


@query()
def side_metrics(spark, sf_dir):
    survey = _surveyed(spark, sf_dir)
    target = _target(spark, sf_dir, survey)
    count = target.groupBy("side_id").agg(F.count_distinct("patch_id").alias("patch_count"))
    return _measured(spark, sf_dir, survey, target, "side_id").join(count, "side_id").withColumn("side_name", S.side_name(F.col("side_id")))


@query()
def mission_metrics(spark, sf_dir):
    survey = _surveyed(spark, sf_dir)
    target = _target(spark, sf_dir, survey)
    route, failed = planned(spark, sf_dir, target)
    points = S.waypoints(route, S.WAYPOINT_M, "side_id", "patch_id")
    return S.mission_metrics(route, target, survey, survey.filter("zone > 0"), failed, points, 1.0)


@query()
def validation_suite(spark, sf_dir):
    """The nine checks on the mission of all patches, with its route and waypoints written as files."""
    keys = ("side_id", "patch_id")
    survey = _surveyed(spark, sf_dir)
    target = _target(spark, sf_dir, survey)
    route = planned(spark, sf_dir, target)[0]
    before = S.through_keys(route.groupBy(*keys).agg(F.max("mission_order").alias("n")), *keys).drop("n")
    mission = stored(route.join(before, list(keys)).select(F.col("side_id").alias("field"), (F.col("before") + F.col("mission_order")).alias("mission_order"), "hop", "x1", "y1", "x2", "y2"))
    points = stored(S.waypoints(route, S.WAYPOINT_M, *keys).select("waypoint_id", "x", "y"))
    folder = scratch(spark)
    for name, table in (("mission_route", mission), ("mission_waypoints", points)):
        files.write_csv(table, f"{folder}/{name}")
    stages = [t.agg((F.count(F.lit(1)) > 0).alias("complete")) for t in (survey, target, mission, points)]
    return S.validated(mission, points, survey.select("row", "col"), target.select(F.col("side_id").alias("field")), reduce(lambda a, b: a.unionByName(b), stages), files.inventory(spark, folder, ["mission_route", "mission_waypoints"]), 1.0)


@query('SELECT "row", col, round(1 + 5 * least(greatest(coalesce(risk, 1), 0), 1), 9) AS cost FROM (SELECT "row", col, CASE WHEN col % 7 <> 0 THEN ndvi * 1.3 - 0.2 END risk FROM f WHERE ndre > 0.1)')
def corridor_costs(spark, sf_dir):
    px = Z.canopy(pixels(spark, sf_dir))
    return rounded(S.corridor_grid(px, px.filter("col % 7 <> 0").select("row", "col", (F.col("ndvi") * 1.3 - 0.2).alias("risk"))), "cost", places=9)


@query("""SELECT id, CAST(s.d2 AS BIGINT) AS d2, s.r AS f_row, s.c AS f_col FROM (SELECT p.id, min({'d2': (q."row" - p."row") ** 2 + (q.col - p.col) ** 2, 'r': q."row", 'c': q.col}) s FROM
 (SELECT CAST("row" AS BIGINT) * 1000 + col id, "row", col FROM f WHERE ndre <= 0.1) p JOIN f q ON q.ndre > 0.5 AND abs(q."row" - p."row") <= 8 AND abs(q.col - p.col) <= 8 GROUP BY p.id)""")
def nearest_free_cell(spark, sf_dir):
    px = pixels(spark, sf_dir)
    points = px.filter("ndre <= 0.1").select((F.col("row").cast("long") * 1000 + F.col("col")).alias("id"), "row", "col")
    return S.nearest_free(points, px.filter("ndre > 0.5"))


_PARTS = """ isl AS (SELECT "row", col, col - row_number() OVER (PARTITION BY "row" ORDER BY col) k FROM f WHERE ndre > 0.1),
 rn AS (SELECT "row", min(col) c0, max(col) c1, CAST("row" AS BIGINT) * 4294967296 + min(col) run FROM isl GROUP BY "row", k),
 ed AS (SELECT a.run a, b.run b FROM rn a JOIN rn b ON abs(a."row" - b."row") = 1 AND a.c0 <= b.c1 AND b.c0 <= a.c1),
 re AS (SELECT run node, run root FROM rn UNION SELECT ed.b, re.root FROM re JOIN ed ON ed.a = re.node AND re.root < ed.b),
 pt AS (SELECT root, CAST(sum(c1 - c0 + 1) AS BIGINT) cells, sum((c1 - c0 + 1) * "row") * 1.0 / sum(c1 - c0 + 1) y FROM (SELECT node, min(root) root FROM re GROUP BY node) JOIN rn ON run = node GROUP BY root)"""


@query("SELECT CAST(side_id AS INT) AS side_id, cells, round(y, 6) AS y FROM (SELECT *, row_number() OVER (ORDER BY y, cells DESC, root) side_id FROM pt) WHERE side_id <= 2", _PARTS, True)
def side_split(spark, sf_dir):
    """The two southernmost connected parts of the canopy."""
    return rounded(S.split_sides(Z.canopy(pixels(spark, sf_dir))).groupBy("side_id").agg(F.count(F.lit(1)).alias("cells"), F.avg("row").alias("y")), "y")


def final_metrics(spark, sf_dir):
    """A metrics document for each dataset, as its producer writes it: JSON with a map of fields."""
    per = sided(spark, sf_dir).groupBy("side_id").agg(F.round(F.avg("ndvi"), 6).alias("coverage_ratio"), F.count(F.lit(1)).alias("target_area_m2"))
    status = F.when(F.col("side_id") == 1, "PLANNED").otherwise("SKIPPED")
    f = per.select(F.col("side_id").cast("string").alias("k"), F.struct(status.alias("status"), "target_area_m2", "coverage_ratio").alias("v"))
    return f.agg(F.to_json(F.struct(F.lit("T4_late").alias("season"), F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))).alias("doc"))


FINAL = "season string, fields map<string, struct<status:string,target_area_m2:bigint,coverage_ratio:double>>"


@query("SELECT 'T4_late' AS season, CAST(side_id AS VARCHAR) AS field_id, count(*) AS target_area_m2, round(avg(ndvi), 6) AS coverage_ratio FROM (SELECT 1 + (\"row\" // 8) % 2 side_id, ndvi FROM f) WHERE side_id = 1 GROUP BY side_id")
def per_field_kpis(spark, sf_dir):
    """Planned fields of the metrics document, one row each."""
    d = final_metrics(spark, sf_dir).select(F.from_json("doc", FINAL).alias("d")).select("d.season", F.explode("d.fields").alias("field_id", "v"))
    return d.filter("v.status = 'PLANNED'").select("season", "field_id", "v.target_area_m2", "v.coverage_ratio")


@query("SELECT CAST(1 + (\"row\" // 8) % 2 AS VARCHAR) AS field, round(avg(ndvi), 6) AS coverage FROM f GROUP BY 1")
def experiment_rows(spark, sf_dir):
    """A nested document's map of fields as rows with new names."""
    d = final_metrics(spark, sf_dir).select(F.from_json("doc", FINAL).alias("d"))
    return d.select(F.explode("d.fields").alias("field", "v")).select("field", F.col("v.coverage_ratio").alias("coverage"))


@query("SELECT bool_and(n > 700) AS all_complete, count(*) FILTER (n > 700) AS complete, count(*) AS stages FROM (SELECT \"row\" % 4 s, count(*) n FROM f WHERE ndre > 0.1 GROUP BY 1)")
def stage_completeness(spark, sf_dir):
    per = Z.canopy(pixels(spark, sf_dir)).groupBy(F.col("row") % 4).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.bool_and(F.col("n") > 700).alias("all_complete"), F.count_if(F.col("n") > 700).alias("complete"), F.count(F.lit(1)).alias("stages"))


@query("SELECT min(h) AS height, min(w) AS width FROM (SELECT max(\"row\") + 1 h, max(col) + 1 w FROM f UNION ALL SELECT max(\"row\") + 1, max(col) + 1 FROM f WHERE col < 97 AND \"row\" > 1)")
def smallest_extent(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return R.smallest_extent(px, px.filter("col < 97 and row > 1"))


@query('SELECT a."row", a.col, a.nir, b.r FROM f a JOIN f b ON a."row" = b."row" AND a.col = b.col WHERE b.col < 97')
def stacked_bands(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return R.stack_bands(px.select("row", "col", "nir"), px.filter("col < 97").select("row", "col", "r"))


@query('SELECT "row", col, nir, re, r, g, ndvi FROM f')
def orthophoto_split(spark, sf_dir):
    return R.split_orthophoto(pixels(spark, sf_dir).select("row", "col", F.array("r", "g", "nir", "re").alias("bands")))


@query("SELECT zone, CASE zone WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS vigour, count(*) AS n FROM z WHERE zone > 0 GROUP BY zone")
def zone_legend(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in (1, "low", 2, "medium", 3, "high")])
    return zoned(spark, sf_dir).filter("zone > 0").groupBy("zone").agg(F.count(F.lit(1)).alias("n")).select("zone", F.element_at(names, F.col("zone")).alias("vigour"), "n")


@query("SELECT 'field' AS stage, count(*) AS n FROM fm UNION ALL SELECT 'target', count(*) FROM z WHERE zone >= 1 UNION ALL SELECT 'corridor', count(*) FROM cr UNION ALL SELECT 'swaths', count(*) FROM ca",
       f"{_CORRIDOR}, ca AS ({_RUNS.format('cr', '')})", True)
def stage_view(spark, sf_dir):
    """Cells of each planning stage on the water rule: field, target, corridor, swaths."""
    z = stored(zoned(spark, sf_dir))
    target = Z.target(z, "water")
    road = stored(P.corridor(z, target))
    counts = {"field": M.field_mask(z).filter("m"), "target": target, "corridor": road, "swaths": P.sweep(road, 4)}
    return reduce(lambda a, b: a.unionByName(b), [t.agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(s)) for s, t in counts.items()])
