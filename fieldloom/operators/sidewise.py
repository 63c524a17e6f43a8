"""Side-wise percentile targets, patches, row-aligned swaths, waypoints and metrics.

Regions are sets of cells (side_id, row, col); patches are their 4-connected parts. Swaths run along the rows of a raster
turned by an angle: each patch's outline is swept by parallel lines and cut into pieces by crossing parity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import geometry, missions, morphology, zones
from fieldloom.session import stored

WIDTH_M, MIN_SWATH_M, WAYPOINT_M, CELL_M, VEHICLE_M, SPEED = 1.2, 1.0, 0.5, 0.5, 0.4, 0.5


def side_name(side: Column) -> Column:
    return F.when(side == 1, "southwest").otherwise("northeast")


def split_sides(cells: DataFrame, count: int = 2) -> DataFrame:
    """Adds side_id to the cells of the `count` southernmost 4-connected parts (by mean row, then size); the others go."""
    labelled = morphology.label_cells(cells.select("row", "col"))
    order = labelled.groupBy("component").agg(F.avg("row").alias("y"), F.count(F.lit(1)).alias("n"))
    ranked = order.withColumn("side_id", F.row_number().over(Window.orderBy("y", F.desc("n"), "component"))).filter(F.col("side_id") <= count)
    return labelled.join(F.broadcast(ranked.select("component", "side_id")), "component").drop("component")  # count rows


def side_targets(layer: DataFrame, value: str = "priority", q: float = 0.8) -> DataFrame:
    """Cells (side_id, row, col, value) at or above their side's percentile."""
    return zones.percentile_target(layer.filter(F.col(value).isNotNull()), value, q, "side_id")


def patches(target: DataFrame, least_m2: float = 0.0, cell_m: float = 1.0) -> DataFrame:
    """Adds patch_id: 4-connected parts of each side, numbered from 1 by area, greatest first, then by first cell."""
    labelled = morphology.label_cells(target.select("side_id", "row", "col"), "side_id")
    size = labelled.groupBy("side_id", "component").agg(F.count(F.lit(1)).alias("cells"), F.min(F.struct("row", "col")).alias("first"))
    big = size.filter(F.col("cells") * cell_m * cell_m >= least_m2)
    ranked = big.withColumn("patch_id", F.row_number().over(Window.partitionBy("side_id").orderBy(F.desc("cells"), "first")))
    return labelled.join(ranked.select("side_id", "component", "patch_id"), ["side_id", "component"]).drop("component")


def turned(table: DataFrame, degrees: float, *pairs: tuple[str, str], about: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Pairs of coordinate columns turned by an angle about a point."""
    c, s, (ox, oy) = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), about
    out = {}
    for x, y in pairs:
        dx, dy = F.col(x) - F.lit(ox), F.col(y) - F.lit(oy)
        out |= {x: F.lit(ox) + dx * c - dy * s, y: F.lit(oy) + dx * s + dy * c}
    return table.withColumns(out)


def scanline_swaths(rings: DataFrame, angle: float, spacing: float = WIDTH_M, least: float = MIN_SWATH_M, about: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """patch_id, row_index, segment_id, x1, y1, x2, y2: pieces inside each patch's rings of parallel lines `spacing` apart.

    The rings are turned by -angle about a point, cut by horizontal lines at multiples of spacing (a side counts for
    min y <= line < max y), paired by order of x, and turned back; pieces shorter than `least` are dropped.
    """
    e = turned(geometry.ring_sides(rings, "patch_id"), -angle, ("x1", "y1"), ("x2", "y2"), about=about).filter("y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    lines = F.sequence(F.ceil(low / spacing).cast("int"), F.ceil(high / spacing).cast("int") - 1)
    hits = e.filter(F.ceil(low / spacing) <= F.ceil(high / spacing) - 1).select("*", F.explode(lines).alias("line"))
    y = F.col("line") * spacing
    x = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    w = Window.partitionBy("patch_id", "line").orderBy("x")
    at = hits.select("patch_id", "line", x.alias("x")).withColumn("i", F.row_number().over(w)).withColumn("to", F.lead("x").over(w))
    pieces = at.filter((F.col("i") % 2 == 1) & (F.col("to") - F.col("x") >= least))
    by = Window.partitionBy("patch_id").orderBy("line", "x")
    out = pieces.select("patch_id", (F.dense_rank().over(Window.partitionBy("patch_id").orderBy("line")) - 1).alias("row_index"), (F.row_number().over(by) - 1).alias("segment_id"),
                        F.col("x").alias("x1"), y.alias("y1"), F.col("to").alias("x2"), y.alias("y2"))
    return turned(out, angle, ("x1", "y1"), ("x2", "y2"), about=about)


def row_swaths(sides: DataFrame, centres: DataFrame, angle: float, *keys: str, spacing: float = WIDTH_M, least: float = MIN_SWATH_M) -> DataFrame:
    """keys, row_index, segment_id, x1, y1, x2, y2: the pieces inside each key's outline of parallel lines at the rows' angle.

    The outline (sides) is turned by -angle about its centre (cx, cy), cut by lines at multiples of spacing, and the pieces are
    turned back. row_index counts lines from the lowest one at or below the outline; segment_id from 1, by row, then along it.
    """
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    turn = lambda x, y, back: (F.col("cx") + (x - F.col("cx")) * c - back * (y - F.col("cy")) * s, F.col("cy") + back * (x - F.col("cx")) * s + (y - F.col("cy")) * c)
    (ax, ay), (bx, by) = turn(F.col("x1"), F.col("y1"), -1), turn(F.col("x2"), F.col("y2"), -1)
    e = sides.join(centres, list(keys)).select(*keys, "cx", "cy", ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    base = e.groupBy(*keys).agg(F.floor(F.min(low) / spacing).alias("base"))
    first, last = F.ceil(low / spacing), F.ceil(high / spacing) - 1
    hits = e.filter(first <= last).select("*", F.explode(F.sequence(first, last)).alias("line"))
    y = F.col("line") * spacing
    x = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    along = Window.partitionBy(*keys, "line").orderBy("x")
    at = hits.select(*keys, "cx", "cy", "line", x.alias("x"), y.alias("y")).withColumn("i", F.row_number().over(along)).withColumn("to", F.lead("x").over(along))
    pieces = at.filter((F.col("i") % 2 == 1) & (F.col("to") - F.col("x") >= least)).join(base, list(keys))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("line", "x"))
    (ax, ay), (bx, by) = turn(F.col("x"), F.col("y"), 1), turn(F.col("to"), F.col("y"), 1)
    return pieces.select(*keys, (F.col("line") - F.col("base")).cast("int").alias("row_index"), order.alias("segment_id"), ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))


def cells_in_rings(rings: DataFrame, cell_m: float, *keys: str) -> DataFrame:
    """keys, row, col: the cells whose centre lies inside the rings by crossing parity, holes left out.

    Each row of cell centres is cut by the rings' sides (a side counts for min y <= centre < max y); the cells between an odd
    crossing and the next one are inside (x <= centre < x of the next).
    """
    e = geometry.ring_sides(rings, *keys).filter("y1 <> y2")
    low, high = F.least("y1", "y2") / cell_m - 0.5, F.greatest("y1", "y2") / cell_m - 0.5
    hits = e.filter(F.ceil(low) <= F.ceil(high) - 1).select("*", F.explode(F.sequence(F.ceil(low).cast("int"), F.ceil(high).cast("int") - 1)).alias("row"))
    y = (F.col("row") + 0.5) * cell_m
    x = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    w = Window.partitionBy(*keys, "row").orderBy("x")
    at = hits.select(*keys, "row", x.alias("x")).withColumn("i", F.row_number().over(w)).withColumn("to", F.lead("x").over(w)).filter("i % 2 = 1")
    first, last = F.ceil(F.col("x") / cell_m - 0.5).cast("int"), F.ceil(F.col("to") / cell_m - 0.5).cast("int") - 1
    return at.filter(first <= last).select(*keys, "row", F.explode(F.sequence(first, last)).alias("col"))


def snake_rows(swaths: DataFrame, *keys: str) -> DataFrame:
    """mission_order by row_index; every second row that has swaths is driven from its far end, each piece turned."""
    odd = (F.dense_rank().over(Window.partitionBy(*keys).orderBy("row_index")) - 1) % 2 == 1
    s = swaths.withColumn("_odd", odd)
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("row_index", F.when(F.col("_odd"), -F.col("x1")).otherwise(F.col("x1"))))
    s = s.withColumn("mission_order", order.cast("int"))
    flip = lambda a, b: F.when(F.col("_odd"), F.col(b)).otherwise(F.col(a))
    return s.select(*keys, "mission_order", "row_index", "segment_id", flip("x1", "x2").alias("x1"), flip("y1", "y2").alias("y1"), flip("x2", "x1").alias("x2"), flip("y2", "y1").alias("y2"))


def connectors(route: DataFrame, *keys: str) -> DataFrame:
    """The straight line from each swath's end to the next one's begin."""
    w = Window.partitionBy(*keys).orderBy("mission_order")
    legs = route.select(*keys, "mission_order", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.lead("x1").over(w).alias("bx"), F.lead("y1").over(w).alias("by"))
    return legs.filter("bx is not null").select(*keys, "mission_order", "x1", "y1", F.col("bx").alias("x2"), F.col("by").alias("y2"))


#: Metres of a line outside a region that count as rounding.
NO_METRES = 1e-5


def judged_connectors(lines: DataFrame, region: DataFrame, cell_m: float, *keys: str) -> DataFrame:
    """Adds direct: the region's cells cover the connector, border included. Only the others need a path."""
    met = geometry.inside_lengths(lines, geometry.cell_pieces(region, cell_m, *keys), *keys, line="mission_order")
    return met.withColumn("direct", F.col("length_m") - F.col("inside_m") <= NO_METRES).select(*lines.columns, "direct")


#: Metres that a path may leave its connector's box by: at least MARGIN_M, or this share of its length.
MARGIN_M, MARGIN_SHARE = 45.0, 0.35


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas and Peucker's line: the farthest point from a chord stays while it is farther than the tolerance."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        (ax, ay), (bx, by) = points[i], points[j]
        dx, dy = bx - ax, by - ay
        square = dx * dx + dy * dy
        far, at = tolerance, None
        for k in range(i + 1, j):
            px, py = points[k][0] - ax, points[k][1] - ay
            t = min(1.0, max(0.0, (px * dx + py * dy) / square)) if square else 0.0
            d = math.hypot(px - t * dx, py - t * dy)
            if d > far:
                far, at = d, k
        if at is not None:
            keep.add(at)
            todo += [(i, at), (at, j)]
    return [points[k] for k in sorted(keep)]


def covered(points: list[tuple[float, float]], cells: dict | set, cell_m: float) -> bool:
    """Whether cells (row, col), borders included, hold the whole line: it is cut where it meets the grid."""
    for (x1, y1), (x2, y2) in zip(points, points[1:], strict=False):
        cuts = {0.0, 1.0}
        for a, b in ((x1 / cell_m, x2 / cell_m), (y1 / cell_m, y2 / cell_m)):
            if a != b:
                cuts.update((k - a) / (b - a) for k in range(math.ceil(min(a, b)), math.floor(max(a, b)) + 1))
        order = sorted(t for t in cuts if 0 <= t <= 1)
        for t, u in zip(order, order[1:], strict=False):
            if u - t > 1e-9:
                x, y = (x1 + (t + u) / 2 * (x2 - x1)) / cell_m, (y1 + (t + u) / 2 * (y2 - y1)) / cell_m
                if not any((math.floor(y + e), math.floor(x + d)) in cells for e in (-1e-7, 1e-7) for d in (-1e-7, 1e-7)):
                    return False
    return True


#: Rows and columns within which the end of a connector is moved to a free cell, and the share of a cell that simplifying may shift.
FREE_CELLS, SIMPLER = 8, 0.25


def _free(cell: tuple[int, int], cost: dict) -> tuple[int, int] | None:
    if cell in cost:
        return cell
    near = [((r - cell[0]) ** 2 + (c - cell[1]) ** 2, r, c) for r in range(cell[0] - FREE_CELLS, cell[0] + FREE_CELLS + 1) for c in range(cell[1] - FREE_CELLS, cell[1] + FREE_CELLS + 1) if (r, c) in cost]
    return min(near)[1:] if near else None


def routed_connectors(lines: DataFrame, region: DataFrame, cell_m: float, *keys: str, risk: DataFrame | None = None) -> DataFrame:
    """keys, mission_order, status, points: a connector is direct if the region covers it, routed if a path inside the region
    leads from its first to its last cell (within MARGIN_M of the connector's box), else failed, without points.

    Only connectors that aren't direct are searched, each in its window of the region's cells. An end outside the region starts from the nearest cell. The path of cell centres is simplified where the
    region still covers it.
    """
    judged = stored(judged_connectors(lines, region, cell_m, *keys))
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = F.array(point("x1", "y1"), point("x2", "y2"))
    direct = judged.filter("direct").select(*keys, "mission_order", F.lit("direct").alias("status"), ends.alias("points"))
    cell = lambda c: F.floor(F.col(c) / cell_m).cast("int")
    legs = judged.filter("not direct").select(*keys, "mission_order", "x1", "y1", "x2", "y2", cell("y1").alias("ar"), cell("x1").alias("ac"), cell("y2").alias("br"), cell("x2").alias("bc"))
    span = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * MARGIN_SHARE
    legs = legs.withColumn("reach", F.ceil(F.greatest(F.lit(MARGIN_M), span) / cell_m).cast("int"))
    costs = region.select(*keys, "row", "col").distinct().join(corridor_grid(region, risk), ["row", "col"])
    box = [(F.least("ar", "br") - F.col("reach")).alias("r0"), (F.greatest("ar", "br") + F.col("reach")).alias("r1"), (F.least("ac", "bc") - F.col("reach")).alias("c0"), (F.greatest("ac", "bc") + F.col("reach")).alias("c1")]
    cells = missions.in_windows(legs.select(*keys, "mission_order", *box), costs, *keys)
    group = [*keys, "mission_order"]
    kinds = ", ".join(f"{k} {lines.schema[k].dataType.simpleString()}" for k in group)

    def run(a: dict, cost: dict) -> list[tuple]:
        first, last = _free((int(a["ar"]), int(a["ac"])), cost), _free((int(a["br"]), int(a["bc"])), cost)
        path = missions.shortest_path(cost, first, last, 2**0.5) if first and last else None
        points, status = [], "failed"
        if path is not None:
            whole = [(a["x1"], a["y1"]), *[((c + 0.5) * cell_m, (r + 0.5) * cell_m) for r, c in path[1:-1]], (a["x2"], a["y2"])]
            short = simplified(whole, SIMPLER * cell_m)
            points, status = short if covered(short, cost, cell_m) else whole, "routed"
            if not covered(points, cost, cell_m):  # an end lies too far outside
                points, status = [], "failed"
        return [(*[a[k] for k in group], status, [{"x": float(x), "y": float(y)} for x, y in points])]

    legs = legs.select(*group, "x1", "y1", "x2", "y2", "ar", "ac", "br", "bc")
    routed = missions.each_leg(legs, cells, group, run, f"{kinds}, status string, points array<struct<x:double,y:double>>")
    return direct.unionByName(routed)


def patch_routes(swaths: DataFrame, links: DataFrame, *keys: str) -> DataFrame:
    """keys, mission_order, hop, segment_type, x1, y1, x2, y2: the parts of each route in order, a swath, then its connector's
    hops, which share their part's mission_order; failed connectors leave a gap."""
    p = F.col("points")
    hops = links.filter(F.size(p) > 1).select(*keys, "mission_order", F.posexplode(F.arrays_zip(F.slice(p, 1, F.size(p) - 1).alias("a"), F.slice(p, 2, F.size(p)).alias("b"))).alias("hop", "e"))
    hops = hops.select(*keys, "mission_order", "hop", F.lit("connector").alias("segment_type"), F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    own = swaths.select(*keys, "mission_order", F.lit(0).alias("hop"), F.lit("swath").alias("segment_type"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("mission_order", F.col("segment_type") == "connector"))
    return own.unionByName(hops).withColumn("mission_order", place.cast("int"))


def corridor_grid(region: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """row, col, cost of a region's cells: 1 + 5 * risk, risk clipped to [0, 1], 1 where it is missing."""
    if risk is None:
        return region.select("row", "col").distinct().withColumn("cost", F.lit(1.0))
    met = region.select("row", "col").distinct().join(risk, ["row", "col"], "left")
    return met.select("row", "col", (1 + 5 * F.least(F.greatest(F.coalesce("risk", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))).alias("cost"))


#: Rows and columns of a block of free cells.
FREE_BLOCK = 512


def nearest_free(points: DataFrame, free: DataFrame, most: int = 8) -> DataFrame:
    """For points (id, row, col) the nearest free cell within `most` rows and columns, by (d2, row, col).

    Free cells are dealt by blocks, a point is looked for in each block that its square meets; a task holds a block's cells and the points
    that look into it, and a point gives one row a block instead of one for each free cell near it.
    """
    block = lambda c: F.floor(c / FREE_BLOCK).cast("int")
    span = lambda c: F.explode(F.sequence(block(F.col(c) - most), block(F.col(c) + most)))
    asked = points.select("id", F.col("row").alias("row"), F.col("col").alias("col"), span("row").alias("b_row")).withColumn("b_col", span("col"))
    cells = free.filter("row is not null and col is not null").select(F.col("row").alias("f_row"), F.col("col").alias("f_col"), block(F.col("row")).alias("b_row"), block(F.col("col")).alias("b_col"))
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((points, "id"), (points, "row"), (free, "col"))]

    def looked(own: pa.Table, near: pa.Table) -> pa.Table:
        row, col, s_row, s_col = [t[c].to_numpy().astype(np.int64) for t, c in ((own, "row"), (own, "col"), (near, "f_row"), (near, "f_col"))]
        order = np.lexsort((s_col, s_row))
        at, d2 = morphology.nearest_of(row, col, s_row[order], s_col[order], most, square=True)
        hit = np.flatnonzero(at >= 0)
        found = near.take(pa.array(order[at[hit]])) if len(hit) else near.slice(0, 0)
        return pa.table({"id": own["id"].take(pa.array(hit)), "d2": pa.array(d2[hit]), "f_row": found["f_row"].cast(own["row"].type), "f_col": found["f_col"]})

    hits = asked.groupBy("b_row", "b_col").cogroup(cells.groupBy("b_row", "b_col")).applyInArrow(looked, "id {}, d2 long, f_row {}, f_col {}".format(*kinds))
    return hits.groupBy("id").agg(F.min(F.struct("d2", "f_row", "f_col")).alias("b")).select("id", "b.d2", "b.f_row", "b.f_col")


def through_keys(counts: DataFrame, *keys: str) -> DataFrame:
    """counts (keys, n) with `before`: what all earlier keys hold, in order of the keys. One row for each key."""
    order = Window.orderBy(*keys) if keys else Window.orderBy(F.lit(1))
    return counts.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def waypoints(route: DataFrame, spacing: float = WAYPOINT_M, *keys: str) -> DataFrame:
    """Points at equal distances of at most `spacing` along each part of the route (a swath, or all hops of a connector), both ends
    included, with the heading to the part's next point; the last repeats its heading. Numbered from 1 through all keys in order.
    """
    hop = F.col("hop") if "hop" in route.columns else F.lit(0)
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    part = Window.partitionBy(*keys, "mission_order")
    along = part.orderBy("hop")
    r = route.select(*keys, "mission_order", hop.alias("hop"), "x1", "y1", "x2", "y2", length.alias("_m"))
    r = r.withColumns({"_to": F.sum("_m").over(along.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_m").over(part), "_last": F.lead("hop").over(along).isNull()})
    r = r.withColumn("_from", F.coalesce(F.lag("_to").over(along), F.lit(0.0))).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_all") / spacing)).cast("int"))
    place = lambda s: F.ceil(F.col(s) * F.col("_n") / F.col("_all")).cast("int")
    first = F.when(F.col("_from") == 0, 0).otherwise(place("_from"))
    last = F.when(F.col("_last"), F.col("_n")).otherwise(place("_to") - 1)
    r = r.withColumns({"_a": F.when(F.col("_all") > 0, first).otherwise(0), "_b": F.when(F.col("_all") > 0, last).otherwise(F.when(F.col("_last"), F.col("_n")).otherwise(-1))}).filter("_a <= _b")
    sizes = r.filter("_last").select(*keys, "mission_order", (F.col("_n") + 1).alias("n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("mission_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    if keys:
        before = through_keys(sizes.groupBy(*keys).agg(F.sum("n").alias("n")), *keys).drop("n")
        starts = starts.join(before, list(keys)).withColumn("_start", F.col("_start") + F.col("before")).drop("before")
    pts = r.select("*", F.explode(F.sequence("_a", "_b")).alias("point"))
    f = F.when(F.col("_m") > 0, (F.col("point") * F.col("_all") / F.col("_n") - F.col("_from")) / F.col("_m")).otherwise(0.0)
    f = F.least(F.greatest(f, F.lit(0.0)), F.lit(1.0))
    pts = pts.select(*keys, "mission_order", "point", (F.col("x1") + f * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + f * (F.col("y2") - F.col("y1"))).alias("y"))
    w = part.orderBy("point")
    dx, dy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    pts = pts.withColumn("_h", F.when(dx.isNotNull(), F.degrees(F.atan2(dy, dx))))
    pts = pts.withColumn("heading_deg", F.coalesce("_h", F.lag("_h").over(w))).drop("_h")
    pts = pts.join(starts, [*keys, "mission_order"]).withColumn("waypoint_id", (F.col("_start") + F.col("point") + 1).cast("long")).drop("_start")
    return pts.withColumn("speed_mps", F.lit(SPEED))


def touched_cells(lines: DataFrame, radius: float, cell_m: float, *keys: str) -> DataFrame:
    """Cells that the strip within `radius` beside a line (flat caps) overlaps: no side of cell or strip parts the two."""
    return buffered_cells(lines, radius, cell_m, *keys, touched=True)


def buffered_cells(lines: DataFrame, radius: float, cell_m: float, *keys: str, touched: bool = False) -> DataFrame:
    """Cells whose centre lies within `radius` of a line, beside it (flat caps); if touched, all cells that this strip overlaps."""
    reach = math.ceil(radius / cell_m)
    x1, y1, x2, y2 = F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")
    rows = F.explode(F.sequence(F.floor(F.least(y1, y2) / cell_m).cast("int") - reach, F.floor(F.greatest(y1, y2) / cell_m).cast("int") + reach))
    cols = F.explode(F.sequence(F.floor(F.least(x1, x2) / cell_m).cast("int") - reach, F.floor(F.greatest(x1, x2) / cell_m).cast("int") + reach))
    near = lines.filter("x1 <> x2 or y1 <> y2").withColumn("row", rows).withColumn("col", cols)
    px, py = (F.col("col") + 0.5) * cell_m, (F.col("row") + 0.5) * cell_m
    length2 = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    along = ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / length2
    across = F.abs((px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)) / F.sqrt(length2)
    if not touched:
        return near.filter((along >= 0) & (along <= 1) & (across <= radius)).select(*keys, "row", "col").distinct()
    length, half = F.sqrt(length2), cell_m / 2
    ux, uy = F.abs(x2 - x1) / length, F.abs(y2 - y1) / length
    shadow = half * (ux + uy)  # half a cell, seen along or across the line
    apart_x, apart_y = F.abs(px - (x1 + x2) / 2), F.abs(py - (y1 + y2) / 2)
    overlaps = (F.abs(along - 0.5) * length < length / 2 + shadow) & (across < radius + shadow)
    overlaps = overlaps & (apart_x < ux * length / 2 + uy * radius + half) & (apart_y < uy * length / 2 + ux * radius + half)
    return near.filter(overlaps).select(*keys, "row", "col").distinct()


def coverage(lines: DataFrame, target: DataFrame, width_m: float, cell_m: float, *keys: str) -> DataFrame:
    """Per key: target cells, those that the strip of this width along a line touches, and their share. Counts cells once, so sides aren't sums of patches."""
    hit = touched_cells(lines, width_m / 2, cell_m, *keys).withColumn("_hit", F.lit(1))
    met = target.select(*keys, "row", "col").distinct().join(hit, [*keys, "row", "col"], "left")
    per = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("target_cells"), F.count("_hit").alias("covered_cells"))
    return per.withColumn("coverage_ratio", F.col("covered_cells") / F.col("target_cells"))


#: Labels of a finished mission and the metres outside the target that the first allows; fixed values.
FEASIBLE, WARNED, OUTSIDE_M = "SIDEWISE_P80_CPP_WITHIN_DEMAND_REGIONS", "SIDEWISE_P80_CPP_WITH_MINOR_PATCH_CONNECTOR_WARNINGS", 0.5


def route_metrics(route: DataFrame, target: DataFrame, safe: DataFrame, vegetation: DataFrame, failed: DataFrame, cell_m: float, *keys: str) -> DataFrame:
    """One row for each key (patch, side or mission) of the target, also those without a route: area, counts of swaths, route parts and
    failed connectors, lengths, coverage by the sensor's strip, metres outside the own target, all targets and the safe area, and crop crossed.

    A region with some of the keys as columns holds for these keys only.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    swath, zero = F.col("segment_type") == "swath", F.lit(0.0)
    parts = route.groupBy(*keys).agg(
        F.count_if(swath).alias("swath_count"), F.count_if(F.col("hop") == 0).alias("route_part_count"), F.sum(length).alias("path_length_m"),
        F.sum(F.when(swath, length).otherwise(zero)).alias("swath_length_m"), F.sum(F.when(swath, zero).otherwise(length)).alias("connector_length_m"),
    )
    # stretches driven twice count once outside and inside regions, as in the union of the route's lines
    lines = stored(geometry.merged_lines(route, *keys).withColumn("line", F.monotonically_increasing_id()))
    lengths = lines.groupBy(*keys).agg(F.sum(length).alias("merged_length_m"))
    regions = {"own": target.select(*keys, "row", "col"), "all": target.select("row", "col"), "safe": safe, "crop": vegetation.select("row", "col")}
    for name, region in regions.items():
        on = [k for k in keys if k in region.columns]
        met = geometry.inside_lengths(lines, geometry.cell_pieces(region, cell_m, *on), *on).groupBy(*keys).agg(F.sum("inside_m").alias(name))
        lengths = lengths.join(met, list(keys), "left")
    beyond = lambda c: F.greatest(F.col("merged_length_m") - F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    lengths = lengths.select(
        *keys, beyond("own").alias("outside_own_length_m"), beyond("all").alias("outside_all_length_m"), beyond("safe").alias("outside_safe_length_m"),
        F.coalesce("crop", F.lit(0.0)).alias("vegetation_length_m"),
    )
    crop = vegetation.select("row", "col").distinct().withColumn("_crop", F.lit(1))
    wheels = buffered_cells(route, VEHICLE_M, cell_m, *keys).join(crop, ["row", "col"], "left").groupBy(*keys).agg(
        (F.count("_crop") * cell_m * cell_m).alias("crop_crossing_area_m2"), (F.count(F.lit(1)) * cell_m * cell_m).alias("vehicle_buffer_area_m2")
    )
    lost = failed.groupBy(*keys).agg(F.count(F.lit(1)).alias("failed_connector_count"))
    out = coverage(route, target, WIDTH_M, cell_m, *keys)
    for table in (parts, lost, lengths, wheels):
        out = out.join(table, list(keys), "left")
    numbers = {c: 0 if c.endswith("_count") else 0.0 for table in (parts, lost, lengths, wheels) for c in table.columns if c not in keys}
    out = out.fillna(numbers).withColumn("target_area_m2", F.col("target_cells") * cell_m * cell_m)
    ratio = F.col("crop_crossing_area_m2") / F.greatest("vehicle_buffer_area_m2", F.lit(1e-9))
    return out.withColumn("crop_crossing_area_ratio", ratio).withColumn("duration_min", F.col("path_length_m") / SPEED / 60)


def mission_metrics(route: DataFrame, target: DataFrame, safe: DataFrame, vegetation: DataFrame, failed: DataFrame, points: DataFrame, cell_m: float) -> DataFrame:
    """One row: the metrics of the whole mission, its sides, patches and waypoints, and whether it is feasible."""
    name = F.lit("combined")
    every = target.withColumn("mission", name)
    per = route_metrics(route.withColumn("mission", name), every, safe.select("row", "col"), vegetation, failed.withColumn("mission", name), cell_m, "mission")
    places = target.agg(F.count_distinct("side_id").alias("side_count"), F.count_distinct("side_id", "patch_id").alias("patch_count"))
    count = points.agg(F.count(F.lit(1)).alias("waypoint_count"))
    good = (F.col("failed_connector_count") == 0) & (F.col("outside_own_length_m") <= OUTSIDE_M)
    return per.crossJoin(places).crossJoin(count).withColumn("feasibility", F.when(good, FEASIBLE).otherwise(WARNED))  # one row each


def validated(route: DataFrame, points: DataFrame, safe: DataFrame, fields: DataFrame, stages: DataFrame, files: DataFrame, cell_m: float) -> DataFrame:
    """One row of the nine checks of a finished mission and whether all hold.

    route: field, mission_order (through the mission), hop and ends; points: waypoint_id, x, y; safe: cells; fields: field, all that
    were planned; stages: complete; files: exists.
    """
    r = route.filter("hop = 0").agg(F.count(F.lit(1)).alias("parts"), F.count_distinct("mission_order").alias("orders"))
    lines = route.withColumn("line", F.monotonically_increasing_id())
    met = geometry.inside_lengths(stored(lines.select("line", "x1", "y1", "x2", "y2")), geometry.cell_pieces(safe, cell_m))
    out = met.agg(F.count_if(F.col("length_m") - F.col("inside_m") > NO_METRES).alias("out"))
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    n = points.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("waypoint_id").alias("ids"), F.count_if(~whole).alias("broken"))
    s = stages.agg(F.bool_and("complete").alias("stages_ok"))
    f = files.agg(F.bool_and("exists").alias("files_ok"))
    mine, planned = route.select("field").distinct(), fields.select("field").distinct()
    apart = mine.join(planned.withColumn("_p", F.lit(True)), "field", "full").join(mine.withColumn("_m", F.lit(True)), "field", "left").agg(F.count_if(F.col("_p").isNull() | F.col("_m").isNull()).alias("strange"))
    met = r.crossJoin(out).crossJoin(n).crossJoin(s).crossJoin(f).crossJoin(apart)  # one row each
    true = lambda c: F.coalesce(c, F.lit(False))
    checks = {"stages_complete": true("stages_ok"), "output_files_exist": true("files_ok"), "route_not_empty": F.col("parts") > 0, "waypoints_not_empty": F.col("n") > 0,
              "route_in_safe_area": F.col("out") == 0, "route_order_unique": F.col("orders") == F.col("parts"), "waypoint_order_unique": F.col("ids") == F.col("n"),
              "coordinates_complete": F.col("broken") == 0, "fields_separated": F.col("strange") == 0}
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    return met.select(*[c.alias(n) for n, c in checks.items()], every.alias("all_ok"))
