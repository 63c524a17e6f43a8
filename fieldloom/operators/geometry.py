"""Plane regions: repair and overlay of outlines, tracing of cells, rings, exact lengths of lines inside.

An outline is a table of sides (x1, y1, x2, y2); a point is inside if a ray from it crosses the outline an odd number of
times, so holes are just more sides and broken outlines (bow ties, nested and touching rings) still have a meaning. For work on
a region it is cut into convex pieces: trapezoids between two heights (y0, y1) with a left side (l0 to l1) and a right
one (r0 to r1). The cuts lie at all corners and crossings of the key's outline, so inside a slab no two sides cross and a
running count of sides by x tells what is inside. Slabs are independent of each other: that is how the work spreads.

Coordinates are metres: heights are rounded to PLACES decimals, and corners of one height closer than EPS are one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.session import stored

PLACES, EPS = 9, 1e-6
ENDS = ("x1", "y1", "x2", "y2")
#: What an overlay keeps of two outlines a and b.
KEEPS = {"repair": lambda a, b: a, "and": lambda a, b: a & b, "or": lambda a, b: a | b, "minus": lambda a, b: a & ~b, "xor": lambda a, b: a != b}


def ring_sides(rings: DataFrame, *keys: str) -> DataFrame:
    """keys, x1, y1, x2, y2: the sides of rings (points: array of x, y; closed or not)."""
    p = F.col("points")
    following = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
    some = rings.filter(F.size(p) > 2)
    e = some.select(*keys, F.explode(F.arrays_zip(p.alias("a"), following.alias("b"))).alias("e"))
    return e.select(*keys, *[F.col(f"e.{end}.{c}").cast("double").alias(f"{c}{i}") for i, end in ((1, "a"), (2, "b")) for c in ("x", "y")]).filter("x1 <> x2 or y1 <> y2")


def _at(y: Column, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    """x of a side at a height; the ends exactly."""
    a, b, c, d = (F.col(n) for n in (x1, y1, x2, y2))
    return F.when(y == b, a).when(y == d, c).otherwise(a + (y - b) / (d - b) * (c - a))


def bin_size(table: DataFrame, xs: tuple[str, ...], ys: tuple[str, ...]) -> float:
    """Width of square bins of which each axis has about as many as the square root of the table's rows."""
    spread = [F.max(F.greatest(*map(F.col, c))) - F.min(F.least(*map(F.col, c))) if len(c) > 1 else F.max(c[0]) - F.min(c[0]) for c in (xs, ys)]
    r = table.agg(F.count(F.lit(1)).alias("n"), spread[0].alias("w"), spread[1].alias("h")).first()
    return max(r["w"] or 0.0, r["h"] or 0.0, EPS) / max(1, math.isqrt(r["n"]))


def even_size(table: DataFrame, xs: tuple[str, ...], ys: tuple[str, ...]) -> float:
    """Width of square bins of which the table's box holds about as many as the table has rows. On a long narrow map those of
    `bin_size` are as wide as the map, and each holds ever more rows as the map grows in length."""
    spread = [F.max(F.greatest(*c)) - F.min(F.least(*c)) for c in (xs, ys)]
    r = table.agg(F.count(F.lit(1)).alias("n"), spread[0].alias("w"), spread[1].alias("h")).first()
    w, h, n = r["w"] or 0.0, r["h"] or 0.0, max(1, r["n"])
    return max(math.sqrt(w * h / n), max(w, h) / n, EPS)


def key_bins(table: DataFrame, *keys: str) -> DataFrame:
    """keys and `size`, the width of the key's bins: see `bin_size`, by the key's own sides. A long side of one of many small
    outlines passes as few bins as that outline has sides, however many outlines there are."""
    spread = [F.max(F.greatest(*c)) - F.min(F.least(*c)) for c in (("x1", "x2"), ("y1", "y2"))]
    bins = F.greatest(F.lit(1.0), F.floor(F.sqrt(F.count(F.lit(1)))))
    return table.groupBy(*keys).agg((F.greatest(*spread, F.lit(EPS)) / bins).alias("size"))


def in_bins(lines: DataFrame, size: float | Column) -> DataFrame:
    """Each line once for every bin (by, bx) that it passes: by bands of y, then by its x within the band."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = lines.withColumn("by", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    flat = F.col("y1") == F.col("y2")
    a = F.when(flat, F.col("x1")).otherwise(at(F.greatest(low, F.col("by") * size)))
    b = F.when(flat, F.col("x2")).otherwise(at(F.least(high, (F.col("by") + 1) * size)))
    slack = F.lit(EPS)  # a border counts for both bins
    return rows.withColumn("bx", F.explode(F.sequence(F.floor((F.least(a, b) - slack) / size), F.floor((F.greatest(a, b) + slack) / size))))


def crossings(sides: DataFrame, *keys: str) -> DataFrame:
    """keys, y: the heights at which two sides of a key cross inside both."""
    sized = sides.join(key_bins(sides, *keys), list(keys)) if keys else sides.crossJoin(key_bins(sides))  # one row
    near = in_bins(sized.select(*keys, "size", *ENDS), F.col("size"))
    own = lambda t, p: t.select(*keys, "by", "bx", *[F.col(c).alias(p + c) for c in ENDS])
    met = own(near, "a").join(own(near, "b"), [*keys, "by", "bx"]).filter(F.struct(*["a" + c for c in ENDS]) < F.struct(*["b" + c for c in ENDS]))
    c = {p + n: F.col(p + n) for p in "ab" for n in ENDS}
    dx, dy, ex, ey = c["ax2"] - c["ax1"], c["ay2"] - c["ay1"], c["bx2"] - c["bx1"], c["by2"] - c["by1"]
    den = dx * ey - dy * ex
    fx, fy = c["bx1"] - c["ax1"], c["by1"] - c["ay1"]
    met = met.withColumn("den", den).filter("den <> 0").withColumn("t", (fx * ey - fy * ex) / F.col("den")).withColumn("u", (fx * dy - fy * dx) / F.col("den"))
    return met.filter("t > 0 and t < 1 and u > 0 and u < 1").select(*keys, F.round(F.col("ay1") + F.col("t") * (F.col("ay2") - F.col("ay1")), PLACES).alias("y")).distinct()


def convex_pieces(a: DataFrame, *keys: str, b: DataFrame | None = None, keep: str = "repair", winding: bool = False) -> DataFrame:
    """keys, y0, y1, l0, l1, r0, r1: the convex pieces of an outline, or of an overlay of two (tables of sides).

    keep: what of the two, see KEEPS. With winding a point is inside where sides that rise and fall don't balance: the union
    of many outlines that all turn the same way (holes the other way).
    """
    sides = a.select(*keys, *ENDS, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    if b is not None:
        sides = sides.unionByName(b.select(*keys, *ENDS, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    sides = sides.withColumns({c: F.round(c, PLACES) for c in ENDS}).filter("y1 <> y2")
    rises = F.col("y1") < F.col("y2")
    up = lambda p, q: F.when(rises, F.col(p)).otherwise(F.col(q))
    sides = sides.select(*keys, "in_a", "in_b", F.when(rises, 1).otherwise(-1).alias("turn"), up("x1", "x2").alias("x1"), up("y1", "y2").alias("y1"), up("x2", "x1").alias("x2"), up("y2", "y1").alias("y2"))
    sides = stored(sides)
    ys = sides.select(*keys, F.col("y1").alias("y")).unionByName(sides.select(*keys, F.col("y2").alias("y"))).unionByName(crossings(sides, *keys)).distinct()
    slabs = stored(ys.withColumn("top", F.lead("y").over(Window.partitionBy(*keys).orderBy("y"))).filter("top is not null"))
    bins = stored(key_bins(sides, *keys))
    sized = lambda t: t.join(bins, list(keys)) if keys else t.crossJoin(bins)  # noqa: E731  # one row
    banded = sized(sides).withColumn("band", F.explode(F.sequence(F.floor(F.col("y1") / F.col("size")), F.floor(F.col("y2") / F.col("size"))))).drop("size")
    cut = banded.join(sized(slabs).withColumn("band", F.floor(F.col("y") / F.col("size"))).drop("size"), [*keys, "band"]).filter("y >= y1 and y < y2")
    cut = cut.select(*keys, F.col("y").alias("y0"), F.col("top").alias("top"), _at(F.col("y")).alias("x0"), _at(F.col("top")).alias("xt"), "in_a", "in_b", "turn")
    # sides on one another count as one place
    by = Window.partitionBy(*keys, "y0").orderBy(F.col("x0") + F.col("xt"), "xt")
    far = (F.abs(F.col("x0") - F.lag("x0").over(by)) > EPS) | (F.abs(F.col("xt") - F.lag("xt").over(by)) > EPS)
    placed = cut.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("place", F.sum("far").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    counted = [F.sum(F.col("in_a") * (F.col("turn") if winding else 1)).alias("n_a"), F.sum(F.col("in_b") * (F.col("turn") if winding else 1)).alias("n_b")]
    placed = placed.groupBy(*keys, "y0", "top", "place").agg(F.min("x0").alias("x0"), F.min("xt").alias("xt"), *counted)
    row = Window.partitionBy(*keys, "y0").orderBy("place")
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    state = lambda n: (F.sum(n).over(upto) != 0) if winding else (F.sum(n).over(upto) % 2 != 0)
    # rounding must not let a side pass the one before it: pieces of a slab never overlap
    placed = placed.withColumns({c: F.max(c).over(upto) for c in ("x0", "xt")})
    inside = placed.withColumn("inside", KEEPS[keep](state("n_a"), state("n_b")))
    turns = inside.withColumn("was", F.lag("inside", 1, False).over(row)).filter(F.col("inside") != F.col("was"))
    pairs = turns.withColumn("r0", F.lead("x0").over(row)).withColumn("r1", F.lead("xt").over(row)).filter("inside and r0 is not null")
    return pairs.select(*keys, "y0", F.col("top").alias("y1"), F.col("x0").alias("l0"), F.col("xt").alias("l1"), "r0", "r1")


def overlay(a: DataFrame, b: DataFrame, keep: str, *keys: str) -> DataFrame:
    """The convex pieces of a and b, a or b, a minus b, a xor b; keys that only one has count as empty in the other."""
    return convex_pieces(a, *keys, b=b, keep=keep)


def area(pieces: DataFrame, *keys: str) -> DataFrame:
    each = (F.col("r0") - F.col("l0") + F.col("r1") - F.col("l1")) / 2 * (F.col("y1") - F.col("y0"))
    return pieces.groupBy(*keys).agg(F.sum(each).alias("area_m2"))


def cell_pieces(cells: DataFrame, cell_m: float, *keys: str) -> DataFrame:
    """The convex pieces of cells: the runs of each row."""
    c = F.col("col") - F.row_number().over(Window.partitionBy(*keys, "row").orderBy("col"))
    runs = cells.select(*keys, "row", "col").distinct().withColumn("_k", c).groupBy(*keys, "row", "_k").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    x0, x1 = F.col("c0") * cell_m, (F.col("c1") + 1) * cell_m
    return runs.select(*keys, (F.col("row") * cell_m).alias("y0"), ((F.col("row") + 1) * cell_m).alias("y1"), x0.alias("l0"), x0.alias("l1"), x1.alias("r0"), x1.alias("r1"))


def cell_borders(cells: DataFrame, cell_m: float, *keys: str) -> DataFrame:
    """keys, x1, y1, x2, y2: the borders of cells as long straight sides with the cells to their left."""
    cells = cells.select(*keys, "row", "col").distinct()

    def border(line: str, along: str, step: int) -> DataFrame:
        """Cells whose neighbour at `step` across `line` is missing, joined to runs along it."""
        across = Window.partitionBy(*keys, along).orderBy(line)
        other = (F.lag if step < 0 else F.lead)(line).over(across)
        bare = cells.withColumn("o", other).filter(F.col("o").isNull() | (F.col("o") != F.col(line) + step))
        k = F.col(along) - F.row_number().over(Window.partitionBy(*keys, line).orderBy(along))
        return bare.withColumn("_k", k).groupBy(*keys, line, "_k").agg(F.min(along).alias("a"), (F.max(along) + 1).alias("b"))

    low, high = F.col("a"), F.col("b")
    row, col = F.col("row"), F.col("col")
    made = [
        border("row", "col", -1).select(*keys, low.alias("x1"), row.alias("y1"), high.alias("x2"), row.alias("y2")),
        border("row", "col", 1).select(*keys, high.alias("x1"), (row + 1).alias("y1"), low.alias("x2"), (row + 1).alias("y2")),
        border("col", "row", -1).select(*keys, col.alias("x1"), high.alias("y1"), col.alias("x2"), low.alias("y2")),
        border("col", "row", 1).select(*keys, (col + 1).alias("x1"), low.alias("y1"), (col + 1).alias("x2"), high.alias("y2")),
    ]
    out = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    return out.select(*keys, *[(F.col(c) * cell_m).cast("double").alias(c) for c in ENDS])


def piece_borders(pieces: DataFrame, *keys: str) -> DataFrame:
    """keys, x1, y1, x2, y2: the outline of convex pieces, with the region to the left; borders between pieces cancel.

    At each height the corners of the pieces above and below are sorted and joined within EPS; what only one of the two
    covers is a level side. So at every corner as many sides begin as end, whatever was rounded.
    """
    p = stored(pieces.withColumn("pid", F.monotonically_increasing_id()))
    corner = lambda c, y, above, below: F.struct(F.lit(c).alias("c"), F.col(y).alias("y"), F.col(c).alias("x"), F.lit(above).alias("above"), F.lit(below).alias("below"))
    ends = p.select(*keys, "pid", F.inline(F.array(corner("l0", "y0", 1, 0), corner("r0", "y0", -1, 0), corner("l1", "y1", 0, 1), corner("r1", "y1", 0, -1))))
    level = Window.partitionBy(*keys, "y")
    fresh = F.coalesce(F.col("x") - F.lag("x").over(level.orderBy("x")) > EPS, F.lit(True)).cast("int")
    ends = ends.withColumn("fresh", fresh).withColumn("at", F.sum("fresh").over(level.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    ends = stored(ends.withColumn("x", F.min("x").over(Window.partitionBy(*keys, "y", "at"))))
    sums = ends.groupBy(*keys, "y", "x").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
    run = level.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    flat = sums.withColumns({"a": F.sum("above").over(run) > 0, "b": F.sum("below").over(run) > 0, "to": F.lead("x").over(level.orderBy("x"))}).filter("a <> b and to is not null")
    flat = flat.select(*keys, F.when(F.col("a"), F.col("x")).otherwise(F.col("to")).alias("x1"), F.col("y").alias("y1"), F.when(F.col("a"), F.col("to")).otherwise(F.col("x")).alias("x2"), F.col("y").alias("y2"))
    of = lambda c, n: F.max(F.when(F.col("c") == c, F.col(n))).alias(f"{n}_{c}")
    whole = ends.groupBy(*keys, "pid").agg(*[of(c, n) for c in ("l0", "r0", "l1", "r1") for n in ("x", "y")])
    side = lambda s, t: F.struct(F.col(f"x_{s}").alias("x1"), F.col(f"y_{s}").alias("y1"), F.col(f"x_{t}").alias("x2"), F.col(f"y_{t}").alias("y2"))
    steep = whole.select(*keys, F.inline(F.array(side("l1", "l0"), side("r0", "r1"))))
    # two pieces that touch along a side hold it in both directions
    rises = F.col("y1") < F.col("y2")
    up = lambda a, b: F.when(rises, F.col(a)).otherwise(F.col(b))
    net = steep.select(*keys, up("x1", "x2").alias("x1"), up("y1", "y2").alias("y1"), up("x2", "x1").alias("x2"), up("y2", "y1").alias("y2"), F.when(rises, 1).otherwise(-1).alias("n"))
    net = net.groupBy(*keys, *ENDS).agg(F.sum("n").alias("n")).filter("n <> 0")
    rises = F.col("n") > 0
    return flat.unionByName(net.select(*keys, up("x1", "x2").alias("x1"), up("y1", "y2").alias("y1"), up("x2", "x1").alias("x2"), up("y2", "y1").alias("y2")))


def linked(borders: DataFrame, *keys: str) -> DataFrame:
    """keys, ring, place, x, y, signed_m2: the corners of the rings that directed sides form, outer rings with an area above 0.

    Each side is followed by the one that turns sharpest to the left at its end, so regions that touch in a corner stay apart.
    Pointer doubling finds the least side of each ring and how far ahead it is, which names the ring and orders it: a
    ring of n sides takes log2(n) rounds, each stored.
    """
    e = stored(borders.select(*keys, *ENDS).withColumn("id", F.monotonically_increasing_id()))
    out = e.select(*keys, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("to"), (F.col("x2") - F.col("x1")).alias("ox"), (F.col("y2") - F.col("y1")).alias("oy"))
    dx, dy, ox, oy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox"), F.col("oy")
    angle = F.atan2(dx * oy - dy * ox, dx * ox + dy * oy)
    angle = F.when(angle > math.pi - 1e-9, -angle).otherwise(angle)
    met = e.join(out, [*keys, "x2", "y2"]).withColumn("angle", angle)
    after = stored(met.groupBy("id").agg(F.max_by("to", "angle").alias("to"), F.max("angle").alias("angle")))
    now = stored(after.select("id", "to", F.struct(F.col("to").alias("least"), F.lit(1).cast("long").alias("ahead")).alias("best")))
    step = 1
    while True:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("best").alias("far"))
        far = F.struct(F.col("far.least").alias("least"), (F.col("far.ahead") + step).alias("ahead"))
        step *= 2
        now = stored(now.join(ahead, "to").select("id", F.col("then").alias("to"), F.least("best", far).alias("best"), (F.col("far.least") < F.col("best.least")).alias("moved")))
        if not now.filter("moved").limit(1).count():
            break
        now = now.drop("moved")
    whole = e.join(now.select("id", F.col("best.least").alias("ring"), F.col("best.ahead").alias("ahead")), "id").join(after.select("id", "angle"), "id")
    signed = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    sums = whole.groupBy("ring").agg(F.sum(signed).alias("signed_m2"))
    corners = whole.filter(F.abs("angle") > 1e-9).join(sums, "ring")  # straight on is no corner
    place = (F.row_number().over(Window.partitionBy("ring").orderBy(F.desc("ahead"))) - 1).alias("place")
    return corners.select(*keys, "ring", place, F.col("x2").alias("x"), F.col("y2").alias("y"), "signed_m2")


def rings_of(pieces: DataFrame, *keys: str) -> DataFrame:
    """The rings of a region given by its convex pieces, see `linked`; rings of no area are dropped."""
    return linked(piece_borders(pieces, *keys), *keys).filter(F.abs("signed_m2") > EPS)


def traced(cells: DataFrame, cell_m: float, *keys: str) -> DataFrame:
    """The rings of cells, see `linked`: one outer ring for each 4-connected part, and one for each hole."""
    return linked(cell_borders(cells, cell_m, *keys), *keys)


def repaired(sides: DataFrame, *keys: str) -> DataFrame:
    """The rings of any outline by crossing parity: crossings become corners, what is covered twice is out, rings don't cross."""
    return rings_of(convex_pieces(sides, *keys), *keys)


def corner_sides(corners: DataFrame, *keys: str) -> DataFrame:
    """keys, ring, x1, y1, x2, y2 of corners (ring, place, x, y)."""
    w = Window.partitionBy(*keys, "ring")
    by = w.orderBy("place")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole))
    return corners.select(*keys, "ring", F.col("x").alias("x1"), F.col("y").alias("y1"), to("x").alias("x2"), to("y").alias("y2"))


def nested(corners: DataFrame, *keys: str) -> DataFrame:
    """keys, ring, part, signed_m2 of every ring: an outer ring is its own part, a hole belongs to the least outer ring around it.

    A point just inside the region beside the hole's longest side is held against the outer rings' sides of its height.
    """
    sides = stored(corner_sides(corners, *keys))
    areas = corners.groupBy(*keys, "ring").agg(F.first("signed_m2").alias("signed_m2"))
    holes = sides.join(areas.filter("signed_m2 < 0"), [*keys, "ring"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.hypot(dx, dy)
    probe = F.struct(((F.col("x1") + F.col("x2")) / 2 - dy / length * 4 * EPS).alias("px"), ((F.col("y1") + F.col("y2")) / 2 + dx / length * 4 * EPS).alias("py"))
    points = holes.groupBy(*keys, "ring").agg(F.max_by(probe, length).alias("p")).select(*keys, F.col("ring").alias("hole"), "p.px", "p.py")
    outer = sides.join(areas.filter("signed_m2 > 0"), [*keys, "ring"]).filter("y1 <> y2")
    size = bin_size(sides, ("x1", "x2"), ("y1", "y2"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    outer = outer.withColumn("band", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    met = points.withColumn("band", F.floor(F.col("py") / size)).join(outer, [*keys, "band"]).filter((low <= F.col("py")) & (F.col("py") < high))
    left = met.filter(F.col("x1") + (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")) < F.col("px"))
    around = left.groupBy(*keys, "hole", "ring", "signed_m2").agg((F.count(F.lit(1)) % 2).alias("odd")).filter("odd = 1")
    part = around.groupBy(*keys, "hole").agg(F.min_by("ring", "signed_m2").alias("part")).withColumnRenamed("hole", "ring")
    return areas.join(part, [*keys, "ring"], "left").withColumn("part", F.coalesce("part", "ring"))


def merged_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, x1, y1, x2, y2: the lines' union. Stretches that lie on one line within EPS and overlap become one."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = F.when((dy < 0) | ((dy == 0) & (dx < 0)), -1.0).otherwise(1.0)
    length = F.hypot(dx, dy)
    on = lines.select(*keys, *ENDS).filter("x1 <> x2 or y1 <> y2").withColumns({"ux": dx * turn / length, "uy": dy * turn / length})
    on = on.withColumn("angle", F.round(F.atan2("uy", "ux"), 6))
    on = on.withColumn("angle", F.when(F.col("angle") >= round(math.pi, 6), 0.0).otherwise(F.col("angle")))
    # the direction of all that share an angle is that angle's, so places along it compare
    on = on.withColumns({"ux": F.cos("angle"), "uy": F.sin("angle")})
    along = lambda x, y: F.col(x) * F.col("ux") + F.col(y) * F.col("uy")
    off = (F.col("x1") + F.col("x2")) / 2 * -F.col("uy") + (F.col("y1") + F.col("y2")) / 2 * F.col("ux")
    on = on.withColumns({"off": off, "s0": F.least(along("x1", "y1"), along("x2", "y2")), "s1": F.greatest(along("x1", "y1"), along("x2", "y2"))})
    level = Window.partitionBy(*keys, "angle").orderBy("off", "s0")
    on = on.withColumn("fresh", F.coalesce(F.col("off") - F.lag("off").over(level) > EPS, F.lit(True)).cast("int")).withColumn("line", F.sum("fresh").over(level.rowsBetween(Window.unboundedPreceding, 0)))
    by = Window.partitionBy(*keys, "angle", "line").orderBy("s0", "s1")
    reach = F.max("s1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    on = on.withColumn("gap", F.coalesce(F.col("s0") > reach + EPS, F.lit(True)).cast("int")).withColumn("run", F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    start, end = (F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2))
    first, last = (F.when(along("x1", "y1") <= along("x2", "y2"), p).otherwise(q) for p, q in ((start, end), (end, start)))
    runs = on.groupBy(*keys, "angle", "line", "run").agg(F.min_by(first, "s0").alias("a"), F.max_by(last, "s1").alias("b"))
    return runs.select(*keys, F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def inside_parts(lines: DataFrame, pieces: DataFrame, *keys: str, line: str = "line") -> DataFrame:
    """line, t0, t1: the parts of each line (a column `line` names it) inside the region, by its share of the line; parts don't overlap.

    keys: columns that line and piece must have in common. A line along the region's border is inside.
    """
    # as wide as both tables ask for: a long line over small pieces, or over none, passes few bins
    pieces = stored(pieces)
    size = max(even_size(pieces, ("l0", "l1", "r0", "r1"), ("y0", "y1")), even_size(lines, ("x1", "x2"), ("y1", "y2")))
    p = pieces.select(*keys, F.col("y0").alias("p0"), F.col("y1").alias("p1"), "l0", "l1", "r0", "r1")
    p = p.withColumn("by", F.explode(F.sequence(F.floor((F.col("p0") - EPS) / size), F.floor((F.col("p1") + EPS) / size))))
    p = p.withColumn("bx", F.explode(F.sequence(F.floor((F.least("l0", "l1") - EPS) / size), F.floor((F.greatest("r0", "r1") + EPS) / size))))
    met = in_bins(lines.select(*keys, line, *ENDS), size).join(p, [*keys, "by", "bx"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    height = F.col("p1") - F.col("p0")
    from_left, from_right = (F.col("l1") - F.col("l0")) / height, (F.col("r1") - F.col("r0")) / height
    up = F.col("y1") - F.col("p0")
    slack = EPS / 10
    walls = [(up, dy), (F.col("p1") - F.col("y1"), -dy), (F.col("x1") - F.col("l0") - up * from_left, dx - dy * from_left), (F.col("r0") + up * from_right - F.col("x1"), dy * from_right - dx)]
    low, high, never = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for a, b in walls:  # a + b t >= -slack
        low.append(F.when(b > 0, (-slack - a) / b))
        high.append(F.when(b < 0, (-slack - a) / b))
        never = never | ((b == 0) & (a < -slack))
    parts = met.filter(~never).select(*keys, line, F.greatest(*low).alias("t0"), F.least(*high).alias("t1")).filter("t0 <= t1").distinct()
    by = Window.partitionBy(*keys, line).orderBy("t0", "t1")
    reach = F.max("t1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("gap", F.coalesce(F.col("t0") > reach + 1e-12, F.lit(True)).cast("int")).withColumn("run", F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys, line, "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("run")


def inside_lengths(lines: DataFrame, pieces: DataFrame, *keys: str, line: str = "line") -> DataFrame:
    """The lines with length_m and inside_m, the length inside the region."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    share = inside_parts(lines, pieces, *keys, line=line).groupBy(*keys, line).agg(F.sum(F.col("t1") - F.col("t0")).alias("share"))
    met = lines.join(share, [*keys, line], "left")
    return met.withColumn("length_m", length).withColumn("inside_m", F.coalesce("share", F.lit(0.0)) * F.col("length_m")).drop("share")
