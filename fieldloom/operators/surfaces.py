"""Contour lines of a surface, kernel densities and hexagonal bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.components import components
from fieldloom.session import settled, stored

#: Steps between levels are one of these times a power of ten.
NICE = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)


def nice_levels(low: float, high: float, most: int = 15) -> list[float]:
    """Multiples of the least nice step that makes at most `most` + 1 intervals, strictly between low and high."""
    if not high > low:
        return []
    raw = (high - low) / (most + 1)
    scale = 10.0 ** math.floor(math.log10(raw))
    step = next(s * scale for s in NICE if s * scale >= raw * (1 - 1e-12))
    return [i * step for i in range(math.floor(low / step) + 1, math.ceil(high / step)) if low < i * step < high]


def contour_segments(pixels: DataFrame, levels: list[float], value: str = "elev") -> DataFrame:
    """level (its number), tail, head (numbers of pixel-grid edges), x1, y1, x2, y2 of the marching squares' pieces.

    A square needs values above 0 at its four corners. Pieces run with the lower ground on one hand all along a line, so an
    edge ends at most one piece and starts at most one; a saddle is joined by its corners' mean. Rows and columns lie
    below 2^26, levels number at most 256.
    """
    if len(levels) > 256:
        raise ValueError("at most 256 levels")
    v = pixels.filter(F.col(value) > 0).select("row", "col", F.col(value).cast("double").alias("v"))
    right = Window.partitionBy("row").orderBy("col")
    pairs = v.withColumn("w", F.lead("v").over(right)).withColumn("_n", F.lead("col").over(right)).filter(F.col("_n") == F.col("col") + 1).drop("_n")
    down = Window.partitionBy("col").orderBy("row")
    squares = pairs.withColumns({"s": F.lead("v").over(down), "t": F.lead("w").over(down), "_n": F.lead("row").over(down)}).filter(F.col("_n") == F.col("row") + 1)
    # corners clockwise: v, w, t, s
    table = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(x)).alias("z")) for i, x in enumerate(levels)]) if levels else F.array().cast("array<struct<level:int,z:double>>")
    met = squares.select("row", "col", "v", "w", "t", "s", F.explode(table).alias("l")).select("row", "col", "v", "w", "t", "s", "l.level", "l.z")
    met = met.filter((F.least("v", "w", "t", "s") < F.col("z")) & (F.greatest("v", "w", "t", "s") >= F.col("z")))
    met = met.withColumns({f"h{c}": F.col(c) >= F.col("z") for c in "vwts"})

    def edge(a: str, b: str, row: int, col: int, upright: bool) -> Column:
        part = F.try_divide(F.col("z") - F.col(a), F.col(b) - F.col(a))
        r, c = F.col("row") + row, F.col("col") + col
        number = F.shiftleft(r.cast("long"), 35) + F.shiftleft(c.cast("long"), 9) + (256 if upright else 0) + F.col("level")
        return F.struct(number.alias("id"), (c + (0 if upright else part)).cast("double").alias("x"), (r + (part if upright else 0)).cast("double").alias("y"))

    north, east, south, west = edge("v", "w", 0, 0, False), edge("w", "t", 0, 1, True), edge("s", "t", 1, 0, False), edge("v", "s", 0, 0, True)
    falls = [(north, F.col("hv") & ~F.col("hw")), (east, F.col("hw") & ~F.col("ht")), (south, F.col("ht") & ~F.col("hs")), (west, F.col("hs") & ~F.col("hv"))]
    rises = [(north, ~F.col("hv") & F.col("hw")), (east, ~F.col("hw") & F.col("ht")), (south, ~F.col("ht") & F.col("hs")), (west, ~F.col("hs") & F.col("hv"))]

    def first(cases: list) -> Column:
        return F.coalesce(*[F.when(on, e) for e, on in cases])

    piece = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    high = (F.col("v") + F.col("w") + F.col("t") + F.col("s")) / 4 >= F.col("z")
    saddle = (F.col("hv") == F.col("ht")) & (F.col("hw") == F.col("hs")) & (F.col("hv") != F.col("hw"))
    one = F.when(high, F.array(piece(north, east), piece(south, west))).otherwise(F.array(piece(north, west), piece(south, east)))
    other = F.when(high, F.array(piece(west, north), piece(east, south))).otherwise(F.array(piece(east, north), piece(west, south)))
    pieces = F.when(saddle & F.col("hv"), one).when(saddle, other).otherwise(F.array(piece(first(falls), first(rises))))
    p = met.select("level", F.explode(pieces).alias("p"))
    return p.select("level", F.col("p.a.id").alias("tail"), F.col("p.b.id").alias("head"), *[F.col(f"p.{e}.{c}").alias(f"{c}{i}") for i, e in ((1, "a"), (2, "b")) for c in ("x", "y")])


def contour_lines(segments: DataFrame) -> DataFrame:
    """level, line, place (from 0), closed, x1, y1, x2, y2: the pieces joined end to end; a line is named by its least edge.

    Edges of one line are a component; a closed line is cut before that edge, and then pointer doubling gives every piece its
    distance from its line's end, in rounds that grow with the logarithm of the longest line.
    """
    spark = segments.sparkSession
    segments = stored(segments)
    if not segments.take(1):
        return segments.select("level", F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("closed"), "x1", "y1", "x2", "y2")
    lines = components(segments.select(F.col("tail").alias("a"), F.col("head").alias("b"))).withColumnRenamed("component", "line")
    named = stored(segments.join(lines, F.col("tail") == F.col("node")).drop("node"))
    starts = named.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    ends = named.select(F.col("head").alias("tail"), "line").join(named.select("tail"), "tail", "left_anti").select("line", F.lit(False).alias("closed"))
    starts = stored(starts.join(ends, "line", "left").select("line", "n", F.coalesce("closed", F.lit(True)).alias("closed")))
    # how many pieces follow: `ahead` of them are known, up to the piece that starts at `to` (null: none follows)
    follows = named.select("tail", F.col("head").alias("to"), "line").join(named.select(F.col("tail").alias("next")), F.col("to") == F.col("next"), "left")
    follows = follows.join(starts.select("line", "closed"), "line")
    now = stored(follows.select("tail", F.when(~F.col("closed") | (F.col("next") != F.col("line")), F.col("next")).alias("to"), F.lit(1).cast("long").alias("ahead")))
    while now.filter("to is not null").take(1):
        far = now.select(F.col("tail").alias("to"), F.col("to").alias("beyond"), F.col("ahead").alias("more"))
        met = now.join(far, "to", "left").select("tail", F.col("beyond").alias("to"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"))
        now = settled(spark, lambda m=met: m, now)
    placed = named.join(now.select("tail", "ahead"), "tail").join(starts, "line")
    return placed.select("level", "line", (F.col("n") - F.col("ahead")).alias("place"), "closed", "x1", "y1", "x2", "y2")


def kernel_density(table: DataFrame, group: str, value: str, points: int = 100, bins: int = 512) -> DataFrame:
    """group, place, at, density: Gaussian density of `value` in each group at `points` places from its least to its greatest, by Scott's
    bandwidth, on counts in `bins` bins taken at their rows' mean. Groups of equal values or of one row, and null values, have no density."""
    v = table.select(group, F.col(value).cast("double").alias("v")).filter("v is not null")
    size = v.groupBy(group).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).cast("double").alias("n")).filter("high > low")
    size = stored(size.withColumn("width", F.col("sd") * F.pow("n", F.lit(-0.2))))
    bin_ = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    counts = v.join(size.select(group, "low", "high"), group).groupBy(group, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.avg("v").alias("mean"))
    # at most `bins` rows a group meet its `points` places
    met = counts.join(size, group).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    met = met.withColumn("at", F.col("low") + (F.col("high") - F.col("low")) * F.col("place") / (points - 1))
    off = (F.col("at") - F.col("mean")) / F.col("width")
    density = F.sum(F.col("c") * F.exp(-0.5 * off * off)) / (F.first("n") * F.first("width") * math.sqrt(2 * math.pi))
    return met.groupBy(group, "place").agg(F.first("at").alias("at"), density.alias("density"))


def hexagons(table: DataFrame, x: str, y: str, across: int = 50) -> DataFrame:
    """x, y (a hexagon's centre) and n, its rows: `across` hexagons over x's range, as many over y's as keep them regular.

    A point belongs to the nearer centre of two lattices shifted by half a step, ties to the second. A range of no width
    counts as 1; rows with a null are left out.
    """
    up = max(1, int(across / math.sqrt(3)))
    t = table.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    r = t.agg(*[f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
    r = r.select("x0", "y0", *[(F.when(F.col(f"{c}1") > F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")).otherwise(1.0) / n).alias(f"s{c}") for c, n in (("x", across), ("y", up))])
    at = t.crossJoin(F.broadcast(r)).withColumns({f"i{c}": (F.col(c) - F.col(f"{c}0")) / F.col(f"s{c}") for c in "xy"})  # one row
    near = {f"{c}a": F.floor(F.col(f"i{c}") + 0.5) for c in "xy"} | {f"{c}b": F.floor(F.col(f"i{c}")) + 0.5 for c in "xy"}
    at = at.withColumns(near)
    far = lambda k: (F.col("ix") - F.col(f"x{k}")) ** 2 + 3 * (F.col("iy") - F.col(f"y{k}")) ** 2
    first = far("a") < far("b")
    own = at.select(*[F.when(first, F.col(f"{c}a").cast("double")).otherwise(F.col(f"{c}b")).alias(f"h{c}") for c in "xy"], "x0", "y0", "sx", "sy")
    return own.groupBy("hx", "hy").agg(F.first(F.col("x0") + F.col("hx") * F.col("sx")).alias("x"), F.first(F.col("y0") + F.col("hy") * F.col("sy")).alias("y"), F.count(F.lit(1)).alias("n")).select("x", "y", "n")
