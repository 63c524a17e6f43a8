"""Contours, densities, hexagons and warping on small tables against plain computations."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.operators import surfaces
from fieldloom.sources import geodesy

PIXELS = "row int, col int, elev double"


def lines_of(spark, heights, levels):
    rows = surfaces.contour_lines(surfaces.contour_segments(spark.createDataFrame(heights, PIXELS), levels)).orderBy("level", "line", "place").collect()
    out = {}
    for r in rows:
        out.setdefault((r["level"], r["line"]), []).append(r)
    return list(out.values())


def test_lines_are_whole(spark):
    """Every piece is in one line, ends meet, points lie on their level, and lower ground keeps to one hand."""
    rng = random.Random(4)
    heights = {(r, c): rng.choice([1.0, 2.0, 3.0, 4.0]) + rng.random() / 10 for r in range(9) for c in range(11)} | {(4, 4): 0.0}
    levels = [1.5, 2.5, 3.5]
    lines = lines_of(spark, [(*p, v) for p, v in heights.items()], levels)
    touched, squares = {}, 0
    for r in range(8):
        for c in range(10):
            v = [heights[p] for p in ((r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c))]
            if min(v) <= 0:
                continue
            for z in levels:
                changes = sum((v[i] >= z) != (v[i - 1] >= z) for i in range(4))
                squares += changes // 2
                for i, e in enumerate([(r, c, "u"), (r, c, "a"), (r, c + 1, "u"), (r + 1, c, "a")]):
                    if (v[i] >= z) != (v[i - 1] >= z):
                        touched[z, e] = touched.get((z, e), 0) + 1
    assert squares == sum(len(x) for x in lines)
    assert sum(n == 1 for n in touched.values()) == 2 * sum(not x[0]["closed"] for x in lines)
    for line in lines:
        assert [x["place"] for x in line] == list(range(len(line)))
        ends = [((x["x1"], x["y1"]), (x["x2"], x["y2"])) for x in line]
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and (ends[-1][1] == ends[0][0]) == line[0]["closed"]
        for (x, y), _ in ends:
            a, b = heights[math.floor(y), math.floor(x)], heights[math.ceil(y), math.ceil(x)]
            assert abs(a + (b - a) * (x % 1 + y % 1) - levels[line[0]["level"]]) < 1e-9


def test_a_hill_and_a_saddle(spark):
    hill = [(r, c, 5.0 - abs(r - 3) - abs(c - 3) if abs(r - 3) + abs(c - 3) < 4 else 0.5) for r in range(7) for c in range(7)]
    one = lines_of(spark, hill, [3.5])
    assert len(one) == 1 and one[0][0]["closed"] and abs(sum(math.hypot(x["x2"] - x["x1"], x["y2"] - x["y1"]) for x in one[0]) - 6 * math.sqrt(2)) < 1e-9
    saddle = lambda low: lines_of(spark, [(0, 0, 4.0), (0, 1, low), (1, 0, low), (1, 1, 4.0)], [3.0])
    assert {(x[0]["x1"], x[0]["y2"]) for x in saddle(1.0)} != {(x[0]["x1"], x[0]["y2"]) for x in saddle(2.5)} and len(saddle(1.0)) == len(saddle(2.5)) == 2


def test_levels_and_empty_surfaces(spark):
    assert surfaces.nice_levels(0.0, 16.0) == [float(i) for i in range(1, 16)] and surfaces.nice_levels(5.0, 5.0) == []
    assert len(surfaces.nice_levels(100.0, 100.37)) <= 16 and all(100 < x < 100.37 for x in surfaces.nice_levels(100.0, 100.37))
    assert lines_of(spark, [], [1.0]) == [] and lines_of(spark, [(0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 1, 3.0)], [1.5]) == [] and lines_of(spark, [(0, 0, 1.0)], []) == []


def test_density(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(3, 2, 400)
    rows = [(1, float(v)) for v in values] + [(2, 5.0), (2, 5.0), (3, 1.0), (4, None), (4, None)]
    got = surfaces.kernel_density(spark.createDataFrame(rows, "g int, v double"), "g", "v", points=20).orderBy("place").collect()
    assert {r["g"] for r in got} == {1}
    h = values.std(ddof=1) * len(values) ** -0.2
    for r in got:
        want = np.exp(-0.5 * ((r["at"] - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        assert abs(r["density"] - want) < 1e-4
    assert abs(got[0]["at"] - values.min()) < 1e-12 and abs(got[-1]["at"] - values.max()) < 1e-12


def test_hexagons_are_the_nearest(spark):
    rng = random.Random(6)
    points = [(rng.random() * 7, rng.random() * 3) for _ in range(300)]
    got = surfaces.hexagons(spark.createDataFrame([*points, (None, 1.0)], "x double, y double"), "x", "y", 10).collect()
    assert sum(r["n"] for r in got) == 300
    x0, y0 = (min(p[i] for p in points) for i in (0, 1))
    sx, sy = (max(p[0] for p in points) - x0) / 10, (max(p[1] for p in points) - y0) / 5
    centres = [(x0 + (i + s) * sx, y0 + (j + s) * sy) for i in range(-1, 12) for j in range(-1, 7) for s in (0, 0.5)]
    want = {}
    for p in points:
        c = min(centres, key=lambda c: ((p[0] - c[0]) / sx) ** 2 + 3 * ((p[1] - c[1]) / sy) ** 2)
        want[round(c[0], 6), round(c[1], 6)] = want.get((round(c[0], 6), round(c[1], 6)), 0) + 1
    assert {(round(r["x"], 6), round(r["y"], 6)): r["n"] for r in got} == want
    assert [r["n"] for r in surfaces.hexagons(spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double"), "x", "y").collect()] == [3]


def test_degrees_and_metres_are_inverse(spark):
    places = [(lat, lon) for lat in (-41.3, -0.5, 0.25, 38.7, 63.0) for lon in (-11.5, -9.0, -6.2)]
    for south in (False, True):
        east, north = geodesy.utm(F.col("lat"), F.col("lon"), 29, south)
        at = spark.createDataFrame(places, "lat double, lon double").select("lat", "lon", east.alias("e"), north.alias("n"))
        back = geodesy.degrees_of(F.col("e"), F.col("n"), 29, south)
        for r in at.select("*", back[0].alias("lat2"), back[1].alias("lon2")).collect():
            assert abs(r["lat"] - r["lat2"]) < 1e-8 and abs(r["lon"] - r["lon2"]) < 1e-8
            assert not south or r["lat"] >= 0 or 0 < r["n"] < 1e7


def test_warp(spark):
    """A sloping plane in degrees, in both hemispheres, stays itself on the metric grid; a hole counts for nothing."""
    for lat, south in ((38.0, False), (-38.0, True)):
        plane = [(r, c, 10.0 + 2.0 * r + 3.0 * c) for r in range(30) for c in range(30) if (r, c) != (12, 12)]
        source = spark.createDataFrame(plane, PIXELS)
        corner = spark.range(1).select(*[x.alias(n) for n, x in zip(("e", "n"), geodesy.utm(F.lit(lat), F.lit(-8.5), 29, south), strict=True)]).first()
        target = spark.createDataFrame([(r, c) for r in range(30) for c in range(30)], "row int, col int")
        met = geodesy.warp_to_metric(source, target, (-8.5, lat, 1e-4, 1e-4), (corner["e"] + 30, corner["n"] - 30, 8.0), 29, south)
        east, north = corner["e"] + 30 + (F.col("col") + 0.5) * 8.0, corner["n"] - 30 - (F.col("row") + 0.5) * 8.0
        back = geodesy.degrees_of(east, north, 29, south)
        rows = met.select("elev", ((lat - back[0]) / 1e-4 - 0.5).alias("y"), ((back[1] + 8.5) / 1e-4 - 0.5).alias("x")).collect()
        assert len(rows) == 900
        inner = [r for r in rows if 0 <= r["y"] <= 29 and 0 <= r["x"] <= 29 and not (11 < r["y"] < 13 and 11 < r["x"] < 13)]
        assert len(inner) > 400 and all(abs(r["elev"] - (10 + 2 * r["y"] + 3 * r["x"])) < 1e-6 for r in inner)
        assert all(r["elev"] is not None for r in rows if 11 < r["y"] < 13 and 11 < r["x"] < 13)
    assert geodesy.warp_to_metric(None, target, (0, 0, 1, 1), (0, 0, 1)) is None
