"""What the findings of the third review showed, on small tables."""

from __future__ import annotations

import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_swath_totals_equal_sql(spark):
    from fieldloom.plans import catalog

    con = pytest.importorskip("duckdb").connect()
    for t in ("orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    (got,) = catalog.QUERIES["swath_totals"](spark, DATA).collect()
    (kind, n, length), = con.sql(catalog.ORACLE["swath_totals"]).fetchall()
    assert (got.segment_type, got.n) == (kind, n) and got.length_m == pytest.approx(length, abs=2e-6)


def test_legs_meet_their_windows_in_any_batches(spark):
    """A leg's cells may fill many batches, a batch may hold many legs, and a leg may have no cell; windows end at their limits."""
    from fieldloom.operators import missions

    legs = spark.createDataFrame([("m", i, 100 * i) for i in range(9)], "mission string, seq int, at int")
    cells = spark.createDataFrame([(r, c, 1.0 + (r + c) % 3) for r in range(-3, 700) for c in (-65, -64, 0, 63, 64) if r % 2 == 0], "row int, col int, cost double")
    windows = legs.filter("seq <> 4").selectExpr("mission", "seq", "at - 70 AS r0", "at + 70 AS r1", "-64 AS c0", "63 AS c1")
    near = missions.in_windows(windows, cells)
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        search = lambda leg, grid: [(leg["seq"], int(leg["at"]), len(grid), float(sum(grid.values())))]
        got = missions.each_leg(legs, near, ["mission", "seq"], search, "seq int, at int, n int, total double").orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)
    grid = {(r.row, r.col): r.cost for r in cells.collect()}
    for i, r in enumerate(got):
        own = [v for (row, col), v in grid.items() if abs(row - 100 * i) <= 70 and -64 <= col <= 63] if i != 4 else []
        assert (r.seq, r.at, r.n, r.total) == (i, 100 * i, len(own), sum(own))
    assert len(got) == 9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_no_table_is_broadcast_by_the_size_of_its_files(spark):
    from fieldloom.plans import rasters
    from fieldloom.session import stored

    rasters.pixels(spark, DATA)
    cells = stored(spark.range(1000).selectExpr("id AS row"))
    many = cells.selectExpr("row", "explode(sequence(1, 1000)) AS col")  # a million rows from a few hundred bytes
    plan = many.join(many.selectExpr("row", "col AS c"), "row")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_chain_takes_the_nearest_end_and_grows_with_its_segments():
    import time

    import numpy as np

    from fieldloom.operators import missions

    def plain(x1, y1, x2, y2):
        order = np.lexsort((x2, x1, y1))
        ends = [((x1[i], y1[i]), (x2[i], y2[i])) for i in order]
        at, out, left = None, [], list(range(len(order)))
        while left:
            i, k = (0, 0) if at is None else min(((i, k) for i in left for k in (0, 1)), key=lambda q: ((ends[q[0]][q[1]][0] - at[0]) ** 2 + (ends[q[0]][q[1]][1] - at[1]) ** 2, q))
            left.remove(i)
            at = ends[i][1 - k]
            out.append((int(order[i]), k == 1))
        return out

    g = np.random.default_rng(3)
    for n, wide in ((0, 5), (1, 5), (60, 8), (300, 40)):  # small ranges: many equal distances and equal segments
        x, y = g.integers(0, wide, n), g.integers(0, wide, n) * 4
        to = x + g.integers(0, 9, n)
        assert missions.chain_order(x, y, to, y) == plain(x, y, to, y)
    n = 40_000
    x, y = g.integers(0, 97, n), np.arange(n) // 7 * 4
    began = time.process_time()
    assert len(missions.chain_order(x, y, x + 5, y)) == n
    assert time.process_time() - began < 20  # comparing all pairs took 34 s for half as many


def test_bins_of_an_outline_do_not_grow_with_the_number_of_outlines(spark):
    """Each key has a cell far up and a triangle over the whole height: its sides pass few bins, and the overlay is exact."""
    from pyspark.sql import functions as F

    from fieldloom.operators import geometry as G

    def ring(key, *points):
        return (key, [{"x": float(x), "y": float(y)} for x, y in points])

    kind = "k int, points array<struct<x:double,y:double>>"
    n, high = 200, 10_000.0
    cells = G.ring_sides(spark.createDataFrame([ring(k, (4, 40 * k), (5, 40 * k), (5, 40 * k + 1), (4, 40 * k + 1)) for k in range(n)], kind), "k")
    wide = G.ring_sides(spark.createDataFrame([ring(k, (0, 0), (10, 0), (5, high)) for k in range(n)], kind), "k")
    sides = cells.unionByName(wide).filter("y1 <> y2")
    near = G.in_bins(sides.join(G.key_bins(sides, "k"), "k"), F.col("size"))
    assert near.groupBy("k").count().agg({"count": "max"}).first()[0] <= 20
    areas = {r.k: r.area_m2 for r in G.area(G.overlay(cells, wide, "and", "k"), "k").collect()}
    for k in (0, 57, n - 1):
        left = lambda y: 5 * y / high
        mean = (max(0.0, 5 - max(4.0, left(40 * k))) + max(0.0, 5 - max(4.0, left(40 * k + 1)))) / 2
        assert abs(areas.get(k, 0.0) - mean) < 1e-6


def test_nearest_kept_over_gaps_blocks_and_wide_rings(spark, monkeypatch):
    """Pixels may be missing between a pixel and its nearest kept one; hits lie in other blocks and beyond a block's width."""
    import random

    from pyspark.sql import functions as F

    from fieldloom.operators import morphology

    monkeypatch.setattr(morphology, "BLOCK", 8)
    monkeypatch.setattr(morphology, "WIDER", 2)
    rng = random.Random(7)
    for share, rows, cols in ((0.02, 30, 20), (0.0, 24, 40)):
        kept = {(r, c): (rng.randrange(1, 4) if rng.random() < share else None) for r in range(rows) for c in range(cols) if rng.random() < 0.8}
        kept[3, 4] = 2
        seeds = [(r, c, v) for (r, c), v in kept.items() if v]
        grid = spark.createDataFrame([(r, c, v) for (r, c), v in kept.items()], "row int, col int, kept int")
        got = {(r.row, r.col): (r.d2, r.kept) for r in morphology.nearest_kept(grid, 4, F.col("col") % 3 > 0).collect()}
        want = {}
        for (r, c), v in kept.items():
            if v is None and c % 3:
                d2, _, _, value = min(((a - r) ** 2 + (b - c) ** 2, a, b, z) for a, b, z in seeds)
                want[r, c] = d2, value
        assert got == want


def test_memberships_stay_in_generated_code(spark):
    """No lambda is run for each point; on a centre the membership is its own, a point without a feature has none."""
    import numpy as np

    from fieldloom.operators import clustering
    from fieldloom.operators.zones import NAMES

    x = [*np.random.default_rng(2).random((20, 5)).round(3).tolist(), [0.5] * 5, [None, 0.1, 0.1, 0.1, 0.1]]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(x)], "id int, " + ", ".join(f"{c} double" for c in NAMES))
    centres = [(0.5,) * 5, (0.2,) * 5, (0.5,) * 5]
    for m in (1.5, 2.0):
        u = clustering.memberships(points, centres, m)
        assert u.columns == [*points.columns, "u"] and "lambda" not in u._jdf.queryExecution().optimizedPlan().toString()
        rows = {r.id: r.u for r in u.collect()}
        assert rows[20] == [0.5, 0.0, 0.5] and rows[21] is None
        for i in range(20):
            inverse = ((np.array(centres) - x[i]) ** 2).sum(1) ** (-1 / (m - 1))
            assert np.allclose(rows[i], inverse / inverse.sum(), rtol=1e-12)


def test_dilation_looks_ahead_without_a_frame_to_the_end(spark):
    """A frame from a pixel to its row's end is computed anew for each pixel: the square of a row's length."""
    from pyspark.sql import functions as F

    from fieldloom.operators import morphology

    cells = spark.range(60).select((F.col("id") / 12).cast("int").alias("row"), (F.col("id") % 12).cast("int").alias("col"), (F.col("id") % 23 == 4).alias("m"))
    near = morphology.diamond(cells, 2)
    assert "unboundedfollowing" not in near._jdf.queryExecution().optimizedPlan().toString().lower()
    at = [(i // 12, i % 12) for i in range(60) if i % 23 == 4]
    assert {(r.row, r.col) for r in near.filter("m").collect()} == {(r, c) for r in range(5) for c in range(12) if any(abs(r - a) + abs(c - b) <= 2 for a, b in at)}


def test_turned_map_makes_the_pixels_near_it_alone(spark, monkeypatch):
    """the frame of a long narrow map grows with the square of its length; near the map nothing changes, so the mission is that of the whole frame."""
    from pyspark.sql import functions as F

    from fieldloom.operators import missions

    h, w = 90, 14
    soil = lambda r, c: r % 9 > 5 or (c in (4, 5) and r % 9 < 4) or (r, c) in ((40, 0), (40, 1))
    layer = spark.createDataFrame([(r, c, 0 if soil(r, c) else 1 + (r + c) % 3) for r in range(h) for c in range(w)], "row int, col int, zone int")
    whole = {(r.row, r.col): r.zone for r in missions.rotated(layer, -20.0).collect()}
    near = missions.rotated(layer, -20.0, margin=missions.MARGIN).collect()
    kept = {(r.row, r.col) for r in near}
    assert all(whole[r.row, r.col] == r.zone for r in near) and all(p in kept for p, z in whole.items() if z)
    assert len(near) <= (h + 2 * missions.MARGIN + 2) * (w + 2 * missions.MARGIN + 2) and any(r.rim for r in near)
    long = layer.unionByName(layer.withColumn("row", F.col("row") + 1910).limit(1))
    assert missions.rotated(long, -20.0, margin=missions.MARGIN).count() < 2.2 * 2000 * (w + 2 * missions.MARGIN) < 2000 * 600
    places = lambda: missions.rotated_mission(layer, "m", "nitrogen", 20.0).orderBy("place").collect()
    got, turned = places(), missions.rotated
    monkeypatch.setattr(missions, "rotated", lambda t, d, value="zone", margin=None: turned(t, d, value).withColumn("rim", F.lit(False)))
    assert got and got == places()


def test_few_edges_take_no_rounds(spark, monkeypatch):
    """a job or more for each round is most of a mission's time; one task and the rounds give the same components."""
    from fieldloom.operators import components as of

    edges = spark.createDataFrame([(3 * i, 3 * i + 3) for i in range(50)] + [(1000, i) for i in range(400, 460)] + [(9, 9), (5, -(1 << 40))], "a long, b long")
    ask = lambda: {r.node: r.component for r in of.components(edges).collect()}
    rounds = []
    pointed = of._pointed
    monkeypatch.setattr(of, "_pointed", lambda *a: rounds.append(1) or pointed(*a))
    few = ask()
    assert not rounds
    monkeypatch.setattr(of, "FEW", 10)
    assert few == ask() and rounds and few[1000] == 400 and few[150] == 0 and few[5] == -(1 << 40) and 9 in few


def test_dilation_doesnt_multiply_its_pixels(spark):
    """each pixel went to the rows around it as a row of its own; gaps in the map are no steps up or down a column."""
    from fieldloom.operators import morphology

    at = {(r, c): (r * 7 + c * 5) % 41 == 3 for r in range(20) for c in range(15) if (r * 3 + c) % 7 and c not in (6, 7)}
    near = morphology.diamond(spark.createDataFrame([(*p, m) for p, m in at.items()], "row int, col int, m boolean"), 4)
    plan = near._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "generate" not in plan and "unboundedfollowing" not in plan
    passed = {p for p in at if any((r, p[1]) in at and abs(r - p[0]) + abs(c - p[1]) <= 4 for (r, c), m in at.items() if m)}
    assert {(r.row, r.col) for r in near.filter("m").collect()} == passed


def test_nearest_free_cell_gives_a_row_a_block(spark, monkeypatch):
    """every free cell near a point was a row, some 200 for one; the square's corners count, ids are exact, and blocks' borders don't matter."""
    import numpy as np

    from fieldloom.operators import sidewise

    monkeypatch.setattr(sidewise, "FREE_BLOCK", 7)
    draw = np.random.default_rng(5)
    free = sorted({(int(r), int(c)) for r, c in draw.integers(-20, 40, (60, 2))} | {(104, 104)})
    points = [((1 << 60) + i, int(r), int(c)) for i, (r, c) in enumerate(draw.integers(-25, 45, (80, 2)))] + [(7, 100, 100), (8, 101, 108), (8, 99, 100), (9, 200, 0), (None, 102, 104)]
    tables = spark.createDataFrame(points, "id long, row int, col int"), spark.createDataFrame([*free, (None, 3)], "row int, col int")
    got = sidewise.nearest_free(*tables, most=4)
    assert "flatmapcogroupsinarrow" in got._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {}
    for i, r, c in points:
        for a, b in free:
            if abs(a - r) <= 4 and abs(b - c) <= 4:
                want[i] = min(want.get(i, (1 << 40,)), ((a - r) ** 2 + (b - c) ** 2, a, b))
    assert {r.id: (r.d2, r.f_row, r.f_col) for r in got.collect()} == want and want[7][0] == 32 and 9 not in want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_missions_of_all_methods_share_one_field(spark, monkeypatch):
    """the field, the longest step of a mission, was made anew for each method though all label the same canopy."""
    from pyspark.sql import functions as F

    from fieldloom.operators import clustering, missions, morphology
    from fieldloom.plans import catalog, reports

    labels = {"a": F.col("col") % 3, "b": F.col("row") % 3}  # a has nothing to sweep
    monkeypatch.setattr(clustering, "fit_all", lambda p, k: {n: p.withColumn("label", x.cast("int")) for n, x in labels.items()})
    made, mask = [], morphology.field_mask
    monkeypatch.setattr(morphology, "field_mask", lambda *a: made.append(1) or mask(*a))
    got = {r.mission: (r.segments, r.length_m) for r in catalog.QUERIES["method_missions"](spark, DATA).collect()}
    assert len(made) == 1 and got
    p, places = reports.points(spark, DATA), reports._places(spark, DATA)
    for name, x in labels.items():
        alone = missions.mission(reports._zones_of(places, p.withColumn("label", x.cast("int"))), name, "nitrogen")
        want = {r.mission: (r.segments, pytest.approx(r.length_m)) for r in missions.path_length(alone).collect()}
        assert want == {n: v for n, v in got.items() if n == name}


def test_smoothing_over_gaps_and_blocks(spark, monkeypatch):
    """Missing pixels don't count, blocks and their rims don't show, and a raster may be narrower than the kernel's reach."""
    import math
    import random

    from pyspark.sql import functions as F

    from fieldloom.operators import morphology

    monkeypatch.setattr(morphology, "SMOOTHED", 1)  # blocks of four times the reach
    rng, sigma, r = random.Random(5), 0.8, 3
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    for h, w in ((31, 40), (2, 27)):
        pixels = {(y, x): (rng.random(), rng.random() < 0.8) for y in range(h) for x in range(w) if rng.random() < 0.8 or (y, x) == (h - 1, w - 1)}
        table = spark.createDataFrame([(*p, *v) for p, v in pixels.items()], "row int, col int, v double, ok boolean")
        got = {(t.row, t.col): (t.v, t.ok) for t in morphology.gaussian(table, ("v",), sigma, F.col("ok")).collect()}
        assert got.keys() == pixels.keys()
        for (y, x), (v, ok) in got.items():
            total = weight = 0.0
            for i in range(-r, r + 1):
                for j in range(-r, r + 1):
                    a, b = (y + i) % (2 * h), (x + j) % (2 * w)
                    near = pixels.get((min(a, 2 * h - 1 - a), min(b, 2 * w - 1 - b)))
                    if near and near[1]:
                        share = kernel[i + r] * kernel[j + r] / sum(kernel) ** 2
                        total, weight = total + share * near[0], weight + share
            assert abs(v - total / max(weight, 1e-6)) < 1e-9 and ok == pixels[y, x][1]


def test_kmeans_steps_read_each_distinct_point_once(spark, monkeypatch):
    from fieldloom.operators import seeding
    from fieldloom.operators.zones import NAMES

    places = [(i % 3 + 0.01 * i, i % 2, 0.0, 1.0, 0.5) for i in range(12)]
    rows = [(n, i, *map(float, p)) for i, p in enumerate(places) for n in range(20 + 5 * i)]
    points = spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"{c} double" for c in NAMES)).repartition(3)
    read, plain = [], seeding._sums

    def counted(table, centres):
        read.append(table.count())
        return plain(table, centres)

    monkeypatch.setattr(seeding, "_sums", counted)
    centres, report = seeding.restarts(points, 3, 2)
    assert set(read[1:]) == {12} and report["converged"].all()
    want = sum(min(sum((a - b) ** 2 for a, b in zip(r[2:], c, strict=True)) for c in centres[0]) for r in rows)
    assert abs(report["inertia"][0] - want) < 1e-6


def test_borders_over_blocks_and_gaps(spark, monkeypatch):
    """Smoothness and compactness against plain loops; blocks of few pixels don't show, and no pixel is spread to all its neighbours."""
    import math
    import random

    from fieldloom.operators import metrics

    monkeypatch.setattr(metrics, "BLOCK", 5)
    rng = random.Random(8)
    zone = {(r, c): (0, 1, 1, 2)[rng.randrange(4)] if c < 7 else 1 + (r > 5) for r in range(14) for c in range(13) if rng.random() < 0.95}
    around = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    near = lambda p, d: (p[0] + d[0], p[1] + d[1])
    veg = [p for p in zone if zone[p] > 0]
    inner = sum(all(zone.get(near(p, d)) == zone[p] for d in around) for p in veg)
    border = {p for p in veg if any(zone.get(near(p, d)) != zone[p] for d in around if 0 in d)}
    part, ratios = {}, {1: [], 2: []}
    for first in veg:
        if first in part:
            continue
        part[first], todo = first, [first]
        for p in todo:
            for q in (near(p, d) for d in around):
                if zone.get(q) == zone[first] and q not in part:
                    part[q] = first
                    todo.append(q)
        length = 0.0
        for p in todo:
            if p in border:
                code = sum(1 if d == (0, 0) else 2 if 0 in d else 10 for d in around if near(p, d) in border and part.get(near(p, d), first) == first and zone[near(p, d)] == zone[p])
                length += metrics.PERIMETER_WEIGHTS.get(code, 0.0)
        if length:
            ratios[zone[first]].append(4 * math.pi * len(todo) / length**2)
    table = spark.createDataFrame([(*p, z) for p, z in zone.items()], "row int, col int, zone int")
    assert abs(metrics.smoothness(table).first()[0] - inner / len(veg)) < 1e-12
    assert abs(metrics.compactness(table).first()[0] - sum(sum(v) / len(v) for v in ratios.values()) / 2) < 1e-9
