"""Regions against scanline counts, shoelace areas and plain loops."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from fieldloom.operators import geometry as G

BOW_TIE = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]
SQUARE, INNER = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(2.0, 2.0), (8.0, 3.0), (7.0, 8.0)]
STAR = [(5 + 4.5 * math.cos(0.3 + 4 * math.pi * i / 5), 5 + 4.5 * math.sin(0.3 + 4 * math.pi * i / 5)) for i in range(5)]
TOUCHING = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)], [(3.0, 0.0), (5.0, 0.0), (5.0, 3.0), (3.0, 3.0)]


def sides(spark, rings: dict[str, list]) -> object:
    rows = [(k, [{"x": x, "y": y} for x, y in r]) for k, rs in rings.items() for r in rs]
    return G.ring_sides(spark.createDataFrame(rows, "k string, points array<struct<x:double,y:double>>"), "k")


def crosses(rings: list, x: float, y: float) -> bool:
    n = 0
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1], strict=True):
            if min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) < x:
                n += 1
    return n % 2 == 1


def counted(inside, low: float, high: float, n: int) -> float:
    step = (high - low) / n
    at = [low + (i + 0.5) * step for i in range(n)]
    return sum(inside(x, y) for x in at for y in at) * step * step


def rings_in(corners) -> dict:
    out = defaultdict(list)
    for r in corners.orderBy("k", "ring", "place").collect():
        out[r["k"], r["ring"]].append((r["x"], r["y"]))
    return out


def shoelace(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def test_repair_equals_parity_count(spark):
    shapes = {"bow": [BOW_TIE], "nested": [SQUARE, INNER], "star": [STAR], "touching": list(TOUCHING), "twice": [SQUARE, SQUARE], "none": [[(0.0, 0.0), (1.0, 1.0)]]}
    pieces = G.convex_pieces(sides(spark, shapes), "k")
    areas = {r["k"]: r["area_m2"] for r in G.area(pieces, "k").collect()}
    assert "twice" not in areas and "none" not in areas
    assert areas["bow"] == pytest.approx(8.0) and areas["touching"] == pytest.approx(24.0) and areas["nested"] == pytest.approx(100 - abs(shoelace(INNER)))
    for k in ("bow", "nested", "star", "touching"):
        last = None
        for n in (60, 240):  # ever finer cells
            off = abs(counted(lambda x, y, k=k: crosses(shapes[k], x, y), -1.0, 11.0, n) - areas[k])
            assert off < 12.0 * 12.0 * 3 / n
            last = off
        assert last < 0.5
    rings = rings_in(G.rings_of(pieces, "k"))
    for k in ("bow", "nested", "star", "touching"):
        own = [r for (name, _), r in rings.items() if name == k]
        assert sum(map(shoelace, own)) == pytest.approx(areas[k], abs=1e-5)
    assert sorted(len(r) for (k, _), r in rings.items() if k == "bow") == [3, 3]
    assert sorted(shoelace(r) > 0 for (k, _), r in rings.items() if k == "nested") == [False, True]
    assert sum(k == "star" for k, _ in rings) == 5  # five tips; the middle is covered twice


@pytest.mark.parametrize("keep", ["and", "or", "minus", "xor"])
def test_overlay_of_random_outlines(spark, keep):
    rng = random.Random(4)
    shape = lambda: [[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 2))]
    a, b = {f"k{i}": shape() for i in range(6)}, {f"k{i}": shape() for i in range(6)}
    a["shared"], b["shared"] = [SQUARE], [[(10.0, 2.0), (14.0, 2.0), (14.0, 8.0), (10.0, 8.0)]]
    pieces = G.overlay(sides(spark, a), sides(spark, b), keep, "k")
    areas = {r["k"]: r["area_m2"] for r in G.area(pieces, "k").collect()}
    op = {"and": lambda p, q: p and q, "or": lambda p, q: p or q, "minus": lambda p, q: p and not q, "xor": lambda p, q: p != q}[keep]
    for k in a:
        want = counted(lambda x, y, k=k: op(crosses(a[k], x, y), crosses(b[k], x, y)), 0.0, 14.0, 200)
        assert areas.get(k, 0.0) == pytest.approx(want, abs=0.8)
    rings = rings_in(G.rings_of(pieces, "k"))
    for k in a:
        assert sum(shoelace(r) for (name, _), r in rings.items() if name == k) == pytest.approx(areas.get(k, 0.0), abs=1e-4)
    if keep == "or":
        assert [len(r) for (k, _), r in rings.items() if k == "shared"] == [8]


def test_union_by_winding(spark):
    many = [[(x, 0.0), (x + 3.0, 0.5), (x + 2.0, 4.0)] for x in (0.0, 1.0, 2.5, 9.0)] + [SQUARE]
    pieces = G.convex_pieces(sides(spark, {"k": many}), "k", winding=True)
    got = G.area(pieces, "k").first()["area_m2"]
    assert got == pytest.approx(counted(lambda x, y: any(crosses([r], x, y) for r in many), -1.0, 13.0, 280), abs=0.6)


def test_traced_rings_give_back_the_cells(spark):
    rng = random.Random(9)
    cells = {(k, r, c) for k in ("a", "b") for r in range(12) for c in range(15) if rng.random() < 0.6}
    cells |= {("ring", r, c) for r in range(5) for c in range(5) if (r, c) not in ((1, 1), (2, 2), (3, 3))} | {("diagonal", 0, 0), ("diagonal", 1, 1), ("one", 3, 7)}
    df = spark.createDataFrame(sorted(cells), "k string, row int, col int")
    corners = G.traced(df.unionByName(df), 0.5, "k")
    rings = rings_in(corners)
    for k in ("a", "b", "ring", "diagonal", "one"):
        own = [r for (name, _), r in rings.items() if name == k]
        got = {(k, r, c) for r in range(13) for c in range(16) if crosses(own, (c + 0.5) * 0.5, (r + 0.5) * 0.5)}
        assert got == {x for x in cells if x[0] == k}
        for r in own:  # corners only, and no corner twice in a ring of a 4-connected part's own cell
            assert all((p[0] == q[0]) != (p[1] == q[1]) for p, q in zip(r, r[1:] + r[:1], strict=True))
            assert all((o[0] == p[0]) != (p[0] == q[0]) for o, p, q in zip(r[-1:] + r[:-1], r, r[1:] + r[:1], strict=True))
    assert sum(k == "diagonal" for k, _ in rings) == 2
    parts = {(r["k"], r["ring"]): r for r in G.nested(corners, "k").collect()}
    outer = {(k, r["part"]) for (k, ring), r in parts.items() if r["signed_m2"] > 0}
    assert len(parts) == len(rings) and all((k, r["part"]) in outer for (k, _), r in parts.items())
    assert len({(k, r["part"]) for (k, _), r in parts.items() if k == "ring"}) == 1
    pieces = G.cell_pieces(df, 0.5, "k")
    assert {r["k"]: r["area_m2"] for r in G.area(pieces, "k").collect()} == {k: sum(x[0] == k for x in cells) / 4 for k in {x[0] for x in cells}}


def test_holes_go_to_the_least_ring_around_them(spark):
    box = lambda a, b, left=False: [(a, a), (b, a), (b, b), (a, b)][:: -1 if left else 1]
    corners = G.repaired(sides(spark, {"k": [box(0.0, 20.0), box(1.0, 19.0), box(5.0, 15.0), box(6.0, 14.0), [(30.0, 0.0), (31.0, 0.0), (31.0, 1.0)]]}), "k")
    rows = G.nested(corners, "k").collect()
    area = {r["ring"]: r["signed_m2"] for r in rows}
    assert sorted((round(r["signed_m2"]), round(area[r["part"]])) for r in rows if r["signed_m2"] < 0) == [(-324, 400), (-64, 100)]


def test_lines_inside_are_exact(spark):
    rng = random.Random(2)
    shape = [SQUARE, INNER, STAR]
    lines = [(i, "k", rng.uniform(-2, 12), rng.uniform(-2, 12), rng.uniform(-2, 12), rng.uniform(-2, 12)) for i in range(60)]
    lines += [(60, "k", 0.0, 0.0, 10.0, 0.0), (61, "k", 0.0, 3.0, 0.0, 7.0), (62, "k", -1.0, 0.0, 11.0, 0.0), (63, "other", 1.0, 1.0, 2.0, 2.0), (64, "k", 5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(lines, "line long, k string, x1 double, y1 double, x2 double, y2 double")
    pieces = G.convex_pieces(sides(spark, {"k": shape}), "k")
    got = {r["line"]: r for r in G.inside_lengths(df, pieces, "k").collect()}
    for i, _, x1, y1, x2, y2 in lines[:60]:
        n = 4000
        share = sum(crosses(shape, x1 + (j + 0.5) / n * (x2 - x1), y1 + (j + 0.5) / n * (y2 - y1)) for j in range(n)) / n
        assert got[i]["inside_m"] == pytest.approx(share * math.hypot(x2 - x1, y2 - y1), abs=0.03)
    assert [round(got[i]["inside_m"], 4) for i in range(60, 65)] == [10.0, 4.0, 10.0, 0.0, 0.0]


def test_merged_lines(spark):
    rows = [("a", 0.0, 0.0, 4.0, 0.0), ("a", 6.0, 0.0, 3.0, 0.0), ("a", 7.0, 0.0, 8.0, 0.0), ("a", 0.0, 0.0, 3.0, 3.0), ("a", 4.0, 4.0, 2.0, 2.0), ("a", 0.0, 1.0, 4.0, 1.0), ("b", 0.0, 0.0, 4.0, 0.0), ("a", 1.0, 1.0, 1.0, 1.0), ("a", 2.0, 5.0, 2.0, 1.0), ("a", 2.0, 2.0, 2.0, 9.0)]
    df = spark.createDataFrame(rows, "k string, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["k"], *(round(r[c], 6) for c in G.ENDS)) for r in G.merged_lines(df, "k").collect())
    assert got == [("a", 0.0, 0.0, 4.0, 4.0), ("a", 0.0, 0.0, 6.0, 0.0), ("a", 0.0, 1.0, 4.0, 1.0), ("a", 2.0, 1.0, 2.0, 9.0), ("a", 7.0, 0.0, 8.0, 0.0), ("b", 0.0, 0.0, 4.0, 0.0)]


def test_polygons_to_geojson_and_back(spark, tmp_path):
    import json

    from fieldloom.sources import files

    hole = {(r, c) for r in range(5) for c in range(6)} - {(1, 1), (2, 1), (3, 4)} | {(8, 8)}
    df = spark.createDataFrame(sorted(("a", r, c) for r, c in hole), "name string, row int, col int")
    features = [json.loads(r["value"]) for r in files.polygons_geojson(G.traced(df, 1.0, "name"), "name").collect()]
    assert sorted(len(f["geometry"]["coordinates"]) for f in features) == [1, 3]
    assert all(r[0] == r[-1] for f in features for r in f["geometry"]["coordinates"])
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    back = files.read_regions(spark, f"file://{path}")
    rings = defaultdict(list)
    for r in back.orderBy("polygon_id", "ring", "place").collect():
        rings[r["polygon_id"], r["ring"]].append((r["x"], r["y"]))
    assert {(r, c) for r in range(-1, 10) for c in range(-1, 10) if crosses(list(rings.values()), c + 0.5, r + 0.5)} == hole
    bow = {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in [*BOW_TIE, BOW_TIE[0]]]]}}
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [bow]}))
    assert sorted(r["n"] for r in files.read_regions(spark, f"file://{path}").groupBy("ring").count().withColumnRenamed("count", "n").collect()) == [3, 3]


def test_long_lines_over_small_or_no_regions(spark):
    line = spark.createDataFrame([(1, -1e6, 0.5, 1e6, 0.5)], "line long, x1 double, y1 double, x2 double, y2 double")
    cell = G.cell_pieces(spark.createDataFrame([(0, 0)], "row int, col int"), 1.0)
    assert G.inside_lengths(line, cell).first()["inside_m"] == pytest.approx(1.0, abs=1e-4)
    assert G.inside_lengths(line, cell.filter("y0 > 5")).first()["inside_m"] == 0
