"""Operators on small rasters against plain computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from fieldloom.operators import clustering, metrics, missions, morphology, sidewise, zones
from fieldloom.operators.components import components
from fieldloom.sources import files, geodesy, raster


def grid(spark, cells, names=("row", "col", "m"), types=("int", "int", "boolean")):
    return spark.createDataFrame(cells, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def random_mask(seed=1, h=14, w=17, p=0.45):
    rng = random.Random(seed)
    return {(r, c): rng.random() < p for r in range(h) for c in range(w)}


def as_mask(spark, mask):
    return grid(spark, [(r, c, v) for (r, c), v in mask.items()])


def as_set(df):
    return {(r["row"], r["col"]) for r in df.filter("m").collect()}


def flood(cells, diagonal=False):
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (diagonal or 0 in (a, b))]
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            r, c = todo.pop()
            for a, b in steps:
                if (r + a, c + b) in left:
                    left.remove((r + a, c + b))
                    part.add((r + a, c + b))
                    todo.append((r + a, c + b))
        out.append(part)
    return out


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[201] == 200


@pytest.mark.parametrize("diagonal", [False, True])
def test_cells_of_components(spark, diagonal):
    mask = random_mask()
    cells = {k for k, v in mask.items() if v}
    rows = morphology.label_cells(grid(spark, [(r, c) for r, c in cells], ("row", "col"), ("int", "int")), diagonal=diagonal).collect()
    got = {}
    for r in rows:
        got.setdefault(r["component"], set()).add((r["row"], r["col"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, flood(cells, diagonal)))


def test_stencils(spark):
    mask = random_mask(2)
    cells = {k for k, v in mask.items() if v}
    near = {(r, c) for (r, c) in mask if any(abs(r - a) + abs(c - b) <= 3 for a, b in cells)}
    assert as_set(morphology.diamond(as_mask(spark, mask), 3)) == near
    square = {(r, c) for (r, c) in mask if any((r + a, c + b) in cells for a in range(-2, 3) for b in range(-2, 3))}
    closed = {(r, c) for (r, c) in mask if all((r + a, c + b) in square for a in range(-2, 3) for b in range(-2, 3))}
    assert as_set(morphology.close(as_mask(spark, mask))) == closed


def test_holes_are_filled(spark):
    mask = random_mask(3, p=0.6)
    cells = {k for k, v in mask.items() if v}
    h, w = max(r for r, _ in mask), max(c for _, c in mask)
    holes = {x for part in flood(set(mask) - cells) if not any(r in (0, h) or c in (0, w) for r, c in part) for x in part}
    assert as_set(morphology.fill_holes(as_mask(spark, mask))) == cells | holes


def test_nearest_kept_and_island_smoothing(spark):
    rng = random.Random(4)
    kept = {(r, c): (rng.randrange(1, 4) if rng.random() < 0.03 else None) for r in range(20) for c in range(25)}
    got = {(r["row"], r["col"]): r["kept"] for r in morphology.nearest_kept(grid(spark, [(r, c, v) for (r, c), v in kept.items()], ("row", "col", "kept"), ("int", "int", "int")), 2).collect()}
    seeds = [(r, c, v) for (r, c), v in kept.items() if v]
    for (r, c), v in kept.items():
        if v is None:
            assert got[r, c] == min(((a - r) ** 2 + (b - c) ** 2, a, b, z) for a, b, z in seeds)[3]


def test_gaussian_is_mask_normalised_and_mirrored(spark):
    rng = np.random.default_rng(5)
    x, ok = rng.random((9, 11)), rng.random((9, 11)) < 0.7
    k = np.exp(-0.5 * (np.arange(-4, 5) / 1.0) ** 2)
    k /= k.sum()

    def smooth(a):
        a = np.pad(a, 4, mode="symmetric")
        a = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, a)
        return np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, a)

    want = smooth(np.where(ok, x, 0)) / np.maximum(smooth(ok.astype(float)), 1e-6)
    df = grid(spark, [(r, c, float(x[r, c]), bool(ok[r, c])) for r in range(9) for c in range(11)], ("row", "col", "v", "ok"), ("int", "int", "double", "boolean"))
    from pyspark.sql import functions as F

    got = {(r["row"], r["col"]): r["v"] for r in morphology.gaussian(df, ("v",), 1.0, F.col("ok")).collect()}
    assert all(abs(got[r, c] - want[r, c]) < 1e-9 for r in range(9) for c in range(11))


def test_sweep_drops_runs_of_three(spark):
    cells = [(0, c) for c, v in enumerate("0011110111") if v == "1"]
    got = missions.sweep(grid(spark, cells, ("row", "col"), ("int", "int")), 4).collect()
    assert [tuple(r) for r in got] == [(2, 0, 5, 0)]


def test_greedy_chain():
    picks = missions.chain_order(*map(np.array, ([0, 0, 0], [0, 4, 8], [5, 5, 5], [0, 4, 8])))
    assert picks == [(0, False), (1, True), (2, False)]


def test_shortest_path_goes_round(spark):
    cost = {(r, c): 1.0 for r in range(7) for c in range(7) if not (c == 3 and r < 6)}
    path = missions.shortest_path(cost, (0, 0), (0, 6))
    assert path[0] == (0, 0) and path[-1] == (0, 6) and (6, 3) in path and all(p in cost for p in path)
    assert missions.shortest_path(cost, (0, 0), (3, 3)) is None
    assert missions.shortest_path({(0, 0): 1.0, (5, 5): 1.0}, (0, 0), (5, 5)) is None


def test_targets_and_empty_mission(spark):
    for present, want in (((0, 1, 2, 3), {1, 2}), ((0, 1, 2), {1}), ((0, 1), set())):
        z = grid(spark, [(0, i, v) for i, v in enumerate(present)], ("row", "col", "zone"), ("int", "int", "int"))
        assert {r["zone"] for r in zones.target(z, "nitrogen").collect()} == want
    soil = grid(spark, [(r, c, 0) for r in range(6) for c in range(6)], ("row", "col", "zone"), ("int", "int", "int"))
    assert missions.mission(soil, "none").count() == 0


def test_percentile_and_order(spark):
    px = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((1, 2, 3, 4, 5))], "row int, col int, ndre double")
    assert [r["ndre"] for r in zones.percentile_target(px).collect()] == [5.0]
    labelled = spark.createDataFrame([(0, 0.5), (1, 0.2), (2, 0.9)], "label int, ndre double")
    assert {r["label"]: r["zone"] for r in zones.order_labels(labelled).collect()} == {1: 1, 0: 2, 2: 3}
    with pytest.raises(Exception, match="no zone for label"):
        zones.map_labels(labelled, zones.order_labels(labelled.filter("label > 0")), None).collect()


def test_waypoints_and_fuzzy_micro_cases(spark):
    route = spark.createDataFrame([(1, 0.0, 0.0, 1.2, 0.0)], "mission_order int, x1 double, y1 double, x2 double, y2 double")
    got = sidewise.waypoints(route, 0.5).orderBy("waypoint_id").collect()
    assert [round(r["x"], 6) for r in got] == [0.0, 0.4, 0.8, 1.2] and all(r["heading_deg"] == 0 for r in got)
    p = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, 0.0, 0.0)], "row int, col int, " + ", ".join(f"{c} double" for c in zones.NAMES))
    u = clustering.memberships(p, [(0.0,) * 5, (3.0, 0.0, 0.0, 0.0, 0.0)]).first()["u"]
    assert [round(x, 6) for x in u] == [0.8, 0.2]
    z = spark.createDataFrame([(1,)] * 2 + [(2,), (3,)], "zone int")
    assert abs(metrics.balance(z, 3).first()["entropy"] - 1.5) < 1e-9


def test_ward_and_spectral_find_blobs():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.1, (40, 5)) for m in (0, 2, 5)])
    truth = np.repeat([0, 1, 2], 40)
    for label in (clustering.ward(x, 3), clustering.spectral(x, 3)):
        assert all(len(set(label[truth == i])) == 1 for i in range(3)) and len(set(label)) == 3


def test_paths_file_and_inputs(spark, tmp_path):
    f = tmp_path / "paths.txt"
    f.write_text("\n".join(["a", "", "b", "c", "d", "e", "NONE", "none"]) + "\n")
    got = files.read_paths(spark, f"file://{f}")
    assert got["nir"] == "a" and got["dem"] is None and got["shape"] is None
    f.write_text("a\nb\n")
    with pytest.raises(ValueError, match="2 of 7"):
        files.read_paths(spark, f"file://{f}")
    with pytest.raises(FileNotFoundError, match="x.tif.*y.tif"):
        files.require(spark, f"file://{tmp_path}", ["x.tif", "y.tif"])


def test_geojson_rings_and_point_in_polygon_area(spark, tmp_path):
    f = tmp_path / "a.geojson"
    f.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"1"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,6],[0,6],[0,0]],[[2,1],[4,1],[4,5],[2,5],[2,1]]]}}]}')
    rings = files.read_rings(spark, f"file://{f}").withColumnRenamed("polygon_id", "patch_id")
    s = sidewise.scanline_swaths(rings, 0.0, 0.5, 0.1).collect()
    assert abs(sum(math.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"]) * 0.5 for r in s) - (60 - 8)) < 1.5


def test_decimation_drops_what_is_left_over(spark):
    px = grid(spark, [(r, c, float(r)) for r in range(5) for c in range(5)], ("row", "col", "nir"), ("int", "int", "double"))
    got = {(r["row"], r["col"]): r["nir"] for r in raster.decimate_average(px, 2, ("nir",)).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 2.5, (1, 1): 2.5}


def test_routes_and_metrics_hold_all_patches(spark, monkeypatch):
    from fieldloom.plans import missions as plans

    cells = [(1, p, 3 * p + r, c) for p in range(1, 10) for r in range(2) for c in range(4)]
    monkeypatch.setattr(plans, "side_patches", lambda *_: grid(spark, cells, ("side_id", "patch_id", "row", "col"), ("int",) * 4))
    cells.append((1, 10, 40, 0))  # a patch of one cell has no swath
    ground = lambda *_: grid(spark, [(s, r, c) for s, _, r, c in cells], ("side_id", "row", "col"), ("int",) * 3)
    monkeypatch.setattr(plans, "zoned", lambda *_: grid(spark, [(r, c, int(r < 3)) for _, _, r, c in cells], ("row", "col", "zone"), ("int",) * 3))
    monkeypatch.setattr(plans, "sided", ground)
    monkeypatch.setattr(plans, "pixels", ground)
    monkeypatch.setattr(plans, "ANGLE", 0.0)  # rows from west to east, 1.2 m apart
    at = {p: [1.2 * k for k in range(60) if low <= 1.2 * k < high] for p, low, high in [(p, 3 * p, 3 * p + 2) for p in range(1, 10)] + [(10, 40, 41)]}
    wide = dict.fromkeys(range(1, 10), 4.0) | {10: 1.0}
    strip = lambda r, y: y - 0.6 < r + 1 - 1e-9 and y + 0.6 > r + 1e-9
    hit = {p: sum(wide[p] for r in ((3 * p, 3 * p + 1) if p < 10 else (40,)) if any(strip(r, y) for y in ys)) for p, ys in at.items()}
    path = {p: wide[p] * len(ys) + 1.2 * (len(ys) - 1) for p, ys in at.items()}
    got = {r["patch_id"]: r for r in plans.patch_metrics(spark, "").collect()}
    assert {p: (r["swath_count"], r["route_part_count"], r["target_cells"], r["covered_cells"]) for p, r in got.items()} == {p: (len(ys), 2 * len(ys) - 1, 8 if p < 10 else 1, hit[p]) for p, ys in at.items()}
    assert all(math.isclose(got[p]["path_length_m"], path[p], abs_tol=1e-9) for p in at)
    assert all(r["failed_connector_count"] == 0 and r["outside_own_length_m"] < 1e-6 and r["outside_safe_length_m"] < 1e-6 for r in got.values())
    assert math.isclose(got[1]["vegetation_length_m"], 0, abs_tol=1e-6) and got[1]["mission_name"] == "southwest_patch_01"
    side = plans.side_metrics(spark, "").first()
    assert (side["patch_count"], side["swath_count"], side["target_area_m2"]) == (10, sum(map(len, at.values())), 73.0) and math.isclose(side["path_length_m"], sum(path.values()))
    total = plans.mission_metrics(spark, "").first()
    assert (total["target_cells"], total["covered_cells"], total["patch_count"]) == (len(cells), sum(hit.values()), 10)
    assert total["feasibility"] == sidewise.FEASIBLE
    assert all(plans.validation_suite(spark, "").first().asDict().values())


def test_lengths_outside_are_exact_and_count_once(spark):
    """Metres outside a region of two cells, of a line driven twice, one across a corner and one along the border."""
    region = grid(spark, [(1, 0, 0), (1, 1, 1)], ("k", "row", "col"), ("int",) * 3)
    rows = [(1, 1, 0, "swath", -1.0, 0.5, 3.0, 0.5), (1, 2, 0, "swath", 2.0, 0.5, -1.0, 0.5), (1, 3, 0, "swath", 0.5, 0.5, 1.5, 1.5), (1, 4, 0, "swath", 0.0, 0.0, 0.0, 1.0)]
    route = spark.createDataFrame(rows, "k int, mission_order int, hop int, segment_type string, x1 double, y1 double, x2 double, y2 double")
    none = grid(spark, [], ("k",), ("int",))
    m = sidewise.route_metrics(route, region, region, region.filter("col = 1"), none, 1.0, "k").first()
    assert math.isclose(m["path_length_m"], 8 + 2**0.5) and math.isclose(m["outside_own_length_m"], 3.0, abs_tol=1e-5)
    assert math.isclose(m["vegetation_length_m"], 2**0.5 / 2, abs_tol=1e-5)


def test_waypoints_follow_parts_through_patches(spark):
    """Numbers run patch by patch; a connector of two hops is one part; each point looks at its part's next one."""
    rows = [(2, 1, 1, 0, "swath", 0.0, 0.0, 1.2, 0.0), (1, 2, 1, 0, "swath", 5.0, 5.0, 5.0, 5.0), (1, 1, 1, 0, "swath", 0.0, 0.0, 0.0, 0.5), (1, 1, 2, 0, "connector", 0.0, 0.5, 0.3, 0.5), (1, 1, 2, 1, "connector", 0.3, 0.5, 0.3, 1.6), (1, 1, 3, 0, "swath", 9.0, 1.6, 8.0, 1.6)]
    route = spark.createDataFrame(rows, "side_id int, patch_id int, mission_order int, hop int, segment_type string, x1 double, y1 double, x2 double, y2 double")
    got = sidewise.waypoints(route, 0.5, "side_id", "patch_id").orderBy("waypoint_id").collect()
    want, number = [], 1
    parts = {}
    for r in rows:
        parts.setdefault(r[:3], []).append((r[5:7], r[7:9]))
    for key in sorted(parts):
        line = [parts[key][0][0]] + [b for _, b in sorted(parts[key], key=lambda h: [r[3] for r in rows if r[:3] == key and r[5:7] == h[0]])]
        whole = sum(math.dist(a, b) for a, b in zip(line, line[1:]))
        n, points = max(1, math.ceil(whole / 0.5)), []
        for i in range(n + 1):
            left = i * whole / n
            for a, b in zip(line, line[1:]):
                m = math.dist(a, b)
                if left <= m + 1e-12:
                    break
                left -= m
            f = left / m if m else 0.0
            points.append((a[0] + f * (b[0] - a[0]), a[1] + f * (b[1] - a[1])))
        heading = [math.degrees(math.atan2(q[1] - p[1], q[0] - p[0])) for p, q in zip(points, points[1:])]
        for (x, y), h in zip(points, heading + heading[-1:], strict=True):
            want.append((*key, number, x, y, h))
            number += 1
    assert len(got) == len(want)
    for r, w in zip(got, want, strict=True):
        assert (r["side_id"], r["patch_id"], r["mission_order"], r["waypoint_id"]) == w[:4]
        assert np.allclose((r["x"], r["y"], r["heading_deg"]), w[4:])


def test_simpler_lines_stay_inside():
    def plain(points, tolerance):
        if len(points) < 3:
            return points
        a, b = np.array(points[0]), np.array(points[-1])
        def off(p):
            t = np.clip(np.dot(p - a, b - a) / max(np.dot(b - a, b - a), 1e-300), 0, 1)
            return float(np.hypot(*(p - a - t * (b - a))))
        far = [off(np.array(p)) for p in points[1:-1]]
        k = int(np.argmax(far)) + 1
        return plain(points[: k + 1], tolerance)[:-1] + plain(points[k:], tolerance) if max(far) > tolerance else [points[0], points[-1]]

    rng = random.Random(6)
    for _ in range(60):
        line = [(0.0, 0.0)]
        for _ in range(rng.randint(1, 40)):
            line.append((line[-1][0] + rng.choice([0, 1, 1]), line[-1][1] + rng.choice([-1, 0, 1]) + rng.random() * 1e-3))
        assert sidewise.simplified(line, 0.25) == plain(line, 0.25)
    cells = {(0, 0), (0, 1), (1, 1)}
    assert sidewise.covered([(0.2, 0.2), (1.5, 0.9), (1.5, 1.9)], cells, 1.0) and sidewise.covered([(0.0, 1.0), (1.0, 1.0)], cells, 1.0)
    assert not sidewise.covered([(0.2, 0.2), (1.5, 1.9)], cells, 1.0) and sidewise.covered([(0.1, 0.1), (0.1, 0.1)], cells, 1.0)


@pytest.mark.parametrize(("change", "check"), [
    ("order", "route_order_unique"), ("number", "waypoint_order_unique"), ("place", "coordinates_complete"), ("field", "fields_separated"), ("safe", "route_in_safe_area"), ("file", "output_files_exist"), ("stage", "stages_complete"), ("empty", "route_not_empty"), (None, None)])
def test_each_check_can_fail(spark, change, check):
    route = [("a", 1, 0, 0.2, 0.5, 0.8, 0.5), ("b", 1 if change == "order" else 2, 0, 0.8, 0.5, 1.8, 0.5), ("c" if change == "field" else "b", 3, 0, 1.8, 0.5, 0.5, 0.5)]
    points = [(1, 0.2, 0.5), (1 if change == "number" else 2, None if change == "place" else 0.8, 0.5)]
    table = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    got = sidewise.validated(
        table([] if change == "empty" else route, "field string, mission_order int, hop int, x1 double, y1 double, x2 double, y2 double"), table(points, "waypoint_id int, x double, y double"),
        table([(0, 0)] + ([] if change == "safe" else [(0, 1)]), "row int, col int"), table([("a",), ("b",)], "field string"), table([(True,), (change != "stage",)], "complete boolean"), table([(change != "file",)], "exists boolean"), 1.0).first().asDict()
    wrong = {n for n, ok in got.items() if not ok}
    assert wrong == ({check, "all_ok"} | ({"fields_separated"} if change == "empty" else set()) if change else set())


def test_touched_cells(spark):
    lines = grid(spark, [(0.3, 0.2, 7.1, 5.4), (2.5, 1.5, 6.5, 1.5), (4.0, 6.0, 1.0, 0.5)], ("x1", "y1", "x2", "y2"), ("double",) * 4)
    rows = [tuple(r) for r in lines.collect()]
    hit = set()
    for a, b, c, d in rows:  # points of the strip, so finely that no overlap of note is missed
        n = math.hypot(c - a, d - b)
        along, across = np.meshgrid(np.linspace(1e-6, 1 - 1e-6, 900), np.linspace(-0.599999, 0.599999, 301))
        x, y = a + along * (c - a) - across * (d - b) / n, b + along * (d - b) + across * (c - a) / n
        hit |= set(zip(np.floor(y).astype(int).ravel().tolist(), np.floor(x).astype(int).ravel().tolist(), strict=True))
    touched = {(r["row"], r["col"]) for r in sidewise.touched_cells(lines, 0.6, 1.0).collect()}
    assert hit <= touched and len(touched - hit) <= 1
    assert {(r["row"], r["col"]) for r in sidewise.buffered_cells(lines, 0.6, 1.0).collect()} <= touched


@pytest.mark.parametrize("tile", [4, 1024])
@pytest.mark.parametrize("diagonal", [False, True])
def test_components_across_tiles(spark, monkeypatch, tile, diagonal):
    monkeypatch.setattr(morphology, "TILE", tile)
    for seed in (3, 8):
        cells = sorted(k for k, v in random_mask(seed, 13, 18, 0.5).items() if v)
        rows = [(g, r, c) for g in (1, 65) for r, c in cells]  # group numbers 64 apart
        got = morphology.label_cells(grid(spark, rows, ("g", "row", "col"), ("int",) * 3), "g", diagonal=diagonal).collect()
        parts = {}
        for r in got:
            parts.setdefault((r["g"], r["component"]), set()).add((r["row"], r["col"]))
        want = sorted(sorted(p) for p in flood(cells, diagonal))
        for g in (1, 65):
            assert sorted(sorted(p) for (k, _), p in parts.items() if k == g) == want
        assert not {c for k, c in parts if k == 1} & {c for k, c in parts if k == 65}


def test_path_longer_than_the_window(spark):
    """A wall that only a detour far outside the first window passes."""
    cost = [(r, c, 1.0) for r in range(40) for c in range(9) if c != 4 or r == 39]
    chain = spark.createDataFrame([("m", 0, 0.0, 0.0, 2.0, 0.0), ("m", 1, 6.0, 0.0, 8.0, 0.0), ("m", 2, 100.0, 0.0, 101.0, 0.0)], missions.SEGMENTS)
    hops = missions.connected(chain, grid(spark, cost, ("row", "col", "cost"), ("int", "int", "double")), margin=3).collect()
    first = sorted((h for h in hops if h["seq"] == 0), key=lambda h: h["hop"])
    assert all(h["routed"] for h in first) and (first[0]["x1"], first[-1]["x2"]) == (2.0, 6.0) and max(h["y2"] for h in first) == 39.0
    length = sum(math.hypot(h["x2"] - h["x1"], h["y2"] - h["y1"]) for h in first)
    assert 78 <= length < 82
    second = [h for h in hops if h["seq"] == 1]
    assert len(second) == 1 and not second[0]["routed"]


def test_routed_connectors(spark):
    """A region shaped like a U: a connector across its gap goes round, one inside an arm stays straight, one to an island fails."""
    cells = [(1, r, c) for r in range(12) for c in range(11) if c < 3 or c > 7 or r < 2] + [(1, 20, 20)]
    region = grid(spark, cells, ("k", "row", "col"), ("int",) * 3)
    lines = spark.createDataFrame([(1, 1, 1.5, 11.5, 9.5, 11.5), (1, 2, 1.5, 3.5, 1.5, 9.5), (1, 3, 1.5, 9.5, 20.5, 20.5)], "k int, mission_order int, x1 double, y1 double, x2 double, y2 double")
    got = {r["mission_order"]: r for r in sidewise.routed_connectors(lines, region, 1.0, "k").collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["routed", "direct", "failed"] and not got[3]["points"]
    points = [(p["x"], p["y"]) for p in got[1]["points"]]
    assert points[0] == (1.5, 11.5) and points[-1] == (9.5, 11.5) and min(y for _, y in points) < 2
    inside = {(r, c) for _, r, c in cells}
    for (x1, y1), (x2, y2) in zip(points, points[1:]):
        for i in range(41):
            x, y = x1 + i / 40 * (x2 - x1), y1 + i / 40 * (y2 - y1)  # a cell's border belongs to it
            assert any((math.floor(y + e), math.floor(x + d)) in inside for e in (-1e-9, 1e-9) for d in (-1e-9, 1e-9))
    swaths = lines.select("k", "mission_order", "x1", "y1", "x2", "y2")
    route = sidewise.patch_routes(swaths, sidewise.routed_connectors(lines, region, 1.0, "k"), "k").orderBy("mission_order").collect()
    kinds = [r["segment_type"] for r in route]
    assert kinds.count("swath") == 3 and kinds[0] == "swath" and kinds[-1] == "swath" and len(route) == 3 + (len(points) - 1) + 1


def test_cells_in_rings(spark):
    rings = [[(0.3, 0.2), (9.7, 1.1), (8.2, 8.8), (4.4, 3.9), (1.1, 9.3)], [(2.0, 2.0), (3.5, 2.2), (2.8, 3.6)]]
    rows = [(1, i, [{"x": x, "y": y} for x, y in r]) for i, r in enumerate(rings)]
    got = {(r["row"], r["col"]) for r in sidewise.cells_in_rings(spark.createDataFrame(rows, "k int, ring int, points array<struct<x:double,y:double>>"), 0.5, "k").collect()}
    want = set()
    for r in range(-2, 24):
        for c in range(-2, 24):
            x, y = (c + 0.5) * 0.5, (r + 0.5) * 0.5
            odd = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1) for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))
            if odd % 2:
                want.add((r, c))
    assert got == want and len(got) > 100


def test_files_round_trip(spark, tmp_path):
    d = f"file://{tmp_path}"
    paths = {"nir": "/a/n.tif", "re": "/a/re.tif", "r": "r.tif", "g": "g.tif", "ndvi": "v.tif", "dem": None, "shape": None}
    files.write_paths(spark, paths, f"{d}/paths")
    assert files.read_paths(spark, f"{d}/paths") == paths
    zones_ = spark.createDataFrame([("data", "kmeans", 0, 1, 2), ("data", "gmm", 3, 4, 1)], "dataset string, method string, row int, col int, zone int")
    files.write_zones(zones_, f"{d}/zones")
    back = files.read_cache(spark, d, ["zones", "dem"])
    assert back["dem"] is None and sorted(tuple(r) for r in back["zones"].select(*zones_.columns).collect()) == sorted(tuple(r) for r in zones_.collect())
    files.write_csv(zones_, f"{d}/csv")
    assert sorted(tuple(r) for r in files.read_csv(spark, f"{d}/csv", "dataset string, method string, row int, col int, zone int").collect()) == sorted(tuple(r) for r in zones_.collect())
    files.write_metrics(spark.createDataFrame([("T4", 3)], "season string, swaths long"), f"{d}/metrics")
    assert [(r["season"], r["swaths"]) for r in files.read_json(spark, f"{d}/metrics", "season string, swaths long").collect()] == [("T4", 3)]
    lines = spark.createDataFrame([(1, [{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}])], "patch_id int, geom array<struct<x:double,y:double>>")
    import json

    value = json.loads(files.to_geojson(lines, "patch_id").first()["value"])
    assert value == {"type": "Feature", "properties": {"patch_id": 1}, "geometry": {"type": "LineString", "coordinates": [[0.0, 1.0], [2.0, 3.0]]}}
    assert {r["path"]: r["exists"] for r in files.inventory(spark, d, ["zones", "none"]).collect()} == {"zones": True, "none": False}


def on_ellipsoid(lat, lon):
    e2 = geodesy.FLATTENING * (2 - geodesy.FLATTENING)
    p, q = math.radians(lat), math.radians(lon)
    n = geodesy.AXIS_M / math.sqrt(1 - e2 * math.sin(p) ** 2)
    return np.array([n * math.cos(p) * math.cos(q), n * math.cos(p) * math.sin(q), n * (1 - e2) * math.sin(p)])


def test_metres_on_the_ellipsoid(spark):
    from pyspark.sql import functions as F

    pairs = [(38.7, -9.1, 38.7, -9.09998), (0.0, -9.0, 0.0005, -9.0), (60.0, 10.0, 59.9999, 10.0003), (38.7, -7.0, 38.71, -7.02)]
    t = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = [r["m"] for r in t.select(geodesy.pixel_size(*[F.col(x) for x in "abcd"]).alias("m")).collect()]
    for m, (a, b, c, d) in zip(got, pairs, strict=True):  # the chord equals the arc to 1e-7 at these distances
        assert math.isclose(m, np.linalg.norm(on_ellipsoid(a, b) - on_ellipsoid(c, d)), rel_tol=2e-6)
    # UTM: the meridian's arc by small chords; away from it, the same scale in all directions and right angles
    arc = sum(np.linalg.norm(on_ellipsoid(45 * (i + 1) / 9000, -9) - on_ellipsoid(45 * i / 9000, -9)) for i in range(9000))
    h = 1e-5
    at = [(45.0, -9.0), (0.0, -9.0), (38.7, -6.5), (38.7 + h, -6.5), (38.7, -6.5 + h)]
    east, north = geodesy.utm(F.col("lat"), F.col("lon"))
    e = [tuple(r) for r in spark.createDataFrame(at, "lat double, lon double").select(east, north).collect()]
    assert abs(e[0][0] - 500000) < 1e-6 and abs(e[0][1] - 0.9996 * arc) < 0.02 and abs(e[1][1]) < 1e-6
    up, right = np.subtract(e[3], e[2]), np.subtract(e[4], e[2])
    scales = [np.linalg.norm(v) / np.linalg.norm(on_ellipsoid(*at[i]) - on_ellipsoid(*at[2])) for v, i in ((up, 3), (right, 4))]
    assert abs(scales[0] - scales[1]) < 1e-6 and abs(up @ right) / (np.linalg.norm(up) * np.linalg.norm(right)) < 1e-6 and 0.9996 < scales[0] < 1.001
    rings = spark.createDataFrame([(1, [{"x": -9.0, "y": 0.0}])], "polygon_id int, points array<struct<x:double,y:double>>")
    assert abs(geodesy.to_metric(rings).first()["points"][0]["x"] - 500000) < 1e-6


@pytest.mark.parametrize("degrees", [0.0, 90.0, 20.0, -35.0])
def test_rotated_raster(spark, degrees):
    h, w = 7, 11
    a = np.random.default_rng(3).integers(1, 4, (h, w))
    layer = grid(spark, [(r, c, int(a[r, c])) for r in range(h) for c in range(w)], ("row", "col", "zone"), ("int",) * 3)
    got = {(r["row"], r["col"]): r["zone"] for r in missions.rotated(layer, degrees).collect()}
    rows, cols = max(r for r, _ in got) + 1, max(c for _, c in got) + 1
    t = math.radians(degrees)
    for (r, c), v in got.items():  # where each place of the frame comes from, about the centres
        y, x = r - (rows - 1) / 2, c - (cols - 1) / 2
        p, q = y * math.cos(t) + x * math.sin(t) + (h - 1) / 2, -y * math.sin(t) + x * math.cos(t) + (w - 1) / 2
        if min(abs(p % 1 - 0.5), abs(q % 1 - 0.5), abs(p), abs(q), abs(p - h + 1), abs(q - w + 1)) > 1e-6:
            assert v == (a[round(p), round(q)] if 0 <= p <= h - 1 and 0 <= q <= w - 1 else 0)
    assert len(got) == rows * cols and (degrees != 0.0 or (rows, cols) == (h, w))


def test_rotated_mission_is_turned_back(spark):
    cells = [(r, c, 1 if 6 <= r <= 24 and 6 <= c <= 30 else 0) for r in range(32) for c in range(38)]
    layer = grid(spark, cells, ("row", "col", "zone"), ("int",) * 3)
    got = {d: missions.rotated_mission(layer, "m", "water", d, 4).orderBy("place").collect() for d in (0.0, 90.0, 20.0)}
    for rows in got.values():  # all swaths lie on the zone again
        assert rows and all(4.5 <= r[x] <= 31.5 and 4.5 <= r[y] <= 25.5 for r in rows if r["kind"] == "swath" for x, y in (("x1", "y1"), ("x2", "y2")))
        assert all(math.isclose(a["x2"], b["x1"]) and math.isclose(a["y2"], b["y1"]) for a, b in zip(rows, rows[1:], strict=False))
    assert all(math.isclose(r["y1"], r["y2"]) for r in got[0.0] if r["kind"] == "swath")
    assert all(math.isclose(r["x1"], r["x2"], abs_tol=1e-6) for r in got[90.0] if r["kind"] == "swath")
    assert all(math.isclose(abs((r["y2"] - r["y1"]) / (r["x2"] - r["x1"])), math.tan(math.radians(20)), abs_tol=1e-6) for r in got[20.0] if r["kind"] == "swath")
