"""What the findings of the fourth review showed, on small tables."""

from __future__ import annotations

import os

import numpy as np
import pytest

from fieldloom.operators.zones import NAMES

DATA = "/root/testdata/sf0.001"
POINTS = "row int, col int, " + ", ".join(f"{c} double" for c in NAMES)


def test_silhouette_counts_every_point(spark, monkeypatch):
    """the silhouette was that of 5000 points; now it is of all, and equal points meet once with their number."""
    from pyspark.sql import functions as F

    from fieldloom.operators import metrics, pairs

    monkeypatch.setattr(pairs, "BLOCK", 700)
    draw = np.random.default_rng(4)
    x = draw.integers(0, 9, (6001, 5)) / 8
    label = np.where(np.arange(6001) == 17, 7, (x[:, 0] > 0.5) + (x[:, 1] > 0.6))  # one cluster of one point
    table = spark.createDataFrame([(i, 0, *map(float, p), int(k)) for i, (p, k) in enumerate(zip(x, label, strict=True))], f"{POINTS}, label int")
    got = metrics.silhouette(table).first()
    ids, own, count = np.unique(label, return_inverse=True, return_counts=True)
    d = np.concatenate([np.sqrt(((x[i : i + 200, None] - x[None]) ** 2).sum(-1)) @ np.eye(len(ids))[own] for i in range(0, len(x), 200)])
    at = np.arange(len(x))
    near, mean = d[at, own] / np.maximum(count[own] - 1, 1), d / count
    mean[at, own] = np.inf
    want = np.where(count[own] > 1, (mean.min(1) - near) / np.maximum(near, mean.min(1)), 0.0).mean()
    assert got["n"] == 6001 and got["silhouette"] == pytest.approx(want, abs=1e-9)
    assert metrics.silhouette(table, 100).first()["n"] == 100
    assert metrics.silhouette(table.filter(F.lit(False))).first()["n"] == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_comparison_holds_the_slope_aware_missions(spark):
    """each rule's mission over the slopes was left out of the comparison; it is the mission planned alone."""
    from fieldloom.operators import missions, morphology
    from fieldloom.plans import catalog
    from fieldloom.plans.rasters import zoned
    from fieldloom.session import stored

    got = {r.mission: (r.segments, pytest.approx(r.length_m)) for r in catalog.QUERIES["mission_comparison"](spark, DATA).collect()}
    assert set(got) == {"water", "water_slope", "nitrogen", "nitrogen_slope", "snake"}
    z = stored(zoned(spark, DATA))
    slopes = morphology.slope(z, 1.0)
    for rule in ("water", "nitrogen"):
        for name, cost in ((rule, None), (f"{rule}_slope", stored(morphology.cost_grid(z, rule, slopes)))):
            alone = missions.path_length(missions.mission(z, name, rule, cost=cost)).first()
            assert got[name] == (alone["segments"], alone["length_m"])


def _points(spark, x):
    return spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(x)], POINTS)


def _same(got, want):
    """Whether two labellings part the points alike."""
    return len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("k", [2, 5])
def test_ward_merges_all_points(spark, monkeypatch, k):
    """F7, F8: Ward's tree stood on 3000 points; now on all, in rounds over blocks, as the plain tree of all rows has it."""
    from fieldloom.operators import clustering, linkage, pairs

    monkeypatch.setattr(pairs, "BLOCK", 250)
    monkeypatch.setattr(linkage, "LAST", 120)
    draw = np.random.default_rng(k)
    x = np.concatenate([draw.normal(m, 0.6, (150, 5)) for m in (0, 1, 3)] + [[[40.0] * 5], [[44.0] * 5]])  # the two far ones are an early pair
    x = np.concatenate([x, x[:90]])  # and some points stand twice
    got = {r.row: r.label for r in clustering.fit_labels(_points(spark, x), "ward", k).collect()}
    assert _same([got[i] for i in range(len(x))], clustering.ward(x, k))


def test_spectral_graph_holds_all_points(spark, monkeypatch):
    """F7, F8: the graph had 3000 points; now each distinct one. Two rings that no centre parts."""
    from fieldloom.operators import clustering, pairs

    monkeypatch.setattr(pairs, "BLOCK", 300)
    monkeypatch.setattr(clustering, "DENSE", 100)
    turn = np.linspace(0, 2 * np.pi, 600, endpoint=False)
    x = np.zeros((1200, 5))
    x[:, 0], x[:, 1] = (np.concatenate([f(turn), 3 * f(turn)]) for f in (np.cos, np.sin))
    x = np.concatenate([x, x[:50], x[:50]])
    got = {r.row: r.label for r in clustering.fit_labels(_points(spark, x), "spectral", 2).collect()}
    truth = np.hypot(x[:, 0], x[:, 1]) > 2
    assert len(got) == len(x) and _same([got[i] for i in range(len(x))], truth.tolist())


def test_leading_vectors_equal_dense_ones():
    from fieldloom.operators import clustering

    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(m, 0.5, (200, 5)) for m in (0, 1, 2.5)])
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :11]
    graph = np.zeros((600, 600))
    np.put_along_axis(graph, near, 1.0, axis=1)
    graph = (graph + graph.T) / 2
    scale = 1 / np.sqrt(graph.sum(1))
    graph *= scale[:, None] * scale
    rows, cols = np.nonzero(graph)
    got = clustering.leading(cols, np.searchsorted(rows, np.arange(600)), graph[rows, cols], 600, 3)
    want = np.linalg.eigh(graph)[1][:, :-4:-1]
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)  # two parts of the graph share the greatest value


def test_mini_batch_and_mixture_read_all_points(spark, monkeypatch):
    """F7, F8: mini-batches left two tenths of the points out."""
    from fieldloom.operators import clustering

    x = np.random.default_rng(8).random((400, 5))
    seen, plain = [], clustering.nearest_centre
    monkeypatch.setattr(clustering, "nearest_centre", lambda p, c: seen.extend(r.row for r in p.select("row").collect()) or plain(p, c))
    clustering.mini_batch(_points(spark, x), 3)
    assert sorted(seen) == list(range(400))


def test_bins_do_not_grow_with_the_length_of_a_narrow_map(spark):
    """lines met a region's pieces in bins as wide as the map, each with ever more rows as the map grew in length."""
    from fieldloom.operators import geometry

    def size(length):
        rows = [(0.0, 10.0, float(y), float(y)) for y in range(length)]
        return geometry.even_size(spark.createDataFrame(rows, "x1 double, x2 double, y1 double, y2 double"), ("x1", "x2"), ("y1", "y2"))

    assert size(1000) == pytest.approx(size(100), rel=0.02) and geometry.even_size(spark.createDataFrame([], "x1 double, x2 double, y1 double, y2 double"), ("x1", "x2"), ("y1", "y2")) > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_measured_mission_finds_its_patches_once(spark, monkeypatch):
    """the raster and its patches were made anew for the swaths, the connectors and the metrics."""
    from fieldloom.operators import sidewise
    from fieldloom.plans import catalog

    made, patches = [], sidewise.patches
    monkeypatch.setattr(sidewise, "patches", lambda *a: made.append(1) or patches(*a))
    row, = catalog.QUERIES["mission_metrics"](spark, DATA).collect()
    assert len(made) == 1 and row["target_cells"] > 0 and row["waypoint_count"] > 0


def test_seeds_are_drawn_from_distinct_points(spark, monkeypatch):
    """a drawing pass read every row; equal points now go once with their number, and keep their chances."""
    from fieldloom.operators import seeding

    x = np.zeros((900, 5))
    x[600:, 0] = 1.0  # 600 rows at one place, 300 at the other
    read, draw = [], seeding._draw
    monkeypatch.setattr(seeding, "_draw", lambda points, *a: read.append(points.count()) or draw(points, *a))
    seeding.parallel_seeds(_points(spark, x), 2, 3)
    assert set(read) == {2}
    ready = seeding.distinct(_points(spark, x)).selectExpr("*", "xxhash64(f1) AS _h")
    first = [d[0, 0] for d in draw(ready, [np.empty((0, 5))] * 60, 1, 0)]
    assert 28 <= first.count(0.0) <= 52  # 40 of 60 expected
