"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

DATA = "/root/testdata/sf0.001"
FAST = ["band_indices", "canopy_zone_stats", "minmax_features", "decimate_average", "false_colour_stretch", "p80_sidewise", "side_stats", "diamond_dilation", "closing_5x5", "zone_components", "filled_holes", "gaussian_smoothing",
        "variance_reduction", "davies_bouldin", "sweep_segments", "vine_sweeps_nitrogen", "scanline_swaths", "sidewise_patches", "per_field_kpis", "cells_in_polygon", "cropped_raster", "rgb_preview",
        "experiment_geometry", "experiment_risk", "mission_layers", "side_split", "snake_rows", "patch_rings", "patch_overlay", "nearest_free_cell",
        "lloyd_centroids", "fuzzy_indices", "contour_totals", "zone_densities", "hexagon_counts", "warped_elevation"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    from fieldloom.plans import catalog

    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
