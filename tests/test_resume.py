"""Resumable runs: what is redone after cuts, losses and changes, and a whole run held against direct computations."""

from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import sidewise as S
from fieldloom.plans import fieldrun
from fieldloom.sources import files
from fieldloom.sources.manifest import Stage, completeness, files_mark, resume


def chain(spark, at, factor=2, calls=None):
    def doubled(_, t):
        (calls if calls is not None else []).append("b")
        return t["a"].withColumn("v", F.col("v") * factor)

    return [
        Stage("a", lambda sp, _: sp.read.parquet(at).withColumnRenamed("id", "v"), reads=(at,)),
        Stage("b", doubled, ("a",), settings=str(factor)),
        Stage("c", lambda _, t: t["b"].agg(F.sum("v").cast("string").alias("value")), ("b",), write=lambda df, path: df.write.mode("overwrite").text(path), lines=True),
        Stage("other", lambda sp, _: sp.range(3)),
    ]


def made(rows):
    return [r["stage"] for r in rows if r["made"]]


def test_only_what_must_be_is_redone(spark, tmp_path):
    at, root = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(5).write.parquet(at)
    first = resume(spark, root, chain(spark, at))
    assert made(first) == ["a", "b", "c", "other"] and [r["rows"] for r in first] == [5, 5, 1, 3]
    marks = [files_mark(spark, f"{root}/stages/{n}") for n in "abc"]
    calls = []
    assert made(resume(spark, root, chain(spark, at, calls=calls))) == [] and not calls
    assert marks == [files_mark(spark, f"{root}/stages/{n}") for n in "abc"]
    assert made(resume(spark, root, chain(spark, at, 3))) == ["b", "c"]  # a setting
    assert spark.read.text(f"{root}/stages/c").first()["value"] == "30"
    shutil.rmtree(f"{root}/stages/a")  # a lost table, and all that stands on it
    assert [r["complete"] for r in completeness(spark, root, ["a", "b", "none"]).collect()] == [False, True, False]
    assert made(resume(spark, root, chain(spark, at, 3))) == ["a", "b", "c"]
    spark.range(7).write.mode("overwrite").parquet(at)  # another input
    again = resume(spark, root, chain(spark, at, 3))
    assert made(again) == ["a", "b", "c"] and again[0]["rows"] == 7


def test_a_stage_that_fails_is_made_next_time(spark, tmp_path):
    at, root = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(5).write.parquet(at)
    good = chain(spark, at)
    resume(spark, root, good)

    def broken(_, t):
        raise RuntimeError("cut off")

    with pytest.raises(RuntimeError):
        resume(spark, root, [good[0], Stage("b", broken, ("a",), settings="new"), *good[2:]])
    assert [r["complete"] for r in completeness(spark, root, ["a", "b"]).collect()] == [True, False]
    assert made(resume(spark, root, good)) == ["b", "c"]


def test_a_need_must_come_before(spark, tmp_path):
    with pytest.raises(ValueError, match="needs a"):
        resume(spark, f"{tmp_path}/out", [Stage("b", lambda _, t: t["a"], ("a",))])


def test_whole_run_equals_direct_computations(spark, tmp_path):
    cells = [(r, c) for r in range(24) for c in range(30)]
    rows = [(r, c, 0.5 + 0.3 * ((r * 7 + c * 3) % 11) / 11, 0.3 - 0.005 * (c // 6), 0.2, 0.25, 0.4 + 0.01 * c, 100.0 + r) for r, c in cells]
    rows[0] = (0, 0, None, *rows[0][3:])  # a band without a value
    px = spark.createDataFrame(rows, "row int, col int, nir double, re double, r double, g double, ndvi double, elev double")
    at = fieldrun.write_bands(spark, px, str(tmp_path))
    outline = {"features": [{"properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [28, 0], [28, 20], [0, 20], [0, 0]]]}}]}
    (tmp_path / "field.json").write_text(json.dumps(outline))
    shutil.rmtree(at)
    files.write_paths(spark, {**{b: b for b in fieldrun.BANDS}, "dem": None, "shape": "field.json"}, at)
    root = f"{tmp_path}/out"
    report = {r["stage"]: r["rows"] for r in fieldrun.field_run(spark, at, root, slopes=True)}
    assert report["pixels"] == 28 * 20 - 1 == report["zones"]  # cells inside, but for the one without a value
    table = lambda n: spark.read.parquet(f"{root}/stages/{n}")
    assert table("pixels").filter("elev is not null").count() == 0
    zones = table("zones").filter("zone > 0").join(table("features").select("row", "col", "f1"), ["row", "col"])
    means = [r["m"] for r in zones.groupBy("zone").agg(F.avg("f1").alias("m")).orderBy("zone").collect()]
    assert means == sorted(means) and len(means) == 3
    target = {(r["row"], r["col"]) for r in table("target").collect()}
    (tmp_path / "rings.json").write_text('{"features": [' + ",".join(r["value"] for r in spark.read.text(f"{root}/stages/target_geojson").collect()) + "]}")
    back = S.cells_in_rings(files.read_rings(spark, f"{tmp_path}/rings.json"), 1.0, "polygon_id")
    assert {(r["row"], r["col"]) for r in back.collect()} == target
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{root}/stages/missions_geojson").collect()]
    assert len(lines) == sum(report[f"mission_{m}"] for m in fieldrun.MISSIONS) > 0
    length = sum(((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 for a, b in (x["geometry"]["coordinates"] for x in lines))
    told = [json.loads(r["value"]) for r in spark.read.text(f"{root}/stages/missions_json").collect()]
    assert sum(m["length_m"] for m in told) == pytest.approx(length)
    assert files.read_csv(spark, f"{root}/stages/zones_csv", "zone int, n long").agg(F.sum("n")).first()[0] == zones.count()
    shutil.rmtree(f"{tmp_path}/nir")
    with pytest.raises(FileNotFoundError, match="nir"):
        fieldrun.field_run(spark, at, root)
