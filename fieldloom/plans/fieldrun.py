"""One resumable run: a paths file and a field's outline in; zones, missions, targets and their tables out, in every sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import clustering as C
from fieldloom.operators import geometry as G
from fieldloom.operators import missions as P
from fieldloom.operators import morphology as M
from fieldloom.operators import sidewise as S
from fieldloom.operators import zones as Z
from fieldloom.plans.rasters import pixels
from fieldloom.plans.registry import query
from fieldloom.session import scratch, stored
from fieldloom.sources import files
from fieldloom.sources import raster as R
from fieldloom.sources.manifest import Stage, resume

BANDS = ("nir", "re", "r", "g", "ndvi")
MISSIONS = ("water", "nitrogen", "p80")


def field_stages(paths: dict[str, str | None], name: str = "data", methods: tuple[str, ...] = ("kmeans",), k: int = 3, pixel_m: float = 1.0, smooth_m: float = 2.5, slopes: bool = False) -> list[Stage]:
    """The stages of a run over Parquet band tables (row, col, value), a DEM of the same grid and an outline in metres, both optional.

    The first method that works is the one whose zones the missions serve; slopes without a DEM give straight connectors.
    Outside the outline there are no pixels. A pixel that a band lacks or holds as null is left out; one without height has none.
    """

    def stacked(spark: SparkSession, _: dict) -> DataFrame:
        band = lambda b: spark.read.parquet(paths[b]).select("row", "col", F.col("value").alias(b)).filter(F.col(b).isNotNull())
        px = R.stack_bands(*[band(b) for b in BANDS]).withColumn("ndre", R.ratio_index("nir", "re"))
        if paths["shape"]:
            sides = files.read_rings(spark, paths["shape"])
            px = px.join(S.cells_in_rings(sides, pixel_m, "polygon_id").select("row", "col").distinct(), ["row", "col"], "left_semi")
        if not paths["dem"]:
            return px.withColumn("elev", F.lit(None).cast("double"))
        return px.join(spark.read.parquet(paths["dem"]).select("row", "col", F.col("value").alias("elev")), ["row", "col"], "left")

    def smooth(_: SparkSession, t: dict) -> DataFrame:
        grid = t["pixels"].withColumn("veg", F.col("ndre") > Z.VEGETATION)
        columns = ("ndre", "ndvi", "nir", "r")
        even = M.gaussian(grid.select("row", "col", *columns, "veg"), columns, max(1.0, smooth_m / pixel_m), F.col("veg"))
        return Z.min_max(Z.features(even.filter("veg"))).select("row", "col", *Z.NAMES)

    def zones(_: SparkSession, t: dict) -> DataFrame:
        each = []
        for method, labelled in C.fit_all(t["features"], k, methods).items():
            z = Z.map_labels(labelled, Z.order_labels(labelled, "f1"), None).select("row", "col", "zone")
            whole = t["pixels"].select("row", "col").join(z, ["row", "col"], "left").withColumn("zone", F.coalesce("zone", F.lit(0)))
            each.append(whole.withColumns({"dataset": F.lit(name), "method": F.lit(method), "place": F.lit(len(each))}))
        return reduce(lambda a, b: a.unionByName(b), each)

    def served(t: dict) -> DataFrame:
        first = t["zones"].agg(F.min_by("method", "place").alias("m")).first()["m"]
        return t["zones"].filter(F.col("method") == first).select("row", "col", "zone")

    def target(_: SparkSession, t: dict) -> DataFrame:
        canopy = served(t).filter("zone > 0").join(t["pixels"].select("row", "col", "ndre"), ["row", "col"])
        return Z.percentile_target(canopy).select("row", "col", "ndre")

    def mission(rule: str):
        def make(_: SparkSession, t: dict) -> DataFrame:
            z = served(t)
            if rule == "p80":
                return P.mission(z, rule, "water", t["target"].select("row", "col"))
            steep = M.slope(t["pixels"], pixel_m) if slopes and paths["dem"] else None
            return P.mission(z, rule, rule, cost=None if steep is None else M.cost_grid(z, rule, steep))

        return make

    def lines(_: SparkSession, t: dict) -> DataFrame:
        every = reduce(lambda a, b: a.unionByName(b), [t[f"mission_{m}"] for m in MISSIONS])
        at = lambda x, y: F.struct((F.col(x) * pixel_m).alias("x"), (F.col(y) * pixel_m).alias("y"))
        return files.to_geojson(every.withColumn("geom", F.array(at("x1", "y1"), at("x2", "y2"))), "mission", "place", "kind")

    def rings(_: SparkSession, t: dict) -> DataFrame:
        return files.polygons_geojson(G.traced(S.patches(t["target"].withColumn("side_id", F.lit(1))), pixel_m, "patch_id"), "patch_id")

    def table(_: SparkSession, t: dict) -> DataFrame:
        return Z.zone_table(served(t).join(t["pixels"], ["row", "col"]).filter("zone > 0"), k, pixel_m)

    def metrics(_: SparkSession, t: dict) -> DataFrame:
        every = reduce(lambda a, b: a.unionByName(b), [t[f"mission_{m}"].select("mission", "x1", "y1", "x2", "y2") for m in MISSIONS])
        return P.path_length(every, pixel_m)

    text = lambda df, path: df.select("value").write.mode("overwrite").text(path)
    routes = tuple(f"mission_{m}" for m in MISSIONS)
    at = f"{name},{methods},{k},{pixel_m},{smooth_m},{slopes}"
    return [
        Stage("pixels", stacked, reads=tuple(p for p in paths.values() if p), settings=at),
        Stage("features", smooth, ("pixels",), settings=at),
        Stage("zones", zones, ("pixels", "features"), settings=at, write=files.write_zones),
        Stage("target", target, ("pixels", "zones"), settings=at),
        *[Stage(f"mission_{m}", mission(m), ("pixels", "zones", "target"), settings=at) for m in MISSIONS],
        Stage("missions_geojson", lines, routes, settings=at, write=text, lines=True),
        Stage("target_geojson", rings, ("target",), settings=at, write=text, lines=True),
        Stage("zones_csv", table, ("pixels", "zones"), settings=at, write=files.write_csv, lines=True),
        Stage("missions_json", metrics, routes, settings=at, write=files.write_metrics, lines=True),
    ]


def field_run(spark: SparkSession, paths_file: str, root: str, **settings) -> list[dict]:
    """Brings the run of a paths file below root up to date; its missing inputs are named in one error."""
    paths = files.read_paths(spark, paths_file)
    given = [n for n in paths if paths[n]]
    found = dict(zip(given, files.require(spark, paths_file.rsplit("/", 1)[0], [paths[n] for n in given]), strict=True))
    return resume(spark, root, field_stages({n: found.get(n) for n in paths}, **settings))


def write_bands(spark: SparkSession, px: DataFrame, root: str) -> str:
    """Puts a pixel table down as band tables with their paths file, whose path is returned."""
    for band in (*BANDS, "elev"):
        px.select("row", "col", F.col(band).alias("value")).write.mode("overwrite").parquet(f"{root}/{band}")
    files.write_paths(spark, {**{b: b for b in BANDS}, "dem": "elev", "shape": None}, f"{root}/paths")
    return f"{root}/paths"


@query()
def resumed_run(spark, sf_dir):
    """A whole run over the raster's band tables, then the same again: rows of each stage, and whether the second call made it anew."""
    root = scratch(spark)
    at = write_bands(spark, stored(pixels(spark, sf_dir)), root)  # six bands read it
    field_run(spark, at, f"{root}/out")
    again = field_run(spark, at, f"{root}/out")
    return spark.createDataFrame([(r["stage"], r["rows"], r["made"]) for r in again], "stage string, rows long, made_again boolean")
