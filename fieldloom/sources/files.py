"""Configuration, vector and result files, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators import geometry

#: Lines of a paths file, in order; fixed by the format.
PATH_NAMES = ("nir", "re", "r", "g", "ndvi", "dem", "shape")


def read_paths(spark: SparkSession, path: str) -> dict[str, str | None]:
    """The seven paths of a paths file: blank lines are dropped, NONE is None, fewer lines are an error."""
    lines = [r["value"].strip() for r in spark.read.text(path).withColumn("i", F.monotonically_increasing_id()).orderBy("i").toLocalIterator()]
    lines = [x for x in lines if x]
    if len(lines) < len(PATH_NAMES):
        raise ValueError(f"{path} has {len(lines)} of {len(PATH_NAMES)} paths")
    return {n: None if n in ("dem", "shape") and x.upper() == "NONE" else x for n, x in zip(PATH_NAMES, lines, strict=False)}


def write_paths(spark: SparkSession, paths: dict[str, str | None], path: str) -> None:
    rows = [(i, paths.get(n) or "NONE") for i, n in enumerate(PATH_NAMES)]
    spark.createDataFrame(rows, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def require(spark: SparkSession, root: str, paths: list[str]) -> list[str]:
    """Absolute paths as they are, others below root; all missing ones are named in one error."""
    full = [p if p.startswith("/") or "://" in p else f"{root.rstrip('/')}/{p}" for p in paths]
    missing = [p for p in full if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))
    return full


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """polygon_id, ring_id (0 is the outer one) and points of a GeoJSON file's polygons and multipolygons."""
    raw = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature", "f"))
    ring = "array<array<array<double>>>"
    one = raw.filter("f.geometry.type = 'Polygon'").select("feature", F.array(F.from_json("f.geometry.coordinates", ring)).alias("polygons"))
    many = raw.filter("f.geometry.type = 'MultiPolygon'").select("feature", F.from_json("f.geometry.coordinates", f"array<{ring}>").alias("polygons"))
    parts = one.unionByName(many).select("feature", F.posexplode("polygons").alias("part", "rings"))
    parts = parts.withColumn("polygon_id", F.dense_rank().over(Window.orderBy("feature", "part")))  # a file's polygons: few
    return parts.select("polygon_id", F.posexplode("rings").alias("ring_id", "points")).select(
        "polygon_id", "ring_id", F.transform("points", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points")
    )


def to_geojson(lines: DataFrame, *properties: str) -> DataFrame:
    """value: a GeoJSON feature for each row with geom (array of x, y)."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("geom", lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """polygon_id, ring, place, x, y, signed_m2: the corners of a GeoJSON file's outlines, repaired by crossing parity."""
    return geometry.repaired(geometry.ring_sides(read_rings(spark, path), "polygon_id"), "polygon_id")


def polygons_geojson(corners: DataFrame, *properties: str) -> DataFrame:
    """value: a GeoJSON feature for each part of a region (see geometry.linked): its outer ring, then its holes, each closed."""
    parts = geometry.nested(corners, *properties).select(*properties, "ring", "part")
    points = F.array_sort(F.collect_list(F.struct("place", F.array("x", "y").alias("at"))))
    ring = corners.join(parts, [*properties, "ring"]).groupBy(*properties, "part", "ring", "signed_m2").agg(F.transform(points, lambda p: p["at"]).alias("line"))
    ring = ring.withColumn("line", F.concat("line", F.slice("line", 1, 1)))
    rings = F.array_sort(F.collect_list(F.struct((-F.col("signed_m2")).alias("m2"), "ring", "line")))
    whole = ring.groupBy(*properties, "part").agg(F.transform(rings, lambda r: r["line"]).alias("coordinates"))
    shape = F.struct(F.lit("Polygon").alias("type"), "coordinates")
    return whole.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), shape.alias("geometry"))).alias("value"))


def write_zones(zones: DataFrame, path: str) -> None:
    zones.write.mode("overwrite").partitionBy("dataset", "method").parquet(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(table: DataFrame, path: str) -> None:
    table.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def inventory(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """path, exists and kb (to one place, null if missing) of files or folders below root."""
    rows = []
    for n in names:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}")
        found = exists(spark, f"{root}/{n}")
        rows.append((n, found, round(where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength() / 1024, 1) if found else None))
    return spark.createDataFrame(rows, "path string, exists boolean, kb double")


def read_cache(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame | None]:
    """The artefacts of a run by name; one that wasn't written is None."""
    return {n: spark.read.parquet(f"{root}/{n}") if exists(spark, f"{root}/{n}") else None for n in names}
