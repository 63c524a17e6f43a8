"""Stages of a run with a manifest, so that a run which was interrupted, or whose inputs changed, redoes only what it must.

A stage's key digests its settings, the keys of the stages it needs and the files it reads (names, sizes, times). Its manifest
row is written after its data; it counts as complete if the key is the present one and the data's files are those recorded, so a
stage that was cut off, lost a file, or stands on anything changed is made again, and with it all that need it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.files import exists

Tables = dict[str, DataFrame]


def _parquet(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("compression", "zstd").parquet(path)


@dataclass(frozen=True)
class Stage:
    """make(spark, tables of `needs`) gives the table that `write` puts down; `reads` are files it reads itself."""

    name: str
    make: Callable[[SparkSession, Tables], DataFrame]
    needs: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()
    settings: str = ""
    write: Callable[[DataFrame, str], None] = _parquet
    lines: bool = False  # the sink is text, not Parquet


def files_mark(spark: SparkSession, path: str) -> str:
    """Number, bytes, latest time and names' digest of the files below a path, listed by Spark; empty if there is no such path."""
    if not exists(spark, path):
        return ""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.xxhash64(F.substring_index("path", "/", -1), "length").cast("decimal(20,0)")
    row = found.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"), F.max("modificationTime").cast("string").alias("t"), F.sum(name).alias("h")).first()
    return f"{row['n']}:{row['b']}:{row['t']}:{row['h']}"


def _recorded(spark: SparkSession, path: str) -> dict:
    """A manifest row; empty if it is missing or was cut off."""
    if not exists(spark, f"{path}/_SUCCESS"):
        return {}
    lines = spark.read.text(path).collect()  # one row
    try:
        return json.loads(lines[0]["value"]) if lines else {}
    except ValueError:
        return {}


def resume(spark: SparkSession, root: str, stages: list[Stage]) -> list[dict]:
    """Brings all stages below root up to date, in the order given; stage, key, rows, data, made for each (made: in this call).

    A stage that needs one not listed before it is an error. Stages with a table have it at root/stages/name.
    """
    keys: dict[str, str] = {}
    anew: set[str] = set()
    out = []
    for s in stages:
        unknown = [n for n in s.needs if n not in keys]
        if unknown:
            raise ValueError(f"stage {s.name} needs {', '.join(unknown)}, not made before it")
        parts = [s.name, s.settings, *[keys[n] for n in s.needs], *[f"{p}={files_mark(spark, p)}" for p in s.reads]]
        keys[s.name] = hashlib.sha256("\n".join(parts).encode()).hexdigest()
        data, note = f"{root}/stages/{s.name}", f"{root}/manifest/{s.name}"
        have = _recorded(spark, note)
        made = bool(anew.intersection(s.needs)) or have.get("key") != keys[s.name] or have.get("data") != files_mark(spark, data)
        if made:
            anew.add(s.name)
            if have:
                _write_note(spark, note, {})
            s.write(s.make(spark, {n: spark.read.parquet(f"{root}/stages/{n}") for n in s.needs}), data)
            have = {"stage": s.name, "key": keys[s.name], "rows": _rows(spark, s, data), "data": files_mark(spark, data)}
            _write_note(spark, note, have)
        out.append({**have, "made": made})
    return out


def _rows(spark: SparkSession, stage: Stage, path: str) -> int:
    """Rows of a table, from the Parquet footers; lines of any other sink."""
    return (spark.read.text(path) if stage.lines else spark.read.parquet(path)).count()


def _write_note(spark: SparkSession, path: str, note: dict) -> None:
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def completeness(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """stage, complete, rows of the stages named: complete if the files recorded in the manifest are there."""
    rows = []
    for n in names:
        have = _recorded(spark, f"{root}/manifest/{n}")
        done = bool(have) and have["data"] == files_mark(spark, f"{root}/stages/{n}")
        rows.append((n, done, have.get("rows")))
    return spark.createDataFrame(rows, "stage string, complete boolean, rows long")
