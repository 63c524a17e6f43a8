"""Shortest paths over a whole raster, tile by tile.

A cost grid is cut into square tiles, each one row with a rim of one pixel. A search holds, for each leg, the distances with which
its paths enter a tile; a round relaxes the tiles whose entries have fallen, in numpy and each in a task's group of its own, and
hands the distances of the pixels beyond their borders on. It ends when no entry can still better a leg's goal, so the costs are
those of a search over the whole grid while no task holds more than a tile. Paths are then read back from the goals, a tile a round.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import morphology
from fieldloom.session import settled, stored

#: Rows and columns of a tile.
TILE = 128
LEG = ["mission", "seq"]
AT = [*LEG, "t_row", "t_col"]
ENTRIES = "mission string, seq int, t_row int, t_col int, row int, col int, arrived boolean, b_row int, b_col int, dist double, from_row int, from_col int"
STEPS = "mission string, seq int, part int, place int, row int, col int, from_row int, from_col int"


def tile_of(c: str | Column, size: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("int")


def cost_tiles(cost: DataFrame, size: int = TILE) -> DataFrame:
    """t_row, t_col, cells of each tile with its rim: costs as doubles in rows of size + 2 pixels, NaN where there is no pixel."""
    def near(c: str) -> Column:
        return F.explode(F.array_distinct(F.array(*[tile_of(F.col(c) + d, size) for d in (-1, 0, 1)])))

    spread = cost.select("row", "col", F.col("cost").cast("double").alias("cost"), near("row").alias("t_row")).withColumn("t_col", near("col"))
    place = (F.col("row") - F.col("t_row") * size + 1) * (size + 2) + F.col("col") - F.col("t_col") * size + 1

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flat = np.full((size + 2) ** 2, np.nan)
        flat[rows["place"].to_numpy()] = rows["cost"].to_numpy()
        return pd.DataFrame({"t_row": [key[0]], "t_col": [key[1]], "cells": [flat.tobytes()]})

    return stored(spread.select("t_row", "t_col", place.alias("place"), "cost").groupBy("t_row", "t_col").applyInPandas(packed, "t_row int, t_col int, cells binary"))


def moves(diagonal: float) -> list[tuple[int, int, float]]:
    return [(dr, dc, diagonal if dr and dc else 1.0) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def relaxed(cells: np.ndarray, rows: np.ndarray, cols: np.ndarray, dist: np.ndarray, diagonal: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances in a tile with rim from its entries, and the number of the move into each pixel (-1: an entry, or out of reach).
    A step pays the cost of the pixel that it enters; rim pixels are entered but not left."""
    n = len(cells)
    enter = np.where(np.isnan(cells), np.inf, cells)
    best, came = np.full(cells.shape, np.inf), np.full(cells.shape, -1, np.int8)
    np.minimum.at(best, (rows, cols), dist)
    while True:
        fell = False
        for k, (dr, dc, length) in enumerate(moves(diagonal)):
            # from the tile's own pixels to their neighbours
            to = (slice(1 + dr, n - 1 + dr), slice(1 + dc, n - 1 + dc))
            total = best[1:-1, 1:-1] + length * enter[to]
            less = total < best[to]
            if less.any():
                best[to][less], came[to][less], fell = total[less], k, True
        if not fell:
            return best, came


def reachable(legs: DataFrame, cost: DataFrame) -> DataFrame:
    """The legs (mission, seq, a_row, a_col, b_row, b_col) whose goal has a cost and lies in a component of the pixel or a neighbour of the start."""
    runs = stored(morphology.label_runs(cost.select("row", "col"), diagonal=True).select("row", "c0", "c1", "component"))
    starts = legs.select(*LEG, F.explode(F.array(*[F.struct((F.col("a_row") + r).alias("row"), (F.col("a_col") + c).alias("at")) for r in (-1, 0, 1) for c in (-1, 0, 1)])).alias("p")).select(*LEG, "p.row", "p.at")
    goals = legs.select(*LEG, F.col("b_row").alias("row"), F.col("b_col").alias("at"))
    met = [t.join(runs, "row").filter(F.col("at").between(F.col("c0"), F.col("c1"))).select(*LEG, "component") for t in (starts, goals)]
    return legs.join(met[0].join(met[1], [*LEG, "component"]).select(*LEG).distinct(), LEG, "left_semi")


def entries(legs: DataFrame, tiles: DataFrame, least: float, diagonal: float, size: int = TILE) -> DataFrame:
    """The least distances with which each leg's paths enter its tiles, and the arrivals; goals must be within reach, costs at least `least`, above 0."""
    spark = legs.sparkSession
    none = F.lit(None).cast("int")
    now = stored(legs.select(*LEG, tile_of("a_row", size).alias("t_row"), tile_of("a_col", size).alias("t_col"), F.col("a_row").alias("row"), F.col("a_col").alias("col"), F.lit(False).alias("arrived"), "b_row", "b_col", F.lit(0.0).alias("dist"), none.alias("from_row"), none.alias("from_col"), F.lit(True).alias("fresh")))
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def entered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mission, seq, t_row, t_col = key
        row, col = int(t_row) * size - 1, int(t_col) * size - 1
        cells = np.frombuffer(rows["cells"].iloc[0], float).reshape(size + 2, size + 2)
        at = np.array([(e["row"] - row, e["col"] - col) for e in rows["seeds"].iloc[0]])
        best, came = relaxed(cells, at[:, 0], at[:, 1], np.array([e["dist"] for e in rows["seeds"].iloc[0]]), diagonal)
        rim = np.ones(cells.shape, bool)
        rim[1:-1, 1:-1] = False
        r, c = np.nonzero(rim & np.isfinite(best))
        step = np.array([m[:2] for m in moves(diagonal)])[came[r, c]].reshape(-1, 2)
        goal = rows["b_row"].iloc[0] - row, rows["b_col"].iloc[0] - col
        out = pd.DataFrame({"row": r + row, "col": c + col, "arrived": False, "dist": best[r, c], "from_row": r + row - step[:, 0], "from_col": c + col - step[:, 1]})
        if all(1 <= g <= size for g in goal) and np.isfinite(best[goal]):
            out.loc[len(out)] = [goal[0] + row, goal[1] + col, True, best[goal], -1, -1]
        out["t_row"], out["t_col"] = out["row"] // size, out["col"] // size
        return out.assign(mission=mission, seq=seq, b_row=goal[0] + row, b_col=goal[1] + col)[names]

    while True:
        arrived = now.filter("arrived").groupBy(*LEG).agg(F.min("dist").alias("bound"))
        ahead = F.col("dist") + least * F.greatest(F.abs(F.col("row") - F.col("b_row")), F.abs(F.col("col") - F.col("b_col")))
        front = now.filter("fresh and not arrived").join(arrived, LEG, "left").filter(F.col("bound").isNull() | (ahead < F.col("bound") + 1e-9))
        if not front.take(1):
            return now.drop("fresh")
        work = front.groupBy(*AT).agg(F.collect_list(F.struct("row", "col", "dist")).alias("seeds"), F.first("b_row").alias("b_row"), F.first("b_col").alias("b_col"))
        step = work.join(tiles, ["t_row", "t_col"]).groupBy(*AT).applyInPandas(entered, ENTRIES)
        both = now.withColumn("fresh", F.lit(False)).unionByName(step.withColumn("fresh", F.lit(True)))
        least_first = F.min(F.struct("dist", "fresh", "from_row", "from_col")).alias("e")  # of equal ones the known entry stays
        now = settled(spark, lambda b=both, e=least_first: b.groupBy(*AT, "row", "col", "arrived", "b_row", "b_col").agg(e).select(*AT, "row", "col", "arrived", "b_row", "b_col", "e.*"), now)


def read_back(found: DataFrame, tiles: DataFrame, diagonal: float, size: int = TILE) -> DataFrame:
    """mission, seq, hop (from 0), row, col, from_row, from_col: the steps of each arrived leg's path."""
    own = stored(found.filter("not arrived").groupBy(*AT).agg(F.collect_list(F.struct("row", "col", "dist", "from_row", "from_col")).alias("seeds")))
    now = found.filter("arrived").select(*AT, F.lit(0).alias("part"), F.col("row").alias("at_row"), F.col("col").alias("at_col"))
    names = [c.split()[0] for c in STEPS.split(", ")]

    def walked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        row, col = int(key[2]) * size - 1, int(key[3]) * size - 1
        seeds = {(e["row"] - row, e["col"] - col): e for e in one["seeds"]}
        at = np.array(list(seeds))
        best, came = relaxed(np.frombuffer(one["cells"], float).reshape(size + 2, size + 2), at[:, 0], at[:, 1], np.array([e["dist"] for e in seeds.values()]), diagonal)
        out, p = [], (int(one["at_row"]) - row, int(one["at_col"]) - col)
        while came[p] >= 0:
            step = moves(diagonal)[came[p]]
            q = p[0] - step[0], p[1] - step[1]
            out.append((p[0] + row, p[1] + col, q[0] + row, q[1] + col))
            p = q
        out.append((p[0] + row, p[1] + col, seeds[p]["from_row"], seeds[p]["from_col"]))
        table = pd.DataFrame(out, columns=["row", "col", "from_row", "from_col"]).astype("Int32")
        return table.assign(mission=key[0], seq=key[1], part=int(one["part"]), place=range(len(out)))[names]

    parts = []
    while now.take(1):
        step = stored(now.join(own, AT).join(tiles, ["t_row", "t_col"]).groupBy(*AT).applyInPandas(walked, STEPS))
        parts.append(step.filter("from_row is not null"))
        at = [tile_of(c, size) for c in ("from_row", "from_col")]
        over = parts[-1].filter((at[0] != tile_of("row", size)) | (at[1] != tile_of("col", size)))
        now = over.select(*LEG, at[0].alias("t_row"), at[1].alias("t_col"), (F.col("part") + 1).alias("part"), F.col("from_row").alias("at_row"), F.col("from_col").alias("at_col"))
    if not parts:
        return own.sparkSession.createDataFrame([], STEPS).select(*LEG, F.col("part").alias("hop"), "row", "col", "from_row", "from_col")
    order = Window.partitionBy(*LEG).orderBy(F.desc("part"), F.desc("place"))
    return reduce(DataFrame.unionByName, parts).select(*LEG, (F.row_number().over(order) - 1).alias("hop"), "row", "col", "from_row", "from_col")


def far_paths(legs: DataFrame, cost: DataFrame, diagonal: float, size: int = TILE) -> DataFrame:
    """mission, seq, hop, x1, y1, x2, y2, routed of legs (mission, seq, ax, ay, bx, by): the steps of a shortest path over the whole grid.

    cost: row, col, cost above 0, one row a pixel; ends are cut to whole pixels. A leg whose goal has no cost or lies in no component at its
    start is one straight hop, not routed, for which no tile is read; one that ends where it starts is one hop of no length.
    """
    whole = [F.col(c).cast("int").alias(n) for c, n in (("ay", "a_row"), ("ax", "a_col"), ("by", "b_row"), ("bx", "b_col"))]
    legs = stored(legs.select(*LEG, *whole))
    near = stored(reachable(legs, cost))
    straight = [F.col(c).cast("double").alias(n) for c, n in (("a_col", "x1"), ("a_row", "y1"), ("b_col", "x2"), ("b_row", "y2"))]
    away = legs.join(near.select(*LEG, F.lit(True).alias("routed")), LEG, "left").filter("routed is null or (a_row = b_row and a_col = b_col)")
    away = away.select(*LEG, F.lit(0).alias("hop"), *straight, F.coalesce("routed", F.lit(False)).alias("routed"))
    near = near.filter("a_row <> b_row or a_col <> b_col")
    if not near.take(1):
        return away
    tiles = cost_tiles(cost, size)
    least = cost.agg(F.min("cost").alias("least")).first()["least"]
    steps = read_back(entries(near, tiles, float(least), diagonal, size), tiles, diagonal, size)
    ends = [F.col(c).cast("double").alias(n) for c, n in (("from_col", "x1"), ("from_row", "y1"), ("col", "x2"), ("row", "y2"))]
    return away.unionByName(steps.select(*LEG, "hop", *ends, F.lit(True).alias("routed")))
