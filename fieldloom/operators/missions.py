"""Sweeps, swath order, routing and mission assembly on pixel tables.

Segments are rows (x1, y1, x2, y2) with x the column and y the row. Sweeps and orders are windows; the greedy chain and the
shortest paths are sequential and run as one task for each mission, missions in parallel.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import morphology, routing, zones
from fieldloom.session import stored

#: Runs of this many pixels or fewer are dropped.
MIN_RUN = 3
DIAGONAL = 1.414
#: Transitions longer than this many margins are searched by tiles at once.
FAR = 10


def sweep(cells: DataFrame, spacing: int, min_run: int = MIN_RUN) -> DataFrame:
    """x1, y1, x2, y2: runs longer than min_run of the cells in every spacing-th row."""
    kept = cells.filter(F.col("row") % max(1, int(spacing)) == 0)
    r = morphology.runs(kept.select("row", "col")).filter(F.col("c1") - F.col("c0") + 1 > min_run)
    return r.select(F.col("c0").alias("x1"), F.col("row").alias("y1"), F.col("c1").alias("x2"), F.col("row").alias("y2"))


def vine_sweep(zone_map: DataFrame, spacing: int, rule: str, min_run: int = MIN_RUN) -> DataFrame:
    """Runs of vines in every spacing-th row. nitrogen: a run is kept if it holds a needed pixel (a zone below the highest), or if
    needed pixels lie on both sides of it in its row; a run at the end of the row needs them on its left only."""
    kept = zone_map.filter(F.col("row") % max(1, int(spacing)) == 0)
    r = morphology.runs(kept.filter("zone > 0").select("row", "col")).filter(F.col("c1") - F.col("c0") + 1 > min_run)
    out = r.select(F.col("c0").alias("x1"), F.col("row").alias("y1"), F.col("c1").alias("x2"), F.col("row").alias("y2"))
    if rule == "water":
        return out
    width = zone_map.agg(F.max("col").alias("last"))
    need = zones.target(zone_map, rule).groupBy("row").agg(F.min("col").alias("n0"), F.max("col").alias("n1"), F.sort_array(F.collect_list("col")).alias("cols"))
    met = out.join(need, F.col("y1") == F.col("row"), "left").crossJoin(F.broadcast(width))  # one row
    holds = F.exists("cols", lambda c: (c >= F.col("x1")) & (c <= F.col("x2")))
    left, right = F.col("n0") < F.col("x1"), F.col("n1") > F.col("x2")
    ok = holds | left & (right | (F.col("x2") == F.col("last")))
    return met.filter(F.coalesce(ok, F.lit(False))).select("x1", "y1", "x2", "y2")


def numbered(segments: DataFrame) -> DataFrame:
    """Adds seq, from 0, in the order of (y, x)."""
    return segments.withColumn("seq", (F.row_number().over(Window.orderBy("y1", "x1", "x2")) - 1).cast("int"))


def snake(segments: DataFrame) -> DataFrame:
    """Numbered segments with every second one turned round."""
    odd = F.col("seq") % 2 == 1
    turn = lambda a, b: F.when(odd, F.col(b)).otherwise(F.col(a))
    return segments.select("seq", turn("x1", "x2").alias("x1"), turn("y1", "y2").alias("y1"), turn("x2", "x1").alias("x2"), turn("y2", "y1").alias("y2"))


def corridor(zone_map: DataFrame, target: DataFrame, reach: int = 8, field: DataFrame | None = None) -> DataFrame:
    """Soil pixels of the field (row, col, m; by default `field_mask` of the map) within `reach` steps of a target pixel."""
    field = (morphology.field_mask(zone_map) if field is None else field).filter("m").select("row", "col")
    grid = zone_map.select("row", "col").join(target.select("row", "col", F.lit(True).alias("m")), ["row", "col"], "left").withColumn("m", F.coalesce("m", F.lit(False)))
    near = morphology.diamond(grid, reach).filter("m").select("row", "col")
    return zone_map.filter("zone = 0").select("row", "col").join(field, ["row", "col"], "left_semi").join(near, ["row", "col"], "left_semi")


def swaths(zone_map: DataFrame, rule: str = "water", target: DataFrame | None = None, spacing: int = 4, reach: int = 8, least: int = 3, field: DataFrame | None = None) -> DataFrame:
    """Sweeps of the corridor; with fewer than `least` of them, of the target itself."""
    wanted = target if target is not None else zones.target(zone_map, rule)
    found = stored(sweep(corridor(zone_map, wanted, reach, field), spacing))
    return found if len(found.take(least)) >= least else sweep(wanted, spacing)


#: Points in a leaf of the tree that finds a chain's next segment.
LEAF = 12


class Remaining:
    """Points of the plane that are taken out one by one; the nearest one left is found through a tree of boxes with counts."""

    def __init__(self, points: np.ndarray):
        self.x, self.y = points[:, 0].tolist(), points[:, 1].tolist()
        self.box: list[tuple] = []
        self.parent, self.left, self.kids, self.own = [], [], [], []
        self.leaf = [0] * len(points)
        todo = [(np.arange(len(points)), -1)]
        while todo:
            some, up = todo.pop()
            node = len(self.box)
            low, high = points[some].min(0), points[some].max(0)
            self.box.append((*low.tolist(), *high.tolist()))
            self.parent.append(up)
            self.left.append(len(some))
            self.kids.append([])
            self.own.append([])
            if up >= 0:
                self.kids[up].append(node)
            if len(some) <= LEAF:
                self.own[node] = some.tolist()
                for p in self.own[node]:
                    self.leaf[p] = node
            else:
                half = np.argpartition(points[some, int((high - low).argmax())], len(some) // 2)
                todo += [(some[half[: len(some) // 2]], node), (some[half[len(some) // 2 :]], node)]

    def take(self, p: int) -> None:
        node = self.leaf[p]
        self.own[node].remove(p)
        while node >= 0:
            self.left[node] -= 1
            node = self.parent[node]

    def nearest(self, x: float, y: float) -> int:
        """The nearest point left; of equally near ones the least number."""

        def away(node: int) -> float:
            x0, y0, x1, y1 = self.box[node]
            dx = x0 - x if x < x0 else x - x1 if x > x1 else 0.0
            dy = y0 - y if y < y0 else y - y1 if y > y1 else 0.0
            return dx * dx + dy * dy

        best, at, todo = math.inf, -1, [(0.0, 0)]
        while todo:
            d, node = todo.pop()
            if d > best:
                continue
            for p in self.own[node]:
                dx, dy = self.x[p] - x, self.y[p] - y
                d = dx * dx + dy * dy
                if d < best or (d == best and p < at):
                    best, at = d, p
            # the nearer box is looked at first
            todo += sorted([(away(k), k) for k in self.kids[node] if self.left[k]], reverse=True)
        return at


def chain_order(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> list[tuple[int, bool]]:
    """Greedy chain: the first segment by (y, x), then always the one with the nearest end; turned if its second end is nearer."""
    order = np.lexsort((x2, x1, y1))
    if not len(order):
        return []
    ends = np.stack([np.stack([x1, y1], 1)[order], np.stack([x2, y2], 1)[order]], 1).astype(float).reshape(-1, 2)
    left, out, p = Remaining(ends), [], 0
    while True:
        out.append((int(order[p // 2]), p % 2 == 1))
        left.take(p)
        left.take(p ^ 1)
        if len(out) == len(order):
            return out
        p = left.nearest(left.x[p ^ 1], left.y[p ^ 1])


SEGMENTS = "mission string, seq int, x1 double, y1 double, x2 double, y2 double"


def chained(segments: DataFrame) -> DataFrame:
    """Segments (mission, x1, y1, x2, y2) in greedy order, with seq; one task for each mission."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        picks = chain_order(*[rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2")])
        out = rows.iloc[[i for i, _ in picks]][["mission", "x1", "y1", "x2", "y2"]].reset_index(drop=True)
        turned = np.array([t for _, t in picks])
        for a, b in (("x1", "x2"), ("y1", "y2")):
            out[a], out[b] = np.where(turned, out[b], out[a]), np.where(turned, out[a], out[b])
        return out.assign(seq=range(len(out)))[["mission", "seq", "x1", "y1", "x2", "y2"]]

    return segments.select("mission", "x1", "y1", "x2", "y2").groupBy("mission").applyInPandas(run, SEGMENTS)


def shortest_path(cost: dict[tuple[int, int], float], start: tuple[int, int], goal: tuple[int, int], diagonal: float = DIAGONAL) -> list[tuple[int, int]] | None:
    """A* over the eight neighbours; a step pays the cost of the pixel it enters. None if the goal can't be reached."""
    if goal not in cost:
        return None
    steps = [(dr, dc, 1.0 if 0 in (dr, dc) else diagonal) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
    best, came, heap = {start: 0.0}, {}, [(0.0, start)]
    done = set()
    while heap:
        _, at = heapq.heappop(heap)
        if at == goal:
            path = [at]
            while at in came:
                at = came[at]
                path.append(at)
            return path[::-1]
        if at in done:
            continue
        done.add(at)
        for dr, dc, length in steps:
            to = (at[0] + dr, at[1] + dc)
            if to in cost:
                total = best[at] + length * cost[to]
                if total < best.get(to, float("inf")):
                    best[to], came[to] = total, at
                    heapq.heappush(heap, (total + ((to[0] - goal[0]) ** 2 + (to[1] - goal[1]) ** 2) ** 0.5, to))
    return None


HOPS = "mission string, seq int, hop int, x1 double, y1 double, x2 double, y2 double, routed boolean"


def connected(chain: DataFrame, cost: DataFrame, margin: int = 45, diagonal: float = DIAGONAL) -> DataFrame:
    """Connectors from each segment to the next: hops of a shortest path over the whole grid, or one straight hop where there is none.

    Each transition is searched in the cells of a window around it. A path through cells outside the window
    enters `margin` cells and more beyond the ends twice, so one that costs less than that is the shortest of all. The other
    transitions, and those over more than FAR margins, are searched tile by tile: see `routing.far_paths`.
    """
    known = cost.agg(F.min("cost").alias("least"), F.greatest(F.max("row") - F.min("row"), F.max("col") - F.min("col")).alias("extent")).first()
    w = Window.partitionBy("mission").orderBy("seq")
    legs = stored(chain.select("mission", "seq", F.col("x2").alias("ax"), F.col("y2").alias("ay"), F.lead("x1").over(w).alias("bx"), F.lead("y1").over(w).alias("by")).filter("bx is not null"))
    if margin >= (known["extent"] or 0):
        return _hops(legs, cost, margin, None, diagonal).drop("sure")
    close = legs.filter(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) <= FAR * margin)
    near = stored(_hops(close, cost, margin, 2 * (margin + 1) * (known["least"] or 0), diagonal)).filter("sure").drop("sure")
    rest = stored(legs.join(near.select("mission", "seq").distinct(), ["mission", "seq"], "left_anti"))
    return near.unionByName(routing.far_paths(rest, cost, diagonal)) if rest.take(1) else near


def _hops(legs: DataFrame, cost: DataFrame, margin: int, most: float | None, diagonal: float) -> DataFrame:
    """The hops of each transition in its window; sure if no path outside it can be shorter (most is None: it holds the grid)."""
    reach = F.greatest(F.lit(margin), F.ceil(0.35 * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).cast("int")
    box = [(F.least("ay", "by") - reach).alias("r0"), (F.greatest("ay", "by") + reach).alias("r1"), (F.least("ax", "bx") - reach).alias("c0"), (F.greatest("ax", "bx") + reach).alias("c1")]
    cells = in_windows(legs.select("mission", "seq", *box), cost).select("mission", "seq", "row", "col", "cost")

    def run(leg: dict, grid: dict) -> list[tuple]:
        a, b = (int(leg["ay"]), int(leg["ax"])), (int(leg["by"]), int(leg["bx"]))
        path = shortest_path(grid, a, b, diagonal)
        points = path if path and len(path) > 1 else [a, b]
        total = sum(grid[q] * (1.0 if 0 in (p[0] - q[0], p[1] - q[1]) else diagonal) for p, q in zip(path, path[1:], strict=False)) if path else float("inf")
        sure = most is None or total <= most
        return [(leg["mission"], leg["seq"], i, float(p[1]), float(p[0]), float(q[1]), float(q[0]), path is not None, sure) for i, (p, q) in enumerate(zip(points, points[1:], strict=False))]

    return each_leg(legs.select("mission", "seq", "ax", "ay", "bx", "by"), cells, ["mission", "seq"], run, HOPS + ", sure boolean")


#: Rows and columns of the blocks by which windows meet their cells.
BLOCK = 64


def in_windows(windows: DataFrame, cells: DataFrame, *keys: str) -> DataFrame:
    """The cells (row, col) in each window (r0, r1, c0, c1, ends included) that has the same keys; they meet by blocks of cells."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    span = lambda a, b: F.explode(F.sequence(block(a), block(b)))
    asked = windows.withColumn("b_row", span("r0", "r1")).withColumn("b_col", span("c0", "c1"))
    met = asked.join(cells.withColumns({"b_row": block("row"), "b_col": block("col")}), [*keys, "b_row", "b_col"])
    return met.filter("row between r0 and r1 and col between c0 and c1").drop("b_row", "b_col", "r0", "r1", "c0", "c1")


def each_leg(legs: DataFrame, cells: DataFrame, group: list[str], search: Callable[[dict, dict], list[tuple]], schema: str) -> DataFrame:
    """search(leg, {(row, col): cost}) of every leg with its window's cells (group, row, col, cost), as rows of the schema.

    The legs go through Python in sorted batches, each leg before its cells: a task holds a batch and one leg's window, and short legs
    cost no group of their own.
    """
    names = [c for c in legs.columns if c not in group]
    none = lambda t, have: [F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema if f.name not in have]
    at = cells.select(*group, "row", "col", F.col("cost").cast("double").alias("cost"))
    both = legs.select(*group, *names, F.lit(True).alias("is_leg"), *none(at, group)).unionByName(at.select("*", F.lit(False).alias("is_leg"), *none(legs, group)))
    fields = [f.split()[0] for f in schema.split(", ")]

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last leg and its cells so far

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            starts = np.flatnonzero(rows["is_leg"].to_numpy(bool))
            cell = list(zip(rows["row"].to_numpy(float), rows["col"].to_numpy(float), strict=True))
            cost, out = rows["cost"].tolist(), []
            for leg, i, j in zip(rows.iloc[starts][[*group, *names]].to_dict("records"), starts, [*starts[1:], len(rows)], strict=True):
                out += search(leg, dict(zip(cell[i + 1 : j], cost[i + 1 : j], strict=True)))
            return pd.DataFrame(out, columns=fields)

        for rows in batches:
            starts = np.flatnonzero(rows["is_leg"].to_numpy(bool))
            if len(starts):
                done = pd.concat([*held, rows.iloc[: starts[-1]]]) if held else rows.iloc[: starts[-1]]
                if len(done):
                    yield found(done)
                held = []
                rows = rows.iloc[starts[-1] :]
            held.append(rows)
        if held:
            yield found(pd.concat(held))

    return both.repartition(*group).sortWithinPartitions(*group, F.desc("is_leg")).mapInPandas(searched, schema)


def straight(chain: DataFrame) -> DataFrame:
    w = Window.partitionBy("mission").orderBy("seq")
    legs = chain.select("mission", "seq", F.lit(0).alias("hop"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.lead("x1").over(w).alias("bx"), F.lead("y1").over(w).alias("by"))
    return legs.filter("bx is not null").select("mission", "seq", "hop", "x1", "y1", F.col("bx").alias("x2"), F.col("by").alias("y2"), F.lit(False).alias("routed"))


def assembled(chain: DataFrame, connectors: DataFrame) -> DataFrame:
    """mission, place (from 0), kind, x1, y1, x2, y2: swath, its connector's hops, the next swath and so on."""
    both = chain.select("mission", "seq", F.lit(-1).alias("hop"), F.lit("swath").alias("kind"), "x1", "y1", "x2", "y2").unionByName(
        connectors.select("mission", "seq", "hop", F.lit("connector").alias("kind"), "x1", "y1", "x2", "y2")
    )
    place = F.row_number().over(Window.partitionBy("mission").orderBy("seq", "hop")) - 1
    return both.withColumn("place", place.cast("int")).select("mission", "place", "kind", "x1", "y1", "x2", "y2")


def ordered(zone_map: DataFrame, name: str, rule: str = "water", target: DataFrame | None = None, spacing: int = 4, reach: int = 8, field: DataFrame | None = None) -> DataFrame:
    """The swaths of a mission in greedy order, stored."""
    return stored(chained(swaths(zone_map, rule, target, spacing, reach, field=field).withColumn("mission", F.lit(name))))


def joined_up(chain: DataFrame, cost: DataFrame | None = None) -> DataFrame:
    """The mission on ordered swaths, with straight connectors or, over a cost grid, routed ones."""
    return assembled(chain, straight(chain) if cost is None else connected(chain, cost))


def mission(zone_map: DataFrame, name: str, rule: str = "water", target: DataFrame | None = None, cost: DataFrame | None = None, spacing: int = 4, reach: int = 8, field: DataFrame | None = None) -> DataFrame:
    """The whole mission: swaths, greedy order, straight or routed connectors. Empty if there is nothing to treat. Missions on maps of
    one canopy can share its field."""
    return joined_up(ordered(zone_map, name, rule, target, spacing, reach, field), cost)


def snake_mission(zone_map: DataFrame, rule: str, spacing: int = 4) -> DataFrame:
    """The older mission: vine sweeps in snake order, without connectors."""
    return snake(numbered(vine_sweep(zone_map, spacing, rule)))


#: Pixels round the turned map that a margin keeps at least: the reach of a corridor twice.
MARGIN = 16


def rotated(layer: DataFrame, degrees: float, value: str = "zone", margin: int | None = None) -> DataFrame:
    """row, col, value of the raster turned about its centre, in a frame that holds all of it: the nearest pixel, 0 where there is none.

    With a margin only the frame's pixels within so many of the map are made, whose number grows with the map's and not with the
    frame's; `rim` is true of those at the margin's end, beyond which the frame is empty.
    """
    size = layer.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    h, w = (size["r"] or 0) + 1, (size["c"] or 0) + 1
    rows, cols, m, off = _frame(h, w, degrees)
    r, c = [F.col("row") * float(m[i, 0]) + F.col("col") * float(m[i, 1]) + float(off[i]) for i in (0, 1)]
    if margin is None:
        frame = layer.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    else:
        # the columns of a frame's row that lie within the margin, from the line where they leave it
        low, high = [F.lit(0)], [F.lit(cols - 1)]
        for i, n in ((0, h), (1, w)):
            if abs(m[i, 1]) > 1e-9:
                at = [(F.lit(float(v)) - F.col("row") * float(m[i, 0]) - float(off[i])) / float(m[i, 1]) for v in (-margin, n - 1 + margin)]
                low.append(F.floor(F.least(*at)).cast("int"))
                high.append(F.ceil(F.greatest(*at)).cast("int"))
        spans = layer.sparkSession.range(rows).select(F.col("id").cast("int").alias("row"), F.greatest(*low).alias("a"), F.least(*high).alias("b")).filter("a <= b")
        frame = spans.select("row", F.explode(F.sequence("a", "b")).alias("col")).filter(r.between(-margin, h - 1 + margin) & c.between(-margin, w - 1 + margin))
        frame = frame.withColumn("rim", ~(r.between(3 - margin, h - 4 + margin) & c.between(3 - margin, w - 4 + margin)))
    near = frame.withColumns({"_r": F.when(r.between(0, h - 1), F.floor(r + 0.5)).cast("int"), "_c": F.when(c.between(0, w - 1), F.floor(c + 0.5)).cast("int")})
    known = layer.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v"))
    met = near.join(known, ["_r", "_c"], "left").withColumn(value, F.coalesce("_v", F.lit(0)).cast(layer.schema[value].dataType))
    return met.select("row", "col", value, *([] if margin is None else ["rim"]))


def _frame(h: int, w: int, degrees: float) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Rows and columns of the frame of a turned map, and the matrix and shift from its pixels to the map's."""
    turn = math.radians(degrees)
    m = np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]])
    rows, cols = (np.ptp(m @ np.array([[0, 0, h, h], [0, w, 0, w]]), axis=1) + 0.5).astype(int).tolist()
    return rows, cols, m, np.array([h - 1, w - 1]) / 2 - m @ (np.array([rows - 1, cols - 1]) / 2)


def rotated_mission(zone_map: DataFrame, name: str, rule: str = "water", degrees: float | None = None, spacing: int = 4, reach: int = 8) -> DataFrame:
    """The older mission with obstacles: the map is turned by -degrees (the row direction by default), swept in snake order with routed
    connectors, and the route turned back about the centres of the two frames. Empty if there is nothing to treat.

    Of the turned map's frame only the pixels near the map are made: what lies beyond is open soil, in no field and on no way.
    """
    angle = row_angle(zone_map, "zone").first()["angle"] if degrees is None else degrees
    flat = stored(rotated(zone_map, -(angle or 0.0), margin=max(MARGIN, 2 * reach)))
    field = stored(morphology.field_mask(flat, flat.filter("rim")))
    chain = stored(snake(numbered(swaths(flat, rule, None, spacing, reach, field=field))).select(F.lit(name).alias("mission"), "seq", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]))
    route = assembled(chain, connected(chain, stored(morphology.cost_grid(flat, rule, field=field))))
    end = zone_map.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).first()
    to_y, to_x = (end["h"] or 0) / 2, (end["w"] or 0) / 2
    y, x = [n / 2 for n in _frame(end["h"] or 1, end["w"] or 1, -(angle or 0.0))[:2]]
    c, s = math.cos(math.radians(angle or 0.0)), math.sin(math.radians(angle or 0.0))
    out = {}
    for i in "12":
        dx, dy = F.col(f"x{i}") - x, F.col(f"y{i}") - y
        out |= {f"x{i}": to_x + dx * c + dy * s, f"y{i}": to_y - dx * s + dy * c}
    return route.withColumns(out)


def path_length(segments: DataFrame, pixel_m: float = 1.0) -> DataFrame:
    return segments.groupBy("mission").agg(F.count(F.lit(1)).alias("segments"), (F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) * pixel_m).alias("length_m"))


def served(segments: DataFrame, target: DataFrame, grid: DataFrame, reach: int = 8, pixel_m: float = 1.0) -> DataFrame:
    """One row: driven metres along the swaths and the share (per cent, one place) of the target within `reach` steps of them."""
    cells = segments.select(F.col("y1").cast("int").alias("row"), F.explode(F.sequence(F.least("x1", "x2").cast("int"), F.greatest("x1", "x2").cast("int"))).alias("col")).distinct()
    mask = grid.select("row", "col").join(cells.withColumn("m", F.lit(True)), ["row", "col"], "left").withColumn("m", F.coalesce("m", F.lit(False)))
    near = morphology.diamond(mask, reach).filter("m").select("row", "col").withColumn("hit", F.lit(1))
    share = target.select("row", "col").join(near, ["row", "col"], "left").agg(F.round(100 * F.count("hit") / F.count(F.lit(1)), 1).alias("served_pct"))
    length = segments.agg(F.round(F.sum(F.abs(F.col("x2") - F.col("x1"))) * pixel_m).alias("length_m"))
    return length.crossJoin(share)  # one row each


def row_angle(layer: DataFrame, value: str = "ndre") -> DataFrame:
    """The most frequent direction of strong edges (Sobel, top 15 %), in degrees; kept for the older missions."""
    grid = layer.select("row", "col", F.col(value).alias("v"))
    by_row, by_col = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    def near(c, w, k):
        return F.coalesce(F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w), F.col(c))
    g = grid.withColumn("dx", near("v", by_row, -1) - near("v", by_row, 1)).withColumn("sx", near("v", by_row, 1) + 2 * F.col("v") + near("v", by_row, -1))
    g = g.withColumn("gx", near("dx", by_col, 1) + 2 * F.col("dx") + near("dx", by_col, -1)).withColumn("gy", near("sx", by_col, -1) - near("sx", by_col, 1))
    g = g.withColumn("size", F.hypot("gx", "gy"))
    cut = g.agg(F.percentile("size", F.lit(0.85)).alias("cut"))
    strong = g.crossJoin(F.broadcast(cut)).filter("size >= cut and size > 0")  # one row
    angle = F.degrees(F.atan2("gy", "gx")) + 90
    return zones.modal_bin(strong, F.pmod(angle + 90, F.lit(180.0)) - 90)
