"""Paths found tile by tile against a plain search of the whole grid."""

from __future__ import annotations

import heapq
import os
import random

import pytest

from fieldloom.operators import missions, routing

KINDS = "row int, col int, cost double"
LEGS = "mission string, seq int, ax double, ay double, bx double, by double"


def least_cost(cost, start, goal):
    """Dijkstra over the eight neighbours."""
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, at = heapq.heappop(heap)
        if at == goal:
            return d if goal in cost else None
        if d > best[at]:
            continue
        for dr, dc, length in routing.moves(missions.DIAGONAL):
            to = (at[0] + dr, at[1] + dc)
            if to in cost and d + length * cost[to] < best.get(to, float("inf")):
                best[to] = d + length * cost[to]
                heapq.heappush(heap, (best[to], to))
    return None


@pytest.mark.parametrize("seed", [1])
def test_costs_equal_a_whole_search(spark, seed):
    rng = random.Random(seed)
    size, (h, w) = 12, (37, 41)
    cost = {(r, c): rng.choice([0.25, 1.0, 1.0, 2.5, 6.0]) for r in range(h) for c in range(w) if rng.random() < 0.62}
    cost |= {(60, 60): 1.0}  # an island
    ends = [((rng.randrange(h), rng.randrange(w)), rng.choice(sorted(cost))) for _ in range(12)] + [((0, 0), (60, 60)), ((5, 5), (5, 5)), ((7, 7), (200, 200))]
    legs = [("m", i, float(a[1]), float(a[0]), float(b[1]), float(b[0])) for i, (a, b) in enumerate(ends)]
    hops = routing.far_paths(spark.createDataFrame(legs, LEGS), spark.createDataFrame([(*p, v) for p, v in cost.items()], KINDS), missions.DIAGONAL, size).collect()
    for i, (a, b) in enumerate(ends):
        own = sorted((x for x in hops if x["seq"] == i), key=lambda x: x["hop"])
        want = least_cost(cost, a, b)
        assert [x["hop"] for x in own] == list(range(len(own))) and ((own[0]["y1"], own[0]["x1"]), (own[-1]["y2"], own[-1]["x2"])) == (a, b)
        if want is None:
            assert len(own) == 1 and not own[0]["routed"]
            continue
        assert a == b or own[0]["routed"]
        paid, at = 0.0, a
        for x in own if a != b else []:
            assert (x["y1"], x["x1"]) == at
            at = (int(x["y2"]), int(x["x2"]))
            assert max(abs(x["y2"] - x["y1"]), abs(x["x2"] - x["x1"])) == 1
            paid += cost[at] * (1.0 if x["y1"] == x["y2"] or x["x1"] == x["x2"] else missions.DIAGONAL)
        assert abs(paid - want) < 1e-9


def test_unreachable_legs_read_no_tile(spark, monkeypatch):
    cost = spark.createDataFrame([(r, c, 1.0) for r in range(20) for c in range(20) if c != 10], KINDS)
    monkeypatch.setattr(routing, "cost_tiles", lambda *a: pytest.fail("tiles were made"))
    got = routing.far_paths(spark.createDataFrame([("m", 0, 1.0, 1.0, 15.0, 1.0)], LEGS), cost, missions.DIAGONAL).collect()
    assert [(g["x1"], g["x2"], g["routed"]) for g in got] == [(1.0, 15.0, False)]


def test_empty_grid_and_no_legs(spark):
    none = spark.createDataFrame([], KINDS)
    leg = spark.createDataFrame([("m", 0, 1.0, 1.0, 4.0, 1.0)], LEGS)
    assert [g["routed"] for g in routing.far_paths(leg, none, missions.DIAGONAL).collect()] == [False]
    assert not routing.far_paths(leg.limit(0), none, missions.DIAGONAL).collect()


def test_far_connector_of_a_chain(spark):
    """Beyond the window and its margins the tiles find what a whole search finds."""
    rng = random.Random(3)
    cost = {(r, c): rng.choice([1.0, 2.5]) for r in range(30) for c in range(150) if c % 40 != 20 or r == (0 if c % 80 == 20 else 29)}
    chain = spark.createDataFrame([("m", 0, 0.0, 4.0, 2.0, 4.0), ("m", 1, 145.0, 9.0, 148.0, 9.0)], missions.SEGMENTS)
    hops = sorted(missions.connected(chain, spark.createDataFrame([(*p, v) for p, v in cost.items()], KINDS), margin=5).collect(), key=lambda x: x["hop"])
    paid = sum(cost[int(x["y2"]), int(x["x2"])] * (1.0 if x["y1"] == x["y2"] or x["x1"] == x["x2"] else missions.DIAGONAL) for x in hops)
    assert abs(paid - least_cost(cost, (4, 2), (9, 145))) < 1e-9


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_far_connectors_query(spark):
    """Every leg of the registered query against a plain search."""
    from fieldloom.plans import missions as plans

    legs, cost = plans.far_legs(spark, DATA)
    grid = {(r["row"], r["col"]): r["cost"] for r in cost.collect()}
    ends = {r["seq"]: ((int(r["ay"]), int(r["ax"])), (int(r["by"]), int(r["bx"]))) for r in legs.collect()}
    got = {r["seq"]: r for r in plans.far_connectors(spark, DATA).collect()}
    assert got and got.keys() == ends.keys()
    for seq, (a, b) in ends.items():
        want = least_cost(grid, a, b)
        assert got[seq]["routed"] == (want is not None) and (want is None or abs(got[seq]["cost"] - want) < 1e-6)
