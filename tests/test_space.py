"""Neighbours, clusters, nearest agents and hulls against brute force, with and without skew handling."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import cluster as C
from skein.operators import hull as U
from skein.operators import nearest as N
from skein.operators import rules as R
from skein.operators import spanning as T
from skein.operators import spatial as S
from skein.operators.skew import Skew, skew_join
from skein.plans import queries
from skein.schema import World
from skein.sources.config import FlockConfig

EVERYTHING_HOT = Skew(cell_rows=2, key_rows=2)


def cloud(seed, n=60, world=World(100, 100), lattice=False, dense=0):
    rng = random.Random(seed)
    points = []
    for i in range(n):
        if i < dense:
            x, y = rng.gauss(20, 1.5), rng.gauss(-20, 1.5)
        else:
            x, y = rng.uniform(world.left, world.right), rng.uniform(world.bottom, world.top)
        points.append((round(x), round(y)) if lattice else (x, y))
    return [(1 + i % 2, i, float(x), float(y)) for i, (x, y) in enumerate(points)]


def frame(spark, points):
    return spark.createDataFrame(points, "time long, id long, x double, y double")


def apart(a, b, world):
    dx, dy = b[2] - a[2], b[3] - a[3]
    if world.toroidal:
        dx -= math.copysign(world.width, dx) if abs(dx) > world.width / 2 else 0
        dy -= math.copysign(world.height, dy) if abs(dy) > world.height / 2 else 0
    return dx * dx + dy * dy


def brute_pairs(points, radius, world, strict=False):
    close = (lambda d: d < radius**2) if strict else (lambda d: d <= radius**2)
    return {(a[0], a[1], b[1]) for a in points for b in points if a[0] == b[0] and a[1] != b[1] and close(apart(a, b, world))}


@pytest.mark.parametrize("toroidal", [True, False])
@pytest.mark.parametrize("radius", [7, 30, 45, 60])
@pytest.mark.parametrize("skew", [Skew(), EVERYTHING_HOT], ids=["even", "hot"])
def test_grid_equals_brute_force(spark, radius, toroidal, skew):
    world = World(100, 100, toroidal)
    points = cloud(radius, lattice=True)
    got = [tuple(r) for r in S.neighbours(frame(spark, points), radius, world, skew=skew).select("time", "id", "id2").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(points, radius, world)
    counts = S.neighbour_counts(frame(spark, points), radius, world, skew=skew).collect()
    want = {(p[0], p[1]): 0 for p in points}
    for t, a, _ in got:
        want[t, a] += 1
    assert {(r["time"], r["id"]): r["n_neighbours"] for r in counts} == want


def test_narrow_world(spark):
    world = World(100, 40)
    points = cloud(5, world=world)
    got = {tuple(r) for r in S.neighbours(frame(spark, points), 18, world, strict=True).select("time", "id", "id2").collect()}
    assert got == brute_pairs(points, 18, world, strict=True)


def test_every_centre_finds_its_51_neighbours(spark):
    rng = random.Random(1)
    world, reach = World(1400, 900), 115.0
    centres = [(0, 0), (690, 0), (-690, 440), (300, -445), (-200, 200)]
    rows = []
    for t, (cx, cy) in enumerate(centres):
        rows.append((t, 0, float(cx), float(cy)))
        for i in range(1, 52):
            r, a = 0.9 * reach * rng.random(), rng.uniform(0, 2 * math.pi)
            x, y = cx + r * math.cos(a), cy + r * math.sin(a)
            x, y = (x + 700) % 1400 - 700, (y + 450) % 900 - 450
            rows.append((t, i, x, y))
    got = S.neighbours(frame(spark, rows), reach, world, strict=True).where("id = 0").groupBy("time").count().collect()
    assert {r["time"]: r["count"] for r in got} == {t: 51 for t in range(5)}


def test_close_pair(spark):
    rows = [(0, 0, -111.31945, 31.2412548), (0, 1, -80.3626938, 104.281799)]
    assert S.neighbours(frame(spark, rows), 100, World(1400, 900)).count() == 2


def brute_dbscan(points, radius, min_pts, world):
    near = brute_pairs(points, radius, world)
    links = {}
    for t, a, b in near:
        links.setdefault(a, set()).add(b)
    core = {p[1] for p in points if len(links.get(p[1], ())) + 1 >= min_pts}
    label = {}
    for a in sorted(core):
        if a in label:
            continue
        todo, label[a] = [a], a + 1
        while todo:
            for b in links.get(todo.pop(), set()) & core:
                if b not in label:
                    label[b] = a + 1
                    todo.append(b)
    out = {}
    for p in points:
        near_core = [label[b] for b in links.get(p[1], ()) if b in core]
        out[p[1]] = label[p[1]] if p[1] in core else max(near_core, default=0)
    return out


@pytest.mark.parametrize("toroidal", [True, False])
@pytest.mark.parametrize("min_pts,radius,dense", [(1, 9.0, 0), (3, 9.0, 0), (3, 2.0, 50), (5, 40.0, 0)])
def test_dbscan_equals_brute_force(spark, toroidal, min_pts, radius, dense):
    world = World(100, 100, toroidal)
    points = cloud(min_pts, n=80, dense=dense)
    got = C.dbscan(frame(spark, points), radius, min_pts, world)
    assert {r["id"]: r["cluster_id"] for r in got.collect()} == brute_dbscan(points, radius, min_pts, world)


def test_dbscan_with_hot_cells(spark):
    world = World(100, 100)
    points = cloud(8, n=60, dense=40) + [(1, 100 + i, 49.5, 0.25) for i in range(20)] + [(1, 200, -49.0, 0.0)]
    got = C.dbscan(frame(spark, points), 3.0, 3, world, skew=EVERYTHING_HOT)
    assert {r["id"]: r["cluster_id"] for r in got.collect()} == brute_dbscan(points, 3.0, 3, world)


def test_undecided_boxes_are_split(spark, monkeypatch):
    """Facing columns of positions just within and just beyond the radius, in one sub-cell each."""
    monkeypatch.setattr(C, "LEVELS", 2)
    world, eps = World(100, 100, toroidal=False), 10.0
    grid = S.Grid.within_radius(world, eps)
    edge = -50 + grid.dx * 7
    for gap, want in ((10.0 - 1e-7, 1), (10.0 + 1e-7, 2)):
        left = [(0, i, edge - 0.3 + 0.0001 * i, 0.001 * i) for i in range(4)]
        right = [(0, 10 + i, left[-1][2] + gap + 0.0001 * i, 0.001 * (3 + i)) for i in range(4)]
        got = C.components(frame(spark, left + right), eps, world)
        assert got.select("component").distinct().count() == want


def test_long_chain_is_one_component(spark):
    points = [(0, (i * 37) % 90, -45.0 + i, 0.0) for i in range(90)]
    got = C.components(frame(spark, points), 1.0, World(100, 100, toroidal=False))
    assert [tuple(r) for r in got.select("component").distinct().collect()] == [(0,)]


@pytest.mark.parametrize("skew", [Skew(), EVERYTHING_HOT], ids=["even", "hot"])
@pytest.mark.parametrize("k,lattice,dense", [(3, False, 0), (3, True, 0), (4, False, 45), (100, False, 0)])
def test_nearest_equals_brute_force(spark, k, lattice, dense, skew):
    points = cloud(k, lattice=lattice, dense=dense) + [(1, 90 + i, 7.0, 7.0) for i in range(9)]
    got = N.nearest(frame(spark, points), k, World(100, 100), skew=skew)
    plain = World(100, 100, toroidal=False)
    want = set()
    for a in points:
        others = sorted((apart(a, b, plain), b[1]) for b in points if b[0] == a[0] and b[1] != a[1])
        want |= {(a[1], b, i + 1) for i, (_, b) in enumerate(others[:k])}
    assert {tuple(r) for r in got.select("id", "id2", "rank").collect()} == want


def brute_hull(points):
    pts = sorted(set(points))
    area = 0.0
    for a, b in itertools.permutations(pts, 2):
        turns = [(b[0] - a[0]) * (r[1] - a[1]) - (b[1] - a[1]) * (r[0] - a[0]) for r in pts]
        beyond = [(r[0] - a[0]) * (r[0] - b[0]) + (r[1] - a[1]) * (r[1] - b[1]) > 0 for r in pts]
        if min(turns) >= 0 and not any(t == 0 and o for t, o in zip(turns, beyond)):
            area += a[0] * b[1] - b[0] * a[1]
    return area / 2


@pytest.mark.parametrize("part", [4096, 4])
@pytest.mark.parametrize("lattice", [True, False])
def test_hull_area(spark, part, lattice):
    points = cloud(3, n=80, lattice=lattice) + [(3, 1, 0.0, 0.0), (3, 2, 5.0, 5.0), (3, 3, 9.0, 9.0), (4, 1, 2.0, 2.0)]
    got = {r["time"]: r["hull_area"] for r in U.hull_area(frame(spark, points), ["time"], part=part).collect()}
    want = {t: brute_hull([(p[2], p[3]) for p in points if p[0] == t]) for t in (1, 2, 3)}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("n,shift", [(5_000, 1000.0)])
def test_hull_of_corners_only(spark, n, shift):
    """Every point is a corner, so nothing shrinks; no array holds more than a bounded part of it."""
    angle = F.col("id") * (2 * math.pi / n)
    circle = spark.range(n).select(
        F.lit(1).alias("time"), (F.cos(angle) * 40 + shift).alias("x"), (F.sin(angle) * 40).alias("y")
    )
    parabola = spark.range(n).select(
        F.lit(2).alias("time"), F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id")).cast("double").alias("y")
    )
    got = {r["time"]: r["hull_area"] for r in U.hull_area(circle.union(parabola), ["time"], part=512).collect()}
    below = sum((2 * i * i + 2 * i + 1) / 2 for i in range(n - 1))
    assert got == {
        1: pytest.approx(n / 2 * math.sin(2 * math.pi / n) * 1600, rel=1e-9),
        2: pytest.approx((n - 1) ** 3 / 2 - below, rel=1e-9),
    }


def test_skew_join(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(30)], "k long, id long")
    table = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    for hot in (0, 5, 100):
        got = skew_join(rows, table, ["k"], spread_by=["id"], hot_rows=hot)
        assert {(r["id"], r["v"]) for r in got.collect()} == {(i, {0: "a", 1: "b"}.get(i % 3)) for i in range(30)}
        assert skew_join(rows, table, ["k"], spread_by=["id"], how="inner", hot_rows=hot).count() == 20


def brute_closest(points, radius, k, world):
    pairs = {}
    for a, b in itertools.product(points, points):
        d = apart(a, b, world)
        if a[0] == b[0] and a[1] != b[1] and d <= radius**2:
            pairs.setdefault(a[:2], []).append((math.sqrt(d), b[1]))
    return {(*key, i + 1): b for key, near in pairs.items() for i, (_, b) in enumerate(sorted(near)[:k])}


@pytest.mark.parametrize("toroidal", [True, False])
@pytest.mark.parametrize("radius", [7, 49, 60])
def test_neighbour_cap_equals_brute_force(spark, toroidal, radius):
    world = World(100, 100, toroidal)
    edge = [(1, 500, 50.0, 3.0), (1, 501, -50.0, 3.0), (1, 502, 49.0, 50.0), (1, 503, -49.5, -50.0), (3, 504, 0.0, 0.0)]
    few = [(7, 1, -49.0, 0.0), (7, 2, 49.0, 3.0), (8, 1, -48.0, -48.0), (8, 2, 49.0, 49.0), (8, 3, -48.0, 49.0)]
    points = cloud(radius, 80, lattice=True, dense=30) + edge + few
    rows = frame(spark, [*points, (1, 600, None, 1.0)])
    got = S.nearest_within(rows, radius, 3, world).collect()
    assert len({(r.time, r.id, r.id2) for r in got}) == len(got)
    assert {(r.time, r.id, r["rank"]): r.id2 for r in got} == brute_closest(points, radius, 3, world)
    assert all(abs(math.hypot(r.ox, r.oy) - r.dist) < 1e-9 for r in got)


def test_neighbour_cap_pairs_no_crowd(spark, monkeypatch):
    """Three neighbours are found without the pairs of a radius, of which there are 640,000 here."""
    monkeypatch.setattr(S, "placed_neighbours", None)
    points = spark.range(800).selectExpr("1L AS time", "id", "double(id % 2) AS x", "double(id % 4 DIV 2) AS y")
    got = S.nearest_within(points, 7.0, 3, World(100, 100)).collect()
    assert len(got) == 2400
    assert {r.id2 for r in got if r.id > 100} == {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11}


def test_capped_perception_pairs_no_crowd(spark, monkeypatch):
    """A capped tick copies no agent into touching cells, which is where the pairs of a radius come from."""
    config = FlockConfig(width=100, height=100, sensory_distance=7.0, neighbours_considered=3)
    rows = [(1, i, float(i % 3), 0.0, float(i), 1.0, 0.0, 0.0, 0.0) for i in range(30)] + [(1, 99, 30.0, 30.0, 1.0, 1.0, 0.0, 0.0, 0.0)]
    state = spark.createDataFrame(rows, "time long, id long, " + ", ".join(f"{c} double" for c in R.STATE))
    monkeypatch.setattr(S.Grid, "spread", None)
    got = {r.id: r for r in R.perceive(state, config).collect()}
    assert len(got) == 31 and got[99].n_neighbours == 0
    assert {r.n_neighbours for i, r in got.items() if i != 99} == {3}
    assert got[0].coh_x == 0.0 and got[29].coh_x == 0.0


@pytest.mark.parametrize("toroidal", [True, False])
def test_pairs_of_positions_are_told_agent_by_agent(spark, monkeypatch, toroidal):
    """Positions with more agents than a block holds, columns of the agents' own, places and ids that are missing."""
    monkeypatch.setattr(S, "BLOCK", 2)
    world = World(100, 100, toroidal)
    points = cloud(5, 60, lattice=True) + [(1, 200 + i, 49.0, float(i % 2)) for i in range(15)] + [(1, 300, -50.0, 0.0)]
    rows = frame(spark, [*points, (1, 400, None, 0.0), (1, None, 49.0, 0.0)]).withColumn("tag", F.col("id") * 2)
    got = S.neighbours(rows, 7, world, skew=EVERYTHING_HOT, form=F.round).collect()
    assert sorted((r.time, r.id, r.id2) for r in got) == sorted(brute_pairs(points, 7, world))
    assert all(r.tag == 2 * r.id and r.dist == round(math.hypot(r.x2 - r.x, r.y2 - r.y) if not toroidal else r.dist) for r in got)


def test_a_crowd_is_told_in_small_rows(spark):
    """No joined row stands for more than 64 times 64 pairs, which Spark would keep in memory, and none is lost."""
    points = spark.range(500).selectExpr("1L AS time", "id", "double(id % 3 DIV 2) AS x", "0.0D AS y")
    celled = S.with_cell(points, S.Grid.for_radius(World(100, 100), 7.0))
    for skew in (Skew(), EVERYTHING_HOT):
        rows = S._blocks(celled, ["time"], [], skew).collect()
        assert max(len(r.agents) for r in rows) <= 64
        assert len({(r.x, r._part) for r in rows}) == len(rows)
        assert sorted(i for r in rows for i in r.agents) == list(range(500))
        got = S.neighbours(points, 7.0, World(100, 100), skew=skew)
        assert (got.count(), got.select("id", "id2").distinct().count()) == (500 * 499, 500 * 499)


@pytest.mark.parametrize("name", ["neighbours_toroidal", "neighbours_enclosed", "neighbours_strict", "fov_neighbours"])
def test_pairs_are_compared_and_rounded_once_per_position(spark, name):
    """Past the step that tells the agents of a position, pairs cost no more than being written."""
    plan = queries.run(name, spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    told, compared = plan.split("Generate explode(", 1)
    assert not any(work in told.lower() for work in ("round(", "sqrt(", "join"))
    assert "Join Inner" in compared


@pytest.mark.parametrize("skew", [Skew(), EVERYTHING_HOT], ids=["even", "hot"])
def test_shared_neighbours_of_positions(spark, monkeypatch, skew):
    """The same as with the neighbours of every agent, on spots with fewer, as many and more agents than neighbours."""
    points = cloud(3, 60, lattice=True, dense=40) + [(1, 200 + i, 1.0, float(i % 3 == 0)) for i in range(25)] + [(5, 1, 0.0, 0.0)]
    rows = frame(spark, [*points, (1, 400, None, 0.0)])
    want = N.shared_neighbours(N.nearest(rows, 4, World(100, 100)), 2).collect()
    monkeypatch.setattr(N, "nearest", None)
    got = N.shared_nearest(rows, 4, 2, skew=skew).collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_shared_query_lists_neighbours_per_position(spark, monkeypatch):
    monkeypatch.setattr(N, "nearest", None)
    assert queries.run("shared_nn", spark, "/root/testdata/sf0.001").count() > 0


def test_mst_knn_keeps_its_tree_per_position(spark, monkeypatch):
    """Agents on one spot are no nodes of the tree and do not ask for neighbours; agents without a place stay alone."""
    rows = [(1, i, float(i % 3), 0.0) for i in range(30)] + [(1, 50 + i, 40.0 + i % 2, 40.0) for i in range(9)] + [(1, 90, None, 1.0)]
    nodes, asked = [], []
    linked, near = T.connected, T.nearest

    def connected(n, edges, frame):
        nodes.append(n.count())
        return linked(n, edges, frame)

    def nearest(*args, asking):
        asked.append(asking.count())
        return near(*args, asking=asking)

    monkeypatch.setattr(T, "connected", connected)
    monkeypatch.setattr(T, "nearest", nearest)
    got = {r.id: r.cluster_id for r in T.mst_knn(frame(spark, rows), rounds=1).collect()}
    assert max(nodes) <= 5 and asked == [5]
    # with 3 neighbours asked for, nobody looks beyond the own spot
    assert got == {i: 90 if i == 90 else 50 + i % 2 if i >= 50 else i % 3 for _, i, _, _ in rows}
