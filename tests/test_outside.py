"""Spatial operators with positions outside the world, against all pairs."""

import math
import os
import random

import pytest

from skein.operators.cluster import components, dbscan
from skein.operators.nearest import nearest
from skein.schema import World


def scattered(seed, n, spread):
    rng = random.Random(seed)
    near = [(rng.gauss(70, 4), rng.gauss(-60, 4)) for _ in range(n // 3)]
    return [(1, i, x, y) for i, (x, y) in enumerate([*near, *((rng.uniform(-spread, spread), rng.uniform(-spread, spread)) for _ in range(n - len(near)))])]


def distance(a, b, world):
    d = [abs(a[2] - b[2]), abs(a[3] - b[3])]
    if world.toroidal:
        d = [min(v, abs(size - v)) for v, size in zip(d, (world.width, world.height))]
    return math.hypot(*d)


def clusters(rows, radius, min_pts, world):
    near = {a[1]: [b[1] for b in rows if distance(a, b, world) <= radius] for a in rows}
    core = {i for i, others in near.items() if len(others) >= min_pts}
    label = {}
    for i in sorted(core):
        stack = [i] if i not in label else []
        while stack:
            j = stack.pop()
            if j not in label:
                label[j] = i
                stack += [o for o in near[j] if o in core]
    for i, others in near.items():
        if i not in core:
            held = [label[o] for o in others if o in core]
            if held:
                label[i] = max(held)
    return {r[1]: label.get(r[1], -1) + 1 for r in rows}


@pytest.mark.parametrize("toroidal", [True, False])
def test_clusters_outside_the_world(spark, toroidal):
    world = World(100, 100, toroidal)
    rows = scattered(1, 90, 74 if toroidal else 200)
    frame = spark.createDataFrame(rows, "time long, id long, x double, y double")
    for min_pts in (1, 3):
        found = {r.id: (r.cluster_id, r.x, r.y) for r in dbscan(frame, 7.0, min_pts, world).collect()}
        want = clusters(rows, 7.0, min_pts, world)
        assert {i: c for i, (c, _, _) in found.items()} == want
        assert all(found[i][1:] == (x, y) for _, i, x, y in rows)


def test_three_far_apart_agents_are_noise(spark):
    frame = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate((60.0, 75.0, 90.0))], "time long, id long, x double, y double")
    world = World(100, 100, False)
    assert {r.cluster_id for r in dbscan(frame, 7.0, 3, world).collect()} == {0}
    assert sorted(r.component for r in components(frame, 7.0, world).collect()) == [0, 1, 2]


def test_nearest_outside_the_world_and_in_a_dense_spot(spark):
    rng = random.Random(2)
    rows = scattered(3, 120, 300) + [(1, 1000 + i, 5 + rng.random() * 1e-6, 5 + rng.random() * 1e-6) for i in range(300)]
    frame = spark.createDataFrame(rows, "time long, id long, x double, y double")
    got = {}
    for r in nearest(frame, 4, World(100, 100, True)).collect():
        got.setdefault(r.id, []).append((r.rank, r.id2))
    for a in rows:
        others = sorted(((b[2] - a[2]) ** 2 + (b[3] - a[3]) ** 2, b[1]) for b in rows if b[1] != a[1])[:4]
        assert [i for _, i in sorted(got[a[1]])] == [i for _, i in others]


def test_a_hot_key_that_the_table_lacks_is_spread(spark, monkeypatch):
    from skein.operators import skew

    rows = spark.createDataFrame([(7 if i % 2 else i, i) for i in range(2000)], "k long, id long")
    table = spark.createDataFrame([(i, f"v{i}") for i in range(2000) if i != 7], "k long, v string")
    seen = {}
    original = skew.spread_rows

    def kept(*args):
        seen["marked"] = original(*args)
        return seen["marked"]

    monkeypatch.setattr(skew, "spread_rows", kept)
    joined = skew.skew_join(rows, table, ["k"], spread_by=["id"], hot_rows=100)
    got = {(r.k, r.id, r.v) for r in joined.collect()}
    assert got == {(7, i, None) if i % 2 else (i, i, f"v{i}") for i in range(2000)}
    assert seen["marked"].where("k = 7").select("_spread").distinct().count() > 900


def test_cut_tables_can_be_discarded(spark):
    from skein import session

    first = session.cut(spark.range(5))
    folder = first.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert first.count() == 5 and os.path.isdir(folder)
    assert session.discard_cuts(spark) >= 1 and not os.path.exists(folder)
