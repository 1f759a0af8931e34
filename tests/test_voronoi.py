"""Voronoi cells against clipping by every other site."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import rings
from skein.operators import voronoi as O
from skein.schema import World

WORLD = World(100, 100)


def clip(ring, p, q):
    def f(v):
        return (v[0] - (p[0] + q[0]) / 2) * (q[0] - p[0]) + (v[1] - (p[1] + q[1]) / 2) * (q[1] - p[1])

    out = []
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if f(a) <= 0:
            out.append(a)
        if f(a) * f(b) < 0:
            t = f(a) / (f(a) - f(b))
            out.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
    return out


def area_and_centre(ring):
    pairs = list(zip(ring, ring[1:] + ring[:1]))
    cross = [a[0] * b[1] - b[0] * a[1] for a, b in pairs]
    total = sum(cross)
    cx = sum((a[0] + b[0]) * c for (a, b), c in zip(pairs, cross)) / (3 * total)
    cy = sum((a[1] + b[1]) * c for (a, b), c in zip(pairs, cross)) / (3 * total)
    return total / 2, (cx, cy)


def brute(sites, relaxations):
    for step in range(relaxations + 1):
        found = []
        for p in sites:
            ring = [(-50, -50), (50, -50), (50, 50), (-50, 50)]
            for q in sites:
                if q != p:
                    ring = clip(ring, p, q)
            found.append(area_and_centre(ring))
        if step < relaxations:
            sites = [c for _, c in found]
    return [a for a, _ in found]


def clouds():
    rng = random.Random(4)
    spread = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(40)]
    crowded = [(rng.gauss(-45, 1), rng.gauss(-45, 1)) for _ in range(30)] + [(40.0, 40.0), (0.0, 49.0)]
    crowded = [(max(-50.0, x), max(-50.0, y)) for x, y in crowded]
    return {1: spread, 2: crowded, 3: [(1.0, 2.0)], 4: [(-10.0, 0.0), (10.0, 0.0)]}


@pytest.mark.parametrize("relaxations", [0, 2])
def test_areas_equal_brute_force(spark, relaxations):
    frames = clouds()
    rows = [(t, i, x, y) for t, sites in frames.items() for i, (x, y) in enumerate(sites)]
    points = spark.createDataFrame(rows, "time long, id long, x double, y double")
    got = {(r["time"], r["id"]): r["area"] for r in O.relaxed_areas(points, WORLD, relaxations=relaxations).collect()}
    for t, sites in frames.items():
        want = brute(sites, relaxations)
        assert [got[t, i] for i in range(len(sites))] == pytest.approx(want, rel=1e-6)
        assert sum(want) == pytest.approx(10000)


def test_occupancy(spark):
    points = spark.createDataFrame(
        [(1, 0, -10.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 0.0)], "time long, id long, x double, y double"
    )
    assert O.occupancy(points, 50.0, WORLD).first()["voronoi_counts"] == pytest.approx(2 / 3)
    assert O.occupancy(points, 10.0, WORLD).first()["voronoi_counts"] == 0


def test_frames_that_a_task_holds_need_no_search_by_jobs(spark, monkeypatch):
    """Nor do relaxations take jobs of their own: sites are written once, whatever their number."""
    monkeypatch.setattr(O, "search", None)
    monkeypatch.setattr(O, "nearest", None)
    written, cut = [], O.cut
    monkeypatch.setattr(O, "cut", lambda df: written.append(df) or cut(df))
    points = spark.range(3000).selectExpr("id % 50 AS time", "id", "double(id % 61 - 30) AS x", "double(id % 47 - 20) AS y")
    areas = O.relaxed_areas(points, WORLD, relaxations=5).groupBy("time").sum("area").collect()
    assert [r["sum(area)"] for r in areas] == pytest.approx([10000] * 50)
    assert len(written) == 1


@pytest.mark.parametrize("relaxations", [0, 1])
def test_crowded_frames_are_cut_by_joins(spark, monkeypatch, relaxations):
    """Frames beyond HELD and within get the same areas; frames may have several columns, and names that are missing."""
    frames = {(None, 1): clouds()[2], ("a", 1): clouds()[1], ("a", 2): clouds()[4], ("b", 2): clouds()[2]}
    rows = [(*f, i, x, y) for f, sites in frames.items() for i, (x, y) in enumerate(sites)]
    points = spark.createDataFrame(rows, "run string, time long, id long, x double, y double")
    monkeypatch.setattr(O, "AT_A_TIME", 7)
    monkeypatch.setattr(O, "HELD", 35)
    got = {tuple(r)[:3]: r.area for r in O.relaxed_areas(points, WORLD, ["run", "time"], relaxations).collect()}
    assert len(got) == len(rows)
    for f, sites in frames.items():
        assert [got[*f, i] for i in range(len(sites))] == pytest.approx(brute(sites, relaxations), rel=1e-6)


def test_agents_without_a_place_have_no_cell(spark):
    rows = [(1, 0, -10.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, None, 0.0), (1, 3, 1.0, None), (2, 0, None, None)]
    points = spark.createDataFrame(rows, "time long, id long, x double, y double")
    areas = {(r.time, r.id): r.area for r in O.relaxed_areas(points, WORLD, relaxations=2).collect()}
    assert areas == {(1, 0): pytest.approx(5000), (1, 1): pytest.approx(5000), (1, 2): None, (1, 3): None, (2, 0): None}
    small = {r.time: r.voronoi_counts for r in O.occupancy(points, 50.0, WORLD).collect()}
    assert small == {1: 0.5, 2: 0.0}


def odd_frames():
    rng = random.Random(7)
    circle = [(0.0, 0.0)] + [(20 * math.cos(i * math.pi / 60), 20 * math.sin(i * math.pi / 60)) for i in range(120)]
    return [
        circle,  # a cell with a corner for every other site
        [(float(a), float(b)) for a in range(-7, 8) for b in range(-5, 6)],
        [(i * 0.5, 0.0) for i in range(-60, 60)],
        [(-50.0, -50.0), (50.0, 50.0), (-50.0, 3.0), (49.0, -50.0), (0.0, 50.0)],
        [(2.0**-i, 3.0**-i) for i in range(9)],
        list({(float(rng.randrange(-50, 50)), float(rng.randrange(-50, 50))) for _ in range(150)}),
        [(3.0, 4.0)],
    ]


@pytest.mark.parametrize("relaxations", [0, 2])
def test_rings_equal_brute_force(relaxations):
    """Hubs, lattices, lines, borders and uneven distances, all frames together."""
    frames = odd_frames()
    starts = np.cumsum([0, *map(len, frames)])
    x, y = (np.array([p[i] for f in frames for p in f]) for i in (0, 1))
    got = rings.relaxed_areas(starts, x, y, 100, 100, relaxations)
    for start, sites in zip(starts, frames):
        assert list(got[start : start + len(sites)]) == pytest.approx(brute(sites, relaxations), rel=1e-6)


def test_rings_outside_the_world_are_empty():
    x = np.array([0.0, 300.0, 300.0])
    assert list(rings.relaxed_areas(np.array([0, 3]), x, np.array([0.0, 0.0, 5.0]), 100, 100, 1)) == [10000, 0, 0]


def test_tasks_take_whole_frames(monkeypatch):
    monkeypatch.setattr(O, "AT_A_TIME", 4)
    times = [0, 0, 0, 1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 4, 5, 5, None]
    for size in (1, 2, 5, 100):
        batches = pa.table({"time": times}).to_batches(max_chunksize=size)
        told = [(t["time"].to_pylist(), list(s)) for t, s in O._whole_frames(iter(batches), ["time"])]
        assert sum((rows for rows, _ in told), []) == times
        assert sum(len(s) for _, s in told) == 7
        for (a, s), (b, _) in zip(told, told[1:]):
            assert a[-1] != b[0] and s[0] == 0
    assert list(O._whole_frames(iter([]), ["time"])) == []
