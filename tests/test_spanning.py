"""Spanning trees and their clusters against Kruskal over all pairs."""

import math
import random

import pytest

from skein.operators import spanning as T

SCHEMA = "time long, id long, x double, y double, cluster_id long"


def kruskal(points):
    """points: {id: (x, y)} -> edges by (length, ends)."""
    ids = sorted(points)
    edges = sorted(
        ((points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2, a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
    )
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    tree = []
    for d2, a, b in edges:
        if find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
            tree.append((a, b, math.sqrt(d2)))
    return tree


def groups_of(ids, edges):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b, *_ in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def mst_knn(points, rounds):
    edges, label, n = kruskal(points), dict.fromkeys(points, 0), 0
    while rounds is None or n < rounds:
        near = {}
        for i, (x, y) in points.items():
            mine = [j for j in points if label[j] == label[i]]
            k = max(1, int(math.log(len(mine))))
            order = sorted(((points[j][0] - x) ** 2 + (points[j][1] - y) ** 2, j) for j in mine if j != i)
            near[i] = {j for _, j in order[:k]}
        kept = [e for e in edges if e[1] in near[e[0]] or e[0] in near[e[1]]]
        label, n = groups_of(points, kept), n + 1
        if len(kept) == len(edges):
            break
        edges = kept
    return label


def frames():
    rng = random.Random(3)
    blob = lambda cx, cy, s, n: [(rng.gauss(cx, s), rng.gauss(cy, s)) for _ in range(n)]
    return {
        1: [(rng.randrange(6), rng.randrange(6)) for _ in range(60)],  # ties and shared spots
        2: blob(0, 0, 1, 40) + blob(500, 0, 1, 40) + blob(0, 900, 20, 20),
        3: [(i, 2 * i) for i in range(20)],
        4: [(5.0, 5.0)] * 4,
        5: [(1.0, 2.0)],
        6: [(0, 0), (-3, 4)],
        7: [(math.cos(k / 5), math.sin(k / 5)) for k in range(30)] + [(0, 0)],
    }


@pytest.fixture(scope="module")
def points(spark):
    rows = [(t, 7 * i % 101, float(x), float(y), 5) for t, ps in frames().items() for i, (x, y) in enumerate(ps)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def placed(t):
    return {7 * i % 101: (float(x), float(y)) for i, (x, y) in enumerate(frames()[t])}


def test_trees_equal_kruskal(points):
    got = T.spanning_tree(points).collect()
    for t in frames():
        mine = sorted((r.id, r.id2) for r in got if r.time == t)
        assert mine == sorted((a, b) for a, b, _ in kruskal(placed(t))), t
        assert len(mine) == len(placed(t)) - 1
    assert sum(r.dist for r in got) == pytest.approx(sum(d for t in frames() for *_, d in kruskal(placed(t))))


@pytest.mark.parametrize("rounds", [1, None])
def test_clusters_equal_the_definition(points, rounds):
    rows = T.mst_knn(points, rounds=rounds).collect()
    assert len(rows) == points.count()
    for t in frames():
        assert {r.id: r.cluster_id for r in rows if r.time == t} == mst_knn(placed(t), rounds), t


def test_no_points(points):
    assert T.spanning_tree(points.where("1 = 0")).collect() == []
    assert T.mst_knn(points.where("1 = 0")).collect() == []
