"""Minimum spanning trees of frames and the clusters they leave together with nearest neighbours.

Edges are ordered by (length, smaller end, larger end), so a tree is unique whatever ties there are.
Every edge of the tree joins sites whose Voronoi cells share a border, and a frame of n sites has
fewer than 3 n of these. So the tree comes from Boruvka's rounds over the borders, as plain joins and
aggregates: each component takes its least edge to another one, and the components that edges
link become one. Each round at least halves the components. No step compares all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.cluster import connected
from skein.operators.nearest import nearest
from skein.operators.skew import skew_join
from skein.operators.voronoi import cells
from skein.schema import World
from skein.session import cut


def _world(points: DataFrame) -> World:
    """A plane around all positions."""
    x, y = points.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()
    return World(2 * (x or 0.0) + 2, 2 * (y or 0.0) + 2, toroidal=False)


def borders(sites: DataFrame, frame: Sequence[str]) -> DataFrame:
    """(frame, a, b, d2), a < b: the pairs of sites whose cells share a border, and their squared distance."""
    frame = list(frame)
    edge = F.explode("ring").alias("p")
    found = cells(sites, _world(sites), frame, labelled=True).select(*frame, "id", "x", "y", edge)
    found = found.where("p.nx is not null").select(
        *frame, "id", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("p.nx").alias("x"), F.col("p.ny").alias("y")
    )
    other = sites.select(*frame, "x", "y", F.col("id").alias("id2"))
    d2 = (F.col("x") - F.col("x1")) ** 2 + (F.col("y") - F.col("y1")) ** 2
    ends = F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")
    return found.join(other, [*frame, "x", "y"]).select(*frame, *ends, d2.alias("d2")).distinct()


def _boruvka(nodes: DataFrame, edges: DataFrame, frame: list[str]) -> list[DataFrame]:
    """The edges (frame, a, b, d2) of the tree, round by round."""
    rounds = []
    edges = cut(edges.select(*frame, F.col("a").alias("u"), F.col("b").alias("v"), "d2", "a", "b"))
    while True:
        least = F.struct("d2", "a", "b", "u", "v").alias("e")
        ends = edges.select(*frame, F.explode(F.array("u", "v")).alias("node"), least)
        chosen = cut(ends.groupBy(*frame, "node").agg(F.min("e").alias("e")).select(*frame, "e.*").distinct())
        if chosen.isEmpty():
            return rounds
        rounds.append(chosen.select(*frame, "a", "b", "d2"))
        labels = connected(nodes, chosen.select(*frame, "u", "v"), frame)
        for end in ("u", "v"):
            named = labels.select(*frame, F.col("node").alias(end), F.col("label").alias("to"))
            edges = edges.join(named, [*frame, end]).withColumn(end, F.col("to")).drop("to")
        edges = cut(edges.where("u <> v").select(*frame, "u", "v", "d2", "a", "b"))
        nodes = labels.select(*frame, F.col("label").alias("node")).distinct()


def spanning_tree(points: DataFrame, frame: Sequence[str] = ("time",)) -> DataFrame:
    """(frame, id, id2, dist), id < id2: the n - 1 edges that join the n agents of a frame at the least length.

    Distances are plain; positions may lie anywhere. Agents on one spot hang on the smallest of them.
    """
    frame = list(frame)
    points = cut(points.select(*frame, "id", "x", "y"))
    sites = cut(points.groupBy(*frame, "x", "y").agg(F.min("id").alias("id")))
    tree = _boruvka(sites.select(*frame, F.col("id").alias("node")), borders(sites, frame), frame)
    here = points.join(sites.withColumnRenamed("id", "first"), [*frame, "x", "y"]).where("id <> first")
    out = here.select(*frame, F.col("first").alias("id"), F.col("id").alias("id2"), F.lit(0.0).alias("dist"))
    for edges in tree:
        out = out.unionByName(edges.select(*frame, F.col("a").alias("id"), F.col("b").alias("id2"), F.sqrt("d2").alias("dist")))
    return out


def mst_knn(points: DataFrame, frame: Sequence[str] = ("time",), rounds: int | None = None) -> DataFrame:
    """``points`` with cluster_id, the smallest agent of the cluster.

    An edge of the spanning tree stays if one of its ends is among the k nearest of the other, where k is
    the floor of log(n), at least 1, for a group of n. The groups that stay together are split in the
    same way again, each with its own k, ``rounds`` times or until no edge goes.

    Agents on one spot hang on the smallest of them, which is the nearest of each: these edges always stay. So
    the tree and the groups are kept per position, and only its smallest agent asks for its neighbours.
    """
    frame = list(frame)
    spot = [*frame, "x", "y"]
    points = cut(points.drop("cluster_id").dropna(subset=[*frame, "id"]))
    at = points.dropna(subset=["x", "y"])
    sites = cut(at.groupBy(*spot).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    nodes = sites.select(*frame, F.col("id").alias("node"))
    edges = nodes.select(*frame, F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for tree in _boruvka(nodes, borders(sites.drop("n"), frame), frame):
        edges = edges.unionByName(tree.select(*frame, "a", "b"))
    edges = cut(edges)
    world = _world(points)
    # agents without a place count to their frame, and are clusters of their own
    sizes = points.groupBy(*frame, F.lit(0).cast("long").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    members, group = at.withColumn("cluster_id", F.lit(0).cast("long")), sites.withColumn("cluster_id", F.lit(0).cast("long"))
    key = [*frame, "cluster_id"]
    done = 0
    while rounds is None or done < rounds:
        k = F.greatest(F.lit(1), F.floor(F.log(F.col("n").cast("double")))).alias("k")
        sizes = cut(sizes.select(*key, k))
        most = sizes.agg(F.max("k")).first()[0]  # grows with the logarithm of a group
        if most is None:
            break
        near = nearest(members, most, world, key, asking=group).join(sizes, key).where("rank <= k")
        pairs = near.select(*frame, F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
        kept = cut(edges.join(pairs, [*frame, "a", "b"], "left_semi"))
        found = connected(nodes, kept.select(*frame, F.col("a").alias("u"), F.col("b").alias("v")), frame)
        named = found.select(*frame, F.col("node").alias("id"), F.col("label").alias("cluster_id"))
        group = cut(sites.join(named, [*frame, "id"]))
        sizes = group.groupBy(*key).agg(F.sum("n").alias("n"))
        members = skew_join(at, group.select(*spot, "cluster_id"), spot, spread_by=["id"], how="inner")
        done += 1
        if kept.count() == edges.count():
            break
        edges = kept
    clusters = group.select(*spot, "cluster_id")
    labelled = skew_join(points, clusters, spot, spread_by=["id"])
    return labelled.withColumn("cluster_id", F.coalesce("cluster_id", "id"))
