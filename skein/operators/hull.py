"""Convex hull areas of groups of any size, without leaving the JVM.

A group is first reduced to its lowest and highest point per x; a group that is
then short becomes one array. A long one is cut along its own hull: its farthest
points in FAN directions are corners, and a further corner lies beyond exactly
one of the chords between them. The points beyond a chord are a cap. A cap that
is still long is cut at its farthest point from the chord, which is a corner
again, and loses all points inside the triangle. Areas of polygon, triangles
and short caps add up to that of the hull, so corners are never gathered, not
even when every point is one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import skew_join
from skein.session import cut

PART = 4096  # rows of a group handled as one array
CAP = 256  # points of a cap handled as one array; most of them are corners
FAN = 32  # directions in which a long group is first cut

_POINTS = "array<struct<x:double,y:double>>"


def _chain(points: Column, side: int) -> Column:
    """Corners of the lower (side 1) or upper (side -1) hull of points sorted by x.

    A new point hides the corners at the end of the chain from which the way to it
    does not turn outwards; on a convex chain these are contiguous.
    """

    def grow(chain: Column, p: Column) -> Column:
        def outward(i: Column) -> Column:
            a, b = F.element_at(chain, i - 1), F.element_at(chain, i)
            turn = (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
            return turn * side > 0

        kept = 1 + F.size(F.filter(F.sequence(F.lit(2), F.size(chain)), outward))
        short = F.size(chain) < 2
        return F.concat(
            F.when(short, chain).otherwise(F.slice(chain, 1, kept)), F.array(p)
        )

    return F.aggregate(points, F.array().cast(_POINTS), grow)


def _under(chain: Column) -> Column:
    """Area between a chain and the x axis."""

    def strip(total: Column, i: Column) -> Column:
        a, b = F.element_at(chain, i - 1), F.element_at(chain, i)
        return total + (b["x"] - a["x"]) * (a["y"] + b["y"]) / 2

    steps = F.when(F.size(chain) > 1, F.sequence(F.lit(2), F.size(chain)))
    return F.coalesce(F.aggregate(steps, F.lit(0.0), strip), F.lit(0.0))


def _chains(ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lower, upper) of each group of (x, lo, hi) rows."""
    sides = ends.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("x", F.col("lo").alias("y")))).alias("lows"),
        F.sort_array(F.collect_list(F.struct("x", F.col("hi").alias("y")))).alias("highs"),
    )
    return sides.select(
        *keys, _chain(F.col("lows"), 1).alias("lower"), _chain(F.col("highs"), -1).alias("upper")
    )


def _beyond(a: Column, b: Column, p: Column) -> Column:
    """Twice the area of a, b, p; positive if p lies right of the way from a to b, which is outside."""
    return (p["x"] - a["x"]) * (b["y"] - a["y"]) - (p["y"] - a["y"]) * (b["x"] - a["x"])


def _along(a: Column, b: Column, p: Column) -> Column:
    return (p["x"] - a["x"]) * (b["x"] - a["x"]) + (p["y"] - a["y"]) * (b["y"] - a["y"])


def _cap_areas(caps: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, area) between the chord (a, b) of each cap and the hull of its points ``ps``."""
    a, b = F.col("a"), F.col("b")

    def placed(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    zero = F.lit(0.0)
    turned = F.array_sort(F.transform("ps", lambda p: placed(_along(a, b, p), _beyond(a, b, p))))
    ends = F.array(placed(zero, zero)), F.array(placed(_along(a, b, b), zero))
    # a column of its own: the sum over its corners would build the chain anew for each
    chains = caps.select(*by, "a", "b", _chain(F.concat(ends[0], turned, ends[1]), -1).alias("chain"))
    return chains.select(*by, (_under(F.col("chain")) / _along(a, b, b)).alias("area"))


def _cut_areas(points: DataFrame, by: Sequence[str], longest: int) -> DataFrame:
    """(by, hull_area) of groups of any length, from arrays of at most ``longest`` points."""
    at, a, b, top = F.struct("x", "y"), F.col("a"), F.col("b"), F.col("top")

    def reach(angle: float) -> Column:
        return F.struct(F.col("x") * math.cos(angle) + F.col("y") * math.sin(angle), "x", "y")

    corners = [F.max_by(at, reach(2 * math.pi * i / FAN)) for i in range(FAN)]
    ring, chords = F.col("ring"), F.col("chords")
    between = F.transform(
        F.sequence(F.lit(1), F.lit(FAN)),
        lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i % FAN + 1).alias("b")),
    )
    rings = points.groupBy(*by).agg(F.array(*corners).alias("ring"))
    fans = cut(rings.select(*by, between.alias("chords")))
    start = chords[0]["a"]
    polygon = F.aggregate(chords, F.lit(0.0), lambda total, c: total - _beyond(start, c["a"], c["b"]) / 2)
    areas = [fans.select(*by, polygon.alias("area"))]
    chord = F.get(F.filter(chords, lambda c: _beyond(c["a"], c["b"], at) > 0), 0)
    outside = skew_join(points, fans, by, spread_by=["x", "y"], how="inner").select(*by, "x", "y", chord.alias("c"))
    caps = cut(outside.where("c is not null").select(*by, "c.a", "c.b", "x", "y"))
    key = [*by, "a", "b"]
    while not caps.isEmpty():  # every round takes at least its top from each long cap
        tops = cut(
            caps.groupBy(*key).agg(
                F.count(F.lit(1)).alias("n"), F.max_by(at, F.struct(_beyond(a, b, at), "x", "y")).alias("top")
            )
        )
        known = skew_join(caps, tops, key, spread_by=["x", "y"], how="inner")
        short = known.where(F.col("n") <= longest).groupBy(*key).agg(F.collect_list(at).alias("ps"))
        areas.append(_cap_areas(short, by))
        long = F.col("n") > longest
        areas.append(tops.where(long).select(*by, (_beyond(a, b, top) / 2).alias("area")))
        first, second = _beyond(a, top, at) > 0, _beyond(top, b, at) > 0
        caps = cut(
            known.where(long & (first | second)).select(
                *by, F.when(first, a).otherwise(top).alias("a"), F.when(first, top).otherwise(b).alias("b"), "x", "y"
            )
        )
    return reduce(DataFrame.unionByName, areas).groupBy(*by).agg(F.sum("area").alias("hull_area"))


def hull_area(
    points: DataFrame, by: Sequence[str], smallest: int = 3, part: int = PART
) -> DataFrame:
    """(by, hull_area) of groups with at least ``smallest`` rows; groups of over ``part`` distinct x are cut."""
    by = list(by)
    ends = cut(
        points.groupBy(*by, "x").agg(
            F.min("y").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("n")
        )
    )
    sizes = ends.groupBy(*by).agg(F.sum("n").alias("n"))
    ends = ends.drop("n")
    lengths = cut(ends.groupBy(*by).agg(F.count(F.lit(1)).alias("length")))
    long = F.col("length") > part
    known = skew_join(ends, lengths, by, spread_by=["x"])
    areas = _chains(known.where(~long), by).select(
        *by, (_under(F.col("upper")) - _under(F.col("lower"))).alias("hull_area")
    )
    if not lengths.where(long).isEmpty():
        both = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y")
        areas = areas.unionByName(_cut_areas(known.where(long).select(*by, "x", both), by, min(part, CAP)))
    return areas.join(sizes.where(F.col("n") >= smallest).drop("n"), by)


def mean_flock_area(
    rows: DataFrame, by: Sequence[str] = ("time",), filter_noise: bool = True
) -> DataFrame:
    """Mean hull area of the flocks (more than two agents) of each frame."""
    kept = rows.where(F.col("cluster_id") != 0) if filter_noise else rows
    areas = hull_area(kept, [*by, "cluster_id"])
    return areas.groupBy(*by).agg(F.avg("hull_area").alias("average_cluster_volumes"))
