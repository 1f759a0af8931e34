"""Exact k nearest neighbours per frame without comparing all pairs.

Positions are counted on a pyramid of ever finer grids over the square that holds
the data. Each position takes the finest grid whose cell around it holds more than k
agents: the k-th neighbour is then at most one cell diagonal away, so only cells
within that distance are searched. The pyramid goes down until its cells hold few
positions, so a chosen cell is searched from few positions (its sub-cells hold at most k
agents each), which bounds the comparisons by the number of agents however uneven they lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators.skew import Skew, skew_join
from skein.schema import World
from skein.session import cut

LEVELS = 9  # grids to begin with: the finest has 2**(levels - 1) cells per side
DEEPER = 6  # grids added while a finest cell is crowded
DEEPEST = 45  # doubles of one scale are told apart before


@dataclass(frozen=True)
class Pyramid:
    """The square over the data and the number of grids on it."""

    x0: float
    y0: float
    extent: float
    levels: int = LEVELS

    @classmethod
    def over(cls, positions: DataFrame) -> "Pyramid":
        x0, x1, y0, y1 = positions.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if x0 is None:
            return cls(0.0, 0.0, 1.0)
        return cls(x0, y0, max(x1 - x0, y1 - y0, 1e-9) * (1 + 1e-9))

    def deep_enough(self, spots: DataFrame, frame: list[str], need: int) -> "Pyramid":
        """More grids, until no finest cell holds more than a few times ``need`` positions."""
        fit = self
        while fit.levels < DEEPEST:
            sizes = _fine(spots.select(*frame, "x", "y"), fit).groupBy(*frame, "fx", "fy").count()
            if (sizes.agg(F.max("count")).first()[0] or 0) <= 8 * need:
                break
            fit = replace(fit, levels=fit.levels + DEEPER)
        return fit


def _spots(points: DataFrame, frame: list[str], k: int, carry: Sequence[str] = ()) -> DataFrame:
    """Occupied positions with their agents: the count and the k + 1 smallest ids, as structs with ``carry`` if any."""
    here = Window.partitionBy(*frame, "x", "y").orderBy("id")
    first = (
        points.select(*frame, "x", "y", "id", *carry)
        .withColumn("_r", F.row_number().over(here))
        .where(F.col("_r") <= k + 1)
    )
    agent = F.struct("id", *carry) if carry else F.col("id")
    # counts beyond k + 1 are never needed
    return first.groupBy(*frame, "x", "y").agg(
        F.sort_array(F.collect_list(agent)).alias("ids"), F.count(F.lit(1)).alias("n")
    )


def _fine(df: DataFrame, pyramid: Pyramid) -> DataFrame:
    """Adds fx, fy: the finest cell of a position. Positions outside the square count to its edge."""
    top = 2 ** (pyramid.levels - 1) - 1
    side = pyramid.extent / (top + 1)

    def index(c: str, low: float) -> Column:
        i = F.floor((F.col(c) - F.lit(low)) / F.lit(side)).cast("long")
        return F.greatest(F.lit(0), F.least(i, F.lit(top)))

    return df.withColumns({"fx": index("x", pyramid.x0), "fy": index("y", pyramid.y0)})


def _levels(cells: DataFrame, levels: int) -> DataFrame:
    """Repeats finest cells once per grid: level, cx, cy (level 0 is the whole frame)."""
    up = {f"c{a}": F.expr(f"shiftright(f{a}, {levels - 1} - level)") for a in "xy"}
    return cells.withColumn(
        "level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    ).withColumns(up)


def search(
    queries: DataFrame,
    spots: DataFrame,
    need: int,
    square: Pyramid,
    frame: Sequence[str],
    hot_rows: int,
) -> DataFrame:
    """(frame, x, y, x2, y2, d2, ids): for each query position all spots that may be
    among its ``need`` nearest agents, and few others.

    ``queries`` are distinct positions and ``spots`` come from ``_spots``; both carry
    their finest cell.
    """
    frame = list(frame)
    fine_cell = [*frame, "fx", "fy"]
    cell = [*frame, "level", "cx", "cy"]
    pyramid = _levels(spots.groupBy(*fine_cell).agg(F.sum("n").alias("n")), square.levels)
    full = pyramid.groupBy(*cell).agg(F.sum("n").alias("n_cell")).where(F.col("n_cell") >= need)
    asking = _levels(queries.select(*fine_cell).distinct(), square.levels)
    chosen = (
        skew_join(asking, full, cell, spread_by=["fx", "fy"], hot_rows=hot_rows)
        .where(F.col("n_cell").isNotNull() | (F.col("level") == 0))
        .groupBy(*fine_cell)
        .agg(F.max("level").alias("level"))
    )
    low = {"x": F.lit(square.x0), "y": F.lit(square.y0)}
    side = F.lit(square.extent) / F.pow(F.lit(2.0), F.col("level"))
    reach = F.sqrt(F.lit(2.0)) * side
    probes = queries.join(chosen, fine_cell).withColumns({"side": side, "reach": reach})

    def span(axis: str) -> Column:
        lo = F.floor((F.col(axis) - low[axis] - F.col("reach")) / F.col("side"))
        hi = F.floor((F.col(axis) - low[axis] + F.col("reach")) / F.col("side"))
        last = F.pow(F.lit(2.0), F.col("level")) - 1
        whole = F.sequence(F.lit(0).cast("long"), F.lit(0).cast("long"))
        some = F.sequence(
            F.greatest(lo, F.lit(0)).cast("long"), F.least(hi, last).cast("long")
        )
        return F.when(F.col("level") == 0, whole).otherwise(some)

    def gap(axis: str, c: str) -> Column:
        start = F.col(c) * F.col("side") + low[axis]
        return F.greatest(start - F.col(axis), F.col(axis) - start - F.col("side"), F.lit(0.0))

    targets = cut(
        probes.withColumn("cx", F.explode(span("x")))
        .withColumn("cy", F.explode(span("y")))
        .where(
            (F.col("level") == 0)
            | (gap("x", "cx") ** 2 + gap("y", "cy") ** 2 <= F.col("reach") ** 2)
        )
        .select(*cell, "x", "y", "reach")
    )
    used = targets.select(*cell).distinct().withColumn("_used", F.lit(1))
    serving = skew_join(
        pyramid.drop("n"), used, cell, spread_by=["fx", "fy"], how="inner", hot_rows=hot_rows
    ).select(*fine_cell, "level", "cx", "cy")
    others = spots.join(serving, fine_cell).select(
        *cell, F.col("x").alias("x2"), F.col("y").alias("y2"), "ids"
    )
    d = (F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    return (
        targets.join(others.hint("merge"), cell)
        .withColumn("d2", V.norm_sq(d))
        .where((F.col("level") == 0) | (F.col("d2") <= F.col("reach") ** 2))
        .select(*frame, "x", "y", "x2", "y2", "d2", "ids")
    )


def near_lists(points: DataFrame, k: int, frame: list[str], skew: Skew) -> DataFrame:
    """(frame, x, y, near): the k + 1 agents closest to each occupied position, those on it included, ties by id.

    An entry has d2, id2, x2, y2. ``points`` (frame, id, x, y) are written.
    """
    bare = cut(_spots(points, frame, k))
    square = Pyramid.over(bare).deep_enough(bare, frame, k + 1)
    spots = cut(_fine(bare, square))
    hot_rows = skew.needed(spots.count() * square.levels).key_rows
    queries = spots.select(*frame, "x", "y", "fx", "fy")
    found = search(queries, spots, k + 1, square, frame, hot_rows).select(
        *frame, "x", "y", "x2", "y2", "d2", F.explode("ids").alias("id2")
    )
    order = Window.partitionBy(*frame, "x", "y").orderBy("d2", "id2")
    best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    return best.groupBy(*frame, "x", "y").agg(
        F.sort_array(F.collect_list(F.struct("d2", "id2", "x2", "y2"))).alias("near")
    )


def nearest(
    points: DataFrame,
    k: int,
    world: World,
    frame: Sequence[str] = ("time",),
    *,
    skew: Skew = Skew(),
    asking: DataFrame | None = None,
) -> DataFrame:
    """(frame, id, x, y, id2, x2, y2, dist, rank): the k closest others, ties by id.

    Distances are plain, and positions may lie anywhere: the grids cover the data, not the ``world``.
    ``asking`` are the points whose neighbours are wanted, by default all.
    """
    frame = list(frame)
    points = cut(points.select(*frame, "id", "x", "y"))
    lists = near_lists(points, k, frame, skew)
    asking = points if asking is None else asking.select(*frame, "id", "x", "y")
    agents = skew_join(
        asking,
        cut(lists),
        [*frame, "x", "y"],
        spread_by=["id"],
        hot_rows=skew.needed(points.count()).key_rows,
    )
    mine = F.slice(F.filter("near", lambda p: p["id2"] != F.col("id")), 1, k)
    return agents.select(
        *frame, "id", "x", "y", F.posexplode(mine).alias("pos", "p")
    ).select(
        *frame,
        "id",
        "x",
        "y",
        F.col("p.id2").alias("id2"),
        F.col("p.x2").alias("x2"),
        F.col("p.y2").alias("y2"),
        F.sqrt("p.d2").alias("dist"),
        (F.col("pos") + 1).cast("long").alias("rank"),
    )


def with_mutual(neighbours: DataFrame, frame: Sequence[str] = ("time",)) -> DataFrame:
    """Flags kNN pairs that hold in both directions."""
    neighbours = cut(neighbours)
    back = neighbours.select(
        *frame, F.col("id2").alias("id"), F.col("id").alias("id2"), F.lit(True).alias("_back")
    )
    return neighbours.join(back, [*frame, "id", "id2"], "left").withColumn(
        "mutual", F.coalesce("_back", F.lit(False))
    ).drop("_back")


def shared_neighbours(
    neighbours: DataFrame, at_least: int, frame: Sequence[str] = ("time",)
) -> DataFrame:
    """kNN pairs with the number of neighbours they share, kept from ``at_least`` on."""
    frame = list(frame)
    neighbours = cut(neighbours.select(*frame, "id", "id2"))
    lists = cut(neighbours.groupBy(*frame, "id").agg(F.collect_set("id2").alias("own")))
    theirs = lists.select(*frame, F.col("id").alias("id2"), F.col("own").alias("other"))
    pairs = skew_join(
        neighbours.select(*frame, "id", "id2"), theirs, [*frame, "id2"], spread_by=["id"], how="inner"
    )
    return (
        pairs.join(lists, [*frame, "id"])
        .withColumn("shared", F.size(F.array_intersect("own", "other")).cast("long"))
        .where(F.col("shared") >= at_least)
        .select(*frame, "id", "id2", "shared")
    )


def shared_nearest(
    points: DataFrame, k: int, at_least: int, frame: Sequence[str] = ("time",), *, skew: Skew = Skew()
) -> DataFrame:
    """``shared_neighbours`` of the k nearest: (frame, id, id2, shared).

    Agents of one position have all but the same neighbours, and those are among the first on their own positions. So
    the lists of neighbours are brought together once per position, and an agent only reads what its position has.
    """
    frame = list(frame)
    points = cut(points.select(*frame, "id", "x", "y"))
    spot = [*frame, "x", "y"]
    near = near_lists(points, k, frame, skew).dropna(subset=["x", "y"])
    here = F.transform(F.filter("near", lambda p: p["d2"] == 0), lambda p: p["id2"])
    lists = cut(near.select(*spot, F.col("near.id2").alias("ids"), here.alias("here")))

    def without(ids: Column, one: Column) -> Column:
        return F.slice(F.filter(ids, lambda i: i != one), 1, k)

    # a neighbour of anyone is one of the k + 1 smallest of its position, and so in the list there
    theirs = lists.withColumn("id2", F.explode("here")).select(*frame, "id2", without(F.col("ids"), F.col("id2")).alias("theirs"))
    asked = lists.select(*spot, "ids", F.explode("ids").alias("id2"))
    known = skew_join(
        asked, cut(theirs), [*frame, "id2"], spread_by=["x", "y"], how="inner",
        hot_rows=skew.needed(asked.count()).key_rows,
    )
    tables = known.groupBy(*spot, "ids").agg(F.collect_list(F.struct("id2", "theirs")).alias("others"))
    agents = skew_join(
        points, cut(tables), spot, spread_by=["id"], hot_rows=skew.needed(points.count()).key_rows
    ).withColumn("own", without(F.col("ids"), F.col("id")))
    shared = F.transform(
        F.filter("others", lambda o: F.array_contains("own", o["id2"])),
        lambda o: F.struct(o["id2"].alias("id2"), F.size(F.array_intersect("own", o["theirs"])).cast("long").alias("shared")),
    )
    kept = F.explode(F.filter(shared, lambda o: o["shared"] >= at_least)).alias("o")
    return agents.select(*frame, "id", kept).select(*frame, "id", "o.id2", "o.shared")


def kth_distances(neighbours: DataFrame, k: int, frame: Sequence[str] = ("time",)) -> DataFrame:
    """Distance of every agent to its k-th neighbour, the curve that suggests a radius."""
    return neighbours.where(F.col("rank") == k).select(*frame, "id", "dist")
