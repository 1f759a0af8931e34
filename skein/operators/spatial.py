"""Neighbour search as an equi-join on grid cells with a distance predicate.

The world is tiled with cells at least one radius wide, so all neighbours of an
agent lie in its own and the eight touching cells. One side keeps its cell, the
other is copied into every touching cell, and Spark joins on (frame, cell).

Skew. A cell may hold a large share of a frame. The most crowded cells get
salts: agents of such a cell are spread over several join keys and only the
copies sent to that cell are repeated. The list of crowded cells has a fixed
limit, so it can be broadcast whatever the table size; more crowded cells than
that already spread over enough keys by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators.nearest import Pyramid, _fine, _spots, search
from skein.operators.skew import NO_SKEW, Skew, hot_keys, skew_join
from skein.schema import World
from skein.session import cut

MAX_SALTS = 512
BLOCK = 1 << 12  # agents of one position that are collected in one row
TOLD = 1 << 6  # agents of one position that are handed on as one row: a task holds the pairs of two such rows at once


@dataclass(frozen=True)
class Grid:
    """Tiling of a world; ``reach`` is how many cells away a neighbour may be."""

    world: World
    nx: int
    ny: int
    reach: int = 1

    @classmethod
    def for_radius(cls, world: World, radius: float) -> "Grid":
        if radius <= 0:
            raise ValueError("the radius must be positive")
        return cls(
            world, max(1, int(world.width // radius)), max(1, int(world.height // radius))
        )

    @classmethod
    def within_radius(cls, world: World, radius: float) -> "Grid":
        """Cells so small that any two agents of one cell are within the radius."""
        if radius <= 0:
            raise ValueError("the radius must be positive")
        nx = max(1, math.ceil(world.width * math.sqrt(2) / radius))
        ny = max(1, math.ceil(world.height * math.sqrt(2) / radius))
        smallest = min(world.width / nx, world.height / ny)
        return cls(world, nx, ny, int(radius / smallest) + 1)

    @property
    def dx(self) -> float:
        return self.world.width / self.nx

    @property
    def dy(self) -> float:
        return self.world.height / self.ny

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Cell of a position. Outside a plane the grid simply goes on; on a torus it wraps around."""

        def along(value: Column, low: float, step: float, n: int) -> Column:
            i = F.floor((value - F.lit(low)) / F.lit(step)).cast("long")
            return F.pmod(i, F.lit(n)) if self.world.toroidal else i

        return (
            along(x, -self.world.width / 2, self.dx, self.nx),
            along(y, -self.world.height / 2, self.dy, self.ny),
        )

    def table_index(self, x: Column, y: Column) -> Column:
        """Row-major number of a position in a table of nx * ny cells; positions outside count to its edge.

        Positions on the upper edge share the last cell, so this is no key for joins within a radius.
        """

        def along(value: Column, half: float, step: float, n: int) -> Column:
            i = F.floor((value + F.lit(half)) / F.lit(step)).cast("long")
            return F.greatest(F.lit(0), F.least(i, F.lit(n - 1)))

        row = along(y, self.world.height / 2, self.dy, self.ny)
        return along(x, self.world.width / 2, self.dx, self.nx) + row * self.nx

    def offsets(self) -> list[tuple[int, int]]:
        """Cell steps that can lead to a neighbour; wrapped duplicates are left out."""
        span = range(-self.reach, self.reach + 1)
        if not self.world.toroidal:
            return [(i, j) for i in span for j in span]
        xs = sorted({i % self.nx for i in span})
        ys = sorted({j % self.ny for j in span})
        return [(i, j) for i in xs for j in ys]

    def spread(self, df: DataFrame, cx: str = "cx", cy: str = "cy") -> DataFrame:
        """Copies each row into every cell whose agents may have it as a neighbour."""
        steps = F.explode(
            F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in self.offsets()])
        )
        moved = df.withColumn("_o", steps)
        tx, ty = F.col(cx) + F.col("_o.i"), F.col(cy) + F.col("_o.j")
        if self.world.toroidal:
            tx, ty = F.pmod(tx, F.lit(self.nx)), F.pmod(ty, F.lit(self.ny))
        return moved.withColumns({cx: tx, cy: ty}).drop("_o")


def with_cell(df: DataFrame, grid: Grid) -> DataFrame:
    cx, cy = grid.cell(F.col("x"), F.col("y"))
    return df.withColumns({"cx": cx, "cy": cy})


def prepared(points: DataFrame, grid: Grid, skew: Skew | None) -> tuple[DataFrame, Skew]:
    """Points with their cell, and the skew handling their number calls for.

    A join reads its points several times (both sides, crowded cells), so they are
    written once. ``skew=None`` means the caller knows them to be few and written.
    """
    celled = with_cell(points, grid)
    if skew is None:
        return celled, NO_SKEW
    celled = cut(celled)
    return celled, skew.needed(celled.count())


def cell_salts(celled: DataFrame, frame: Sequence[str], hot_rows: int) -> DataFrame:
    """(frame, cx, cy, salts) of the most crowded cells."""
    salts = F.least(F.ceil(F.col("_n") / hot_rows), F.lit(MAX_SALTS)).cast("int")
    return hot_keys(celled, [*frame, "cx", "cy"], hot_rows).withColumn("salts", salts).drop("_n")


def cell_join(
    left: DataFrame,
    right: DataFrame,
    grid: Grid,
    frame: Sequence[str],
    within: Column,
    *,
    how: str = "inner",
    hot_rows: int = Skew.cell_rows,
    crowd: DataFrame | None = None,
) -> DataFrame:
    """Joins ``left`` rows (x, y, cx, cy, id) with ``right`` rows (x2, y2, cx, cy) nearby.

    Keeps cx, cy and _salt of the left row, so a later groupBy on them and the
    left key needs no further shuffle. ``crowd``: rows that say how crowded a cell is, by default ``left``.
    """
    keys = [*frame, "cx", "cy", "_salt"]
    spread = grid.spread(right)
    if not hot_rows:
        left = left.withColumn("_salt", F.lit(0))
        spread = spread.withColumn("_salt", F.lit(0))
    else:
        hot = F.broadcast(cell_salts(left if crowd is None else crowd, frame, hot_rows))
        where = [*frame, "cx", "cy"]
        salts = F.coalesce(F.col("salts"), F.lit(1))
        left = (
            left.join(hot, where, "left")
            .withColumn("_salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
            .drop("salts")
        )
        spread = (
            spread.join(hot, where, "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
            .drop("salts")
        )
    condition = within
    for key in keys:
        condition = condition & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    # sort-merge: the copies outgrow the size the optimiser assumes for a broadcast, and
    # sorted runs spill and are split by adaptive execution when a partition is large
    joined = left.alias("a").join(spread.alias("b").hint("merge"), condition, how)
    right_only = [c for c in right.columns if c not in (*frame, "cx", "cy")]
    return joined.select("a.*", *[F.col(f"b.{c}").alias(c) for c in right_only])


def _as_other(points: DataFrame, frame: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return points.select(
        *frame,
        "cx",
        "cy",
        F.col("id").alias("id2"),
        F.col("x").alias("x2"),
        F.col("y").alias("y2"),
        *[F.col(c).alias(f"{c}2") for c in extra],
    )


def _reach(radius: float, world: World, strict: bool) -> Column:
    d = V.delta(F.col("a.x"), F.col("a.y"), F.col("b.x2"), F.col("b.y2"), world)
    limit = F.lit(float(radius) ** 2)
    return V.norm_sq(d) < limit if strict else V.norm_sq(d) <= limit


PLACE = ["cx", "cy", "_salt"]  # where a pair was compared; grouping by it needs no shuffle


def placed_neighbours(
    points: DataFrame,
    radius: float,
    world: World,
    frame: Sequence[str] = ("time",),
    carry: Sequence[str] = (),
    *,
    strict: bool = False,
    skew: Skew | None = Skew(),
) -> DataFrame:
    """``neighbours``, joined agent by agent, with the columns PLACE: all pairs of an agent share one place. ``carry``: columns of the other."""
    grid = Grid.for_radius(world, radius)
    celled, skew = prepared(points, grid, skew)
    near = _reach(radius, world, strict) & (F.col("a.id") != F.col("b.id2"))
    pairs = cell_join(celled, _as_other(celled, frame, carry), grid, frame, near, hot_rows=skew.cell_rows)
    ox, oy = V.delta(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), world)
    return pairs.withColumns({"ox": ox, "oy": oy}).withColumn(
        "dist", V.norm((F.col("ox"), F.col("oy")))
    )


def _blocks(celled: DataFrame, frame: list[str], own: list[str], skew: Skew) -> DataFrame:
    """Occupied positions with their agents as an array of ids, or of structs with the columns ``own``.

    A position with more than BLOCK agents is collected in several rows, so that no array holds a crowd. All are
    handed on in rows of TOLD agents, ``_part`` tells them apart: Spark keeps all rows that come of one joined row in
    memory, and a task whose rows stay in the processor's caches tells more than twice as many a second.
    """
    spot = [*frame, "cx", "cy", "x", "y"]
    known = celled.dropna(subset=["x", "y", "id"])
    part = F.lit(0)
    if skew.cell_rows:
        known = known.join(F.broadcast(hot_keys(known, spot, BLOCK)), spot, "left")
        part = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("_n", F.lit(1)) / BLOCK))
    agent = F.struct("id", *own) if own else F.col("id")
    lists = known.groupBy(*spot, part.alias("_hash")).agg(F.collect_list(agent).alias("agents"))
    rows = F.transform(F.sequence(F.lit(1), F.size("agents"), F.lit(TOLD)), lambda i: F.slice("agents", i, TOLD))
    dealt = lists.select(*spot, "_hash", F.posexplode(rows).alias("_row", "agents"))
    return dealt.select(*spot, F.struct("_hash", "_row").alias("_part"), "agents")


def _spot_pairs(
    points: DataFrame,
    radius: float,
    world: World,
    frame: Sequence[str],
    strict: bool,
    skew: Skew | None,
    form: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(frame, id and other columns of an agent, x, y, x2, y2, ox, oy, dist, ids2): an agent and a block of agents nearby.

    Positions are compared once, whatever the number of agents on them, and told agent by agent after that;
    the agents of ``ids2`` share one position. The agent itself is among those of its own.
    """
    frame = list(frame)
    grid = Grid.for_radius(world, radius)
    celled, skew = prepared(points, grid, skew)
    own = [c for c in points.columns if c not in (*frame, "x", "y", "id")]
    blocks = _blocks(celled, frame, own, skew)
    if skew.cell_rows:
        blocks = cut(blocks)
    left = blocks.select(*frame, "cx", "cy", "x", "y", "agents", F.xxhash64("x", "y", "_part").alias("id"))
    ids = F.col("agents.id") if own else F.col("agents")
    right = blocks.select(*frame, "cx", "cy", F.col("x").alias("x2"), F.col("y").alias("y2"), ids.alias("ids2"))
    near = _reach(radius, world, strict)
    pairs = cell_join(left, right, grid, frame, near, hot_rows=skew.cell_rows, crowd=celled)
    ox, oy = V.delta(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), world)
    pairs = pairs.withColumns({"ox": ox, "oy": oy}).withColumn("dist", V.norm((F.col("ox"), F.col("oy"))))
    if form:
        pairs = pairs.withColumns({c: form(F.col(c)) for c in ("ox", "oy", "dist")})
    both = [*frame, "x", "y", "x2", "y2", "ox", "oy", "dist", "ids2"]
    agent = F.explode("agents").alias("a")
    mine = [F.col(f"a.{c}").alias(c) for c in ("id", *own)] if own else [F.col("a").alias("id")]
    return pairs.select(*both, agent).select(*both, *mine)


def _told(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each agent of ``ids2``, but for the agent itself."""
    out = [*columns, "x2", "y2", "ox", "oy", "dist"]
    rows = pairs.select(*out, F.explode("ids2").alias("id2")).where("id <> id2")
    return rows.select(*columns, "id2", "x2", "y2", "ox", "oy", "dist")


def neighbours(
    points: DataFrame,
    radius: float,
    world: World,
    frame: Sequence[str] = ("time",),
    *,
    strict: bool = False,
    skew: Skew | None = Skew(),
    form: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Ordered pairs (id, id2) within the radius, with the offset (ox, oy) and dist.

    The pairs of a frame grow with the square of its agents, but they are only written out: what is shuffled,
    sorted and compared are occupied positions. ``form`` is applied to ox, oy and dist, once per pair of positions.
    """
    return _told(_spot_pairs(points, radius, world, frame, strict, skew, form), points.columns)


def closest(pairs: DataFrame, k: int, frame: Sequence[str]) -> DataFrame:
    """The k closest of each agent's placed pairs, ties by id, with their rank."""
    order = Window.partitionBy(*frame, *PLACE, "id").orderBy("dist", "id2")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).drop(*PLACE)


def occupied(celled: DataFrame, frame: Sequence[str], *sums: str) -> DataFrame:
    """One row per occupied position: agents there and the sums of their columns.

    Agents at one spot have the same distances, so they are merged before the
    join; a spot that holds most of a frame becomes a single row.
    """
    return celled.groupBy(*frame, "cx", "cy", F.col("x").alias("x2"), F.col("y").alias("y2")).agg(
        F.count(F.lit(1)).alias("n2"), *[F.sum(c).alias(f"{c}2") for c in sums]
    )


def neighbour_counts(
    points: DataFrame,
    radius: float,
    world: World,
    frame: Sequence[str] = ("time",),
    *,
    strict: bool = False,
    skew: Skew | None = Skew(),
) -> DataFrame:
    """Every agent with the number of other agents within the radius.

    Counted per occupied position against occupied positions, then handed to the
    agents standing there, so coincident agents cost one comparison.
    """
    grid = Grid.for_radius(world, radius)
    celled, skew = prepared(points, grid, skew)
    points = celled.drop("cx", "cy")
    spots = occupied(celled, frame)
    left = spots.select(
        *frame, "cx", "cy", F.col("x2").alias("x"), F.col("y2").alias("y"),
        F.xxhash64("x2", "y2").alias("id"),
    )
    near = cell_join(left, spots, grid, frame, _reach(radius, world, strict), hot_rows=skew.cell_rows)
    counted = near.groupBy(*frame, "cx", "cy", "_salt", "x", "y").agg(
        (F.sum("n2") - 1).alias("n_neighbours")
    )
    table = counted.drop("cx", "cy", "_salt")
    if skew.key_rows:
        table = cut(table)
    return skew_join(
        points.drop("n_neighbours"), table, [*frame, "x", "y"], spread_by=["id"], hot_rows=skew.key_rows
    )


def _images(spots: DataFrame, radius: float, world: World) -> DataFrame:
    """``spots`` with x2, y2, their place; on a torus also copied beyond its border, as far as the radius reaches."""
    spots = spots.withColumns({"x2": F.col("x"), "y2": F.col("y")})
    if not world.toroidal:
        return spots
    margin = radius * (1 + 1e-9)

    def along(axis: str, size: float) -> Column:
        at = F.col(axis)
        beyond = [F.when(at >= size / 2 - margin, at - size), F.when(at <= margin - size / 2, at + size)]
        return F.explode(F.array_compact(F.array(at, *beyond)))

    return spots.withColumn("x", along("x", world.width)).withColumn("y", along("y", world.height))


def closest_within(
    points: DataFrame,
    radius: float,
    k: int,
    world: World,
    frame: Sequence[str] = ("time",),
    carry: Sequence[str] = (),
    *,
    skew: Skew | None = Skew(),
) -> DataFrame:
    """``points`` with ``near``: the k closest others within the radius, ties by id; empty or null where there is none.

    An entry has dist, id2, x2, y2 and the other's columns ``carry``, named with a 2. The search is done once
    per occupied position and is as dear as ``nearest``, however many agents the radius holds. Only on a torus
    that the radius spans, where an agent may be near in two directions, are all pairs compared.
    """
    frame = list(frame)
    skew = skew or NO_SKEW
    if world.toroidal and 2 * radius * (1 + 1e-6) >= min(world.width, world.height):
        pairs = closest(placed_neighbours(points, radius, world, frame, carry, skew=skew), k, frame)
        item = F.struct("dist", "id2", "x2", "y2", *[f"{c}2" for c in carry])
        lists = pairs.groupBy(*frame, "id").agg(F.sort_array(F.collect_list(item)).alias("near"))
        return points.join(lists, [*frame, "id"], "left")
    place = {"_x": F.col("x"), "_y": F.col("y")}
    if world.toroidal:
        place = {"_x": V.wrapped(F.col("x"), world.width), "_y": V.wrapped(F.col("y"), world.height)}
    points = cut(points.withColumns(place))
    known = points.select(*frame, F.col("_x").alias("x"), F.col("_y").alias("y"), "id", *carry).dropna(
        subset=["x", "y", "id"]
    )
    bare = cut(_spots(known, frame, k, carry))
    # an entry of ids is an agent with its place
    entry = ["id", "x2", "y2", *[f"{c}2" for c in carry]]

    def placed(agent: Column) -> Column:
        own = {"id": agent["id"] if carry else agent, "x2": F.col("x2"), "y2": F.col("y2")}
        return F.struct(*[(own[c] if c in own else agent[c[:-1]]).alias(c) for c in entry])

    images = _images(bare, radius, world).withColumn("ids", F.transform("ids", placed)).drop("x2", "y2")
    square = Pyramid.over(images).deep_enough(images, frame, k + 1)
    spots = cut(_fine(images, square))
    hot_rows = skew.needed(spots.count() * square.levels).key_rows
    queries = _fine(bare.select(*frame, "x", "y"), square)
    spot = [*frame, "x", "y"]
    found = search(queries, spots, k + 1, square, frame, hot_rows)
    # a wide search also meets the other images of an agent: only one lies within the radius
    reach = F.lit(radius * (1 + 1e-9))
    found = found.where((F.abs(F.col("x2") - F.col("x")) <= reach) & (F.abs(F.col("y2") - F.col("y")) <= reach))
    found = found.select(*spot, F.explode("ids").alias("p"))
    d = V.delta(F.col("x"), F.col("y"), F.col("p.x2"), F.col("p.y2"), world)
    found = found.where(V.norm_sq(d) <= F.lit(float(radius) ** 2)).withColumn("dist", V.norm(d))
    order = Window.partitionBy(*spot).orderBy("dist", "p.id")
    best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    item = F.struct("dist", F.col("p.id").alias("id2"), *[F.col(f"p.{c}").alias(c) for c in entry[1:]])
    lists = best.groupBy(*spot).agg(F.sort_array(F.collect_list(item)).alias("near")).withColumnsRenamed({"x": "_x", "y": "_y"})
    agents = skew_join(
        points,
        cut(lists),
        [*frame, "_x", "_y"],
        spread_by=["id"],
        hot_rows=skew.needed(points.count()).key_rows,
    )
    mine = F.slice(F.filter("near", lambda p: p["id2"] != F.col("id")), 1, k)
    return agents.withColumn("near", mine).drop("_x", "_y")


def nearest_within(
    points: DataFrame, radius: float, k: int, world: World, frame: Sequence[str] = ("time",)
) -> DataFrame:
    """The k closest neighbours within the radius (the neighbour cap), ties by id, with their rank."""
    found = closest_within(points, radius, k, world, frame)
    ranked = found.select(*points.columns, F.posexplode("near").alias("pos", "p"))
    pairs = ranked.select(*points.columns, "p.id2", "p.x2", "p.y2", "p.dist", (F.col("pos") + 1).alias("rank"))
    ox, oy = V.delta(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), world)
    return pairs.withColumns({"ox": ox, "oy": oy})


def visible_neighbours(
    steps: DataFrame, radius: float, degrees: float, world: World, frame: Sequence[str] = ("time",)
) -> DataFrame:
    """Neighbour pairs where id2 lies inside the view cone of the moving agent id."""
    pairs = _spot_pairs(steps, radius, world, frame, False, Skew())
    seen = V.in_view((F.col("ox"), F.col("oy")), (F.col("dx"), F.col("dy")), degrees)
    return _told(pairs.where(seen), steps.columns)
