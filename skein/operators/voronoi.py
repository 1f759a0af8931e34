"""Voronoi cells of every frame, relaxed, without one task seeing a crowded frame.

Frames of at most HELD sites are taken whole by a task, with all their relaxations (``rings``). The cells
of larger ones are cut from joins over all tasks, as are those of ``cells`` and ``moved_cells``:

A site's cell starts as the world clipped by the bisectors towards its nearest
sites. It is final when all further sites are more than twice as far as its
farthest corner. Otherwise its corners are checked: a corner closer to another
site than to its own shows a bisector that is missing. Clipping and checking
repeat until no corner is closer to another site, which is exact.

Relaxed sites start from the neighbours they had before. Cells that are clipped by
some sites hold the exact ones, so their areas add up to the world only if all are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import rings
from skein.operators.nearest import Pyramid, _fine, nearest, search
from skein.operators.skew import Skew, skew_join
from skein.schema import World
from skein.session import cut

FIRST = 16  # nearest sites that clip a cell before its corners are checked
AT_ONCE = 8  # sites a corner may add to its cell in one check
HUB = 32  # neighbours of a site whose list others don't take over after a move
HELD = 1 << 16  # sites of a frame that one task takes whole
AT_A_TIME = 1 << 12  # sites, about, whose cells a task computes together
RELAXATIONS = 5  # fixed value: Lloyd relaxations before areas are taken
_RING = "array<struct<x:double,y:double>>"
# A corner that also knows the site beyond the edge that starts there; none beyond the world's border.
_LABELLED = "array<struct<x:double,y:double,nx:double,ny:double>>"


def _clip(ring: Column, x: Column, y: Column, qx: Column, qy: Column, kind: str) -> Column:
    """The part of a convex ring that is closer to (x, y) than to (qx, qy)."""

    def beyond_edge(a: Column, new: Column) -> list[Column]:
        """What a corner of a labelled ring says about its edge: a new one, or that of ``a``."""
        if kind != _LABELLED:
            return []
        return [F.when(new, q).otherwise(a[c]).alias(c) for c, q in (("nx", qx), ("ny", qy))]

    def beyond(p: Column) -> Column:
        return (p["x"] - (x + qx) / 2) * (qx - x) + (p["y"] - (y + qy) / 2) * (qy - y)

    def edge(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % F.size(ring) + 1)
        fa, fb = beyond(a), beyond(b)
        t = F.try_divide(fa, fa - fb)
        crossing = F.struct(
            (a["x"] + (b["x"] - a["x"]) * t).alias("x"),
            (a["y"] + (b["y"] - a["y"]) * t).alias("y"),
            *beyond_edge(a, fa < 0),
        )
        none = F.array().cast(kind)
        corner = F.struct(a["x"].alias("x"), a["y"].alias("y"), *beyond_edge(a, (fa == 0) & (fb > 0)))
        return F.concat(
            F.when(fa <= 0, F.array(corner if kind == _LABELLED else a)).otherwise(none),
            F.when(fa * fb < 0, F.array(crossing)).otherwise(none),
        )

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(ring)), edge)).cast(kind)


def _clip_all(df: DataFrame, others: str, kind: str) -> DataFrame:
    """Clips column ``ring`` of a site by the bisectors towards every (x, y) in ``others``."""
    x, y = F.col("x"), F.col("y")
    clipped = F.aggregate(
        others, F.col("ring"), lambda ring, q: _clip(ring, x, y, q["x"], q["y"], kind)
    )
    return df.withColumn("ring", clipped)


def _along(ring: Column, term) -> Column:
    """Sum of term(a, b) over the edges of a ring."""

    def step(total: Column, i: Column) -> Column:
        return total + term(F.element_at(ring, i), F.element_at(ring, i % F.size(ring) + 1))

    return F.aggregate(F.sequence(F.lit(1), F.size(ring)), F.lit(0.0), step)


def _cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def _farthest_sq(ring: Column, x: Column, y: Column) -> Column:
    far = F.transform(
        ring, lambda p: (p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)
    )
    return F.array_max(far)


def _key(frame: Sequence[str]) -> list[str]:
    return [*frame, "id"]


def _box(world: World, kind: str) -> Column:
    w, h = world.width / 2, world.height / 2
    border = [F.lit(None).alias(c) for c in ("nx", "ny") if kind == _LABELLED]
    corners = ((-w, -h), (w, -h), (w, h), (-w, h))
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), *border) for x, y in corners]).cast(kind)


def cells(
    sites: DataFrame,
    world: World,
    frame: Sequence[str] = ("time",),
    *,
    skew: Skew = Skew(),
    labelled: bool = False,
) -> DataFrame:
    """(frame, id, x, y, ring): the exact Voronoi cell of every site within the world.

    ``sites`` are at distinct positions inside the world. Corners of ``labelled`` rings carry the
    position (nx, ny) of the site on the other side of the edge that starts there.
    """
    kind = _LABELLED if labelled else _RING
    frame = list(frame)
    key = _key(frame)
    near = nearest(sites, FIRST, world, frame, skew=skew)
    lists = near.groupBy(*key).agg(
        F.sort_array(
            F.collect_list(F.struct("dist", F.col("x2").alias("x"), F.col("y2").alias("y")))
        ).alias("others")
    )
    first = sites.select(*key, "x", "y").join(lists, key, "left").withColumn("ring", _box(world, kind))
    # a site alone in its frame keeps the whole world
    others = F.coalesce("others", F.array().cast("array<struct<dist:double,x:double,y:double>>"))
    first = _clip_all(first.withColumn("others", others), "others", kind)
    far = _farthest_sq(F.col("ring"), F.col("x"), F.col("y"))
    known = F.size("others")
    settled = (known < FIRST) | (
        F.element_at("others", -1)["dist"] * F.element_at("others", -1)["dist"] >= 4 * far
    )
    first = cut(
        first.withColumn("done", F.when(known == 0, True).otherwise(settled)).select(
            *key, "x", "y", "ring", "done"
        )
    )
    return _checked(first, sites, world, frame, kind, skew)


def _checked(first: DataFrame, sites: DataFrame, world: World, frame: list[str], kind: str, skew: Skew) -> DataFrame:
    """Exact cells from rings that hold them: corners are checked until none is closer to another site.

    ``first`` (frame, id, x, y, ring, done) is written; ``done`` cells are known to be exact. A corner adds the
    AT_ONCE closest of the sites that beat its own; a clip that changes nothing ends a cell, so rounding can't keep
    it open.
    """
    key = _key(frame)
    done = first.where("done").drop("done")
    open_cells = first.where("not done").drop("done")
    if open_cells.isEmpty():
        return done
    extent = float(max(world.width, world.height))
    square = Pyramid(-extent / 2, -extent / 2, extent)
    spots = cut(
        _fine(sites.select(*frame, "x", "y", F.array("id").alias("ids"), F.lit(1).alias("n")), square)
    )
    hot_rows = skew.needed(spots.count()).key_rows
    spot = [*frame, "x", "y"]
    closest = Window.partitionBy(*spot).orderBy("d2", "x2", "y2")
    while not open_cells.isEmpty():
        corners = open_cells.select(
            *key, F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode("ring").alias("p")
        ).select(*key, "sx", "sy", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
        asked = _fine(corners.select(*spot).distinct(), square)
        best = (
            search(asked, spots, 1, square, frame, hot_rows)
            .withColumn("_r", F.row_number().over(closest))
            .where(F.col("_r") <= AT_ONCE)
            .groupBy(*spot)
            .agg(F.collect_list(F.struct("d2", F.col("x2").alias("x"), F.col("y2").alias("y"))).alias("b"))
        )
        own = (F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2
        closer = F.filter("b", lambda q: q["d2"] < own * (1 - 1e-9) - 1e-12)
        missing = (
            corners.join(best, spot)
            .withColumn("q", F.explode(closer))
            .groupBy(*key)
            .agg(F.collect_set(F.struct("q.x", "q.y")).alias("m"))
        )
        checked = open_cells.withColumn("was", F.col("ring")).join(missing, key, "left")
        some = F.coalesce("m", F.array().cast(_RING))
        checked = _clip_all(checked.withColumn("m", some), "m", kind)
        checked = cut(checked.withColumn("whole", F.col("ring") == F.col("was")).drop("m", "was"))
        done = done.unionByName(checked.where("whole").drop("whole"))
        open_cells = checked.where("not whole").drop("whole")
    return done


def moved_cells(
    before: DataFrame,
    sites: DataFrame,
    world: World,
    frame: Sequence[str] = ("time",),
    *,
    skew: Skew = Skew(),
) -> DataFrame:
    """Labelled cells of ``sites`` that were at the places of ``before`` (labelled cells, written) and have moved.

    A cell is clipped by its old neighbours and theirs, at their new places; no search is made for that. Such cells hold
    the exact ones, so a frame whose areas add up to the world has nothing but exact cells. Corners are checked
    in the other frames only. The neighbours of a site with over HUB of them are not handed on: they
    would be handed to each other.
    """
    frame = list(frame)
    key = _key(frame)
    places = before.select(*key, F.col("x").alias("nx"), F.col("y").alias("ny")).join(
        sites.select(*key, "x", "y"), key
    )
    edges = before.select(*key, F.explode("ring").alias("p")).select(*key, "p.nx", "p.ny").where("nx IS NOT NULL")
    pairs = cut(
        edges.distinct()
        .join(places.withColumnRenamed("id", "id2"), [*frame, "nx", "ny"])
        .select(*key, "id2", "x", "y")
    )
    lists = cut(pairs.groupBy(*key).agg(F.collect_list(F.struct(F.col("id2").alias("id"), "x", "y")).alias("one")))
    theirs = lists.where(F.size("one") <= HUB).select(*frame, F.col("id").alias("id2"), F.col("one").alias("two"))
    two = (
        pairs.select(*key, "id2").join(theirs, [*frame, "id2"])
        .groupBy(*key)
        .agg(F.flatten(F.collect_list("two")).alias("two"))
    )
    none = F.array().cast("array<struct<id:long,x:double,y:double>>")
    around = F.array_distinct(F.concat(F.coalesce("one", none), F.coalesce("two", none)))
    x, y = F.col("x"), F.col("y")
    by_distance = F.sort_array(
        F.transform(
            F.filter(around, lambda q: q["id"] != F.col("id")),
            lambda q: F.struct(
                ((q["x"] - x) * (q["x"] - x) + (q["y"] - y) * (q["y"] - y)).alias("d2"),
                q["x"].alias("x"),
                q["y"].alias("y"),
            ),
        )
    )
    first = (
        sites.select(*key, "x", "y")
        .join(lists, key, "left")
        .join(two, key, "left")
        .withColumns({"others": by_distance, "ring": _box(world, _LABELLED)})
    )
    first = _clip_all(first, "others", _LABELLED)
    first = cut(first.select(*key, "x", "y", "ring", (F.abs(_along(F.col("ring"), _cross)) / 2).alias("area")))
    whole = world.width * world.height
    exact = first.groupBy(*frame).agg((F.sum("area") <= F.lit(whole * (1 + 1e-11))).alias("done"))
    marked = skew_join(
        first.drop("area"), cut(exact), frame, spread_by=["id"], hot_rows=skew.needed(first.count()).key_rows
    )
    return _checked(cut(marked), sites, world, frame, _LABELLED, skew)


def _relaxed_apart(
    sites: DataFrame, world: World, frame: list[str], relaxations: int, skew: Skew
) -> DataFrame:
    """(frame, id, area) of frames of any size, a few jobs a relaxation."""
    ring = F.col("ring")
    twice = _along(ring, _cross)
    found = cells(sites, world, frame, skew=skew, labelled=relaxations > 0)
    for _ in range(relaxations):
        found = cut(found)
        centres = found.withColumns(
            {
                "twice": twice,
                "mx": _along(ring, lambda a, b: (a["x"] + b["x"]) * _cross(a, b)),
                "my": _along(ring, lambda a, b: (a["y"] + b["y"]) * _cross(a, b)),
            }
        )
        sites = cut(
            centres.select(
                *frame,
                "id",
                F.coalesce(F.try_divide("mx", F.col("twice") * 3), "x").alias("x"),
                F.coalesce(F.try_divide("my", F.col("twice") * 3), "y").alias("y"),
            )
        )
        found = moved_cells(found, sites, world, frame, skew=skew)
    return found.select(*frame, "id", (F.abs(twice) / 2).alias("area"))


def _frame_starts(table: pa.Table, frame: Sequence[str]) -> np.ndarray:
    """Where the frames of a table start that is sorted by them."""
    new = np.arange(table.num_rows) == 0
    for c in frame:
        codes = pc.fill_null(table[c].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_frames(batches: Iterator[pa.RecordBatch], frame: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about AT_A_TIME rows that end where a frame does, and where their frames start."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows < AT_A_TIME:
            continue
        starts = _frame_starts(rest, frame)
        # frames end about every AT_A_TIME rows; the last one may go on
        ends = starts[np.searchsorted(starts, np.arange(AT_A_TIME, starts[-1] + AT_A_TIME, AT_A_TIME).clip(max=starts[-1]))]
        done = 0
        for end in np.unique(ends[ends > 0]):
            yield rest.slice(done, end - done), starts[(starts >= done) & (starts < end)] - done
            done = end
        rest = rest.slice(done)
    if rest is not None and rest.num_rows:
        yield rest, _frame_starts(rest, frame)


def _held_areas(world: World, frame: list[str], relaxations: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_frames(batches, frame):
            x, y = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in "xy")
            frames = np.append(starts, table.num_rows)
            areas = rings.relaxed_areas(frames, x, y, world.width, world.height, relaxations)
            yield from table.drop(["x", "y"]).append_column("area", pa.array(areas)).to_batches()

    return task


def relaxed_areas(
    points: DataFrame,
    world: World,
    frame: Sequence[str] = ("time",),
    relaxations: int = RELAXATIONS,
    *,
    skew: Skew = Skew(),
) -> DataFrame:
    """(frame, id, area) of cells after moving each site to its cell's centre some times.

    Agents on one spot are one site, named by its smallest agent. The area is null where a place is missing.
    """
    frame = list(frame)
    sites = cut(points.groupBy(*frame, "x", "y").agg(F.min("id").alias("id")).select(*_key(frame), "x", "y"))
    nowhere = F.col("x").isNull() | F.col("y").isNull()
    missing = sites.where(nowhere).select(*_key(frame), F.lit(None).cast("double").alias("area"))
    held = sites.where(~nowhere)
    n, apart = held.count(), None
    if n > HELD:
        sizes = cut(held.groupBy(*frame).agg((F.count(F.lit(1)) > HELD).alias("crowded")))
        if not sizes.where("crowded").isEmpty():
            hot_rows = skew.needed(n).key_rows
            marked = cut(skew_join(held, sizes, frame, spread_by=["id"], hot_rows=hot_rows))
            crowded = marked.where("crowded").drop("crowded")
            apart = _relaxed_apart(crowded, world, frame, relaxations, skew)
            held = marked.where("NOT coalesce(crowded, false)").drop("crowded")
    schema = held.select(*_key(frame), F.lit(0.0).alias("area")).schema
    dealt = held.repartition(max(1, math.ceil(n / AT_A_TIME)), *frame).sortWithinPartitions(*frame)
    found = dealt.mapInArrow(_held_areas(world, frame, relaxations), schema).unionByName(missing)
    return found if apart is None else found.unionByName(apart)


def occupancy(
    points: DataFrame, radius: float, world: World, frame: Sequence[str] = ("time",), **options
) -> DataFrame:
    """(frame, voronoi_counts): cells smaller than the disc of the radius, per agent."""
    limit = math.pi * radius * radius
    small = (
        relaxed_areas(points, world, frame, **options)
        .groupBy(*frame)
        .agg(F.count_if(F.col("area") < limit).alias("small"))
    )
    agents = points.groupBy(*frame).agg(F.count(F.lit(1)).alias("agents"))
    return small.join(agents, [*frame]).select(
        *frame, (F.col("small") / F.col("agents")).alias("voronoi_counts")
    )
