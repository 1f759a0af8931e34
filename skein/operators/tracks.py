"""Ordered operators over agent tracks (run_id, id, time, x, y, cluster_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skein.functions import angles, vectors as V
from skein.operators.ordered import fill_forward, over_slices, running_sum, run_rank
from skein.schema import World


def with_displacement(df: DataFrame, w: WindowSpec, world: World) -> DataFrame:
    """Adds dx, dy: the step from the agent's previous sample, NULL at its first."""
    px, py = F.lag("x").over(w), F.lag("y").over(w)
    dx, dy = V.delta(px, py, F.col("x"), F.col("y"), world)
    return df.withColumns({"dx": dx, "dy": dy})


def with_directions(df: DataFrame, w: WindowSpec, world: World) -> DataFrame:
    """Adds dx, dy, headings and bearings (NULL in the agent's first one or two samples)."""
    stepped = with_displacement(df, w, world)
    headed = stepped.withColumn("headings", angles.heading(F.col("dx"), F.col("dy")))
    return headed.withColumn(
        "bearings", angles.bearing(F.lag("headings").over(w), F.col("headings"))
    )


def displacement(tracks: DataFrame, world: World, size: int | None = None) -> DataFrame:
    """All samples with dx, dy; the first sample of each agent has NULL."""
    return over_slices(tracks, lambda d, w: with_displacement(d, w, world), before=1, size=size)


def preprocess(tracks: DataFrame, world: World, size: int | None = None) -> DataFrame:
    """Samples with displacements, 0 at the first sample of each agent."""
    return displacement(tracks, world, size).fillna(0.0, ["dx", "dy"])


def directional(tracks: DataFrame, world: World, size: int | None = None) -> DataFrame:
    """Steps, headings and bearings from the third sample of each agent on."""
    return over_slices(
        tracks, lambda d, w: with_directions(d, w, world), before=2, size=size
    ).where(F.col("bearings").isNotNull())


def heading_rows(tracks: DataFrame, world: World, size: int | None = None) -> DataFrame:
    """Steps and headings from the second sample of each agent on."""
    return (
        displacement(tracks, world, size)
        .where(F.col("dx").isNotNull())
        .withColumn("headings", angles.heading(F.col("dx"), F.col("dy")))
    )


def moving_averages(
    tracks: DataFrame, world: World, tau: int, size: int | None = None
) -> DataFrame:
    """Directional rows with right-aligned full-window means of bearing and heading.

    The mean is NULL until tau directional samples exist.
    """

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = with_directions(d, w, world)
        # heading exists one sample earlier than bearing; only directional rows count
        d = d.withColumn("headings", F.when(F.col("bearings").isNotNull(), F.col("headings")))
        span = w.rowsBetween(-(tau - 1), 0)
        full = F.count("bearings").over(span) == tau
        return d.withColumns(
            {
                "bearing_ma": F.when(full, F.avg("bearings").over(span)),
                "heading_ma": F.when(full, F.avg("headings").over(span)),
            }
        )

    return over_slices(tracks, build, before=tau + 1, size=size).where(
        F.col("bearings").isNotNull()
    )


def curvature(
    tracks: DataFrame, world: World, tau: int, max_speed: float, size: int | None = None
) -> DataFrame:
    """Left-aligned mean turn of each directional sample over the next tau steps.

    Rows without tau following turns, or with a turn that has no direction, are dropped.
    """

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = with_directions(d, w, world)
        ahead = (F.lead("dx").over(w), F.lead("dy").over(w))
        d = d.withColumn("turn", V.wedge((F.col("dx"), F.col("dy")), ahead))
        span = w.rowsBetween(0, tau - 1)
        total = F.sum(F.col("turn") / F.lit(float(max_speed) ** 2)).over(span) / F.lit(tau)
        return d.withColumn("turn_tau", F.when(F.count("turn").over(span) == tau, total))

    return over_slices(tracks, build, before=2, after=tau, size=size).where(
        F.col("bearings").isNotNull() & F.col("turn_tau").isNotNull()
    )


def boundary_rows(tracks: DataFrame, margin: float, world: World) -> DataFrame:
    return tracks.where(V.near_edge(F.col("x"), F.col("y"), margin, world))


def flag_boundary_dependent(
    tracks: DataFrame, margin: float, world: World, reach: int, size: int | None = None
) -> DataFrame:
    """Adds ``affected``: the sample or one of the ``reach`` samples before it is near an edge."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        edge = V.near_edge(F.col("x"), F.col("y"), margin, world).cast("int")
        d = d.withColumn("_edge", edge)
        hit = F.max("_edge").over(w.rowsBetween(-reach, 0)) == 1
        return d.withColumn("affected", hit).drop("_edge")

    return over_slices(tracks, build, before=reach, size=size)


def remove_boundary_dependent(
    tracks: DataFrame, margin: float, world: World, reach: int = 2, size: int | None = None
) -> DataFrame:
    flagged = flag_boundary_dependent(tracks, margin, world, reach, size)
    return flagged.where(~F.col("affected")).drop("affected")


def segments(tracks: DataFrame, world: World, size: int | None = None) -> DataFrame:
    """Number of edge crossings so far: rows of one segment draw as one unbroken line."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        over = V.crosses_boundary(
            F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"), world
        )
        return d.withColumn("breaking", F.coalesce(over, F.lit(False)))

    crossed = over_slices(tracks, build, before=1, size=size)
    return running_sum(
        crossed, {"segment": F.col("breaking").cast("long")}, size=size
    ).withColumn("segment", F.col("segment").cast("long"))


def last_crossing(tracks: DataFrame, world: World, size: int | None = None) -> DataFrame:
    """Adds the time of each agent's latest edge crossing, carried forward."""
    cut = segments(tracks, world, size)
    marked = cut.withColumn("crossed_at", F.when(F.col("breaking"), F.col("time")))
    return fill_forward(marked, "crossed_at", "last_crossing", size=size)


def cumulative_path(directions: DataFrame, size: int | None = None) -> DataFrame:
    """Path of unit steps along the bearings of each agent."""
    return running_sum(
        directions,
        {"path_x": F.cos("bearings"), "path_y": F.sin("bearings")},
        size=size,
    )


def trails(tracks: DataFrame, length: int = 4, size: int | None = None) -> DataFrame:
    """Each sample with the positions of the ``length`` samples before it and its own."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        spot = F.struct("x", "y")
        return d.withColumn("trail", F.collect_list(spot).over(w.rowsBetween(-length, 0)))

    return over_slices(tracks, build, before=length, size=size)


def subsample(tracks: DataFrame, start: int = 1, every: int = 1) -> DataFrame:
    """Every n-th row of each run in (time, id) order, from row ``start`` on."""
    if start > every:
        raise ValueError("start must not exceed every")
    ranked = run_rank(tracks, "row")
    return ranked.where(F.pmod(F.col("row") - start, F.lit(every)) == 0).drop("row_of")


def time_page(tracks: DataFrame, time: int) -> DataFrame:
    return tracks.where(F.col("time") == time)


def time_range(tracks: DataFrame, start: int, stop: int) -> DataFrame:
    return tracks.where((F.col("time") >= start) & (F.col("time") < stop))


def timeline_facets(rows: DataFrame, sections: int) -> DataFrame:
    """Cuts each run into sections of equal row count; section 1 is the latest part."""
    ranked = run_rank(rows, "_row", descending=True)
    step = F.ceil(F.col("_row_of") / F.lit(sections))
    return ranked.withColumn(
        "timeline_facet", F.ceil(F.col("_row") / step).cast("long")
    ).drop("_row", "_row_of")


def time_bins(rows: DataFrame, width: int, bins: int | None = None) -> DataFrame:
    """Rows with the first time of their bin; with ``bins``, only those before the last bin's end."""
    bin_start = F.floor((F.col("time") - 1) / F.lit(width)) * width + 1
    shown = rows if bins is None else rows.where(F.col("time") < bins * width)
    return shown.withColumn("time_bin", bin_start.cast("long"))


def sampled(ticks: DataFrame, rate: int) -> DataFrame:
    """Every ``rate``-th tick as samples; time k is the state after tick k * rate."""
    return (
        ticks.where(F.pmod(F.col("tick"), F.lit(rate)) == 0)
        .withColumn("time", F.floor(F.col("tick") / F.lit(rate)).cast("long"))
        .drop("tick")
    )
