"""Ordered operators that never put one whole agent into one task.

A window over an agent sorts all its samples in a single task, which fails when
one agent holds a large share of the table. Samples carry a dense 1-based index,
so an agent can be cut into slices of fixed length: rows near a slice edge are
copied into the neighbouring slice ("halo"), windows run per slice, and the
copies are dropped again. Running totals add the sum of earlier slices, which
comes from a small table with one row per slice. Operators that read their rows
twice write them first, so that what made the rows runs once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from skein.schema import AGENT
from skein.session import cut

SLICE = 1 << 17  # samples of one agent handled by one task
FRAMES = 1 << 10  # times of one run whose blocks are added up by one task


def _slice_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def sample_index(
    df: DataFrame, key: Sequence[str], instant: str, ties: Sequence[str], out: str = "time"
) -> DataFrame:
    """1-based position of each row within ``key`` by (``instant``, ``ties``).

    Rows are numbered inside one-hour slices; the counts of earlier slices are
    added. No task holds more than one hour of one key.
    """
    hour = F.datediff(F.to_date(instant), F.lit("1970-01-01")) * 24 + F.hour(instant)
    hourly = df.withColumn("_hour", hour)
    by_key = [*key, "_hour"]
    before = (
        hourly.groupBy(*by_key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*key).orderBy("_hour")) - F.col("_n"))
        .drop("_n")
    )
    within = Window.partitionBy(*by_key).orderBy(instant, *ties)
    return (
        hourly.withColumn("_rank", F.row_number().over(within))
        .join(before, by_key)
        .withColumn(out, (F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_hour", "_rank", "_before")
    )


def over_slices(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    key: Sequence[str] = AGENT,
    seq: str = "time",
    before: int = 0,
    after: int = 0,
    size: int | None = None,
) -> DataFrame:
    """Apply window expressions that look at most ``before``/``after`` samples away.

    ``build`` gets the sliced table and the window to use; all its windows share
    one shuffle and one sort. ``seq`` must be dense within ``key``.
    """
    size = size or SLICE
    position = F.col(seq) - 1
    first = F.greatest(_slice_of(position - after, size), F.lit(0))
    last = _slice_of(position + before, size)
    spread = df.withColumn("_home", _slice_of(position, size)).withColumn(
        "_slice", F.explode(F.sequence(first, last))
    )
    window = Window.partitionBy(*key, "_slice").orderBy(seq)
    return build(spread, window).where("_slice = _home").drop("_slice", "_home")


def running_sum(
    df: DataFrame,
    columns: dict[str, Column],
    *,
    key: Sequence[str] = AGENT,
    seq: str = "time",
    size: int | None = None,
) -> DataFrame:
    """Inclusive running sums (new name -> summed expression) along ``seq`` within ``key``."""
    size = size or SLICE
    sliced = cut(df.withColumn("_slice", _slice_of(F.col(seq) - 1, size)))
    totals = sliced.groupBy(*key, "_slice").agg(
        *[F.sum(c).alias(f"_sum_{n}") for n, c in columns.items()]
    )
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *key,
        "_slice",
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in columns],
    )
    inside = (
        Window.partitionBy(*key, "_slice").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    )
    for name, expr in columns.items():
        sliced = sliced.withColumn(f"_run_{name}", F.sum(expr).over(inside))
    joined = sliced.join(offsets, [*key, "_slice"])
    for name in columns:
        joined = joined.withColumn(name, F.col(f"_run_{name}") + F.col(f"_off_{name}"))
    return joined.drop("_slice", *[f"_{p}_{n}" for p in ("run", "off") for n in columns])


def fill_forward(
    df: DataFrame,
    column: str,
    out: str,
    *,
    key: Sequence[str] = AGENT,
    seq: str = "time",
    size: int | None = None,
) -> DataFrame:
    """Last non-NULL value of ``column`` up to and including each row."""
    size = size or SLICE
    sliced = cut(df.withColumn("_slice", _slice_of(F.col(seq) - 1, size)))
    known = F.when(F.col(column).isNotNull(), F.col(seq))
    ends = sliced.groupBy(*key, "_slice").agg(F.max_by(column, known).alias("_end"))
    earlier = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *key, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")
    )
    inside = (
        Window.partitionBy(*key, "_slice").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        sliced.withColumn("_seen", F.last(column, ignorenulls=True).over(inside))
        .join(carried, [*key, "_slice"])
        .withColumn(out, F.coalesce("_seen", "_carried"))
        .drop("_slice", "_seen", "_carried")
    )


def run_rank(
    df: DataFrame, out: str, *, descending: bool = False, id_block: int = SLICE, frames: int = FRAMES
) -> DataFrame:
    """Position of each row within its run by (time, id), and the run's row count.

    Rows are numbered per (time, block of ids). The counts of earlier blocks are added up within
    chunks of ``frames`` times and those of earlier chunks from sums of chunks, so one long run is
    spread over many tasks: a window over a run sees one row per chunk.
    """
    def order(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    def before(window: WindowSpec) -> Column:
        return F.sum("_n").over(window) - F.col("_n")

    chunk, block = _slice_of(F.col("time"), frames), _slice_of(F.col("id"), id_block)
    placed = cut(df.withColumns({"_chunk": chunk, "_block": block}))
    by_block = ["run_id", "_chunk", "time", "_block"]
    counts = cut(placed.groupBy(*by_block).agg(F.count(F.lit(1)).alias("_n")))
    chunks = counts.groupBy("run_id", "_chunk").agg(F.sum("_n").alias("_n"))
    starts = chunks.select(
        "run_id",
        "_chunk",
        before(Window.partitionBy("run_id").orderBy(order("_chunk"))).alias("_start"),
        F.sum("_n").over(Window.partitionBy("run_id")).alias(f"{out}_of"),
    )
    inside = Window.partitionBy("run_id", "_chunk").orderBy(order("time"), order("_block"))
    offsets = counts.withColumn("_before", before(inside)).join(starts, ["run_id", "_chunk"]).drop("_n")
    within = Window.partitionBy(*by_block).orderBy(order("id"))
    return (
        placed.withColumn("_rank", F.row_number().over(within))
        .join(offsets, by_block)
        .withColumn(out, (F.col("_start") + F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_chunk", "_block", "_rank", "_before", "_start")
    )
