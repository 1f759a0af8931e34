"""Order parameters and flock measures per time step.

Every metric takes rows and the grouping columns (("time",) for one flock,
("run_id", "time") for many runs) and aggregates with map-side combine, so a
frame that holds most of the table is summed before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import skew_join
from skein.session import cut

FRAME = ("time",)


def without_noise(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("cluster_id") != 0)


def _length(x, y):
    return F.sqrt(x * x + y * y)


def avg_norm_vel(
    steps: DataFrame, by: Sequence[str] = FRAME, filter_noise: bool = True
) -> DataFrame:
    """Length of the summed steps over count times length of the mean absolute step."""
    rows = without_noise(steps) if filter_noise else steps
    sums = rows.groupBy(*by).agg(
        F.sum("dx").alias("sx"),
        F.sum("dy").alias("sy"),
        F.sum(F.abs("dx")).alias("ax"),
        F.sum(F.abs("dy")).alias("ay"),
    )
    # count * |mean absolute step| equals |summed absolute step|
    ratio = F.try_divide(_length(F.col("sx"), F.col("sy")), _length(F.col("ax"), F.col("ay")))
    return sums.select(*by, ratio.alias("avg_norm_vel"))


def avg_norm_vel2(
    steps: DataFrame, by: Sequence[str] = FRAME, filter_noise: bool = True
) -> DataFrame:
    """Length of the summed steps over the summed step lengths, in [0, 1]."""
    rows = without_noise(steps) if filter_noise else steps
    sums = rows.groupBy(*by).agg(
        F.sum("dx").alias("sx"),
        F.sum("dy").alias("sy"),
        F.sum(_length(F.col("dx"), F.col("dy"))).alias("base"),
    )
    ratio = F.try_divide(_length(F.col("sx"), F.col("sy")), F.col("base"))
    return sums.select(*by, ratio.alias("avg_norm_vel"))


def no_flocks(rows: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    """Clusters per frame; frames with noise only do not appear."""
    return without_noise(rows).groupBy(*by).agg(F.countDistinct("cluster_id").alias("no_flocks"))


def first_time_at_most(rows: DataFrame, limits: Sequence[int]) -> DataFrame:
    """First time with at most n flocks, for each n; frames of noise only count 0 flocks."""
    flocks = rows.groupBy("time").agg(
        F.countDistinct(F.when(F.col("cluster_id") != 0, F.col("cluster_id"))).alias("n")
    )
    wanted = F.explode(F.array(*[F.lit(n).cast("long") for n in limits])).alias("flock_limit")
    return (
        flocks.select("time", "n", wanted)
        .where("n <= flock_limit")
        .groupBy("flock_limit")
        .agg(F.min("time").alias("first_time"))
    )


def curvature_order(curved: DataFrame, by: Sequence[str] = FRAME) -> DataFrame:
    return curved.groupBy(*by).agg(F.avg("turn_tau").alias("rop"))


def mean_or_missing(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Group means where a group with any missing value has no mean and is dropped."""
    return (
        rows.groupBy(*by)
        .agg(F.avg(value).alias(value), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_all"))
        .where("_n = _all")
        .drop("_n", "_all")
    )


def zscores(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Standardises columns within a group, from aggregated moments instead of a wide window."""
    rows = cut(rows)  # read for the moments, the crowded groups and the result
    moments = rows.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns],
    )
    joined = skew_join(rows, cut(moments), by, spread_by=["id", "time"])
    for c in columns:
        gap = F.col(c) - F.col(f"_m_{c}")
        joined = joined.withColumn(c, F.try_divide(gap, f"_s_{c}"))
    return joined.drop(*[f"_{p}_{c}" for p in "ms" for c in columns])


def min_max(rows: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Rescales a per-frame measure to [0, 1] within a group."""
    ends = rows.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return (
        rows.join(ends, [*by])
        .withColumn(column, F.try_divide(F.col(column) - F.col("_lo"), span))
        .drop("_lo", "_hi")
    )


def world_extent(rows: DataFrame) -> DataFrame:
    """Whole-number size of the positive quadrant, agents and frames seen."""
    return rows.agg(
        F.ceil(F.greatest(F.lit(0.0), F.max("x"))).cast("long").alias("extent_x"),
        F.ceil(F.greatest(F.lit(0.0), F.max("y"))).cast("long").alias("extent_y"),
        F.countDistinct("id").alias("agents"),
        F.max("time").alias("last_time"),
        F.min("time").alias("first_time"),
    )
