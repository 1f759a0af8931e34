"""Circular histograms of headings and bearings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import angles
from skein.session import cut


def directional_counts(rows: DataFrame, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Heading and bearing counts per bin, zero-filled within every group present.

    Both angles are counted in one pass: each row is folded into (bin, heading
    or bearing) pairs, and the pairs are summed before the shuffle.
    """
    marks = F.explode(
        F.array(
            F.struct(
                angles.angle_bin(F.col("headings"), 0.0, bins).alias("bin"),
                F.lit(1).alias("h"),
                F.lit(0).alias("b"),
            ),
            F.struct(
                angles.angle_bin(F.col("bearings"), -math.pi, bins).alias("bin"),
                F.lit(0).alias("h"),
                F.lit(1).alias("b"),
            ),
        )
    ).alias("m")
    # a row whose angle falls in no bin still makes its group present
    counted = cut(
        rows.select(*by, marks)
        .groupBy(*by, F.col("m.bin").alias("bin"))
        .agg(F.sum("m.h").alias("heading_count"), F.sum("m.b").alias("bearing_count"))
    )
    if by:
        numbers = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long")))
        grid = counted.select(*by).distinct().select(*by, numbers.alias("bin"))
    else:
        grid = rows.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return grid.join(counted, [*by, "bin"], "left").select(
        *by,
        "bin",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("heading_count", "bearing_count")],
    )


def degree_counts(rows: DataFrame) -> DataFrame:
    """Rows per whole degree of heading, rounded down and rounded to nearest."""
    both = F.explode(
        F.array(
            F.struct(F.lit("floor").alias("kind"), angles.degree_bin(F.col("headings")).alias("degree")),
            F.struct(F.lit("round").alias("kind"), angles.rounded_degree(F.col("headings")).alias("degree")),
        )
    ).alias("m")
    return rows.select(both).groupBy("m.kind", "m.degree").agg(F.count(F.lit(1)).alias("n"))
