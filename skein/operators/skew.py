"""Joins against a keyed table when a few keys hold most of the rows.

The hot keys come from one pre-aggregated pass and are limited to HOT_LIMIT
rows, so their part of the table can be broadcast whatever the data size. All
other rows take the shuffled join; hot rows are spread over keys that match
nothing there, so no task receives a whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_LIMIT = 10_000  # hot keys treated apart: the bound on every broadcast here
SPREAD = 1 << 20


@dataclass(frozen=True)
class Skew:
    """When a key counts as hot; 0 switches the handling off."""

    cell_rows: int = 20_000  # agents of one grid cell: their pairs are compared in one task
    key_rows: int = 500_000  # rows of one key of a plain lookup

    def needed(self, rows: int) -> "Skew":
        """Switches off what ``rows`` rows in all cannot reach."""
        return Skew(
            self.cell_rows if rows > self.cell_rows else 0,
            self.key_rows if rows > self.key_rows else 0,
        )


NO_SKEW = Skew(0, 0)


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """The most frequent keys with their row counts ``_n``, at most HOT_LIMIT of them."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .orderBy(F.desc("_n"))
        .limit(HOT_LIMIT)
    )


def spread_rows(rows: DataFrame, hot_values: DataFrame, keys: Sequence[str], spread: Column) -> DataFrame:
    """``rows`` with their hot values and the number by which hot ones are dealt out."""
    return rows.join(hot_values, list(keys), "left").withColumn("_spread", spread.cast("int"))


def skew_join(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    *,
    spread_by: Sequence[str],
    how: str = "left",
    hot_rows: int = Skew.key_rows,
) -> DataFrame:
    """Adds the columns of ``table`` (at most one row per key) to ``rows``.

    ``table`` is read twice: write an expensive one first. Pass ``hot_rows=0``
    where the caller knows that no key can be hot.
    """
    keys = list(keys)
    if not hot_rows:
        return rows.join(table, keys, how)
    values = [c for c in table.columns if c not in keys]
    pack = F.struct(*[F.col(c) for c in values] or [F.lit(1).alias("_one")])
    hot = hot_keys(rows, keys, hot_rows).drop("_n")
    known = table.join(F.broadcast(hot), keys).select(*keys, pack.alias("_hot"))
    # every hot key is spread, also one that the table lacks
    hot_values = F.broadcast(hot.join(F.broadcast(known), keys, "left").withColumn("_is_hot", F.lit(True)))
    spread = F.when(F.col("_is_hot").isNull(), 0).otherwise(
        1 + F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD))
    )
    marked = spread_rows(rows, hot_values, keys, spread)
    joined = marked.join(
        table.select(*keys, pack.alias("_cold"), F.lit(0).alias("_spread")), [*keys, "_spread"], "left"
    ).withColumn("_value", F.coalesce("_hot", "_cold"))
    if how == "inner":
        joined = joined.where(F.col("_value").isNotNull())
    return joined.select(*rows.columns, *[F.col(f"_value.{c}").alias(c) for c in values])
