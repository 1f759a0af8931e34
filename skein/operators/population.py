"""Starting, adding and removing agents. States are as in ``rules``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators.rules import noise
from skein.operators.skew import skew_join
from skein.session import cut
from skein.sources.config import FlockConfig

# Ways to place a new flock.
STARTS = ("RandomRandom", "CircleCircumferenceIn")


def start(agents: DataFrame, config: FlockConfig, how: str = "RandomRandom") -> DataFrame:
    """First state of the given agents (id and any frame columns)."""
    if how not in STARTS:
        raise NotImplementedError(f"start {how}")

    def u(salt: int):
        return noise(F.col("id"), 0, salt, config.seed)

    if how == "RandomRandom":
        x, y = (u(11) - 0.5) * config.width, (u(12) - 0.5) * config.height
        placed = agents.withColumns(
            {
                "x": x,
                "y": y,
                "_vx": (u(13) * 2 - 1) * config.max_speed,
                "_vy": (u(14) * 2 - 1) * config.max_speed,
            }
        )
        v = V.ensure_length((F.col("_vx"), F.col("_vy")), config.min_speed, config.max_speed)
    else:
        # the drawn number up to 360 is used as an angle in radians
        angle, r = u(13) * 360.0, config.height / 2.0
        placed = agents.withColumns(
            {
                "_cx": F.cos(angle) * r,
                "_cy": F.sin(angle) * r,
                "_out": u(12) / 3 + 2 / 3,
                "_speed": (u(11) / 3 + 0.5) * 0.5,
            }
        )
        inward = (-F.col("_cx"), -F.col("_cy"))
        slow = V.rescale(inward, 1.0)
        far = V.norm(inward) > F.col("_speed")
        v = tuple(F.when(far, slow[i] * F.col("_speed")).otherwise(inward[i]) for i in (0, 1))
        placed = placed.withColumns(
            {"x": F.col("_cx") * F.col("_out"), "y": F.col("_cy") * F.col("_out")}
        )
    zero = F.lit(0.0)
    return placed.select(
        *agents.columns, "x", "y", v[0].alias("vx"), v[1].alias("vy"),
        zero.alias("ax"), zero.alias("ay"), zero.alias("wander"),
    )


def new_agents(spark, count: int, first_id: int = 0, run_id: int = 0) -> DataFrame:
    """(run_id, id) of ``count`` agents with consecutive ids."""
    return spark.range(first_id, first_id + count).select(
        F.lit(run_id).cast("long").alias("run_id"), "id"
    )


def insert(state: DataFrame, more: DataFrame) -> DataFrame:
    return state.unionByName(more, allowMissingColumns=True)


def delete(state: DataFrame, ids: DataFrame) -> DataFrame:
    """Removes the agents whose id is listed (frame columns of the list apply too)."""
    return state.join(ids, ids.columns, "left_anti")


def _last_ids(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """The highest id of each run, written: a skew join reads it more than once."""
    return cut(state.groupBy(*by).agg(F.max("id").alias("_last")))


def delete_last(state: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Removes the agent with the highest id of each run."""
    last = _last_ids(state, by)
    return skew_join(state, last, by, spread_by=["id"]).where("id < _last").drop("_last")


def double(state: DataFrame, config: FlockConfig, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Adds one newly placed agent per agent, with ids above the highest of the run."""
    last = _last_ids(state, by)
    fresh = skew_join(state.select(*by, "id"), last, by, spread_by=["id"]).select(
        *by, (F.col("id") + F.col("_last") + 1).alias("id")
    )
    return insert(state, start(fresh, config))


def duplicate(state: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Adds a copy of every row under an id above the highest of the run."""
    copies = skew_join(state, _last_ids(state, by), by, spread_by=["id"])
    return insert(state, copies.withColumn("id", F.col("id") + F.col("_last") + 1).drop("_last"))


def halve(state: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Keeps the agents with ids up to the middle of the run's highest id."""
    last = _last_ids(state, by)
    kept = skew_join(state, last, by, spread_by=["id"])
    return kept.where("id * 2 <= _last").drop("_last")


def select_at(points: DataFrame, x: float, y: float, size: float) -> DataFrame:
    """The agent nearest to a click, if any lies within ``size``; ties by id."""
    dist = V.norm((F.col("x") - x, F.col("y") - y))
    return points.withColumn("dist", dist).where(F.col("dist") < size).orderBy("dist", "id").limit(1)
