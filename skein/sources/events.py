"""Position samples derived from the ``events`` table.

Every user is an agent; its events in time order are its samples. Position
comes from the JSON counter and the value, on a 100 x 100 world.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.ordered import sample_index
from skein.schema import EVENTS, World

WORLD = World(100, 100)
RUNS = 5

# Cluster of each event type; 0 is noise.
CLUSTERS = {"error": 0, "click": 1, "purchase": 2, "signup": 3, "view": 4}


def cluster_of(event_type: Column) -> Column:
    chain = F
    for name, label in CLUSTERS.items():
        chain = chain.when(event_type == name, F.lit(label))
    return chain.otherwise(F.lit(4)).cast("long")


def positions(events: DataFrame) -> DataFrame:
    """Event rows as agent positions, batch or streaming."""
    return events.select(
        F.pmod(F.col("user_id"), F.lit(RUNS)).cast("long").alias("run_id"),
        F.col("user_id").alias("id"),
        "ts",
        "event_id",
        (F.get_json_object("props", "$.k").cast("double") - 50).alias("x"),
        (F.pmod(F.floor("value"), F.lit(100)).cast("double") - 50).alias("y"),
        cluster_of(F.col("event_type")).alias("cluster_id"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, id, time, x, y, cluster_id; time is dense and starts at 1 for each agent."""
    placed = positions(read_events(spark, sf_dir))
    return sample_index(placed, ["run_id", "id"], "ts", ["event_id"]).select(
        "run_id", "id", "time", "x", "y", "cluster_id"
    )


def point_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as one frame of points, spread by their first two components."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.lit(0).cast("long").alias("time"),
        F.col("vec_id").cast("long").alias("id"),
        (F.col("embedding")[0].cast("double") * 100).alias("x"),
        (F.col("embedding")[1].cast("double") * 100).alias("y"),
        F.col("label").cast("long").alias("cluster_id"),
    )
