"""An experiment: many runs measured in one pass, then statistics over the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import histograms, stats
from skein.operators.hull import mean_flock_area
from skein.operators.population import start
from skein.operators.tracks import directional, timeline_facets
from skein.plans.simulate import simulate
from skein.schema import World
from skein.sources import recorder
from skein.sources.config import FlockConfig

METRICS = ["average_norm_vel", "average_norm_vel2", "no_flocks", "convex_hull"]


def run_metrics(rows: DataFrame) -> DataFrame:
    """The order parameters, flock count and mean flock area of every (run_id, time).

    ``rows`` are directional. Velocities and flocks share one aggregation; noise
    counts for velocities only. Frames without flocks have NULL flock measures.
    """

    def length(x: str, y: str):
        return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))

    sums = rows.groupBy("run_id", "time").agg(
        F.sum("dx").alias("sx"),
        F.sum("dy").alias("sy"),
        F.sum(F.abs("dx")).alias("ax"),
        F.sum(F.abs("dy")).alias("ay"),
        F.sum(length("dx", "dy")).alias("path"),
        F.countDistinct(F.when(F.col("cluster_id") != 0, F.col("cluster_id"))).alias("flocks"),
    )
    velocity = sums.select(
        "run_id",
        "time",
        F.try_divide(length("sx", "sy"), length("ax", "ay")).alias("average_norm_vel"),
        F.try_divide(length("sx", "sy"), F.col("path")).alias("average_norm_vel2"),
        F.when(F.col("flocks") > 0, F.col("flocks")).alias("no_flocks"),
    )
    areas = mean_flock_area(rows, ("run_id", "time")).withColumnRenamed(
        "average_cluster_volumes", "convex_hull"
    )
    return velocity.join(areas, ["run_id", "time"], "left")


def experiment_stats(rows: DataFrame, sample_rate: int = 1) -> DataFrame:
    """Mean and variance over runs of every metric, per time in ticks."""
    return stats.across_runs(run_metrics(rows), METRICS).withColumn(
        "t", F.col("time") * sample_rate
    )


def run_experiment(
    spark: SparkSession, config: FlockConfig, runs: int, folder: str, facets: int = 6, bins: int = 360
) -> DataFrame:
    """Simulates ``runs`` runs, stores samples, statistics and direction counts, returns the statistics."""
    agents = spark.range(runs * config.agents).select(
        F.floor(F.col("id") / config.agents).alias("run_id"), F.col("id")
    )
    samples = simulate(start(agents, config), config)
    recorder.write_samples(samples, f"{folder}/samples")
    recorder.write_config(spark, config, f"{folder}/config")
    world = World(config.width, config.height)
    recorder.write_preprocessed(recorder.read_samples(spark, f"{folder}/samples"), world, f"{folder}/preprocessed")
    rows = directional(recorder.read_preprocessed(spark, f"{folder}/preprocessed").drop("dx", "dy"), world)
    results = experiment_stats(rows, config.sample_rate)
    recorder.write_stats(results, f"{folder}/results_stats")
    counts = histograms.directional_counts(
        timeline_facets(rows, facets), bins, by=("timeline_facet", "run_id")
    )
    recorder.write_stats(counts, f"{folder}/direction_counts")
    return spark.read.schema(results.schema).option("header", True).csv(f"{folder}/results_stats")
