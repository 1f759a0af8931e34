"""Simulation runs: ticks as DataFrame jobs, samples as a table.

All runs advance together; the frame of the neighbour join is the run. A state is
written after every tick, so a plan never spans more than one tick and a lost
executor repeats one tick at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.cluster import dbscan
from skein.operators.rules import tick
from skein.operators.skew import Skew
from skein.session import cut, shared_dir
from skein.sources.config import FlockConfig


def simulate(
    start: DataFrame,
    config: FlockConfig,
    ticks: int | None = None,
    frame: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Samples (frame, time, id, x, y, vx, vy, n_neighbours, cluster_id) of a run.

    Time k is the state after tick k * sample_rate; the start is not sampled.
    Clusters do not act on the motion, so only sampled states are clustered.
    """
    ticks = config.iterations if ticks is None else ticks
    spark = start.sparkSession
    path = f"{shared_dir(spark)}/samples-{uuid.uuid4().hex}"
    state = cut(start)
    # agents neither appear nor leave during a run, so the start tells whether skew is possible
    skew = None if state.count() <= Skew.cell_rows else Skew()
    columns = [*frame, "id", "x", "y", "vx", "vy", "n_neighbours"]
    empty = True
    for number in range(1, ticks + 1):
        state = cut(tick(state, config, number, frame, skew=skew))
        if number % config.sample_rate:
            continue
        sample = state.select(*columns)
        if config.clustering:
            sample = dbscan(sample, config.sensory_distance, 3, config.world, frame)
        else:
            sample = sample.withColumn("cluster_id", F.lit(0).cast("long"))
        # one folder per sample: writing it again gives the same table
        sample.write.mode("overwrite").parquet(f"{path}/time={number // config.sample_rate}")
        empty = False
    if empty:
        raise ValueError("no tick is sampled: ticks is below sample_rate")
    samples = spark.read.parquet(path)
    return samples.withColumn("time", F.col("time").cast("long"))
