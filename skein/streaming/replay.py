"""Replaying recorded samples: a playhead over a table, and steps over a stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.ordered import over_slices
from skein.operators.tracks import with_displacement
from skein.schema import World
from skein.session import shared_dir


def moving_samples(samples: DataFrame, world: World, rescale: float = 1.0) -> DataFrame:
    """Samples with the velocity towards them, and the trail of the four before."""

    def build(d, w):
        d = with_displacement(d, w, world)
        spot = F.struct("x", "y")
        return d.withColumns(
            {
                "vx": F.coalesce(F.col("dx"), F.lit(0.0)) * rescale,
                "vy": F.coalesce(F.col("dy"), F.lit(0.0)) * rescale,
                "trail": F.collect_list(spot).over(w.rowsBetween(-4, -1)),
            }
        ).drop("dx", "dy")

    return over_slices(samples, build, before=4)


@dataclass(frozen=True)
class Playhead:
    """Where a replay stands; signals return a new one. Frames are filters on the table."""

    first: int
    last: int
    at: int
    step: int = 1
    playing: bool = True

    @classmethod
    def over(cls, samples: DataFrame, at: int) -> "Playhead":
        """A playhead between the first and the last time of the samples."""
        first, last = samples.agg(F.min("time"), F.max("time")).first()
        return cls(first or 0, last or 0, at).seek(at)

    def tick(self) -> "Playhead":
        return self.seek(self.at + self.step) if self.playing else self

    def seek(self, time: int) -> "Playhead":
        return replace(self, at=max(self.first, min(self.last, time)))

    def forward(self) -> "Playhead":
        return self.seek(self.at + 1)

    def back(self) -> "Playhead":
        return self.seek(self.at - 1)

    def turn(self) -> "Playhead":
        return replace(self, step=-self.step)

    def pause(self) -> "Playhead":
        return replace(self, playing=False)

    def play(self) -> "Playhead":
        return replace(self, playing=True)

    def frame(self, samples: DataFrame) -> DataFrame:
        return samples.where(F.col("time") == self.at)

    def window(self, samples: DataFrame, before: int = 4) -> DataFrame:
        return samples.where(F.col("time").between(self.at - before, self.at))


STEP_SCHEMA = "run_id long, id long, event_id long, time long, x double, y double, dx double, dy double"


def stream_steps(positions: DataFrame, world: World) -> DataFrame:
    """Running steps of each agent over a stream of (run_id, id, ts, event_id, x, y).

    The state of an agent is its last position and sample count. Samples of one
    micro-batch are ordered by (ts, event_id); the trigger's limit on files or
    bytes bounds how many one agent can have there.
    """
    sizes = (world.width, world.height) if world.toroidal else (None, None)

    def shortest(d: np.ndarray, size: int | None) -> np.ndarray:
        if size is None:
            return d
        return np.where(np.abs(d) > size / 2, d + np.where(d < 0, size, -size), d)

    def follow(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        rows = pd.concat(chunks).sort_values(["ts", "event_id"])
        last_x, last_y, seen = state.get if state.exists else (np.nan, np.nan, 0)
        xs, ys = rows["x"].to_numpy(), rows["y"].to_numpy()
        out = pd.DataFrame(
            {
                "run_id": key[0],
                "id": key[1],
                "event_id": rows["event_id"].to_numpy(),
                "time": seen + 1 + np.arange(len(rows)),
                "x": xs,
                "y": ys,
                "dx": shortest(np.diff(xs, prepend=last_x), sizes[0]),
                "dy": shortest(np.diff(ys, prepend=last_y), sizes[1]),
            }
        )
        if not seen:
            out.loc[0, ["dx", "dy"]] = 0.0  # the first sample has no step
        state.update((float(xs[-1]), float(ys[-1]), int(seen + len(rows))))
        yield out

    return positions.groupBy("run_id", "id").applyInPandasWithState(
        follow,
        STEP_SCHEMA,
        "x double, y double, seen long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def run_to_table(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Processes everything available and returns the written table."""
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def stream_recordings(spark: SparkSession, table: str, schema, **options) -> DataFrame:
    """A Parquet table of sample files as a stream, some files per trigger.

    A table that is one file is read as the only file of that name in its folder.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    status = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path)
    if status.isFile():
        options = {"pathGlobFilter": path.getName(), **options}
        table = table.rstrip("/").rpartition("/")[0]
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(table)
