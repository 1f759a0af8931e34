"""Schemas and the world geometry shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# One agent of one simulation run; every ordered operator works within it.
AGENT = ("run_id", "id")

# Position samples as the recorder writes them (CSV header order).
SAMPLES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("cluster_id", T.LongType()),
        T.StructField("n_neighbours", T.LongType()),
        T.StructField("time", T.LongType()),
    ]
)

# Samples with displacements, the preprocessed form.
PREPROCESSED = T.StructType(
    SAMPLES.fields[:3]
    + [T.StructField("dx", T.DoubleType()), T.StructField("dy", T.DoubleType())]
    + SAMPLES.fields[3:]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

BOUNDARY_JSON = "type string, distance double, force double, radius double"
DISTANCE_JSON = "type string"


@dataclass(frozen=True)
class World:
    """Origin-centred rectangle; odd sizes lose one unit, as edges are whole numbers."""

    width: int = 100
    height: int = 100
    toroidal: bool = True  # distances wrap around the edges

    @property
    def left(self) -> int:
        return -(self.width // 2)

    @property
    def right(self) -> int:
        return self.width // 2

    @property
    def bottom(self) -> int:
        return -(self.height // 2)

    @property
    def top(self) -> int:
        return self.height // 2

    def enclosed(self) -> "World":
        return World(self.width, self.height, toroidal=False)
