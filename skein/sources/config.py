"""Flocking parameters: defaults, TOML files, overrides, command line, tagged JSON."""

from __future__ import annotations

import argparse
import json
import tomllib
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.schema import BOUNDARY_JSON, DISTANCE_JSON, World

# Boundary, distance and noise names as configuration files spell them.
BOUNDARIES = ("Toroidal", "Absorbing", "Reflective", "Repulsive")
DISTANCES = ("EucToroidal", "EucEnclosed")
NOISE_MODELS = ("Reynolds", "Vicsek")

# Names of configuration keys and the parameter they set.
KEYS = {
    "no_boids": "agents",
    "sample_rate": "sample_rate",
    "init_width": "width",
    "init_height": "height",
    "sensory_distance": "sensory_distance",
    "alignment_coefficient": "alignment_coef",
    "cohesion_coefficient": "cohesion_coef",
    "separation_coefficient": "separation_coef",
    "alignment_treshold_coefficient": "alignment_trs_coef",
    "cohesion_treshold_coefficient": "cohesion_trs_coef",
    "separation_treshold_coefficient": "separation_trs_coef",
    "min_speed": "min_speed",
    "max_speed": "max_speed",
    "max_steering": "max_steering",
    "agent_steering": "agent_steering",
    "field_of_vision": "field_of_vision",
    "dbscan_flock_clustering_on": "clustering",
    "rules_impl": "cohesion_yields",
    "wander_on": "wander_on",
    "wander_rate": "wander_rate",
    "wander_radius": "wander_radius",
    "wander_distance": "wander_distance",
    "wander_coefficient": "wander_coef",
    "baseline_speed": "baseline_speed",
    "save_path": "save_path",
    "save_timestamp": "save_timestamp",
    "save": "save",
}

# Command-line defaults where they differ from the kernel's.
COMMAND_LINE = {
    "agents": 1024,
    "sample_rate": 64,
    "width": 800,
    "height": 800,
    "sensory_distance": 35.0,
    "alignment_coef": 0.2,
    "cohesion_coef": 0.06,
    "separation_coef": 0.3,
    "alignment_trs_coef": 1.0,
    "cohesion_trs_coef": 0.8,
    "separation_trs_coef": 0.3,
    "min_speed": 2.1,
    "max_speed": 2.1,
    "max_steering": 0.65,
    "agent_steering": False,
    "field_of_vision": 280.0,
    "clustering": True,
    "wander_rate": 0.4,
    "wander_radius": 11.5,
    "wander_distance": 13.0,
    "wander_coef": 1.0,
}


@dataclass(frozen=True)
class FlockConfig:
    """One set of flocking parameters. The defaults are fixed values of the model."""

    agents: int = 256
    width: int = 600
    height: int = 600
    baseline_speed: float = 1.0
    min_speed: float = 0.65
    max_speed: float = 4.1
    max_steering: float = 0.7
    alignment_coef: float = 0.02
    cohesion_coef: float = 0.002
    separation_coef: float = 4.1
    sensory_distance: float = 60.0
    alignment_trs_coef: float = 1.15
    cohesion_trs_coef: float = 0.95
    separation_trs_coef: float = 0.35
    field_of_vision: float = 181.0
    agent_steering: bool = True
    cohesion_yields: bool = False  # cohesion acts only where separation does not
    wander_on: bool = False
    wander_rate: float = 0.03
    wander_radius: float = 5.2
    wander_distance: float = 21.5
    wander_coef: float = 0.4
    noise_model: str = "Reynolds"
    boundary: str = "Toroidal"
    boundary_distance: float = 100.0
    boundary_force: float = 0.05
    distance: str = "EucToroidal"
    neighbours_considered: int = 0  # 0 is no cap
    stop_movement: bool = False
    seek_x: float | None = None
    seek_y: float | None = None
    sample_rate: int = 1
    clustering: bool = False
    iterations: int = 8
    seed: int = 42
    save: bool = False
    save_path: str = "./"
    save_timestamp: bool = True

    def __post_init__(self):
        if self.boundary not in BOUNDARIES:
            raise NotImplementedError(f"boundary {self.boundary}")
        if self.distance not in DISTANCES or self.noise_model not in NOISE_MODELS:
            raise ValueError(f"unknown distance or noise model: {self.distance}, {self.noise_model}")

    @property
    def world(self) -> World:
        return World(self.width, self.height, self.distance == "EucToroidal")

    @property
    def reach(self) -> float:
        """How far any enabled or disabled rule looks."""
        return self.sensory_distance * max(
            self.alignment_trs_coef, self.cohesion_trs_coef, self.separation_trs_coef
        )

    def overwrite(self, **values) -> "FlockConfig":
        """Values given win; None and unknown names are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in values.items() if k in known and v is not None})

    def with_boundary_json(self, boundary: str = "", distance: str = "") -> "FlockConfig":
        """Applies tagged JSON; absent means reflecting walls, and wrapped distances
        exactly when the boundary wraps."""
        b = json.loads(boundary) if boundary else {"type": "Reflective"}
        wraps = b["type"] == "Toroidal"
        d = json.loads(distance) if distance else {"type": DISTANCES[0 if wraps else 1]}
        return self.overwrite(
            boundary=b["type"],
            boundary_distance=b.get("distance"),
            boundary_force=b.get("force"),
            distance=d["type"],
        )

    def to_frame(self, spark: SparkSession) -> DataFrame:
        values = {k: v for k, v in asdict(self).items() if v is not None}
        return spark.createDataFrame([tuple(values.values())], list(values))


def from_mapping(values: dict, base: FlockConfig | None = None) -> FlockConfig:
    named = {KEYS.get(k, k): v for k, v in values.items()}
    return (base or FlockConfig()).overwrite(**named)


def load_toml(path: str, **overwrite) -> FlockConfig:
    """An experiment's parameters: the file, with clustering on, wrapped space, and overrides."""
    with open(path, "rb") as file:
        config = from_mapping(tomllib.load(file), FlockConfig(**COMMAND_LINE))
    return config.overwrite(clustering=True, cohesion_yields=False).overwrite(**overwrite)


def from_command_line(argv: list[str]) -> FlockConfig:
    """Parameters from ``--config FILE`` with single values on top."""
    parser = argparse.ArgumentParser(prog="skein")
    parser.add_argument("-c", "--config")
    for key, name in KEYS.items():
        kind = {f.name: f.type for f in fields(FlockConfig)}[name]
        if kind == "bool":
            parser.add_argument(f"--{key}", dest=name, action=argparse.BooleanOptionalAction)
        else:
            parser.add_argument(f"--{key}", dest=name, type={"int": int, "str": str}.get(kind, float))
    given = vars(parser.parse_args(argv))
    path = given.pop("config")
    base = FlockConfig(**COMMAND_LINE)
    if path:
        with open(path, "rb") as file:
            base = from_mapping(tomllib.load(file), base)
    return base.overwrite(**given)


def parse_boundary(column: Column) -> Column:
    """Tagged boundary JSON as a struct."""
    return F.from_json(column, BOUNDARY_JSON)


def parse_distance(column: Column) -> Column:
    return F.from_json(column, DISTANCE_JSON)


def parameter_grid(spark: SparkSession, **axes) -> DataFrame:
    """All combinations of the given parameter values, numbered from 0."""
    names = list(axes)
    df = spark.range(1).select()
    for name in names:
        values = F.array(*[F.lit(v) for v in axes[name]])
        df = df.select("*", F.explode(values).alias(name))
    index, stride = F.lit(0), 1
    for name in reversed(names):
        place = F.array_position(F.array(*[F.lit(v) for v in axes[name]]), F.col(name)) - 1
        index, stride = index + place * stride, stride * len(axes[name])
    return df.withColumn("config_id", index.cast("long"))


def noise_levels(spark: SparkSession) -> DataFrame:
    """The noise axis of a sweep: 0.00 to 0.30 in steps of 0.01."""
    return spark.range(31).select((F.col("id") / 100).alias("noise"))
