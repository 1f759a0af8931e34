"""Hand-checked values for the small building blocks."""

import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skein.functions import angles, vectors as V
from skein.operators import metrics as M
from skein.operators import tracks as K
from skein.operators.cluster import components
from skein.operators.spatial import Grid, neighbours
from skein.schema import World
from skein.sources import config as C
from skein.sources import recorder


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(*values):
    return [F.lit(float(v)) for v in values]


def test_wrapped_vector(spark):
    world = World(70, 70)
    there = V.delta(*lit(30, -30, -30, 30), world)
    back = V.delta(*lit(-30, 30, 30, -30), world)
    assert [value(spark, c) for c in (*there, *back)] == [10, -10, -10, 10]


def test_step_of_half_the_world_stays(spark):
    assert value(spark, V.wrap_delta(F.lit(0.0), F.lit(50.0), 100)) == 50
    assert value(spark, V.wrap_delta(F.lit(50.0), F.lit(0.0), 100)) == -50


@pytest.mark.parametrize(
    "a,b,expected",
    [((3, 2), (0, 0), 3.606), ((3, 2), (-3, 3), 2.236), ((3, 2), (-3, -3.5), 3.202), ((-3, 3), (-3, -3.5), 1.5)],
)
def test_wrapped_distance(spark, a, b, expected):
    assert value(spark, V.distance(*lit(*a, *b), World(8, 8))) == pytest.approx(expected, abs=1e-3)


def test_zero_vectors_stay_zero(spark):
    assert [value(spark, c) for c in V.normalize(tuple(lit(0, 0)))] == [0, 0]
    assert value(spark, V.wedge(tuple(lit(0, 0)), tuple(lit(1, 0)))) is None


def test_lengths(spark):
    assert [value(spark, c) for c in V.limit_length(tuple(lit(6, 8)), 5)] == [3, 4]
    assert [value(spark, c) for c in V.ensure_length(tuple(lit(0.3, 0.4)), 1, 5)] == pytest.approx([0.6, 0.8])
    assert [value(spark, c) for c in V.rotate(tuple(lit(3, 4)), tuple(lit(0, 1)))] == [-4, 3]


def test_nearest_image_and_crossing(spark):
    world = World(100, 100)
    assert [value(spark, c) for c in V.nearest_image(*lit(49, 0, -49, 0), world)] == [-51, 0]
    assert value(spark, V.crosses_boundary(*lit(49, 0, -49, 0), world))
    assert not value(spark, V.crosses_boundary(*lit(4, 0, -4, 0), world))


@pytest.mark.parametrize("x,y,expected", [(300, 300, 15), (400, 400, 15), (-400, -400, 0)])
def test_cell_index(spark, x, y, expected):
    grid = Grid(World(800, 800), 4, 4)
    assert value(spark, grid.table_index(F.lit(float(x)), F.lit(float(y)))) == expected


def test_table_index_of_positions_outside(spark):
    grid = Grid(World(800, 400), 8, 2)
    cases = {(-1000, -1000): 0, (1000, -1000): 7, (-1000, 1000): 8, (1000, 1000): 15, (-1, -1): 3, (0, 0): 12}
    assert {p: value(spark, grid.table_index(*lit(*p))) for p in cases} == cases


@pytest.mark.parametrize("toroidal", [True, False])
def test_a_pair_at_one_radius_across_the_edge_is_found(spark, toroidal):
    world = World(800, 800, toroidal=toroidal)
    rows = spark.createDataFrame([(1, 1, 395.0, 0.0), (1, 2, 405.0, 0.0), (1, 3, 400.0, 100.0)], "time long, id long, x double, y double")
    near = neighbours(rows, 10.0, world).select("id", "id2").collect()
    assert sorted(tuple(r) for r in near) == [(1, 2), (2, 1)]


def test_zero_radius_is_rejected():
    with pytest.raises(ValueError):
        Grid.for_radius(World(), 0)


def test_odd_world_loses_one_unit():
    assert (World(101, 7).left, World(101, 7).right, World(101, 7).top) == (-50, 50, 3)


def walk(spark, points):
    rows = [(0, 0, i + 1, float(x), float(y), 1) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "run_id long, id long, time long, x double, y double, cluster_id long")


def test_headings_and_bearings(spark):
    path = walk(spark, zip((0, 2, 3, 5, 6), (0, 2, 5, 6, 3)))
    world = World(100, 100)
    heads = [math.degrees(r["headings"]) for r in K.heading_rows(path, world).orderBy("time").collect()]
    assert heads == pytest.approx([225, 198.43495, 243.43495, 341.56505], abs=1e-4)
    turns = [math.degrees(r["bearings"]) for r in K.directional(path, world).orderBy("time").collect()]
    assert turns == pytest.approx([26.56505, -45, -98.13010], abs=1e-4)


def test_order_parameter_by_hand(spark):
    rows = [(1, 1, float(a), float(b)) for a, b in ((1, 1), (2, -2), (-3, -3), (-4, 4))]
    steps = spark.createDataFrame(rows, "time long, cluster_id long, dx double, dy double")
    got = M.avg_norm_vel(steps).first()["avg_norm_vel"]
    assert got == pytest.approx(0.282843, abs=1e-6)


def test_two_groups_of_points(spark):
    spots = [(1, 1), (2, 2), (3, 3), (18, 6), (19, 5), (20, 6)]
    rows = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(spots)]
    df = spark.createDataFrame(rows, "time long, id long, x double, y double")
    got = {r["id"]: r["component"] for r in components(df, 2, World(60, 60, toroidal=False)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_curvature_of_a_circle_then_a_line(spark):
    turn = 2 * math.asin(0.8 / 4)
    points = [(2 * math.cos(turn * i), 2 * math.sin(turn * i)) for i in range(11)]
    for _ in range(20):
        points.append((points[-1][0] + 0.5, points[-1][1] + 0.5))
    rows = K.curvature(walk(spark, points), World(100, 100), tau=2, max_speed=1.0).orderBy("time").collect()
    assert all(r["turn_tau"] == pytest.approx(math.sin(turn)) for r in rows if r["time"] <= 9)
    assert all(r["turn_tau"] == pytest.approx(0, abs=1e-9) for r in rows if r["time"] >= 13)


def test_angle_bins_are_closed_above(spark):
    quarter = math.pi / 2
    bins = [value(spark, angles.angle_bin(F.lit(a), 0.0, 4)) for a in (0.0, quarter, quarter + 0.01, 4 * quarter)]
    assert bins == [None, 1, 2, 4]


def test_recording_names():
    stamp = datetime(2022, 11, 9, 23, 54, 19, 490000, tzinfo=timezone.utc)
    assert recorder.file_name(stamp) == "boids-data_1668038059490.csv"
    assert recorder.file_name() == "boids-data.csv"


def test_boundary_json(spark):
    text = '{"type":"Repulsive","distance":100,"force":0.05}'
    parsed = value(spark, C.parse_boundary(F.lit(text)))
    assert (parsed["type"], parsed["distance"], parsed["force"]) == ("Repulsive", 100, 0.05)
    config = C.FlockConfig().with_boundary_json(text)
    assert (config.boundary, config.boundary_distance, config.distance) == ("Repulsive", 100, "EucEnclosed")
    assert C.FlockConfig().with_boundary_json('{"type":"Toroidal"}').distance == "EucToroidal"
    assert C.FlockConfig().with_boundary_json().boundary == "Reflective"
    with pytest.raises(NotImplementedError):
        C.FlockConfig().with_boundary_json('{"type":"RepulsiveCircle","radius":3}')


def test_configuration_file_and_command_line(tmp_path):
    path = tmp_path / "flock.toml"
    path.write_text("no_boids = 12\nsensory_distance = 45.0\nmin_speed = 2\nrules_impl = true\n")
    config = C.load_toml(str(path), max_speed=3.5)
    assert (config.agents, config.sensory_distance, config.max_speed) == (12, 45.0, 3.5)
    assert config.clustering and not config.cohesion_yields and config.wander_radius == 11.5
    given = C.from_command_line(["-c", str(path), "--min_speed", "1.5", "--no-agent_steering"])
    assert (given.agents, given.min_speed, given.cohesion_yields) == (12, 1.5, True)


def test_parameter_grid(spark):
    grid = C.parameter_grid(spark, density=[1.0, 2.0, 3.0], reach=[10, 20]).collect()
    assert sorted(r["config_id"] for r in grid) == list(range(6))
    assert C.noise_levels(spark).count() == 31


def test_falloffs(spark):
    assert value(spark, V.soft_falloff(F.lit(1.0))) == 0
    assert value(spark, V.sigmoid_falloff(F.lit(0.6))) == 0.5
