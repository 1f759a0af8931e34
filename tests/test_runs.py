"""Simulation, experiments, recordings and streams."""

import uuid

import pytest
from pyspark.sql import functions as F

from skein.operators import population as P
from skein.operators import rules as R
from skein.operators import stats
from skein.operators.skew import Skew
from skein.operators.tracks import preprocess
from skein.plans.experiment import run_experiment
from skein.plans.simulate import simulate
from skein.session import shared_dir
from skein.sources import recorder
from skein.sources.config import FlockConfig
from skein.sources.events import WORLD, positions, read_events, tracks
from skein.schema import EVENTS
from skein.streaming import replay

SF = "/root/testdata/sf0.001"
SMALL = FlockConfig(
    agents=20, width=100, height=100, sensory_distance=12.0, min_speed=0.5, max_speed=2.0, sample_rate=2
)


def fresh(spark, name):
    """A new folder: the shared folder outlives a test session."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def start(spark, config=SMALL, how="RandomRandom"):
    return P.start(P.new_agents(spark, config.agents), config, how)


def test_samples_are_one_based_and_complete(spark):
    samples = simulate(start(spark), SMALL, ticks=5)
    seen = {r["time"]: r["count"] for r in samples.groupBy("time").count().collect()}
    assert seen == {1: 20, 2: 20}
    speed = samples.select(F.hypot("vx", "vy").alias("v")).agg(F.min("v"), F.max("v")).first()
    assert speed[0] > 0.5 - 1e-9 and speed[1] < 2 + 1e-9
    assert samples.where("abs(x) > 50 or abs(y) > 50").count() == 0


def test_no_sample_is_an_error(spark):
    with pytest.raises(ValueError):
        simulate(start(spark), SMALL, ticks=1)


@pytest.mark.parametrize("how", P.STARTS)
def test_starts(spark, how):
    state = start(spark, how=how)
    assert state.count() == 20 and state.where("abs(x) > 50 or abs(y) > 50").count() == 0
    with pytest.raises(NotImplementedError):
        P.start(P.new_agents(spark, 1), SMALL, "TwoWalls")


def test_crowded_cells_do_not_change_a_tick(spark):
    state = start(spark).withColumn("time", F.lit(1))
    crowd = state.withColumns({"id": F.col("id") + 100, "x": F.lit(3.0), "y": F.lit(3.0)})
    both = state.unionByName(crowd)
    a, b = (R.tick(both, SMALL, 1, skew=s) for s in (Skew(), Skew(2, 2)))
    columns = [F.round(c, 9) if t == "double" else F.col(c) for c, t in sorted(a.dtypes)]
    assert sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))


def test_population_changes(spark):
    state = start(spark)
    assert P.double(state, SMALL).select("id").distinct().count() == 40
    assert P.halve(state).count() == 10
    assert P.delete_last(state).agg(F.max("id")).first()[0] == 18
    assert P.delete(state, spark.range(5)).count() == 15
    assert P.insert(state, P.start(P.new_agents(spark, 3, first_id=20), SMALL)).count() == 23
    assert P.select_at(state, 0.0, 0.0, 500.0).count() == 1
    assert P.select_at(state, 0.0, 0.0, 1e-9).count() == 0


def test_experiment_writes_its_tables(spark):
    folder = fresh(spark, "experiment-test")
    config = SMALL.overwrite(agents=8, sample_rate=1, clustering=True)
    result = run_experiment(spark, config.overwrite(iterations=4), runs=2, folder=folder, bins=8)
    assert {r["time"] for r in result.collect()} == {3, 4}
    counts = spark.read.option("header", True).csv(f"{folder}/direction_counts")
    assert counts.where("bin = 1").count() >= 2
    assert spark.read.json(f"{folder}/config").first()["agents"] == 8


def test_rewriting_a_recording_leaves_nothing_behind(spark):
    folder = fresh(spark, "rewrite-test")
    samples = tracks(spark, SF).withColumn("n_neighbours", F.lit(0).cast("long"))
    recorder.write_samples(samples, folder)
    recorder.write_samples(samples.where("time = 1"), folder)
    assert recorder.read_samples(spark, folder).count() == 15


def test_recordings_are_told_apart_by_file(spark, tmp_path):
    for name, rows in (("boids-data_1.csv", 2), ("boids-data_2.csv", 3), ("other.csv", 9)):
        lines = ["id,x,y,cluster_id,n_neighbours,time"] + [f"{i},1.5,2.5,0,0,1" for i in range(rows)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = recorder.read_recordings(spark, str(tmp_path)).groupBy("run_name").count().collect()
    assert {r["run_name"]: r["count"] for r in got} == {"boids-data_1": 2, "boids-data_2": 3}


def test_incomplete_frames_are_found(spark):
    rows = [(0, 1, 0), (0, 1, 1), (0, 2, 0), (0, 3, 0), (0, 3, 2)]
    samples = spark.createDataFrame(rows, "run_id long, time long, id long")
    got = {r["time"]: r["complete"] for r in recorder.check_samples(samples).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_playhead():
    head = replay.Playhead(first=1, last=3, at=2)
    assert [head.tick().at, head.tick().tick().at, head.back().back().at] == [3, 3, 1]
    assert head.turn().tick().at == 1 and head.pause().tick().at == 2 and head.seek(9).at == 3
    assert head.pause().play().tick().at == 3


def test_stream_in_several_batches_equals_one(spark):
    """Agents' state survives from one micro-batch to the next."""
    folder = fresh(spark, "stream-input")
    events = read_events(spark, SF)
    for k in range(4):
        part = events.where(F.col("event_id").between(k * 250, k * 250 + 249))
        part.coalesce(1).write.mode("append").parquet(folder)
    source = replay.stream_recordings(spark, folder, EVENTS, maxFilesPerTrigger=1, latestFirst=False)
    got = replay.run_to_table(replay.stream_steps(positions(source), WORLD), spark, "stream-test")
    want = preprocess(tracks(spark, SF), WORLD)
    columns = ["run_id", "id", "time", "x", "y", "dx", "dy"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_repeated_agents_are_no_complete_frame(spark):
    rows = [(0, 1, 1), (0, 1, 2), (0, 1, 3), (0, 2, 1), (0, 2, 1), (0, 2, 3), (0, 3, 3), (0, 3, 2), (0, 3, 1)]
    samples = spark.createDataFrame(rows, "run_id long, time long, id long")
    got = {r["time"]: r["complete"] for r in recorder.check_samples(samples).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_change_points_count_elements_not_times(spark):
    from skein.operators import stats

    values = [1.0, 1.1, 0.9, 5.0, 5.1, 4.9, 5.0]
    gains = []
    for times in (range(1, 8), (1, 2, 4, 8, 20, 21, 22)):
        rows = [(0, t, v) for t, v in zip(times, values)] + [(0, 30, None)]
        series = spark.createDataFrame(rows, "run_id long, time long, v double")
        (row,) = stats.change_points(series, "v").collect()
        gains.append(row["gain"])
        assert row["change_point"] == list(times)[2]
    assert gains[0] == gains[1]


def test_equal_angles_have_no_fit_error(spark):
    from skein.operators import stats

    rows = spark.createDataFrame([(r, 0.5) for r in (0, 0, 0)] + [(1, 0.1), (1, 0.4)], "run_id long, b double")
    fit = stats.circular_fit(rows, "b", ("run_id",))
    got = {r["run_id"]: r for r in stats.fit_error(stats.circular_density(rows, "b", 90, ("run_id",)), fit, ("run_id",)).collect()}
    assert got[0]["normal_error"] is None or got[0]["normal_error"] > 0
    assert got[1]["cauchy_error"] > 0 and fit.where("rho > 1").count() == 0


def test_stream_of_a_table_of_parts_equals_the_batch(spark, tmp_path):
    from skein.plans import queries as Q

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    batch = Q.run("preprocessed_round_trip", spark, "/root/testdata/sf0.001")
    stream = Q.run("replay_stream", spark, str(tmp_path)).select(*batch.columns)
    assert stream.count() == batch.count() and stream.exceptAll(batch).count() == 0


def test_recordings_of_a_folder(spark, tmp_path):
    """Single files and folders of part files; a prepared twin wins; files of other names are left alone."""
    raw, prepared = "id,x,y,cluster_id,n_neighbours,time", "id,x,y,dx,dy,cluster_id,n_neighbours,time"
    (tmp_path / "boids-data_7.csv").write_text(f"{raw}\n1,0.5,0.5,0,0,1\n1,2.5,0.5,0,0,2\n")
    (tmp_path / "boids-data_8.csv").write_text(f"{raw}\n1,9.5,9.5,0,0,1\n")
    (tmp_path / "prepro_boids-data_8.csv").write_text(f"{prepared}\n1,3.5,3.5,1.5,0.0,0,0,1\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    nested = tmp_path / "prepro_boids-data_9.csv"
    nested.mkdir()
    for i in (1, 2):
        (nested / f"part-{i}.csv").write_text(f"{prepared}\n{i},4.5,4.5,0.0,2.5,0,0,1\n")
    read = ["run_id", "prepared", "id", "time", "x", "dx", "dy"]
    everything = [
        (7, False, 1, 1, 0.5, 0.0, 0.0), (7, False, 1, 2, 2.5, 2.0, 0.0), (8, True, 1, 1, 3.5, 1.5, 0.0),
        (9, True, 1, 1, 4.5, 0.0, 2.5), (9, True, 2, 1, 4.5, 0.0, 2.5),
    ]
    for names, runs in ((None, (7, 8, 9)), (["boids-data_7"], (7,)), (["boids-data_8"], (8,)), ([], ())):
        got = recorder.recordings(spark, str(tmp_path), WORLD, names).select(*read).collect()
        assert sorted(map(tuple, got)) == [r for r in everything if r[0] in runs]


def test_settings_of_runs(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7), (2, 1, 0.1)], "run_id long, time long, m double")
    settings = spark.createDataFrame([(1, "calm")], "run_id long, mood string")
    got = stats.with_settings(rows, settings).select("run_id", "time", "mood").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "calm"), (1, 2, "calm"), (2, 1, None)]
