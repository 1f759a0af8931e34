"""Cutting agents into slices must not change any result."""

import pytest
from pyspark.sql import functions as F

from skein.operators import histograms, metrics
from skein.operators import ordered as O
from skein.operators import tracks as K
from skein.plans import queries
from skein.session import cut
from skein.sources.events import WORLD, tracks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    return tracks(spark, SF).cache()


def rows(df):
    names = sorted(df.columns)
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.select(names).dtypes]
    return sorted(map(tuple, df.select(*rounded).collect()), key=repr)


@pytest.mark.parametrize("size", [1, 3, 7])
@pytest.mark.parametrize(
    "build",
    [
        lambda d, s: K.displacement(d, WORLD, s),
        lambda d, s: K.directional(d, WORLD, s),
        lambda d, s: K.moving_averages(d, WORLD, 5, s),
        lambda d, s: K.curvature(d, WORLD, 5, 2.0, s),
        lambda d, s: K.flag_boundary_dependent(d, 7.0, WORLD, 2, s),
        lambda d, s: K.last_crossing(d, WORLD, s),
        lambda d, s: K.cumulative_path(K.directional(d, WORLD), s).drop("headings", "bearings"),
        lambda d, s: K.trails(d, 4, s).withColumn("trail", F.col("trail").cast("string")),
    ],
    ids=["displacement", "directional", "averages", "curvature", "boundary", "crossing", "path", "trails"],
)
def test_slices_equal_whole_agents(samples, build, size):
    assert rows(build(samples, size)) == rows(build(samples, None))


@pytest.mark.parametrize("descending", [False, True])
def test_rank_by_blocks(samples, descending):
    whole = O.run_rank(samples, "row", descending=descending)
    assert rows(O.run_rank(samples, "row", descending=descending, id_block=2, frames=3)) == rows(whole)


@pytest.mark.parametrize(
    "name",
    ["timeline_facets", "facet_direction_counts", "subsample_tracks", "zscore_ma", "cumulative_path", "track_segments"],
)
def test_events_are_read_twice_at_most(spark, monkeypatch, name):
    """Once for the counts of hours and once for the rows, over all jobs of the query."""
    scans = []

    def scanned(df):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("events.parquet"))

    def counting(df):
        scanned(df)
        return cut(df)

    for module in (O, metrics, histograms):
        monkeypatch.setattr(module, "cut", counting)
    scanned(queries.run(name, spark, SF))
    assert 0 < sum(scans) <= 2


def test_sample_index_is_dense(samples):
    per_agent = samples.groupBy("id").agg(F.count("*").alias("n"), F.max("time").alias("last"), F.countDistinct("time").alias("d"))
    assert per_agent.where("n <> last or n <> d").count() == 0


def test_invariants(samples):
    rows = K.directional(samples, WORLD)
    low_high = rows.agg(F.min("headings"), F.max("headings"), F.min("bearings"), F.max("bearings")).first()
    assert 0 <= low_high[0] and low_high[1] < 6.283186 and -3.1415927 <= low_high[2] and low_high[3] < 3.1415927
