"""Angle densities, likelihood fits and decided change points against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import stats as X

SCHEMA = "g string, a double"


def angles():
    rng = np.random.default_rng(5)

    def wrap(x):
        return (np.asarray(x) + math.pi) % (2 * math.pi) - math.pi

    return {
        "normal": wrap(rng.normal(3.0, 0.9, 400)),
        "cauchy": wrap(-1 + 0.4 * rng.standard_cauchy(400)),
        "narrow": wrap(3.1 + rng.normal(0, 0.1, 300)),
        "flat": wrap(rng.uniform(-math.pi, math.pi, 300)),
        "two": wrap(np.r_[rng.normal(0, 0.5, 150), rng.normal(2.5, 0.4, 90)]),
        "few": np.array([0.1, 1.0, -2.0]),
    }


@pytest.fixture(scope="module")
def rows(spark):
    every = [(g, float(a)) for g, x in angles().items() for a in x] + [("normal", None)]
    return spark.createDataFrame(every, SCHEMA).repartition(4)


def normal_loglik(x, mu, rho):
    sd = math.sqrt(-2 * math.log(rho))
    z = (x - mu)[:, None] + 2 * math.pi * np.arange(-12, 13)
    return np.log(np.exp(-0.5 * (z / sd) ** 2).sum(1) / sd / math.sqrt(2 * math.pi)).sum()


def cauchy_loglik(x, mu, rho):
    return np.log((1 - rho * rho) / (1 + rho * rho - 2 * rho * np.cos(x - mu)) / (2 * math.pi)).sum()


def refined(loglik, x, mu, rho):
    """A plain pattern search from a start, down to steps of 1e-8."""
    best, step = loglik(x, mu, rho), 0.02
    while step > 1e-8:
        moves = [(mu + i * step, min(max(rho + j * step, 1e-6), 0.99999)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        value, m, r = max((loglik(x, *p), *p) for p in moves)
        if value > best:
            best, mu, rho = value, m, r
        else:
            step /= 2
    return mu, rho


def test_likelihood_fits(rows):
    got = {r.g: r for r in X.circular_mle(rows, "a", ["g"]).collect()}
    for g, x in angles().items():
        r = got[g]
        assert r.n == len(x)
        for loglik, mu, rho in ((normal_loglik, r.normal_mu, r.normal_rho), (cauchy_loglik, r.cauchy_mu, r.cauchy_rho)):
            at, size = refined(loglik, x, mu, rho)
            assert abs(size - rho) < 2e-6, (g, loglik)
            assert abs(math.sin(at - mu)) * size < 2e-6, (g, loglik)


def test_likelihood_fits_of_odd_groups(spark):
    odd = spark.createDataFrame([("same", 2.0)] * 5 + [("one", -1.0), ("none", None)], SCHEMA)
    got = {r.g: r for r in X.circular_mle(odd, "a", ["g"]).collect()}
    assert set(got) == {"same", "one"}
    assert got["same"].normal_rho == pytest.approx(1) and got["same"].normal_mu == pytest.approx(2)
    assert got["same"].cauchy_rho > 0.999 and got["one"].cauchy_mu == pytest.approx(-1)
    assert X.circular_mle(odd.where("1 = 0"), "a", ["g"]).collect() == []


def test_density_is_the_sum_over_all_angles(rows):
    got = {(r.g, r.bin): r for r in X.circular_density(rows, "a", 60, ["g"]).collect()}
    assert len(got) == 60 * len(angles())
    for g, x in angles().items():
        for b in range(60):
            theta = (b + 0.5) * 2 * math.pi / 60 - math.pi
            z = (x - theta)[:, None] + 2 * math.pi * np.arange(-2, 3)
            want = np.exp(-0.5 * (z / 0.1) ** 2).sum() / len(x) / (0.1 * math.sqrt(2 * math.pi))
            assert got[g, b].theta == pytest.approx(theta)
            assert abs(got[g, b].density - want) < 1e-9


def test_moments_of_parts_add_up(rows):
    parts = [X.angle_moments(rows.where(c), "a", ["g"], 5) for c in ("a < 0", "a >= 0")]
    added = parts[0].unionByName(parts[1]).groupBy("g", "k").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    whole = {(r.g, r.k): r for r in X.angle_moments(rows, "a", ["g"], 5).collect()}
    for r in added.collect():
        assert r.c == pytest.approx(whole[r.g, r.k].c) and r.n == whole[r.g, r.k].n


def test_bandwidth_from_the_data(rows):
    got = X.circular_density(rows, "a", 90, ["g"], bandwidth=None).groupBy("g").agg(F.sum("density").alias("d"))
    assert all(r.d * 2 * math.pi / 90 == pytest.approx(1, abs=1e-3) for r in got.collect())
    with pytest.raises(ValueError):
        X.circular_density(rows, "a", 90, ["g"], bandwidth=0.01)


def test_change_points_are_decided(spark):
    rng = random.Random(4)
    series = {
        "constant": [2.0] * 40,
        "noise": [rng.gauss(0, 1) for _ in range(60)],
        "step": [rng.gauss(0, 1) for _ in range(30)] + [rng.gauss(4, 1) for _ in range(30)],
        "clean": [1.0] * 10 + [2.0] * 10,
        "spread": [rng.gauss(0, 0.1) for _ in range(40)] + [rng.gauss(0, 3) for _ in range(40)],
        "short": [1.0],
        "gaps": [None, 1.0, None, 5.0],
    }
    frame = spark.createDataFrame([(k, i, v) for k, x in series.items() for i, v in enumerate(x)], "k string, i long, v double")
    mean = {r.k: r for r in X.change_decisions(frame, "v", "mean", ["k"], "i").collect()}
    var = {r.k: r for r in X.change_decisions(frame, "v", "var", ["k"], "i").collect()}
    assert set(mean) == set(series)
    assert {k for k, r in mean.items() if r.change_point is not None} == {"step", "clean", "gaps"}
    assert abs(mean["step"].change_point - 29) <= 1 and mean["clean"].change_point == 9
    assert mean["clean"].statistic == math.inf and mean["constant"].statistic == 0
    x = np.array(series["step"])
    k = mean["step"].change_point + 1
    rest = ((x[:k] - x[:k].mean()) ** 2).sum() + ((x[k:] - x[k:].mean()) ** 2).sum()
    assert mean["step"].statistic == pytest.approx(60 * math.log(((x - x.mean()) ** 2).sum() / rest))
    assert var["spread"].change_point is not None and var["constant"].change_point is None and var["noise"].change_point is None


def test_columns_become_series(spark):
    wide = spark.createDataFrame([(1, 2, 0.5), (2, None, 1.5)], "t long, x long, y double")
    got = sorted((r.series, r.t, r.value) for r in X.unpivoted(wide, "t").where("value is not null").collect())
    assert got == [("x", 1, 2.0), ("y", 1, 0.5), ("y", 2, 1.5)]
