"""Statistics over many runs, change points and circular fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.ordered import running_sum
from skein.operators.skew import skew_join
from skein.session import cut

PENALTY = 3.0  # of a change point, times log(n)
TERMS = 80  # moments of a density; a kernel of bandwidth 0.1 needs no further ones
ANGLE_BINS = 1 << 13  # of the histograms that likelihoods are computed from
NORMAL_TERMS = 24  # of the wrapped normal law, enough up to CONCENTRATED
CONCENTRATED = 0.95  # mean resultant length from which no angle wraps
TOLERANCE = 1e-9
STEPS = 8  # of an iteration between two looks at its progress
MOST = 400  # steps until an iteration without an end gives up


def across_runs(metrics: DataFrame, values: Sequence[str]) -> DataFrame:
    """Mean and sample variance per time over all runs; missing where a run lacks the time.

    ``metrics`` has one row per (run_id, time).
    """
    runs = metrics.agg(F.countDistinct("run_id")).scalar()
    counted = metrics.groupBy("time").agg(
        *[F.count(v).alias(f"_c_{v}") for v in values],
        *[F.avg(v).alias(f"_m_{v}") for v in values],
        *[F.var_samp(v).alias(f"_v_{v}") for v in values],
    ).withColumn("_runs", runs)
    cols: list[Column] = []
    for v in values:
        whole = F.col(f"_c_{v}") == F.col("_runs")
        cols.append(F.when(whole, F.col(f"_m_{v}")).alias(f"mean_{v}"))
        cols.append(F.when(whole, F.col(f"_v_{v}")).alias(f"var_{v}"))
    return counted.select("time", *cols)


def to_wide(metrics: DataFrame, value: str, times: Sequence[int] | None = None) -> DataFrame:
    """One row per run with a column t_TIME for each time."""
    labelled = metrics.withColumn("label", F.format_string("t_%d", "time"))
    labels = [f"t_{t}" for t in times] if times is not None else None
    return labelled.groupBy("run_id").pivot("label", labels).agg(F.first(value))


def to_long(wide: DataFrame, value: str) -> DataFrame:
    """The inverse of ``to_wide``: run_id, time, value; gaps stay away."""
    columns = [c for c in wide.columns if c.startswith("t_")]
    long = wide.unpivot("run_id", columns, "label", value)
    time = F.regexp_extract("label", "t_(.+)", 1).cast("long")
    return long.where(F.col(value).isNotNull()).select("run_id", time.alias("time"), value)


def sweep_summary(metrics: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean over runs of each run's mean over time, with the highest run mean."""
    per_run = metrics.groupBy(*by, "run_id").agg(F.avg(value).alias("_m"))
    return per_run.groupBy(*by).agg(
        F.avg("_m").alias(f"mean_{value}"), F.max("_m").alias(f"max_{value}"), F.count(F.lit(1)).alias("runs")
    )


def with_settings(rows: DataFrame, settings: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows with the settings of their configuration; rows of an unknown one keep missing settings.

    ``settings`` has one row per ``key``. Keys that hold many rows take a lookup of their own.
    """
    return skew_join(rows, settings, [key], spread_by=[c for c in rows.columns if c != key])


def describe(metrics: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        F.avg(value).alias("mean"),
        F.count(value).alias("n"),
    )


def _splits(series: DataFrame, value: str, kind: str, key: list[str], seq: str) -> DataFrame:
    """Per series its best split: change_point, gain, and what a test needs (n, _all)."""
    series = cut(series.where(F.col(value).isNotNull()))
    whole = series.groupBy(*key).agg(F.avg(value).alias("_mu"), F.count(value).alias("_n"))
    centred = series.join(whole, key).withColumn("_d", F.col(value) - F.col("_mu"))
    places = F.lit(1).cast("long")
    sums = cut(
        running_sum(
            centred, {"_s": F.col("_d"), "_q": F.col("_d") * F.col("_d"), "_k": places}, key=key, seq=seq
        )
    )
    totals = sums.groupBy(*key).agg(F.sum(F.col("_d") * F.col("_d")).alias("_all"))
    k, n = F.col("_k"), F.col("_n")
    split = sums.join(totals, key).where(k < n)
    if kind == "mean":
        # deviations sum to zero, so both means follow from the left sum
        left, right = F.col("_s") / k, -F.col("_s") / (n - k)
        gain = k * (n - k) / n * (left - right) * (left - right)
    else:
        tail = F.col("_all") - F.col("_q")
        split = split.where((k >= 2) & (k <= n - 2) & (F.col("_q") > 1e-12) & (tail > 1e-12))
        gain = n * F.log(F.col("_all") / n) - k * F.log(F.col("_q") / k) - (n - k) * F.log(tail / (n - k))
    ranked = split.withColumn("gain", F.round(gain, 9))
    best = ranked.groupBy(*key).agg(
        F.max_by(seq, F.struct("gain", -F.col(seq))).alias("change_point"), F.max("gain").alias("gain")
    )
    return best.join(totals.join(whole, key), key, "right")


def change_points(
    series: DataFrame, value: str, kind: str = "mean", key: Sequence[str] = ("run_id",), seq: str = "time"
) -> DataFrame:
    """At most one change per series: the split with the largest gain, and that gain.

    ``mean`` weighs the squared difference of the two means, ``var`` the drop in
    log variance around the series mean. The split is the last element before the
    change; ``seq`` may have gaps, elements are counted. Elements without a value are left out.
    """
    key = list(key)
    best = _splits(series, value, kind, key, seq)
    return best.where(F.col("change_point").isNotNull()).select(*key, "change_point", "gain")


def change_decisions(
    series: DataFrame, value: str, kind: str = "mean", key: Sequence[str] = ("run_id",), seq: str = "time"
) -> DataFrame:
    """Key, n, statistic, penalty and change_point of every series; null where one level explains it as well.

    The statistic is twice the gain in log likelihood of a normal law with two levels
    (``mean``) or two variances (``var``) over one. It has to exceed PENALTY * log(n), as the
    split costs three parameters. A series without two different values never changes.
    """
    key = list(key)
    best = _splits(series, value, kind, key, seq)
    n, rest = F.col("_n"), F.col("_all") - F.col("gain")
    if kind == "mean":
        # A split without any error left is as certain as can be.
        tested = F.when(rest > 1e-12 * F.col("_all"), n * F.log(F.col("_all") / rest)).otherwise(F.lit(math.inf))
        tested = F.when(F.col("gain") > 0, tested)
    else:
        tested = F.col("gain")
    statistic = F.coalesce(F.when(F.col("_all") > 1e-12, tested), F.lit(0.0))
    penalty = PENALTY * F.log(n.cast("double"))
    return best.select(
        *key, n.alias("n"), statistic.alias("statistic"), penalty.alias("penalty"), "change_point"
    ).withColumn("change_point", F.when(F.col("statistic") > F.col("penalty"), F.col("change_point")))


def unpivoted(stats: DataFrame, seq: str) -> DataFrame:
    """(series, seq, value): every column of a table of statistics as a series of its own."""
    columns = [c for c in stats.columns if c != seq]
    same = stats.select(seq, *[F.col(c).cast("double").alias(c) for c in columns])
    return same.unpivot(seq, columns, "series", "value")


def latest_change(points: Sequence[DataFrame], cap: float | None = None) -> DataFrame:
    """The latest change point of several series, at most ``cap`` if one is given; 0 without any."""
    every = points[0].select("change_point")
    for more in points[1:]:
        every = every.union(more.select("change_point"))
    latest = F.max("change_point") if cap is None else F.least(F.max("change_point"), F.lit(int(cap)))
    return every.agg(F.coalesce(latest, F.lit(0)).cast("long").alias("max_change_point"))


def circular_fit(rows: DataFrame, angle: str, by: Sequence[str]) -> DataFrame:
    """Mean direction and concentration, with the moment fits of two wrapped laws.

    A wrapped normal has variance -2 log(rho), a wrapped Cauchy scale -log(rho).
    """
    sums = rows.groupBy(*by).agg(
        F.avg(F.cos(angle)).alias("_c"), F.avg(F.sin(angle)).alias("_s"), F.count(angle).alias("n")
    )
    rho = F.least(F.hypot("_c", "_s"), F.lit(1.0))  # rounding may lift equal angles over 1
    return sums.select(
        *by,
        "n",
        F.atan2("_s", "_c").alias("mu"),
        rho.alias("rho"),
        F.when(rho > 0, F.sqrt(-2 * F.log(rho))).alias("normal_sd"),
        F.when(rho > 0, -F.log(rho)).alias("cauchy_scale"),
    )


def angle_moments(rows: DataFrame, angle: str, by: Sequence[str], terms: int = TERMS) -> DataFrame:
    """(by, k, c, s, n): sums of cos(k angle) and sin(k angle); tables of these are merged by adding."""
    every = rows.where(F.col(angle).isNotNull())
    steps = every.select(*by, F.col(angle).alias("_a"), F.explode(F.sequence(F.lit(1), F.lit(terms))).alias("k"))
    return steps.groupBy(*by, "k").agg(
        F.sum(F.cos(F.col("k") * F.col("_a"))).alias("c"),
        F.sum(F.sin(F.col("k") * F.col("_a"))).alias("s"),
        F.count(F.lit(1)).alias("n"),
    )


def circular_density(
    rows: DataFrame, angle: str, bins: int, by: Sequence[str], bandwidth: float | None = 0.1, terms: int = TERMS
) -> DataFrame:
    """Density of the angles at the centres of ``bins`` bins, under a wrapped normal kernel.

    Sums of ``terms`` moments hold all that the kernel can see, so the density is that of
    all angles, not of bins, and no angle meets a centre. Without a bandwidth each group has its own,
    from its spread and size, but none that needs more moments.
    """
    width = 2 * math.pi / bins
    least = math.sqrt(2 * math.log(1e12)) / terms  # the last moment weighs 1e-12
    moments = angle_moments(rows, angle, by, terms)
    h = F.lit(bandwidth)
    if bandwidth is None:
        rho = F.least(F.sqrt(F.col("c") ** 2 + F.col("s") ** 2) / F.col("n"), F.lit(1.0))
        spread = F.when(rho > 0, F.sqrt(-2 * F.log(rho))).otherwise(math.pi)
        own = moments.where("k = 1").select(*by, (0.9 * spread * F.pow("n", F.lit(-0.2))).alias("_h"))
        moments = moments.join(own, [*by])
        h = F.greatest(F.col("_h"), F.lit(least))
    elif bandwidth < least:
        raise ValueError(f"a bandwidth of {bandwidth} needs more than {terms} terms")
    weight = F.exp(-0.5 * (F.col("k") * h) ** 2) / (math.pi * F.col("n"))
    at = F.col("k") * F.col("theta")
    centres = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))
    spread = moments.withColumn("_w", weight).select("*", centres.alias("bin"))
    spread = spread.withColumn("theta", (F.col("bin") + 0.5) * width - math.pi)
    part = F.col("_w") * (F.col("c") * F.cos(at) + F.col("s") * F.sin(at))
    # A density with few angles may come out below zero by rounding.
    total = F.greatest(F.sum(part) + 1 / (2 * math.pi), F.lit(0.0))
    return spread.groupBy(*by, "bin", "theta").agg(total.alias("density"))


def angle_histogram(rows: DataFrame, angle: str, by: Sequence[str], bins: int = ANGLE_BINS) -> DataFrame:
    """(by, bin, n, c, s): angles per bin and the mean of their directions, so a bin stands where its angles lie."""
    at = F.pmod(F.floor((F.col(angle) + math.pi) * (bins / (2 * math.pi))), F.lit(bins)).cast("long")
    return rows.where(F.col(angle).isNotNull()).groupBy(*by, at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.cos(angle)).alias("c"), F.avg(F.sin(angle)).alias("s")
    )


def _cauchy_step(bins: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """One step of the fixed point for the wrapped Cauchy law, from its two coefficients p and q."""
    w = F.col("n") / (1 - F.col("p") * F.col("c") - F.col("q") * F.col("s"))
    sums = bins.join(fit, by).groupBy(*by).agg(
        F.sum(w).alias("_w"), F.sum(w * F.col("c")).alias("_c"), F.sum(w * F.col("s")).alias("_s"), F.first("p").alias("_p"), F.first("q").alias("_q")
    )
    p, q = F.col("_c") / F.col("_w"), F.col("_s") / F.col("_w")
    # Angles that are all equal lead to a coefficient of one, which weighs them without bound.
    shrink = F.least(F.lit(1.0), (1 - 1e-12) / F.greatest(F.hypot(p, q), F.lit(1e-300)))
    moved = F.greatest(F.abs(p - F.col("_p")), F.abs(q - F.col("_q")))
    return sums.select(*by, (p * shrink).alias("p"), (q * shrink).alias("q"), moved.alias("moved"))


def _normal_step(bins: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """One Newton step for the wrapped normal law in (mu, rho), by the derivatives of its cosine series."""
    z = F.atan2("s", "c") - F.col("mu")
    joined = bins.join(fit, by).withColumn("_z", z)

    def series(weight, wave) -> Column:
        terms = F.sequence(F.lit(1), F.lit(NORMAL_TERMS))
        return F.aggregate(terms, F.lit(0.0), lambda t, p: t + weight(p, F.pow(F.col("rho"), p * p)) * wave(p * F.col("_z")))

    rho = F.col("rho")
    laws = joined.withColumns({
        "f": 1 + 2 * series(lambda p, r: r, F.cos),
        "fm": 2 * series(lambda p, r: p * r, F.sin),
        "fr": 2 * series(lambda p, r: p * p * r, F.cos) / rho,
        "fmm": -2 * series(lambda p, r: p * p * r, F.cos),
        "fmr": 2 * series(lambda p, r: p * p * p * r, F.sin) / rho,
        "frr": 2 * series(lambda p, r: p * p * (p * p - 1) * r, F.cos) / (rho * rho),
    })
    f = F.greatest(F.col("f"), F.lit(1e-12))
    m, r = F.col("fm") / f, F.col("fr") / f
    n = F.col("n")
    sums = laws.groupBy(*by).agg(
        F.first("mu").alias("mu"), F.first("rho").alias("rho"), F.sum(n * m).alias("gm"), F.sum(n * r).alias("gr"),
        F.sum(n * (m * m - F.col("fmm") / f)).alias("hmm"), F.sum(n * (m * r - F.col("fmr") / f)).alias("hmr"),
        F.sum(n * (r * r - F.col("frr") / f)).alias("hrr"),
        F.sum(n * m * m).alias("omm"), F.sum(n * m * r).alias("omr"), F.sum(n * r * r).alias("orr"),
    )
    # Where the curvature points the wrong way the outer products of the gradients take its place.
    good = (F.col("hmm") > 0) & (F.col("hmm") * F.col("hrr") > F.col("hmr") ** 2)
    a, b, d = (F.when(good, F.col(f"h{x}")).otherwise(F.col(f"o{x}")) for x in ("mm", "mr", "rr"))
    det = a * d - b * b
    dm = F.coalesce(F.try_divide(d * F.col("gm") - b * F.col("gr"), det), F.lit(0.0))
    dr = F.coalesce(F.try_divide(a * F.col("gr") - b * F.col("gm"), det), F.lit(0.0))
    dm, dr = (F.greatest(F.lit(-0.2), F.least(x, F.lit(0.2))) for x in (dm, dr))
    new = F.greatest(F.lit(1e-6), F.least(F.col("rho") + dr, F.lit(0.98)))
    moved = F.greatest(F.abs(dm), F.abs(new - F.col("rho")))
    turned = F.atan2(F.sin(F.col("mu") + dm), F.cos(F.col("mu") + dm))
    return sums.select(*by, turned.alias("mu"), new.alias("rho"), moved.alias("moved"))


def _iterated(bins: DataFrame, fit: DataFrame, by: list[str], step) -> DataFrame:
    """Steps until no group moves by more than TOLERANCE."""
    for _ in range(0, MOST, STEPS):
        for _ in range(STEPS):
            fit = step(bins, fit.drop("moved"), by)
        fit = cut(fit)
        if (fit.agg(F.max("moved")).first()[0] or 0.0) <= TOLERANCE:
            break
    return fit.drop("moved")


def circular_mle(rows: DataFrame, angle: str, by: Sequence[str]) -> DataFrame:
    """Maximum-likelihood fits of the wrapped normal and the wrapped Cauchy law, per group.

    n, normal_mu, normal_rho, cauchy_mu, cauchy_rho. Likelihoods are sums over a histogram of bounded
    size, whose bins carry the mean direction of their angles, so a fit errs by the square of a bin's
    width only. Groups so concentrated that no angle wraps take the plain normal fit. A group whose angles
    have no direction at all keeps a rho near zero.
    """
    by = list(by)
    bins = cut(angle_histogram(rows, angle, by))
    n, c, s = F.col("n"), F.col("c"), F.col("s")
    sums = bins.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * c).alias("_c"), F.sum(n * s).alias("_s"))
    start = cut(
        sums.select(
            *by, "n", F.atan2("_s", "_c").alias("mu"),
            F.greatest(F.least(F.hypot("_c", "_s") / n, F.lit(1.0)), F.lit(1e-6)).alias("rho"),
        )
    )
    p, q = F.col("rho") * F.cos("mu"), F.col("rho") * F.sin("mu")
    twice = 2 / (1 + F.col("rho") ** 2) * (1 - 1e-12)
    cauchy = _iterated(bins, start.select(*by, (p * twice).alias("p"), (q * twice).alias("q")), by, _cauchy_step)
    size = F.hypot("p", "q")
    cauchy = cauchy.select(
        *by,
        F.atan2("q", "p").alias("cauchy_mu"),
        F.when(size > 0, (1 - F.sqrt(1 - size * size)) / size).otherwise(0.0).alias("cauchy_rho"),
    )
    wide = start.where(F.col("rho") <= CONCENTRATED).select(*by, "mu", "rho")
    normal = _iterated(bins, wide, by, _normal_step).select(*by, "mu", "rho")
    off = F.atan2(F.sin(F.atan2("s", "c") - F.col("mu")), F.cos(F.atan2("s", "c") - F.col("mu")))
    tight = bins.join(start.where(F.col("rho") > CONCENTRATED).select(*by, "mu"), by).withColumn("_d", off)
    tight = tight.groupBy(*by).agg(
        F.first("mu").alias("mu"), (F.sum(n * F.col("_d")) / F.sum(n)).alias("_m"),
        (F.sum(n * F.col("_d") * F.col("_d")) / F.sum(n)).alias("_q"),
    )
    var = F.greatest(F.col("_q") - F.col("_m") ** 2, F.lit(0.0))
    tight = tight.select(*by, (F.col("mu") + F.col("_m")).alias("mu"), F.exp(-var / 2).alias("rho"))
    both = normal.unionByName(tight).select(*by, F.col("mu").alias("normal_mu"), F.col("rho").alias("normal_rho"))
    return start.select(*by, "n").join(both, by).join(cauchy, by)


def fit_error(density: DataFrame, fit: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of squared gaps between a density and the two fitted wrapped laws.

    Null for a law that has no density, as of angles that are all equal.
    """
    both = density.join(fit, [*by])
    z = F.col("theta") - F.col("mu")
    rho = F.col("rho")
    spread = F.when(rho < 1, 1 + rho * rho - 2 * rho * F.cos(z))
    cauchy = (1 - rho * rho) / spread / (2 * math.pi)
    sd = F.when(F.col("normal_sd") > 0, F.col("normal_sd"))
    normal = sum(
        F.exp(-0.5 * F.pow((z + 2 * math.pi * w) / sd, F.lit(2.0))) for w in range(-3, 4)
    ) / (sd * math.sqrt(2 * math.pi))
    gap = lambda law: F.sum(F.pow(F.col("density") - law, F.lit(2.0)))
    return both.groupBy(*by).agg(gap(normal).alias("normal_error"), gap(cauchy).alias("cauchy_error"))
