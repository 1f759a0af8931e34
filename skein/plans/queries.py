"""The query catalogue: every entry reads whole tables and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.functions.angles import degree_bin
from skein.functions.vectors import near_edge
from skein.operators import cluster as C
from skein.operators import histograms as H
from skein.operators import hull as U
from skein.operators import metrics as M
from skein.operators import nearest as N
from skein.operators import population as P
from skein.operators import rules as R
from skein.operators import spanning as T
from skein.operators import spatial as S
from skein.operators import stats as X
from skein.operators import tracks as K
from skein.operators import voronoi as O
from skein.plans import experiment as E
from skein.plans.shape import fixed, shape
from skein.plans.simulate import simulate
from skein.schema import EVENTS, World
from skein.session import cut, shared_dir
from skein.sources import recorder as IO
from skein.sources.config import FlockConfig, parse_boundary
from skein.sources.events import RUNS, WORLD, point_cloud, positions, read_events, tracks
from skein.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]

TAU = 5
MAX_SPEED = 2.0
EDGE_MARGIN = 7.0
FACETS = 6
BINS = 360

# name -> (output contract, function)
CATALOGUE: dict[str, tuple[str, Query]] = {}


ROUNDED: set[str] = set()  # queries that round their doubles themselves, where that is cheaper


def query(spec: str, rounded: bool = False):
    def register(fn: Query) -> Query:
        CATALOGUE[fn.__name__] = (spec, fn)
        if rounded:
            ROUNDED.add(fn.__name__)
        return fn

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, fn = CATALOGUE[name]
    return shape(fn(spark, sf_dir), spec, name not in ROUNDED) if spec else fn(spark, sf_dir)


# --- tracks, steps and angles ---------------------------------------------------------


@query("run_id id time x:double y:double cluster_id")
def track_samples(spark, sf):
    return tracks(spark, sf)


@query("id time dx:double dy:double step:double")
def toroidal_displacement(spark, sf):
    steps = K.displacement(tracks(spark, sf), WORLD).where(F.col("dx").isNotNull())
    return steps.withColumn("step", F.hypot("dx", "dy"))


@query(
    "id time unit_x:double unit_y:double limited_x:double limited_y:double ensured_x:double ensured_y:double "
    "turned_x:double turned_y:double sine:double soft:double sigmoid:double"
)
def step_vectors(spark, sf):
    """Every step with its direction, held to lengths, turned by the position, and its weights as a distance."""
    steps = K.displacement(tracks(spark, sf), WORLD).where(F.col("dx").isNotNull())
    step, at = (F.col("dx"), F.col("dy")), (F.col("x"), F.col("y"))
    forms = {
        "unit": V.normalize(step),
        "limited": V.limit_length(step, 20.0),
        "ensured": V.ensure_length(step, 10.0, 20.0),
        "turned": V.rotate(step, V.normalize(at)),
    }
    near = F.least(V.norm(step) / 20, F.lit(1.0))
    columns = {f"{name}_{c}": v[i] for name, v in forms.items() for i, c in enumerate("xy")}
    return steps.select(
        "id", "time", *[v.alias(name) for name, v in columns.items()], V.wedge(at, step).alias("sine"),
        V.soft_falloff(near).alias("soft"), V.sigmoid_falloff(near).alias("sigmoid"),
    )


@query("id time dx:double dy:double")
def plain_diff(spark, sf):
    return K.displacement(tracks(spark, sf), WORLD.enclosed()).where(F.col("dx").isNotNull())


@query("id time x:double y:double dx:double dy:double cluster_id")
def preprocess_dxdy(spark, sf):
    return K.preprocess(tracks(spark, sf), WORLD)


@query("id time headings:double")
def headings(spark, sf):
    return K.heading_rows(tracks(spark, sf), WORLD)


@query("id time bearings:double")
def bearings(spark, sf):
    return K.directional(tracks(spark, sf), WORLD)


DIRECTIONAL = "id time x:double y:double dx:double dy:double headings:double bearings:double cluster_id"


@query(DIRECTIONAL)
def directional_data(spark, sf):
    return K.directional(tracks(spark, sf), WORLD)


@query(DIRECTIONAL)
def directional_data_enclosed(spark, sf):
    return K.directional(tracks(spark, sf), WORLD.enclosed())


@query(DIRECTIONAL)
def directional_boundary_free(spark, sf):
    flagged = K.flag_boundary_dependent(tracks(spark, sf), EDGE_MARGIN, WORLD, reach=2)
    return K.directional(flagged, WORLD).where(~F.col("affected"))


# --- group measures -------------------------------------------------------------------


@query("time avg_norm_vel:double")
def avg_norm_vel(spark, sf):
    return M.avg_norm_vel(K.directional(tracks(spark, sf), WORLD))


@query("time avg_norm_vel:double")
def avg_norm_vel2(spark, sf):
    return M.avg_norm_vel2(K.directional(tracks(spark, sf), WORLD))


@query("time avg_norm_vel:double")
def avg_norm_vel2_with_noise(spark, sf):
    return M.avg_norm_vel2(K.directional(tracks(spark, sf), WORLD), filter_noise=False)


@query("time cluster_id avg_norm_vel:double")
def avg_norm_vel_by_cluster(spark, sf):
    return M.avg_norm_vel(K.directional(tracks(spark, sf), WORLD), by=("time", "cluster_id"))


@query("time no_flocks")
def no_flocks(spark, sf):
    return M.no_flocks(tracks(spark, sf))


@query("flock_limit first_time")
def first_n_flocks_time(spark, sf):
    return M.first_time_at_most(tracks(spark, sf), [0, 1, 2, 3, 4])


@query("time rop:double")
def curvature_order(spark, sf):
    return M.curvature_order(K.curvature(tracks(spark, sf), WORLD, TAU, MAX_SPEED))


@query("id time bearing_ma:double heading_ma:double")
def bearing_moving_avg(spark, sf):
    rows = K.moving_averages(tracks(spark, sf), WORLD, TAU)
    return rows.where(F.col("bearing_ma").isNotNull())


@query("run_id time noise bearing_ma:double label:string time_label")
def bearing_ma_noise_split(spark, sf):
    rows = K.moving_averages(tracks(spark, sf), WORLD, TAU)
    split = rows.withColumn("noise", (F.col("cluster_id") == 0).cast("long"))
    means = M.mean_or_missing(split, "bearing_ma", ("run_id", "time", "noise"))
    labelled = K.run_rank(means.withColumn("id", F.col("noise")), "row")
    return labelled.withColumn("label", F.format_string("s_%d", "run_id")).withColumn(
        "time_label", F.col("row") * 16
    )


@query("time cluster_id bearing_ma:double")
def bearing_ma_by_cluster(spark, sf):
    rows = K.moving_averages(tracks(spark, sf), WORLD, TAU)
    return M.mean_or_missing(rows, "bearing_ma", ("time", "cluster_id"))


@query("run_id id time bearing_ma:double heading_ma:double")
def zscore_ma(spark, sf):
    rows = K.moving_averages(tracks(spark, sf), WORLD, 30)
    return M.zscores(rows.where(F.col("bearing_ma").isNotNull()), ["bearing_ma", "heading_ma"])


@query("run_id time avg_norm_vel:double")
def min_max_velocity(spark, sf):
    steps = K.directional(tracks(spark, sf), WORLD)
    return M.min_max(M.avg_norm_vel2(steps, ("run_id", "time")), "avg_norm_vel", ("run_id",))


# --- histograms and sections ----------------------------------------------------------


@query("bin heading_count bearing_count")
def directional_histogram(spark, sf):
    return H.directional_counts(K.directional(tracks(spark, sf), WORLD), BINS)


@query("kind:string degree n")
def degree_histogram(spark, sf):
    return H.degree_counts(K.directional(tracks(spark, sf), WORLD))


@query("run_id id time timeline_facet")
def timeline_facets(spark, sf):
    return K.timeline_facets(K.directional(tracks(spark, sf), WORLD), FACETS)


@query("timeline_facet run_id bin heading_count bearing_count")
def facet_direction_counts(spark, sf):
    faceted = K.timeline_facets(K.directional(tracks(spark, sf), WORLD), FACETS)
    return H.directional_counts(faceted, BINS, by=("timeline_facet", "run_id"))


@query("time_bin degree n")
def time_bin_headings(spark, sf):
    binned = K.time_bins(K.directional(tracks(spark, sf), WORLD), width=4)
    return binned.groupBy("time_bin", degree_bin(F.col("headings")).alias("degree")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- boundary, sampling, segments -----------------------------------------------------


@query("id time x:double y:double")
def boundary_rows(spark, sf):
    return K.boundary_rows(tracks(spark, sf), EDGE_MARGIN, WORLD)


@query("id time x:double y:double cluster_id")
def boundary_clean_tracks(spark, sf):
    return K.remove_boundary_dependent(tracks(spark, sf), EDGE_MARGIN, WORLD, reach=2)


@query("rows boundary_share:double affected_share:double")
def boundary_share(spark, sf):
    flagged = K.flag_boundary_dependent(tracks(spark, sf), EDGE_MARGIN, WORLD, reach=2)
    edge = near_edge(F.col("x"), F.col("y"), EDGE_MARGIN, WORLD)
    return flagged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(edge.cast("int")).alias("boundary_share"),
        F.avg(F.col("affected").cast("int")).alias("affected_share"),
    )


@query("run_id id time row x:double y:double")
def subsample_tracks(spark, sf):
    return K.subsample(tracks(spark, sf), start=2, every=3)


@query("id time x:double y:double cluster_id")
def time_page(spark, sf):
    return K.time_page(tracks(spark, sf), 10)


@query("id time x:double y:double")
def time_range(spark, sf):
    return K.time_range(tracks(spark, sf), 10, 20)


@query("id time segment last_crossing")
def track_segments(spark, sf):
    return K.last_crossing(tracks(spark, sf), WORLD)


@query("id time path_x:double path_y:double")
def cumulative_path(spark, sf):
    steps = K.directional(tracks(spark, sf), WORLD)
    return K.cumulative_path(steps)


@query("id time trail_length trail_x:double trail_y:double")
def trails(spark, sf):
    trailed = K.trails(tracks(spark, sf), 4)

    def total(axis: str):
        return F.aggregate("trail", F.lit(0.0), lambda acc, p: acc + p[axis])

    return trailed.select(
        "id",
        "time",
        F.size("trail").alias("trail_length"),
        total("x").alias("trail_x"),
        total("y").alias("trail_y"),
    )


# --- neighbours and clusters ----------------------------------------------------------

RADIUS = 7.0
VIEW = 280.0
MIN_PTS = 3
CLOUD = World(100, 100, toroidal=False)


def placed(spark, sf):
    """What neighbours take of the samples."""
    return tracks(spark, sf).select("time", "id", "x", "y")


@query("time id id2 ox:double oy:double dist:double", rounded=True)
def neighbours_toroidal(spark, sf):
    return S.neighbours(placed(spark, sf), RADIUS, WORLD, form=fixed)


@query("time id id2 dist:double", rounded=True)
def neighbours_enclosed(spark, sf):
    return S.neighbours(placed(spark, sf), RADIUS, WORLD.enclosed(), form=fixed)


@query("time id id2 dist:double", rounded=True)
def neighbours_strict(spark, sf):
    return S.neighbours(placed(spark, sf), RADIUS, WORLD, strict=True, form=fixed)


@query("id id2 dist:double", rounded=True)
def point_cloud_neighbours(spark, sf):
    return S.neighbours(point_cloud(spark, sf).drop("cluster_id"), 3.0, CLOUD, form=fixed)


@query("time id n_neighbours")
def neighbour_counts(spark, sf):
    return S.neighbour_counts(tracks(spark, sf), RADIUS, WORLD)


@query("time id id2")
def fov_neighbours(spark, sf):
    steps = K.displacement(tracks(spark, sf), WORLD).where(F.col("dx").isNotNull())
    return S.visible_neighbours(steps.select("time", "id", "x", "y", "dx", "dy"), RADIUS, VIEW, WORLD)


@query("time id id2 rank dist:double")
def capped_neighbours(spark, sf):
    return S.nearest_within(placed(spark, sf), RADIUS, 3, WORLD)


@query("time id cluster_id")
def dbscan_labels(spark, sf):
    return C.dbscan(tracks(spark, sf), RADIUS, MIN_PTS, WORLD)


@query("time cluster_id agents")
def cluster_sizes(spark, sf):
    return C.cluster_sizes(C.dbscan(tracks(spark, sf), RADIUS, MIN_PTS, WORLD))


@query("time id component")
def components(spark, sf):
    return C.components(tracks(spark, sf), RADIUS, WORLD)


@query("id cluster_id")
def point_cloud_dbscan(spark, sf):
    return C.dbscan(point_cloud(spark, sf), 2.5, MIN_PTS, CLOUD)


@query("time id id2 dist:double")
def spanning_tree(spark, sf):
    return T.spanning_tree(tracks(spark, sf))


@query("time id cluster_id")
def mst_knn_clusters(spark, sf):
    return T.mst_knn(tracks(spark, sf), rounds=1)


# --- flocking rules and ticks ---------------------------------------------------------

FLOCK = FlockConfig(
    width=100,
    height=100,
    sensory_distance=7.0,
    alignment_trs_coef=1.0,
    cohesion_trs_coef=0.8,
    separation_trs_coef=0.5,
    alignment_coef=0.3,
    cohesion_coef=0.1,
    separation_coef=1.2,
    min_speed=0.5,
    max_speed=4.1,
    max_steering=0.7,
    field_of_vision=280.0,
)


def flock_states(spark, sf, world=WORLD):
    """Every sample with a step is an agent of its frame's flock."""
    steps = K.displacement(tracks(spark, sf), world).where(F.col("dx").isNotNull())
    return R.as_state(steps).drop("cluster_id")


def pushes(spark, sf, config=FLOCK):
    return R.rule_pushes(R.perceive(flock_states(spark, sf), config), config)


@query("time id n_neighbours sep_n sep_px:double sep_py:double")
def rule_separation(spark, sf):
    return pushes(spark, sf)


@query("time id coh_n coh_px:double coh_py:double")
def rule_cohesion(spark, sf):
    return pushes(spark, sf)


@query("time id ali_n ali_px:double ali_py:double")
def rule_alignment(spark, sf):
    return pushes(spark, sf)


TICK = "time id x:double y:double vx:double vy:double ax:double ay:double wander:double n_neighbours"


def one_tick(spark, sf, **changes):
    config = FLOCK.overwrite(**changes)
    return R.tick(flock_states(spark, sf), config, 1)


@query(TICK)
def tick_toroidal(spark, sf):
    return one_tick(spark, sf)


@query(TICK)
def tick_absorbing(spark, sf):
    return one_tick(spark, sf, boundary="Absorbing", distance="EucEnclosed")


@query(TICK)
def tick_reflective(spark, sf):
    return one_tick(spark, sf, boundary="Reflective", distance="EucEnclosed")


@query(TICK)
def tick_repulsive(spark, sf):
    return one_tick(
        spark, sf, boundary="Repulsive", boundary_distance=10.0, boundary_force=0.05, distance="EucEnclosed"
    )


@query(TICK)
def tick_full_view(spark, sf):
    return one_tick(spark, sf, field_of_vision=360.0)


@query(TICK)
def tick_unsteered(spark, sf):
    return one_tick(spark, sf, agent_steering=False)


@query(TICK)
def tick_cohesion_yields(spark, sf):
    return one_tick(spark, sf, cohesion_yields=True)


@query(TICK)
def tick_capped(spark, sf):
    return one_tick(spark, sf, neighbours_considered=3)


WANDERING = dict(wander_on=True, wander_rate=0.32, wander_radius=0.5, wander_distance=0.5, wander_coef=0.5)


@query(TICK)
def tick_wander_reynolds(spark, sf):
    return one_tick(spark, sf, **WANDERING)


@query(TICK)
def tick_wander_vicsek(spark, sf):
    return one_tick(spark, sf, **WANDERING, noise_model="Vicsek")


@query(TICK)
def tick_seek(spark, sf):
    return one_tick(spark, sf, seek_x=10.0, seek_y=-45.0)


@query(TICK)
def tick_without_motion(spark, sf):
    return one_tick(spark, sf, stop_movement=True)


@query("time id marked:boolean")
def marked_neighbours(spark, sf):
    return R.mark_neighbours(tracks(spark, sf), 7, RADIUS, FLOCK)


SIMULATED = "run_id time id x:double y:double vx:double vy:double n_neighbours cluster_id"


def run_starts(spark, sf):
    """The second sample of every agent, with its first step as velocity, starts its run."""
    return K.time_page(flock_states(spark, sf), 2).drop("time")


@query(SIMULATED)
def simulate_runs(spark, sf):
    config = FLOCK.overwrite(**WANDERING, sample_rate=2)
    return simulate(run_starts(spark, sf), config, ticks=4)


@query(SIMULATED)
def simulate_clustered(spark, sf):
    return simulate(run_starts(spark, sf), FLOCK.overwrite(sample_rate=2, clustering=True), ticks=2)


# --- nearest neighbours and hulls -----------------------------------------------------


@query("time id id2 rank dist:double")
def knn(spark, sf):
    return N.nearest(tracks(spark, sf), 3, WORLD)


@query("time id id2 mutual:boolean")
def knn_mutual(spark, sf):
    return N.with_mutual(N.nearest(tracks(spark, sf), 3, WORLD))


@query("time id dist:double")
def knn_distance_curve(spark, sf):
    return N.kth_distances(N.nearest(tracks(spark, sf), 4, WORLD), 4)


@query("time id id2 shared")
def shared_nn(spark, sf):
    return N.shared_nearest(tracks(spark, sf), 10, 5)


@query("time id id2 dist:double push_x:double push_y:double")
def nearest_agent(spark, sf):
    return R.disrupt(N.nearest(tracks(spark, sf), 1, WORLD))


@query("id id2 rank dist:double")
def point_cloud_knn(spark, sf):
    return N.nearest(point_cloud(spark, sf), 4, CLOUD)


@query("time cluster_id hull_area:double")
def convex_hull_area(spark, sf):
    return U.hull_area(M.without_noise(tracks(spark, sf)), ["time", "cluster_id"])


@query("time average_cluster_volumes:double")
def mean_flock_area(spark, sf):
    return U.mean_flock_area(tracks(spark, sf))


@query("cluster_id hull_area:double")
def point_cloud_hulls(spark, sf):
    return U.hull_area(point_cloud(spark, sf), ["cluster_id"])


@query("time voronoi_counts:double")
def voronoi_occupancy(spark, sf):
    return O.occupancy(tracks(spark, sf), RADIUS, WORLD)


@query("time sites total_area:double")
def voronoi_cells(spark, sf):
    """Cells tile the world: their number and the sum of their areas."""
    areas = O.relaxed_areas(tracks(spark, sf), WORLD, relaxations=0)
    return areas.groupBy("time").agg(F.count(F.lit(1)).alias("sites"), F.sum("area").alias("total_area"))


# --- many runs ------------------------------------------------------------------------

STATISTICS = [f"{m}_{v}" for v in E.METRICS for m in ("mean", "var")]
STATS = " ".join(f"{s}:double" for s in STATISTICS)


def directions(spark, sf):
    return K.directional(tracks(spark, sf), WORLD)


@query("run_id time average_norm_vel:double average_norm_vel2:double no_flocks convex_hull:double")
def experiment_metrics(spark, sf):
    return E.run_metrics(directions(spark, sf))


@query(f"t {STATS}")
def experiment_stats(spark, sf):
    return E.experiment_stats(directions(spark, sf), sample_rate=16)


def velocity_by_run(spark, sf):
    return M.avg_norm_vel2(directions(spark, sf), ("run_id", "time"), filter_noise=False)


def experiment_wide(spark, sf):
    """The column list follows the data, so the contract is built from it."""
    wide = X.to_wide(velocity_by_run(spark, sf), "avg_norm_vel")
    spec = " ".join(["run_id", *[f"{c}:double" for c in wide.columns if c != "run_id"]])
    return shape(wide, spec)


CATALOGUE["experiment_wide"] = ("", experiment_wide)


@query("time " + " ".join(f"run_{r}:double" for r in range(RUNS)))
def runs_wide(spark, sf):
    """One row per time, one column per run: the columns are known, whatever the length of the runs."""
    wide = velocity_by_run(spark, sf).groupBy("time").pivot("run_id", list(range(RUNS))).agg(F.max("avg_norm_vel"))
    return wide.select("time", *[F.col(str(r)).alias(f"run_{r}") for r in range(RUNS)])


@query("run_id time avg_norm_vel:double")
def wide_to_long(spark, sf):
    wide = X.to_wide(velocity_by_run(spark, sf), "avg_norm_vel")
    return X.to_long(wide, "avg_norm_vel")


@query("noise_level agents mean_avg_norm_vel:double max_avg_norm_vel:double runs")
def sweep_summary(spark, sf):
    """Runs differ in parameters; a run's number stands for its two settings."""
    tagged = velocity_by_run(spark, sf).withColumns(
        {"noise_level": F.col("run_id") % 2, "agents": F.floor(F.col("run_id") / 2)}
    )
    return X.sweep_summary(tagged, "avg_norm_vel", ("noise_level", "agents"))


@query("noise_percent agents mean_avg_norm_vel:double max_avg_norm_vel:double runs")
def sweep_by_config(spark, sf):
    """Runs looked up in a table of their settings: agents, and the share of noise in whole percent."""
    noise = F.floor(100 * F.count(F.when(F.col("cluster_id") == 0, 1)) / F.count(F.lit(1)))
    settings = cut(
        tracks(spark, sf).groupBy("run_id").agg(noise.alias("noise_percent"), F.countDistinct("id").alias("agents"))
    )
    tagged = X.with_settings(velocity_by_run(spark, sf), settings)
    return X.sweep_summary(tagged, "avg_norm_vel", ("noise_percent", "agents"))


@query("run_id lowest:double highest:double mean:double n")
def metric_summary(spark, sf):
    return X.describe(velocity_by_run(spark, sf), "avg_norm_vel", ("run_id",))


@query("run_id change_point gain:double")
def change_point_mean(spark, sf):
    return X.change_points(velocity_by_run(spark, sf), "avg_norm_vel", "mean")


@query("run_id change_point gain:double")
def change_point_var(spark, sf):
    return X.change_points(velocity_by_run(spark, sf), "avg_norm_vel", "var")


@query("max_change_point")
def latest_change_point(spark, sf):
    series = velocity_by_run(spark, sf)
    both = [X.change_points(series, "avg_norm_vel", kind) for kind in ("mean", "var")]
    return X.latest_change(both)


@query("series:string n statistic:double change_point")
def stats_change_points(spark, sf):
    """Levels of flock numbers and areas, variances of the order parameters, as far as the penalty admits a change."""
    stats = E.experiment_stats(directions(spark, sf), sample_rate=16).select("t", *STATISTICS)
    series = X.unpivoted(stats, "t")
    level = F.col("series").rlike("no_flocks|convex_hull")
    parts = [
        X.change_decisions(series.where(test), "value", kind, ("series",), "t")
        for test, kind in ((level, "mean"), (~level, "var"))
    ]
    return parts[0].unionByName(parts[1])


@query("run_id n normal_mu:double normal_rho:double cauchy_mu:double cauchy_rho:double")
def circular_mle(spark, sf):
    return X.circular_mle(directions(spark, sf), "bearings", ("run_id",))


@query("run_id n mu:double rho:double normal_sd:double cauchy_scale:double")
def circular_fit(spark, sf):
    return X.circular_fit(directions(spark, sf), "bearings", ("run_id",))


@query("run_id bin theta:double density:double")
def circular_density(spark, sf):
    return X.circular_density(directions(spark, sf), "bearings", 90, ("run_id",))


@query("run_id normal_error:double cauchy_error:double")
def circular_fit_error(spark, sf):
    rows = directions(spark, sf)
    fit = X.circular_fit(rows, "bearings", ("run_id",))
    return X.fit_error(X.circular_density(rows, "bearings", 90, ("run_id",)), fit, ("run_id",))


@query("run_id id clustered")
def agents_with_clustered(spark, sf):
    """Every agent with its number of clustered samples; missing for agents that never were in a cluster."""
    samples = tracks(spark, sf)
    clustered = samples.where("cluster_id <> 0").groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("clustered"))
    return clustered.join(samples.select("run_id", "id").distinct(), ["run_id", "id"], "right")


@query("run_id samples folder:string label:string")
def run_names(spark, sf):
    """Names of a run's files: a folder put together from its number, and the label without what precedes it."""
    folder = F.concat(F.lit("data/run-"), F.col("run_id").cast("string"), F.lit("/"))
    counted = tracks(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("samples")).withColumn("folder", folder)
    return counted.withColumn("label", F.regexp_replace("folder", "^data/run-([0-9]+)/$", "run $1"))


# --- population -----------------------------------------------------------------------

AGENTS = "run_id id x:double y:double vx:double vy:double"


def agents(spark, sf):
    return tracks(spark, sf).select("run_id", "id").distinct()


@query(AGENTS)
def random_start(spark, sf):
    return P.start(agents(spark, sf), FLOCK)


@query(AGENTS)
def circle_start(spark, sf):
    return P.start(agents(spark, sf), FLOCK, "CircleCircumferenceIn")


SAMPLED = "run_id id time x:double y:double"


@query(SAMPLED)
def insert_agents(spark, sf):
    """Samples outside clusters enter again as samples of new agents."""
    samples = tracks(spark, sf)
    loose = samples.where("cluster_id = 0").withColumn("id", F.col("id") + 1000000)
    return P.insert(samples.where("cluster_id <> 0"), loose)


@query(SAMPLED)
def delete_agents(spark, sf):
    """Agents whose latest sample is noise leave."""
    samples = tracks(spark, sf)
    latest = samples.groupBy("run_id", "id").agg(F.max_by("cluster_id", "time").alias("c"))
    return P.delete(samples, latest.where("c = 0").select("run_id", "id"))


@query(SAMPLED)
def delete_last_agent(spark, sf):
    return P.delete_last(tracks(spark, sf))


@query(SAMPLED)
def double_population(spark, sf):
    return P.duplicate(tracks(spark, sf))


@query(SAMPLED)
def halve_population(spark, sf):
    return P.halve(tracks(spark, sf))


@query("id time x:double y:double dist:double")
def click_select(spark, sf):
    """A click picks one agent of the shown frame: the limit is the feature."""
    return P.select_at(K.time_page(tracks(spark, sf), 10), 3.0, -40.0, 15.0)


# --- recordings, replay, streams ------------------------------------------------------


@query("extent_x extent_y agents last_time first_time")
def world_extent(spark, sf):
    return M.world_extent(tracks(spark, sf))


@query("run_id time agents expected complete:boolean")
def replay_validate(spark, sf):
    return IO.check_samples(tracks(spark, sf))


@query("id x:double y:double vx:double vy:double trail_length")
def replay_frame(spark, sf):
    samples = tracks(spark, sf)
    head = replay.Playhead.over(samples, at=20).forward()
    # only the frames that the shown one needs go through the windows
    shown = head.frame(replay.moving_samples(head.window(samples), WORLD, rescale=0.5))
    return shown.withColumn("trail_length", F.size("trail"))


@query("run_id id time x:double y:double dx:double dy:double")
def replay_stream(spark, sf):
    source = replay.stream_recordings(spark, f"{sf}/events.parquet", EVENTS)
    return replay.run_to_table(replay.stream_steps(positions(source), WORLD), spark, "replay")


def recorded(spark, sf):
    return tracks(spark, sf).withColumn("n_neighbours", F.lit(0).cast("long"))


@query("run_id id time x:double y:double cluster_id")
def recorder_round_trip(spark, sf):
    path = f"{shared_dir(spark)}/recording-{uuid.uuid4().hex}"
    IO.write_samples(recorded(spark, sf), path)
    return IO.read_samples(spark, path)


@query("run_id id time dx:double dy:double")
def preprocessed_round_trip(spark, sf):
    path = f"{shared_dir(spark)}/preprocessed-{uuid.uuid4().hex}"
    IO.write_preprocessed(recorded(spark, sf), WORLD, path)
    return IO.read_preprocessed(spark, path)


@query("run_name:string prepared:boolean run_id id time x:double y:double dx:double dy:double")
def recordings_read_back(spark, sf):
    """A folder with a raw recording of every run and a prepared one of the even runs, read as runs."""
    folder = f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex}"
    samples = recorded(spark, sf)
    IO.write_recordings(samples, folder, F.format_string(f"{IO.FILE_STEM}_%d.csv", "run_id"))
    prepared = K.preprocess(samples.where(F.col("run_id") % 2 == 0), WORLD)
    name = F.format_string(f"{IO.PREPROCESSED_PREFIX}{IO.FILE_STEM}_%d.csv", "run_id")
    IO.write_recordings(prepared, folder, name, mode="append")
    return IO.recordings(spark, folder, WORLD)


@query("event_id name:string boundary:string strength:double")
def config_json(spark, sf):
    """Tagged boundary settings per event, written and parsed as JSON."""
    kind = F.when(F.col("event_type") == "error", "Repulsive").otherwise("Toroidal")
    tagged = F.to_json(F.struct(kind.alias("type"), F.col("value").alias("distance"), F.lit(0.05).alias("force")))
    parsed = read_events(spark, sf).withColumn("b", parse_boundary(tagged))
    return parsed.select(
        "event_id",
        IO.recording_name(F.col("ts")).alias("name"),
        F.col("b.type").alias("boundary"),
        (F.col("b.distance") * F.col("b.force")).alias("strength"),
    )
