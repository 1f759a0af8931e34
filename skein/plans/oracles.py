"""DuckDB twins of the catalogue, written straight from the definitions."""

from __future__ import annotations

from skein.plans.queries import CATALOGUE, FLOCK, WANDERING
from skein.plans.shape import rounded, shape_sql
from skein.sources.events import RUNS

PI = "pi()"
TURN = "(2 * pi())"
HALF, SIZE = 50, 100

TRACK = """track AS (
  SELECT user_id % 5 AS run_id, user_id AS id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "time",
         CAST(props->>'k' AS DOUBLE) - 50 AS x,
         CAST(CAST(floor(value) AS BIGINT) % 100 AS DOUBLE) - 50 AS y,
         CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
                         WHEN 'signup' THEN 3 ELSE 4 END AS cluster_id
  FROM events)"""


def tor(d: str) -> str:
    return (
        f"(CASE WHEN abs({d}) > {HALF} THEN ({d}) + CASE WHEN ({d}) < 0 THEN {SIZE} ELSE -{SIZE} END "
        f"ELSE ({d}) END)"
    )


def pmod(a: str, b: str) -> str:
    return f"(CASE WHEN ({a}) % {b} < 0 THEN (({a}) % {b} + {b}) % {b} ELSE ({a}) % {b} END)"


def steps_cte(toroidal: bool = True, name: str = "steps") -> str:
    wrap = tor if toroidal else (lambda d: f"({d})")
    return f"""{name} AS (
  SELECT *, {wrap('x - px')} AS dx, {wrap('y - py')} AS dy
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM track
        WINDOW w AS (PARTITION BY id ORDER BY "time")))"""


HEADED = f"""headed AS (
  SELECT *, {pmod(f'atan2(dx, dy) + {PI}', TURN)} AS headings FROM steps WHERE dx IS NOT NULL)"""
DIRS = f"""dirs AS (
  SELECT *, {pmod(f'ph - headings + {PI}', TURN)} - {PI} AS bearings
  FROM (SELECT *, lag(headings) OVER (PARTITION BY id ORDER BY "time") AS ph FROM headed)
  WHERE ph IS NOT NULL)"""


def ctes(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


WITH_TRACK = ctes(TRACK)
WITH_STEPS = ctes(TRACK, steps_cte())
WITH_HEADED = ctes(TRACK, steps_cte(), HEADED)
DIR_PARTS = (TRACK, steps_cte(), HEADED, DIRS)
WITH_DIRS = ctes(*DIR_PARTS)

AFFECTED = """flagged AS (
  SELECT *, max(edge) OVER (PARTITION BY id ORDER BY "time" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit
  FROM (SELECT *, CASE WHEN abs(x) > 50 - 7 OR abs(y) > 50 - 7 THEN 1 ELSE 0 END AS edge FROM track))"""


def moving(tau: int) -> str:
    return f"""ma AS (
  SELECT *, CASE WHEN count(*) OVER w = {tau} THEN avg(bearings) OVER w END AS bearing_ma,
            CASE WHEN count(*) OVER w = {tau} THEN avg(headings) OVER w END AS heading_ma
  FROM dirs WINDOW w AS (PARTITION BY id ORDER BY "time" ROWS BETWEEN {tau - 1} PRECEDING AND CURRENT ROW))"""


V1 = "sqrt(sum(dx)^2 + sum(dy)^2) / nullif(count(*) * sqrt((sum(abs(dx))/count(*))^2 + (sum(abs(dy))/count(*))^2), 0)"
V2 = "sqrt(sum(dx)^2 + sum(dy)^2) / nullif(sum(sqrt(dx*dx + dy*dy)), 0)"


def angle_bin(v: str, low: str, bins: int = 360) -> str:
    return f"CAST(ceil(round((({v}) - ({low})) / ({TURN} / {bins}), 9)) AS BIGINT)"


FACETED = """faceted AS (
  SELECT *, CAST(ceil(r / ceil(n / 6.0)) AS BIGINT) AS timeline_facet
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY "time" DESC, id DESC) AS r,
               count(*) OVER (PARTITION BY run_id) AS n FROM dirs))"""


def histogram(source: str, keys: str = "") -> str:
    k = keys + ", " if keys else ""
    using = f"USING ({k}bin)"
    groups = f"(SELECT DISTINCT {keys} FROM {source})" if keys else "(SELECT 1 AS one)"
    return f"""SELECT {k}bin, coalesce(h, 0) AS heading_count, coalesce(b, 0) AS bearing_count
  FROM (SELECT {keys or 'one'}, bin FROM {groups} g, (SELECT unnest(range(1, 361)) AS bin) bins) grid
  LEFT JOIN (SELECT {k}{angle_bin('headings', '0')} AS bin, count(*) AS h FROM {source} GROUP BY ALL) hs {using}
  LEFT JOIN (SELECT {k}{angle_bin('bearings', '-pi()')} AS bin, count(*) AS b FROM {source} GROUP BY ALL) bs {using}"""


SQL: dict[str, str] = {
    "track_samples": WITH_TRACK + "SELECT * FROM track",
    "toroidal_displacement": WITH_STEPS
    + "SELECT *, sqrt(dx*dx + dy*dy) AS step FROM steps WHERE dx IS NOT NULL",
    "plain_diff": ctes(TRACK, steps_cte(False)) + "SELECT * FROM steps WHERE dx IS NOT NULL",
    "preprocess_dxdy": WITH_STEPS
    + 'SELECT id, "time", x, y, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy, cluster_id FROM steps',
    "headings": WITH_HEADED + "SELECT * FROM headed",
    "bearings": WITH_DIRS + "SELECT * FROM dirs",
    "directional_data": WITH_DIRS + "SELECT * FROM dirs",
    "directional_data_enclosed": ctes(TRACK, steps_cte(False), HEADED, DIRS) + "SELECT * FROM dirs",
    "directional_boundary_free": ctes(*DIR_PARTS, AFFECTED)
    + 'SELECT dirs.* FROM dirs JOIN flagged USING (id, "time") WHERE hit = 0',
    "avg_norm_vel": WITH_DIRS
    + f'SELECT "time", {V1} AS avg_norm_vel FROM dirs WHERE cluster_id <> 0 GROUP BY 1',
    "avg_norm_vel2": WITH_DIRS
    + f'SELECT "time", {V2} AS avg_norm_vel FROM dirs WHERE cluster_id <> 0 GROUP BY 1',
    "avg_norm_vel2_with_noise": WITH_DIRS
    + f'SELECT "time", {V2} AS avg_norm_vel FROM dirs GROUP BY 1',
    "avg_norm_vel_by_cluster": WITH_DIRS
    + f'SELECT "time", cluster_id, {V1} AS avg_norm_vel FROM dirs WHERE cluster_id <> 0 GROUP BY 1, 2',
    "no_flocks": WITH_TRACK
    + 'SELECT "time", count(DISTINCT cluster_id) AS no_flocks FROM track WHERE cluster_id <> 0 GROUP BY 1',
    "first_n_flocks_time": WITH_TRACK
    + """SELECT flock_limit, min("time") AS first_time
  FROM (SELECT "time", count(DISTINCT CASE WHEN cluster_id <> 0 THEN cluster_id END) AS n FROM track GROUP BY 1),
       (SELECT unnest([0, 1, 2, 3, 4]) AS flock_limit) WHERE n <= flock_limit GROUP BY 1""",
    "curvature_order": WITH_DIRS
    + """SELECT "time", avg(turn_tau) AS rop FROM (
    SELECT "time", CASE WHEN count(turn) OVER w = 5 THEN sum(turn / 4.0) OVER w / 5 END AS turn_tau
    FROM (SELECT *, (dx*ny - dy*nx) / nullif(sqrt(dx*dx + dy*dy) * sqrt(nx*nx + ny*ny), 0) AS turn
          FROM (SELECT *, lead(dx) OVER l AS nx, lead(dy) OVER l AS ny FROM dirs
                WINDOW l AS (PARTITION BY id ORDER BY "time")))
    WINDOW w AS (PARTITION BY id ORDER BY "time" ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  WHERE turn_tau IS NOT NULL GROUP BY 1""",
    "bearing_moving_avg": ctes(*DIR_PARTS, moving(5))
    + "SELECT * FROM ma WHERE bearing_ma IS NOT NULL",
    "bearing_ma_noise_split": ctes(*DIR_PARTS, moving(5))
    + """SELECT *, printf('s_%d', run_id) AS label,
       16 * row_number() OVER (PARTITION BY run_id ORDER BY "time", noise) AS time_label
  FROM (SELECT run_id, "time", CASE WHEN cluster_id = 0 THEN 1 ELSE 0 END AS noise, avg(bearing_ma) AS bearing_ma
        FROM ma GROUP BY 1, 2, 3 HAVING count(*) = count(bearing_ma))""",
    "bearing_ma_by_cluster": ctes(*DIR_PARTS, moving(5))
    + """SELECT "time", cluster_id, avg(bearing_ma) AS bearing_ma FROM ma GROUP BY 1, 2
  HAVING count(*) = count(bearing_ma)""",
    "zscore_ma": ctes(*DIR_PARTS, moving(30))
    + """SELECT run_id, id, "time",
       (bearing_ma - avg(bearing_ma) OVER r) / stddev_samp(bearing_ma) OVER r AS bearing_ma,
       (heading_ma - avg(heading_ma) OVER r) / stddev_samp(heading_ma) OVER r AS heading_ma
  FROM ma WHERE bearing_ma IS NOT NULL WINDOW r AS (PARTITION BY run_id)""",
    "min_max_velocity": WITH_DIRS
    + f"""SELECT run_id, "time", (v - min(v) OVER r) / nullif(max(v) OVER r - min(v) OVER r, 0) AS avg_norm_vel
  FROM (SELECT run_id, "time", {V2} AS v FROM dirs WHERE cluster_id <> 0 GROUP BY 1, 2)
  WINDOW r AS (PARTITION BY run_id)""",
    "directional_histogram": WITH_DIRS + histogram("dirs"),
    "degree_histogram": WITH_DIRS
    + """SELECT 'floor' AS kind, floor(round(degrees(headings), 9)) AS degree, count(*) AS n FROM dirs GROUP BY 1, 2
  UNION ALL SELECT 'round', round(round(degrees(headings), 9)), count(*) FROM dirs GROUP BY 1, 2""",
    "timeline_facets": ctes(*DIR_PARTS, FACETED) + "SELECT * FROM faceted",
    "facet_direction_counts": ctes(*DIR_PARTS, FACETED)
    + histogram("faceted", "timeline_facet, run_id"),
    "time_bin_headings": WITH_DIRS
    + """SELECT CAST(floor(("time" - 1) / 4.0) * 4 + 1 AS BIGINT) AS time_bin,
       floor(round(degrees(headings), 9)) AS degree, count(*) AS n FROM dirs GROUP BY 1, 2""",
    "boundary_rows": WITH_TRACK + "SELECT * FROM track WHERE abs(x) > 50 - 7 OR abs(y) > 50 - 7",
    "boundary_clean_tracks": ctes(TRACK, AFFECTED) + "SELECT * FROM flagged WHERE hit = 0",
    "boundary_share": ctes(TRACK, AFFECTED)
    + "SELECT count(*) AS rows, avg(edge) AS boundary_share, avg(hit) AS affected_share FROM flagged",
    "subsample_tracks": WITH_TRACK
    + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY "time", id) AS row FROM track)
  WHERE (row - 2) % 3 = 0 AND row >= 2""",
    "time_page": WITH_TRACK + 'SELECT * FROM track WHERE "time" = 10',
    "time_range": WITH_TRACK + 'SELECT * FROM track WHERE "time" >= 10 AND "time" < 20',
    "track_segments": ctes(TRACK, steps_cte())
    + """SELECT id, "time", sum(crossed) OVER w AS segment,
       max(CASE WHEN crossed = 1 THEN "time" END) OVER w AS last_crossing
  FROM (SELECT *, CASE WHEN (dx - (x - px))^2 + (dy - (y - py))^2 > 0.00025 THEN 1 ELSE 0 END AS crossed FROM steps)
  WINDOW w AS (PARTITION BY id ORDER BY "time" ROWS UNBOUNDED PRECEDING)""",
    "cumulative_path": WITH_DIRS
    + """SELECT id, "time", sum(cos(bearings)) OVER w AS path_x, sum(sin(bearings)) OVER w AS path_y
  FROM dirs WINDOW w AS (PARTITION BY id ORDER BY "time" ROWS UNBOUNDED PRECEDING)""",
    "trails": WITH_TRACK
    + """SELECT id, "time", count(*) OVER w AS trail_length, sum(x) OVER w AS trail_x, sum(y) OVER w AS trail_y
  FROM track WINDOW w AS (PARTITION BY id ORDER BY "time" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
}



CLOUD = """cloud AS (
  SELECT 0 AS "time", vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS x,
         CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings)"""


def near_cte(
    source: str = "track", radius: float = 7, toroidal: bool = True, less: str = "<=", name: str = "near"
) -> str:
    wrap = tor if toroidal else (lambda d: f"({d})")
    return f"""{name} AS (
  SELECT *, sqrt(ox*ox + oy*oy) AS dist
  FROM (SELECT a.*, b.id AS id2, {wrap('b.x - a.x')} AS ox, {wrap('b.y - a.y')} AS oy
        FROM {source} a JOIN {source} b ON a."time" = b."time" AND a.id <> b.id)
  WHERE ox*ox + oy*oy {less} {radius * radius})"""


def labels_cte(source: str, min_pts: int) -> str:
    """Reachability among core agents, then the smallest core agent; border takes the largest."""
    return f"""core AS (
  SELECT "time", id FROM {source} LEFT JOIN (SELECT "time", id, count(*) AS deg FROM near GROUP BY 1, 2) d
  USING ("time", id) WHERE coalesce(deg, 0) + 1 >= {min_pts}),
links AS (
  SELECT n."time", n.id, n.id2 FROM near n
  JOIN core a ON a."time" = n."time" AND a.id = n.id JOIN core b ON b."time" = n."time" AND b.id = n.id2),
reach AS (
  SELECT "time", id, id AS seen FROM core
  UNION SELECT r."time", r.id, l.id2 FROM reach r JOIN links l ON l."time" = r."time" AND l.id = r.seen),
core_label AS (SELECT "time", id, min(seen) + 1 AS label FROM reach GROUP BY 1, 2),
border AS (
  SELECT n."time", n.id, max(c.label) AS label FROM near n JOIN core_label c ON c."time" = n."time" AND c.id = n.id2
  WHERE (n."time", n.id) NOT IN (SELECT ("time", id) FROM core) GROUP BY 1, 2),
labels AS (
  SELECT t."time", t.id, coalesce(c.label, b.label, 0) AS cluster_id FROM {source} t
  LEFT JOIN core_label c ON c."time" = t."time" AND c.id = t.id
  LEFT JOIN border b ON b."time" = t."time" AND b.id = t.id)"""


def unit(x: str, y: str) -> tuple[str, str]:
    n = f"sqrt({x}*{x} + {y}*{y})"
    return f"{x} / {n}", f"{y} / {n}"


def seen(degrees: float, v: tuple[str, str] = ("dx", "dy"), o: tuple[str, str] = ("ox", "oy")) -> str:
    (vx, vy), (ux, uy) = unit(*v), unit(*o)
    return (
        f"({o[0]}*{o[0]} + {o[1]}*{o[1]} >= 1e-4 AND {v[0]}*{v[0]} + {v[1]}*{v[1]} > 0 "
        f"AND ({vx}) * ({ux}) + ({vy}) * ({uy}) > cos({degrees} * 0.5 * pi() / 180))"
    )


MOVING = "moving AS (SELECT * FROM steps WHERE dx IS NOT NULL)"

SQL |= {
    "neighbours_toroidal": ctes(TRACK, near_cte()) + "SELECT * FROM near",
    "neighbours_enclosed": ctes(TRACK, near_cte(toroidal=False)) + "SELECT * FROM near",
    "neighbours_strict": ctes(TRACK, near_cte(less="<")) + "SELECT * FROM near",
    "point_cloud_neighbours": ctes(CLOUD, near_cte("cloud", 3, False)) + "SELECT * FROM near",
    "neighbour_counts": ctes(TRACK, near_cte())
    + """SELECT "time", id, coalesce(n, 0) AS n_neighbours FROM track
  LEFT JOIN (SELECT "time", id, count(*) AS n FROM near GROUP BY 1, 2) c USING ("time", id)""",
    "fov_neighbours": ctes(TRACK, steps_cte(), MOVING, near_cte("moving"))
    + f"SELECT * FROM near WHERE {seen(280)}",
    "capped_neighbours": ctes(TRACK, near_cte())
    + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "time", id ORDER BY dist, id2) AS rank FROM near)
  WHERE rank <= 3""",
    "dbscan_labels": ctes(TRACK, near_cte(), labels_cte("track", 3), recursive=True)
    + "SELECT * FROM labels",
    "cluster_sizes": ctes(TRACK, near_cte(), labels_cte("track", 3), recursive=True)
    + 'SELECT "time", cluster_id, count(*) AS agents FROM labels GROUP BY 1, 2',
    "components": ctes(TRACK, near_cte(), labels_cte("track", 1), recursive=True)
    + 'SELECT "time", id, cluster_id - 1 AS component FROM labels',
    "point_cloud_dbscan": ctes(CLOUD, near_cte("cloud", 2.5, False), labels_cte("cloud", 3), recursive=True)
    + "SELECT * FROM labels",
}



def noise(tick: int, salt: int, seed: int = 42) -> str:
    m = 2147483648
    first = f"((id % {m}) * 1103515245 + {(tick * 7919 + salt * 104729 + seed) % m}) % {m}"
    return f"((({first}) * 1103515245 + 12345) % {m} / {m}.0)"


def tick_ctes(source: str, config, tick: int, frame: str = '"time"', name: str = "t") -> list[str]:
    """One tick over ``source`` (frame, id, x, y, vx, vy, ax, ay, wander), as CTE ``name``_out."""
    wrap = tor if config.distance == "EucToroidal" else (lambda d: f"({d})")
    look, r2 = config.sensory_distance, config.reach**2
    view = (
        "true" if config.field_of_vision == 360 else seen(config.field_of_vision, ("vx", "vy"))
    )
    cap = config.neighbours_considered
    capped = (
        f'QUALIFY row_number() OVER (PARTITION BY {frame}, id ORDER BY d, id2) <= {cap}' if cap else ""
    )
    pairs = f"""{name}_pairs AS (
  SELECT *, sqrt(ox*ox + oy*oy) AS d
  FROM (SELECT a.*, b.id AS id2, b.vx AS vx2, b.vy AS vy2, {wrap('b.x - a.x')} AS ox, {wrap('b.y - a.y')} AS oy
        FROM {source} a JOIN {source} b ON a.{frame} = b.{frame} AND a.id <> b.id)
  WHERE ox*ox + oy*oy <= {r2} {capped})"""

    def some(trs: float, apart: bool = True) -> str:
        return f"{view} AND d < {look * trs}" + (" AND d > 0" if apart else "")

    sep, coh = some(config.separation_trs_coef), some(config.cohesion_trs_coef)
    ali = some(config.alignment_trs_coef, False)
    sums = f"""{name}_sums AS (
  SELECT s.*, coalesce(n_neighbours, 0) AS n_neighbours, coalesce(sep_n, 0) AS sep_n, coalesce(coh_n, 0) AS coh_n,
         coalesce(ali_n, 0) AS ali_n, coalesce(sep_x, 0) AS sep_dx, coalesce(sep_y, 0) AS sep_dy,
         coalesce(coh_x, 0) AS coh_dx, coalesce(coh_y, 0) AS coh_dy,
         coalesce(ali_x, 0) AS ali_dx, coalesce(ali_y, 0) AS ali_dy
  FROM {source} s LEFT JOIN (
    SELECT {frame}, id, count(*) AS n_neighbours,
           count(*) FILTER ({sep}) AS sep_n, count(*) FILTER ({coh}) AS coh_n, count(*) FILTER ({ali}) AS ali_n,
           avg(-ox / (d * d)) FILTER ({sep}) AS sep_x, avg(-oy / (d * d)) FILTER ({sep}) AS sep_y,
           avg(ox) FILTER ({coh}) AS coh_x, avg(oy) FILTER ({coh}) AS coh_y,
           avg(vx2) FILTER ({ali}) AS ali_x, avg(vy2) FILTER ({ali}) AS ali_y
    FROM {name}_pairs GROUP BY 1, 2) p USING ({frame}, id))"""
    wandering = config.wander_on and config.wander_rate
    h = "nullif(sqrt(vx*vx + vy*vy), 0)"
    hx, hy = f"coalesce(vx / {h}, 0)", f"coalesce(vy / {h}, 0)"
    if config.noise_model == "Vicsek":
        wx = f"{hx} * cos(wander) - {hy} * sin(wander)"
        wy = f"{hy} * cos(wander) + {hx} * sin(wander)"
    else:
        r, dist = config.wander_radius, config.wander_distance
        wx = f"{hx} * {dist} * sqrt(2) + {r} * ({hx} * cos(wander) - {hy} * sin(wander))"
        wy = f"{hy} * {dist} * sqrt(2) + {r} * ({hy} * cos(wander) + {hx} * sin(wander))"
    aims = f"""{name}_aims AS (
  SELECT *, {wx if wandering else 0} AS wan_dx, {wy if wandering else 0} AS wan_dy,
         {wrap(f'{config.seek_x} - x') if config.seek_x is not None else 0} AS seek_dx,
         {wrap(f'{config.seek_y} - y') if config.seek_y is not None else 0} AS seek_dy
  FROM {name}_sums)"""
    names = ("sep", "coh", "ali", "wan", "seek")
    top, lim = config.max_speed, config.max_steering
    cols, cols2 = [], []
    for n in names:
        length = f"sqrt({n}_dx*{n}_dx + {n}_dy*{n}_dy)"
        for a in "xy":
            if config.agent_steering:
                cols.append(f"CASE WHEN {length} > 0 THEN {n}_d{a} / {length} * {top} - v{a} END AS {n}_g{a}")
            elif n == "ali":
                cols.append(f"{n}_d{a} AS {n}_g{a}")
            else:
                cols.append(f"CASE WHEN {length} > 0 THEN {n}_d{a} / {length} END AS {n}_g{a}")
        turn = f"sqrt({n}_gx*{n}_gx + {n}_gy*{n}_gy)"
        for a in "xy":
            g = f"{n}_g{a}"
            limited = f"CASE WHEN {turn} > {lim} THEN {g} / {turn} * {lim} ELSE {g} END" if config.agent_steering else g
            cols2.append(f"coalesce({limited}, 0) AS {n}_p{a}")
    goals = f"{name}_goals AS (SELECT *, {', '.join(cols)} FROM {name}_aims)"
    raw = f"{name}_raw AS (SELECT *, {', '.join(cols2)} FROM {name}_goals)"
    weights = {"sep": config.separation_coef, "coh": config.cohesion_coef, "ali": config.alignment_coef,
               "wan": config.wander_coef if wandering else 0.0}
    rules = f"""{name}_rules AS (SELECT * REPLACE ({', '.join(
        f"{n}_p{a} * {w} AS {n}_p{a}" for n, w in weights.items() for a in 'xy')}) FROM {name}_raw)"""
    yields = "CASE WHEN sep_px = 0 AND sep_py = 0 THEN coh_p{a} ELSE 0 END" if config.cohesion_yields else "coh_p{a}"

    def force(a: str) -> str:
        if config.seek_x is not None:
            return f"seek_p{a}"
        return f"sep_p{a} + {yields.format(a=a)} + ali_p{a} + wan_p{a}"

    u = f"({noise(tick, 1, config.seed)} * 2 - 1) * {config.wander_rate} * pi()"
    w2 = (u if config.noise_model == "Vicsek" else f"(wander + {u}) % (2 * pi())") if wandering else "wander"
    pushed = f"""{name}_pushed AS (
  SELECT * REPLACE (vx + ax + {force('x')} AS vx, vy + ay + {force('y')} AS vy, {w2} AS wander) FROM {name}_rules)"""
    n = "sqrt(vx*vx + vy*vy)"

    def held(a: str, salt: int) -> str:
        return (
            f"CASE WHEN vx = 0 AND vy = 0 THEN ({noise(tick, salt, config.seed)} * 2 - 1) * {top} "
            f"WHEN {n} > {top} THEN v{a} / {n} * {top} WHEN {n} < {config.min_speed} "
            f"THEN v{a} / {n} * {config.min_speed} ELSE v{a} END"
        )

    paced = f"{name}_paced AS (SELECT * REPLACE ({held('x', 2)} AS vx, {held('y', 3)} AS vy) FROM {name}_pushed)"
    b = 0 if config.stop_movement else config.baseline_speed
    moved = f"""{name}_moved AS (
  SELECT * REPLACE (x + vx * {b} AS x, y + vy * {b} AS y, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay) FROM {name}_paced)"""
    edge = []
    for a in "xy":
        if config.boundary == "Toroidal":
            edge.append(f"CASE WHEN {a} < -50 THEN {a} + 100 WHEN {a} > 50 THEN {a} - 100 ELSE {a} END AS {a}")
        elif config.boundary == "Absorbing":
            edge.append(f"least(greatest({a}, -50), 50) AS {a}")
            edge.append(f"CASE WHEN {a} < -50 OR {a} > 50 THEN 0 ELSE v{a} END AS v{a}")
        elif config.boundary == "Reflective":
            edge.append(f"CASE WHEN ({a} < -50 AND v{a} < 0) OR ({a} > 50 AND v{a} > 0) THEN -v{a} ELSE v{a} END AS v{a}")
        else:
            m, k = config.boundary_distance, config.boundary_force
            edge.append(f"CASE WHEN {a} < -50 + {m} THEN {k} WHEN {a} > 50 - {m} THEN -{k} ELSE 0 END AS a{a}")
    out = f"{name}_out AS (SELECT * REPLACE ({', '.join(edge)}) FROM {name}_moved)"
    return [pairs, sums, aims, goals, raw, rules, pushed, paced, moved, out]


STATE = """state AS (
  SELECT run_id, id, "time", x, y, dx AS vx, dy AS vy, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS wander
  FROM steps WHERE dx IS NOT NULL)"""
START = """start AS (SELECT * EXCLUDE ("time") FROM state WHERE "time" = 2)"""
STATE_FIELDS = "run_id, id, x, y, vx, vy, ax, ay, wander"


def one_tick(**changes) -> str:
    config = FLOCK.overwrite(**changes)
    return ctes(TRACK, steps_cte(), STATE, *tick_ctes("state", config, 1)) + "SELECT * FROM t_out"


def simulated(config, ticks: int) -> tuple[list[str], str]:
    parts, source, samples = [TRACK, steps_cte(), STATE, START], "start", []
    for k in range(1, ticks + 1):
        parts += tick_ctes(source, config, k, "run_id", f"k{k}")
        parts.append(f"s{k} AS MATERIALIZED (SELECT {STATE_FIELDS}, n_neighbours FROM k{k}_out)")
        parts.append(f"n{k} AS (SELECT {STATE_FIELDS} FROM s{k})")
        source = f"n{k}"
        if k % config.sample_rate == 0:
            samples.append(f'SELECT *, {k // config.sample_rate} AS "time", 0 AS cluster_id FROM s{k}')
    return parts, " UNION ALL ".join(samples)


def _simulate_runs() -> str:
    parts, last = simulated(FLOCK.overwrite(**WANDERING, sample_rate=2), 4)
    return ctes(*parts) + last


SQL |= {
    "rule_separation": ctes(TRACK, steps_cte(), STATE, *tick_ctes("state", FLOCK, 1)) + "SELECT * FROM t_rules",
    "rule_cohesion": ctes(TRACK, steps_cte(), STATE, *tick_ctes("state", FLOCK, 1)) + "SELECT * FROM t_rules",
    "rule_alignment": ctes(TRACK, steps_cte(), STATE, *tick_ctes("state", FLOCK, 1)) + "SELECT * FROM t_rules",
    "tick_toroidal": one_tick(),
    "tick_absorbing": one_tick(boundary="Absorbing", distance="EucEnclosed"),
    "tick_reflective": one_tick(boundary="Reflective", distance="EucEnclosed"),
    "tick_repulsive": one_tick(
        boundary="Repulsive", boundary_distance=10.0, boundary_force=0.05, distance="EucEnclosed"
    ),
    "tick_full_view": one_tick(field_of_vision=360.0),
    "tick_unsteered": one_tick(agent_steering=False),
    "tick_cohesion_yields": one_tick(cohesion_yields=True),
    "tick_capped": one_tick(neighbours_considered=3),
    "tick_wander_reynolds": one_tick(**WANDERING),
    "tick_wander_vicsek": one_tick(**WANDERING, noise_model="Vicsek"),
    "tick_seek": one_tick(seek_x=10.0, seek_y=-45.0),
    "tick_without_motion": one_tick(stop_movement=True),
    "marked_neighbours": ctes(TRACK, near_cte())
    + """SELECT t."time", t.id, n.id IS NOT NULL AS marked FROM track t
  LEFT JOIN near n ON n."time" = t."time" AND n.id2 = t.id AND n.id = 7""",
    "simulate_runs": _simulate_runs(),
}



def knn_cte(k: int, source: str = "track") -> str:
    return f"""knn AS MATERIALIZED (
  SELECT *, sqrt(d2) AS dist FROM (
    SELECT *, row_number() OVER (PARTITION BY "time", id ORDER BY d2, id2) AS rank FROM (
      SELECT a."time", a.id, b.id AS id2, (b.x - a.x)^2 + (b.y - a.y)^2 AS d2,
             (b.x - a.x) * 10 AS push_x, (b.y - a.y) * 10 AS push_y
      FROM {source} a JOIN {source} b ON a."time" = b."time" AND a.id <> b.id))
  WHERE rank <= {k})"""


def hull_ctes(source: str, by: str) -> tuple[str, ...]:
    """An edge is on the hull when nothing lies right of it or beyond its ends on its line."""
    on = " AND ".join(f"{{a}}.{c} = {{b}}.{c}" for c in by.split(", "))
    cross = "(b.x - a.x) * (r.y - a.y) - (b.y - a.y) * (r.x - a.x)"
    outside = "(r.x - a.x) * (r.x - b.x) + (r.y - a.y) * (r.y - b.y) > 0"
    keys = ", ".join(f"a.{c}" for c in by.split(", "))
    return (
        f"spots AS (SELECT DISTINCT {by}, x, y FROM {source})",
        f"""edges AS (
  SELECT {keys}, a.x * b.y - b.x * a.y AS part
  FROM spots a JOIN spots b ON {on.format(a='a', b='b')} AND (a.x <> b.x OR a.y <> b.y)
  JOIN spots r ON {on.format(a='a', b='r')}
  GROUP BY {keys}, a.x, a.y, b.x, b.y
  HAVING min({cross}) >= 0 AND count(*) FILTER ({cross} = 0 AND {outside}) = 0)""",
        f"""hulls AS (
  SELECT {by}, coalesce(area, 0) AS hull_area
  FROM (SELECT {by} FROM {source} GROUP BY {by} HAVING count(*) > 2) g
  LEFT JOIN (SELECT {by}, sum(part) / 2 AS area FROM edges GROUP BY {by}) e USING ({by}))""",
    )


FLOCKED = "flocked AS (SELECT * FROM track WHERE cluster_id <> 0)"
CLOUD_LABELLED = """clouds AS (
  SELECT label AS cluster_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y
  FROM embeddings)"""
MEASURES = (
    *DIR_PARTS,
    "flying AS (SELECT * FROM dirs WHERE cluster_id <> 0)",
    *hull_ctes("flying", 'run_id, "time", cluster_id'),
    f"""measures AS (
  SELECT run_id, "time", average_norm_vel, average_norm_vel2, no_flocks, convex_hull FROM (
    SELECT run_id, "time", {V1} AS average_norm_vel, {V2} AS average_norm_vel2,
           nullif(count(DISTINCT cluster_id) FILTER (cluster_id <> 0), 0) AS no_flocks FROM dirs GROUP BY 1, 2) v
  LEFT JOIN (SELECT run_id, "time", avg(hull_area) AS convex_hull FROM hulls GROUP BY 1, 2) h
  USING (run_id, "time"))""",
)
METRICS = ("average_norm_vel", "average_norm_vel2", "no_flocks", "convex_hull")


def across(metric: str) -> str:
    whole = f"CASE WHEN count({metric}) = (SELECT count(DISTINCT run_id) FROM measures) THEN"
    return f"{whole} avg({metric}) END AS mean_{metric}, {whole} var_samp({metric}) END AS var_{metric}"


BY_RUN = f"""v AS (SELECT run_id, "time", {V2} AS avg_norm_vel FROM dirs GROUP BY 1, 2)"""
WITH_V = ctes(*DIR_PARTS, BY_RUN)


def change_cte(kind: str, source: str = "v", key: str = "run_id", seq: str = '"time"', value: str = "avg_norm_vel") -> str:
    """Left and right of every split by window sums; the best split, the earliest on ties."""
    if kind == "mean":
        gain, ok = "k * (n - k) / n * (ls / k - (ts - ls) / (n - k))^2", "k < n"
    else:
        rest = "(tq - lq)"
        ok = f"k >= 2 AND k <= n - 2 AND lq > 1e-12 AND {rest} > 1e-12"
        gain = f"n * ln(tq / n) - k * ln(lq / k) - (n - k) * ln({rest} / (n - k))"
    return f"""change_{kind} AS (
  SELECT {key}, {seq} AS change_point, gain, n, tq FROM (
    SELECT {key}, {seq}, n, tq, round({gain}, 9) AS gain FROM (
      SELECT *, CAST(row_number() OVER w AS DOUBLE) AS k, sum({value}) OVER w AS ls, sum(d * d) OVER w AS lq
      FROM (SELECT v.*, {value} - mu AS d, n, ts, tq FROM {source} v JOIN (
              SELECT {key}, mu, n, ts, sum(({value} - mu)^2) AS tq FROM {source} JOIN (
                SELECT {key}, avg({value}) AS mu, CAST(count(*) AS DOUBLE) AS n, sum({value}) AS ts
                FROM {source} GROUP BY 1) m USING ({key}) GROUP BY ALL) t USING ({key}))
      WINDOW w AS (PARTITION BY {key} ORDER BY {seq} ROWS UNBOUNDED PRECEDING))
    WHERE {ok})
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, change_point) = 1)"""


def _stats_change_points() -> str:
    columns = [f"{v}_{m}" for m in METRICS for v in ("mean", "var")]
    wide = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    measured = ", ".join(across(m) for m in METRICS)
    level = "regexp_matches(series, 'no_flocks|convex_hull')"
    decided = """SELECT series, n, statistic, CASE WHEN statistic > 3 * ln(n) THEN change_point END AS change_point FROM (
    SELECT s.series, s.n, c.change_point,
           coalesce(CASE WHEN s.tq > 1e-12 THEN {statistic} END, 0) AS statistic
    FROM (SELECT series, count(*) AS n, sum((value - mu)^2) AS tq
          FROM {source} JOIN (SELECT series, avg(value) AS mu FROM {source} GROUP BY 1) USING (series) GROUP BY 1) s
    LEFT JOIN change_{kind} c USING (series))"""
    by_mean = """CASE WHEN c.gain > 0 THEN CASE WHEN s.tq - c.gain > 1e-12 * s.tq THEN s.n * ln(s.tq / (s.tq - c.gain))
      ELSE CAST('inf' AS DOUBLE) END END"""
    return ctes(
        *MEASURES,
        f'results AS (SELECT 16 * "time" AS t, {measured} FROM measures GROUP BY "time")',
        f"long AS (FROM (SELECT t, {wide} FROM results) UNPIVOT (value FOR series IN ({', '.join(columns)})))",
        f"levels AS (SELECT * FROM long WHERE {level})",
        f"spreads AS (SELECT * FROM long WHERE NOT {level})",
        change_cte("mean", "levels", "series", "t", "value"),
        change_cte("var", "spreads", "series", "t", "value"),
    ) + " UNION ALL ".join(
        [
            decided.format(statistic=by_mean, source="levels", kind="mean"),
            decided.format(statistic="c.gain", source="spreads", kind="var"),
        ]
    )


def _circular_mle() -> str:
    """The wrapped Cauchy law by its fixed point, the wrapped normal one by Newton steps on all angles."""

    def series(weight: str, wave: str) -> str:
        return f"2 * list_sum(list_transform(range(1, 25), lambda p: {weight} * rho^(p * p) * {wave}(p * z)))"

    return ctes(
        *DIR_PARTS,
        """start AS (
  SELECT run_id, count(*) AS n, atan2(avg(sin(bearings)), avg(cos(bearings))) AS mu,
         sqrt(avg(cos(bearings))^2 + avg(sin(bearings))^2) AS rho FROM dirs GROUP BY 1)""",
        """angles AS MATERIALIZED (SELECT run_id, bearings FROM dirs)""",
        """cauchy AS (
  SELECT 0 AS step, run_id, rho * cos(mu) AS p, rho * sin(mu) AS q FROM start
  UNION ALL
  SELECT step + 1, run_id, sum(cos(bearings) / (1 - p * cos(bearings) - q * sin(bearings))) / sum(1 / (1 - p * cos(bearings) - q * sin(bearings))),
         sum(sin(bearings) / (1 - p * cos(bearings) - q * sin(bearings))) / sum(1 / (1 - p * cos(bearings) - q * sin(bearings)))
  FROM cauchy JOIN angles USING (run_id) WHERE step < 80 GROUP BY step, run_id)""",
        f"""normal AS (
  SELECT 0 AS step, run_id, mu, rho FROM start
  UNION ALL
  SELECT step + 1, run_id, mu + greatest(-0.2, least(0.2, (hrr * gm - hmr * gr) / det)),
         greatest(1e-6, least(0.98, rho + greatest(-0.2, least(0.2, (hmm * gr - hmr * gm) / det)))) FROM (
    SELECT *, hmm * hrr - hmr * hmr AS det FROM (
      SELECT step, run_id, mu, rho, sum(fm / f) AS gm, sum(fr / f) AS gr, sum((fm / f)^2 - fmm / f) AS hmm,
             sum(fm / f * fr / f - fmr / f) AS hmr, sum((fr / f)^2 - frr / f) AS hrr FROM (
        SELECT step, run_id, mu, rho, 1 + {series('1', 'cos')} AS f, {series('p', 'sin')} AS fm,
               {series('p * p', 'cos')} / rho AS fr, -{series('p * p', 'cos')} AS fmm,
               {series('p * p * p', 'sin')} / rho AS fmr, {series('p * p * (p * p - 1)', 'cos')} / rho^2 AS frr
        FROM (SELECT step, run_id, mu, rho, bearings - mu AS z FROM normal JOIN angles USING (run_id) WHERE step < 14))
      GROUP BY step, run_id, mu, rho)))""",
        recursive=True,
    ) + """SELECT run_id, s.n, atan2(sin(o.mu), cos(o.mu)) AS normal_mu, o.rho AS normal_rho, atan2(q, p) AS cauchy_mu,
       (1 - sqrt(1 - p * p - q * q)) / sqrt(p * p + q * q) AS cauchy_rho
  FROM start s JOIN normal o USING (run_id) JOIN cauchy c USING (run_id) WHERE o.step = 14 AND c.step = 80"""


FIT = """fit AS (
  SELECT run_id, n, atan2(s, c) AS mu, rho, sqrt(-2 * ln(rho)) AS normal_sd, -ln(rho) AS cauchy_scale
  FROM (SELECT *, sqrt(c * c + s * s) AS rho FROM (
    SELECT run_id, count(*) AS n, avg(cos(bearings)) AS c, avg(sin(bearings)) AS s FROM dirs GROUP BY 1)))"""
RING = "(2 * pi() / 90)"
KERNEL = " + ".join(f"exp(-0.5 * ((bearings - theta + {w} * 2 * pi()) / 0.1)^2)" for w in (-1, 0, 1))
DENSITY = f"""density AS (
  SELECT run_id, bin, theta, avg({KERNEL}) / (0.1 * sqrt(2 * pi())) AS density
  FROM dirs, (SELECT bin, (bin + 0.5) * {RING} - pi() AS theta FROM (SELECT unnest(range(90)) AS bin)) centres
  GROUP BY 1, 2, 3)"""


def normal_law() -> str:
    terms = " + ".join(
        f"exp(-0.5 * ((theta - mu + {w} * 2 * pi()) / normal_sd)^2)" for w in range(-3, 4)
    )
    return f"({terms}) / (normal_sd * sqrt(2 * pi()))"


AGENTS = ctes(TRACK, "agents AS (SELECT DISTINCT run_id, id FROM track)")


def placed_cte(source: str, name: str, how: str = "random") -> str:
    u = {k: noise(0, k) for k in (11, 12, 13, 14)}
    if how == "random":
        n = "sqrt(vx*vx + vy*vy)"
        held = [
            f"CASE WHEN {n} > 4.1 THEN v{a} / {n} * 4.1 WHEN {n} < 0.5 THEN v{a} / {n} * 0.5 ELSE v{a} END AS v{a}"
            for a in "xy"
        ]
        return f"""{name} AS (SELECT * REPLACE ({', '.join(held)}) FROM (
  SELECT run_id, id, ({u[11]} - 0.5) * 100 AS x, ({u[12]} - 0.5) * 100 AS y,
         ({u[13]} * 2 - 1) * 4.1 AS vx, ({u[14]} * 2 - 1) * 4.1 AS vy FROM {source}))"""
    return f"""{name} AS (
  SELECT run_id, id, cx * far AS x, cy * far AS y, -cx / 50 * speed AS vx, -cy / 50 * speed AS vy FROM (
    SELECT run_id, id, 50 * cos({u[13]} * 360) AS cx, 50 * sin({u[13]} * 360) AS cy,
           {u[12]} / 3 + 2.0 / 3 AS far, ({u[11]} / 3 + 0.5) * 0.5 AS speed FROM {source}))"""


PLACED = AGENTS.rstrip() + ",\n" + placed_cte("agents", "placed") + "\n"


LAST = "(SELECT run_id, max(id) AS last FROM track GROUP BY 1)"
ROUND_TRIP = WITH_STEPS + 'SELECT *, row_number() OVER () AS r FROM (SELECT run_id, id, "time", x, y, cluster_id, coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy FROM steps)'


def _simulate_clustered() -> str:
    parts, _ = simulated(FLOCK.overwrite(sample_rate=2), 2)
    # runs take the place of times: the frame of a simulated sample is its run
    parts.append('shown AS (SELECT run_id AS "time", id, x, y FROM s2)')
    parts += [near_cte("shown"), labels_cte("shown", 3)]
    return ctes(*parts, recursive=True) + """SELECT s.*, l.cluster_id, 1 AS "time"
  FROM s2 s JOIN labels l ON l."time" = s.run_id AND l.id = s.id"""


# Grown from the smallest agent: every step takes the least edge, by (length, smaller end, larger end), that
# leaves the tree; ``best`` and ``pid`` are the least edge of each agent outside of it.
GROWN = """grown AS (
  SELECT t."time", 1 AS step, t.id, t.x, t.y, (t.x - r.x)^2 + (t.y - r.y)^2 AS best, r.id AS pid
  FROM track t JOIN (SELECT "time", id, x, y FROM track QUALIFY row_number() OVER (PARTITION BY "time" ORDER BY id) = 1) r
    ON t."time" = r."time" AND t.id <> r.id
  UNION ALL
  SELECT "time", step + 1, id, x, y, CASE WHEN nearer THEN d2 ELSE best END, CASE WHEN nearer THEN vid ELSE pid END
  FROM (SELECT *, (d2, least(id, vid), greatest(id, vid)) < (best, least(id, pid), greatest(id, pid)) AS nearer FROM (
    SELECT *, (x - vx)^2 + (y - vy)^2 AS d2 FROM (
      SELECT *, first_value(id) OVER w AS vid, first_value(x) OVER w AS vx, first_value(y) OVER w AS vy FROM grown
      WINDOW w AS (PARTITION BY "time" ORDER BY best, least(id, pid), greatest(id, pid)))
    WHERE id <> vid)))"""
TREE = """tree AS MATERIALIZED (
  SELECT "time", least(id, pid) AS id, greatest(id, pid) AS id2, sqrt(best) AS dist FROM grown
  QUALIFY row_number() OVER (PARTITION BY "time", step ORDER BY best, least(id, pid), greatest(id, pid)) = 1)"""


def _mst_knn() -> str:
    return ctes(
        TRACK,
        GROWN,
        TREE,
        knn_cte(12),
        """near AS (
  SELECT k."time", least(id, id2) AS id, greatest(id, id2) AS id2 FROM knn k
  JOIN (SELECT "time", greatest(1, floor(ln(count(*)))) AS k FROM track GROUP BY 1) n ON n."time" = k."time" AND rank <= k
  GROUP BY ALL)""",
        'kept AS (SELECT t."time", t.id, t.id2 FROM tree t JOIN near USING ("time", id, id2))',
        'steps AS (SELECT "time", id, id2 FROM kept UNION ALL SELECT "time", id2, id FROM kept)',
        """reach AS (
  SELECT "time", id, id AS other FROM track
  UNION SELECT r."time", r.id, s.id2 FROM reach r JOIN steps s ON s."time" = r."time" AND s.id = r.other)""",
        recursive=True,
    ) + 'SELECT "time", id, min(other) AS cluster_id FROM reach GROUP BY 1, 2'


SQL |= {
    "spanning_tree": ctes(TRACK, GROWN, TREE, recursive=True) + "SELECT * FROM tree",
    "mst_knn_clusters": _mst_knn(),
    "knn": ctes(TRACK, knn_cte(3)) + "SELECT * FROM knn",
    "knn_mutual": ctes(TRACK, knn_cte(3))
    + """SELECT *, count(*) OVER (PARTITION BY "time", least(id, id2), greatest(id, id2)) = 2 AS mutual FROM knn""",
    "knn_distance_curve": ctes(TRACK, knn_cte(4)) + "SELECT * FROM knn WHERE rank = 4",
    "shared_nn": ctes(TRACK, knn_cte(10))
    + """SELECT e."time", e.id, e.id2, count(*) AS shared FROM knn e
  JOIN knn a ON a."time" = e."time" AND a.id = e.id
  JOIN knn b ON b."time" = e."time" AND b.id = e.id2 AND b.id2 = a.id2
  GROUP BY 1, 2, 3 HAVING count(*) >= 5""",
    "nearest_agent": ctes(TRACK, knn_cte(1)) + "SELECT * FROM knn",
    "point_cloud_knn": ctes(CLOUD, knn_cte(4, "cloud")) + "SELECT * FROM knn",
    "convex_hull_area": ctes(TRACK, FLOCKED, *hull_ctes("flocked", '"time", cluster_id')) + "SELECT * FROM hulls",
    "mean_flock_area": ctes(TRACK, FLOCKED, *hull_ctes("flocked", '"time", cluster_id'))
    + 'SELECT "time", avg(hull_area) AS average_cluster_volumes FROM hulls GROUP BY 1',
    "point_cloud_hulls": ctes(CLOUD_LABELLED, *hull_ctes("clouds", "cluster_id")) + "SELECT * FROM hulls",
    "experiment_metrics": ctes(*MEASURES) + "SELECT * FROM measures",
    "experiment_stats": ctes(*MEASURES)
    + f'SELECT 16 * "time" AS t, {", ".join(across(m) for m in METRICS)} FROM measures GROUP BY "time"',
    "runs_wide": WITH_V
    + f"""SELECT "time", {", ".join(f'max(CASE WHEN run_id = {r} THEN avg_norm_vel END) AS run_{r}' for r in range(RUNS))}
  FROM v GROUP BY 1""",
    "voronoi_cells": WITH_TRACK
    + """SELECT "time", count(DISTINCT (x, y)) AS sites, 100.0 * 100.0 AS total_area FROM track GROUP BY 1""",
    "wide_to_long": WITH_V + "SELECT * FROM v",
    "step_vectors": WITH_STEPS
    + """SELECT id, "time",
  CASE WHEN n = 0 THEN 0 ELSE dx / n END AS unit_x, CASE WHEN n = 0 THEN 0 ELSE dy / n END AS unit_y,
  CASE WHEN n > 20 THEN dx * 20 / n ELSE dx END AS limited_x, CASE WHEN n > 20 THEN dy * 20 / n ELSE dy END AS limited_y,
  CASE WHEN n > 20 THEN dx * 20 / n WHEN n > 0 AND n < 10 THEN dx * 10 / n ELSE dx END AS ensured_x,
  CASE WHEN n > 20 THEN dy * 20 / n WHEN n > 0 AND n < 10 THEN dy * 10 / n ELSE dy END AS ensured_y,
  CASE WHEN p = 0 THEN 0 ELSE (dx * x - dy * y) / p END AS turned_x,
  CASE WHEN p = 0 THEN 0 ELSE (dy * x + dx * y) / p END AS turned_y,
  (x * dy - y * dx) / nullif(n * p, 0) AS sine,
  1 - exp(4 * least(n / 20, 1.0::DOUBLE) - 4) AS soft, 1 - 1 / (1 + exp(-15 * (least(n / 20, 1.0::DOUBLE) - 0.6))) AS sigmoid
  FROM (SELECT *, sqrt(dx * dx + dy * dy) AS n, sqrt(x * x + y * y) AS p FROM steps WHERE dx IS NOT NULL)""",
    "sweep_by_config": WITH_V
    + """SELECT noise_percent, agents, avg(m) AS mean_avg_norm_vel, max(m) AS max_avg_norm_vel, count(*) AS runs
  FROM (SELECT run_id, avg(avg_norm_vel) AS m FROM v GROUP BY 1)
  JOIN (SELECT run_id, CAST(floor(100 * count(*) FILTER (cluster_id = 0) / count(*)) AS BIGINT) AS noise_percent,
               count(DISTINCT id) AS agents FROM track GROUP BY 1) USING (run_id) GROUP BY 1, 2""",
    "sweep_summary": WITH_V
    + """SELECT noise_level, agents, avg(m) AS mean_avg_norm_vel, max(m) AS max_avg_norm_vel, count(*) AS runs
  FROM (SELECT run_id % 2 AS noise_level, run_id // 2 AS agents, run_id, avg(avg_norm_vel) AS m FROM v GROUP BY 1, 2, 3)
  GROUP BY 1, 2""",
    "metric_summary": WITH_V
    + """SELECT run_id, min(avg_norm_vel) AS lowest, max(avg_norm_vel) AS highest, avg(avg_norm_vel) AS mean,
       count(avg_norm_vel) AS n FROM v GROUP BY 1""",
    "change_point_mean": ctes(*DIR_PARTS, BY_RUN, change_cte("mean")) + "SELECT * FROM change_mean",
    "change_point_var": ctes(*DIR_PARTS, BY_RUN, change_cte("var")) + "SELECT * FROM change_var",
    "latest_change_point": ctes(*DIR_PARTS, BY_RUN, change_cte("mean"), change_cte("var"))
    + """SELECT coalesce(max(change_point), 0) AS max_change_point
  FROM (SELECT change_point FROM change_mean UNION ALL SELECT change_point FROM change_var)""",
    "agents_with_clustered": WITH_TRACK
    + """SELECT run_id, id, clustered FROM (
    SELECT run_id, id, count(*) AS clustered FROM track WHERE cluster_id <> 0 GROUP BY 1, 2) c
  RIGHT JOIN (SELECT DISTINCT run_id, id FROM track) a USING (run_id, id)""",
    "run_names": WITH_TRACK
    + """SELECT run_id, count(*) AS samples, 'data/run-' || run_id || '/' AS folder, 'run ' || run_id AS label
  FROM track GROUP BY run_id""",
    "stats_change_points": _stats_change_points(),
    "circular_mle": _circular_mle(),
    "circular_fit": ctes(*DIR_PARTS, FIT) + "SELECT * FROM fit",
    "circular_density": ctes(*DIR_PARTS, DENSITY) + "SELECT * FROM density",
    "circular_fit_error": ctes(*DIR_PARTS, FIT, DENSITY)
    + f"""SELECT run_id, sum((density - {normal_law()})^2) AS normal_error,
       sum((density - (1 - rho*rho) / (1 + rho*rho - 2 * rho * cos(theta - mu)) / (2 * pi()))^2) AS cauchy_error
  FROM density JOIN fit USING (run_id) GROUP BY 1""",
    "random_start": PLACED + "SELECT * FROM placed",
    "circle_start": AGENTS.rstrip() + ",\n" + placed_cte("agents", "placed", "circle") + "\nSELECT * FROM placed",
    "insert_agents": WITH_TRACK
    + 'SELECT run_id, CASE WHEN cluster_id = 0 THEN id + 1000000 ELSE id END AS id, "time", x, y FROM track',
    "delete_agents": WITH_TRACK
    + """SELECT * FROM track WHERE (run_id, id) NOT IN (
    SELECT (run_id, id) FROM (SELECT run_id, id, arg_max(cluster_id, "time") AS c FROM track GROUP BY 1, 2) WHERE c = 0)""",
    "delete_last_agent": WITH_TRACK + f"SELECT track.* FROM track JOIN {LAST} USING (run_id) WHERE id < last",
    "double_population": WITH_TRACK
    + f"SELECT * FROM track UNION ALL SELECT track.* REPLACE (id + last + 1 AS id) FROM track JOIN {LAST} USING (run_id)",
    "halve_population": WITH_TRACK + f"SELECT track.* FROM track JOIN {LAST} USING (run_id) WHERE id * 2 <= last",
    "click_select": WITH_TRACK
    + """SELECT *, sqrt((x - 3)^2 + (y + 40)^2) AS dist FROM track
  WHERE "time" = 10 AND sqrt((x - 3)^2 + (y + 40)^2) < 15 ORDER BY dist, id LIMIT 1""",
    "world_extent": WITH_TRACK
    + """SELECT ceil(greatest(0, max(x))) AS extent_x, ceil(greatest(0, max(y))) AS extent_y,
       count(DISTINCT id) AS agents, max("time") AS last_time, min("time") AS first_time FROM track""",
    "replay_validate": WITH_TRACK
    + """SELECT run_id, "time", agents, len(top) AS expected, agents = len(top) AND ids = top AS complete FROM (
    SELECT *, first(ids) OVER (PARTITION BY run_id ORDER BY len(ids) DESC, "time") AS top FROM (
      SELECT run_id, "time", count(*) AS agents, list_sort(list(DISTINCT id)) AS ids FROM track GROUP BY 1, 2))""",
    "replay_frame": WITH_STEPS
    + 'SELECT id, x, y, coalesce(dx, 0) * 0.5 AS vx, coalesce(dy, 0) * 0.5 AS vy, 4 AS trail_length FROM steps WHERE "time" = 21',
    "replay_stream": ROUND_TRIP,
    "recorder_round_trip": WITH_TRACK + "SELECT * FROM track",
    "preprocessed_round_trip": ROUND_TRIP,
    "recordings_read_back": WITH_STEPS
    + """SELECT 'boids-data_' || run_id AS run_name, run_id % 2 = 0 AS prepared, run_id, id, "time", x, y,
  coalesce(dx, 0) AS dx, coalesce(dy, 0) AS dy FROM steps""",
    "config_json": """SELECT event_id, printf('boids-data_%d.csv', epoch_us(ts) // 1000) AS name,
       CASE WHEN event_type = 'error' THEN 'Repulsive' ELSE 'Toroidal' END AS boundary, value * 0.05 AS strength
  FROM events""",
    "simulate_clustered": _simulate_clustered(),
}


def all_sql() -> dict[str, str]:
    specs = {name: CATALOGUE[name][0] for name in SQL}
    return {name: shape_sql(sql, specs[name]) if specs[name] else sql for name, sql in SQL.items()}
