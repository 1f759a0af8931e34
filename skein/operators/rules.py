"""The flocking model: one tick is a neighbour join, sums per agent and a projection.

State columns: the frame, id, x, y, vx, vy, ax, ay, wander. The neighbour side of
the join is merged per occupied position first, and the sums are taken on the
join's own partitioning, so a tick shuffles the agents once and the copies once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators.skew import Skew, skew_join
from skein.operators.spatial import Grid, cell_join, closest_within, occupied, prepared
from skein.session import cut
from skein.sources.config import FlockConfig

STATE = ["x", "y", "vx", "vy", "ax", "ay", "wander"]

# Multiplier, increment and modulus of the repeatable noise.
LCG = (1103515245, 12345, 2147483648)


def noise(key: Column, tick: int, salt: int, seed: int) -> Column:
    """Repeatable uniform number in [0, 1) for an agent, tick and use."""
    a, c, m = LCG
    first = F.pmod(F.pmod(key, F.lit(m)) * a + (tick * 7919 + salt * 104729 + seed) % m, F.lit(m))
    return F.pmod(first * a + c, F.lit(m)) / F.lit(float(m))


def _vec(name: str) -> V.Vector:
    return F.col(f"{name}x"), F.col(f"{name}y")


def perceive(
    state: DataFrame,
    config: FlockConfig,
    frame: Sequence[str] = ("time",),
    *,
    skew: Skew | None = Skew(),
) -> DataFrame:
    """Every agent with n_neighbours and the sums its rules need.

    sep_*, coh_*, ali_* are sums over the neighbours each rule takes into
    account, sep_n, coh_n, ali_n their counts.
    """
    if config.neighbours_considered:
        return _perceive_capped(state, config, frame, skew=skew)
    world = config.world
    grid = Grid.for_radius(world, config.reach)
    celled, skew = prepared(state, grid, skew)
    spots = occupied(celled, frame, "vx", "vy")
    d = V.delta(F.col("a.x"), F.col("a.y"), F.col("b.x2"), F.col("b.y2"), world)
    within = V.norm_sq(d) <= F.lit(float(config.reach) ** 2)
    near = cell_join(celled, spots, grid, frame, within, hot_rows=skew.cell_rows)
    # the agent's own spot is always within reach, so no agent is lost by the inner join
    own = F.when((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")), 1).otherwise(0)
    return _sums(
        near.withColumn("own", own), config, [*frame, "cx", "cy", "_salt", "id"], state.columns
    ).drop("cx", "cy", "_salt")


def _perceive_capped(state, config: FlockConfig, frame, *, skew) -> DataFrame:
    """The same with at most ``neighbours_considered`` closest neighbours per agent."""
    others = ["x2", "y2", "vx2", "vy2"]
    found = closest_within(
        state, config.reach, config.neighbours_considered, config.world, frame, ("vx", "vy"), skew=skew
    )

    def entry(own: int, values: list[Column]) -> Column:
        return F.struct(*[v.alias(c) for v, c in zip(values, others)], F.lit(own).alias("own"))

    itself = F.array(entry(1, [F.col(c[:-1]) for c in others]))
    kept = F.transform("near", lambda p: entry(0, [p[c] for c in others]))
    near = found.select(*state.columns, F.explode(F.concat(itself, F.coalesce(kept, F.array().cast(
        "array<struct<x2:double,y2:double,vx2:double,vy2:double,own:int>>"
    )))).alias("p"))
    near = near.select(*state.columns, *[f"p.{c}" for c in others], F.lit(1).alias("n2"), "p.own")
    return _sums(near, config, [*frame, "id"], state.columns)


def _sums(near: DataFrame, config: FlockConfig, keys: list[str], columns: list[str]) -> DataFrame:
    """Sums per agent. Rows marked ``own`` include the agent itself, which is taken off."""
    o = V.delta(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), config.world)
    near = near.withColumns({"ox": o[0], "oy": o[1]}).withColumn("d", V.norm(_vec("o")))
    n = F.col("n2") - F.col("own")
    seen = V.in_view(_vec("o"), _vec("v"), config.field_of_vision)
    look = config.sensory_distance
    apart = F.col("d") > 0
    sep = seen & apart & (F.col("d") < look * config.separation_trs_coef)
    coh = seen & apart & (F.col("d") < look * config.cohesion_trs_coef)
    ali = seen & (F.col("d") < look * config.alignment_trs_coef)

    def total(mask: Column, value: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(mask, value)), F.lit(0.0)).alias(name)

    def count(mask: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(mask, n)), F.lit(0)).alias(name)

    own, d2 = F.col("own"), F.col("d") * F.col("d")
    kept = [F.first(c).alias(c) for c in columns if c not in keys]
    return near.groupBy(*keys).agg(
        *kept,
        F.sum(n).alias("n_neighbours"),
        total(sep, F.try_divide(-F.col("ox"), d2) * n, "sep_x"),
        total(sep, F.try_divide(-F.col("oy"), d2) * n, "sep_y"),
        count(sep, "sep_n"),
        total(coh, F.col("ox") * n, "coh_x"),
        total(coh, F.col("oy") * n, "coh_y"),
        count(coh, "coh_n"),
        total(ali, F.col("vx2") - own * F.col("vx"), "ali_x"),
        total(ali, F.col("vy2") - own * F.col("vy"), "ali_y"),
        count(ali, "ali_n"),
    )


def _mean(name: str) -> V.Vector:
    n = F.col(f"{name}_n")
    return tuple(F.coalesce(F.try_divide(f"{name}_{a}", n), F.lit(0.0)) for a in "xy")


def _wander_target(config: FlockConfig) -> V.Vector:
    """Offset of a point on a circle ahead (Reynolds) or of a turned heading (Vicsek)."""
    ahead = V.normalize(_vec("v"))
    turn = (F.cos("wander"), F.sin("wander"))
    if config.noise_model == "Vicsek":
        target = V.rotate(ahead, turn)
    else:
        target = V.add(
            V.scale(ahead, config.wander_distance * math.sqrt(2)),
            V.rotate(ahead, V.scale(turn, config.wander_radius)),
        )
    zero = F.lit(0.0)
    return V.delta(zero, zero, *target, config.world)


def _seek_target(config: FlockConfig) -> V.Vector:
    return V.delta(F.col("x"), F.col("y"), F.lit(config.seek_x), F.lit(config.seek_y), config.world)


def with_pushes(df: DataFrame, wanted: dict[str, V.Vector], config: FlockConfig) -> DataFrame:
    """Adds NAME_px, NAME_py: the push of an agent towards each wanted direction.

    A push is the unit vector, or with steering the change to full speed in that
    direction, limited; no direction gives no push. Lengths are columns of their
    own so that each is computed once.
    """
    df = df.withColumns({f"_{n}_d{a}": v[i] for n, v in wanted.items() for i, a in enumerate("xy")})
    df = df.withColumns({f"_{n}_len": V.norm(_vec(f"_{n}_d")) for n in wanted})

    def along(n: str, a: str) -> Column:
        return F.try_divide(f"_{n}_d{a}", f"_{n}_len")

    if config.agent_steering:
        top = config.max_speed
        df = df.withColumns(
            {f"_{n}_g{a}": along(n, a) * top - F.col(f"v{a}") for n in wanted for a in "xy"}
        )
        df = df.withColumns({f"_{n}_turn": V.norm(_vec(f"_{n}_g")) for n in wanted})

    def push(n: str, a: str) -> Column:
        out = along(n, a)
        if config.agent_steering:
            g, turn = F.col(f"_{n}_g{a}"), F.col(f"_{n}_turn")
            out = F.when(turn > config.max_steering, F.try_divide(g, turn) * config.max_steering).otherwise(g)
        return F.when(F.col(f"_{n}_len") > 0, out).otherwise(F.lit(0.0))

    df = df.withColumns({f"{n}_p{a}": push(n, a) for n in wanted for a in "xy"})
    helpers = ["dx", "dy", "len", "gx", "gy", "turn"]
    return df.drop(*[f"_{n}_{h}" for n in wanted for h in helpers])


def rule_pushes(perceived: DataFrame, config: FlockConfig) -> DataFrame:
    """Adds the weighted push of every rule that is on, as NAME_px and NAME_py."""
    if config.seek_x is not None:
        return with_pushes(perceived, {"seek": _seek_target(config)}, config)
    weights = {
        "sep": config.separation_coef,
        "coh": config.cohesion_coef,
        "ali": config.alignment_coef,
        "wan": config.wander_coef if config.wander_on and config.wander_rate else 0,
    }
    on = [n for n, weight in weights.items() if weight]
    wanted = {n: _wander_target(config) if n == "wan" else _mean(n) for n in on}
    df = with_pushes(perceived, wanted, config)
    if "ali" in on and not config.agent_steering:
        # without steering the mean velocity itself is the push
        df = df.withColumns({f"ali_p{a}": _mean("ali")[i] for i, a in enumerate("xy")})
    df = df.withColumns(
        {f"{n}_p{a}": F.col(f"{n}_p{a}") * weights[n] for n in on for a in "xy"}
    )
    if config.cohesion_yields and "sep" in on and "coh" in on:
        free = (F.col("sep_px") == 0) & (F.col("sep_py") == 0)
        df = df.withColumns(
            {f"coh_p{a}": F.when(free, F.col(f"coh_p{a}")).otherwise(F.lit(0.0)) for a in "xy"}
        )
    return df


def _next_wander(config: FlockConfig, tick: int) -> Column:
    if not (config.wander_on and config.wander_rate):
        return F.col("wander")
    step = (noise(F.col("id"), tick, 1, config.seed) * 2 - 1) * config.wander_rate * math.pi
    if config.noise_model == "Vicsek":
        return step
    return (F.col("wander") + step) % (2 * math.pi)


def _boundary(config: FlockConfig) -> dict[str, Column]:
    """New x, y, vx, vy, ax, ay from moved ones, by the kind of boundary."""
    w = config.world
    out = {}
    for axis, low, high in (("x", w.left, w.right), ("y", w.bottom, w.top)):
        p, v = F.col(axis), F.col(f"v{axis}")
        below, above = p < low, p > high
        if config.boundary == "Toroidal":
            out[axis] = F.when(below, high + p - low).when(above, low + p - high).otherwise(p)
        elif config.boundary == "Absorbing":
            out[axis] = F.greatest(F.lit(float(low)), F.least(p, F.lit(float(high))))
            out[f"v{axis}"] = F.when(below | above, F.lit(0.0)).otherwise(v)
        elif config.boundary == "Reflective":
            out[f"v{axis}"] = F.when((below & (v < 0)) | (above & (v > 0)), -v).otherwise(v)
        else:
            margin, force = config.boundary_distance, config.boundary_force
            inside_low, inside_high = p < low + margin, p > high - margin
            # x tests its low side first, y its high side
            push = (
                F.when(inside_low, force).when(inside_high, -force)
                if axis == "x"
                else F.when(inside_high, -force).when(inside_low, force)
            )
            out[f"a{axis}"] = push.otherwise(F.lit(0.0))
    return out


def advance(perceived: DataFrame, config: FlockConfig, tick: int) -> DataFrame:
    """Applies the rules, moves the agents and enforces the boundary."""
    ruled = rule_pushes(perceived, config)
    pushes = [c[:-1] for c in ruled.columns if c.endswith("_px")]
    pushed = ruled.withColumns(
        {
            **{
                f"_v{a}": sum((F.col(f"{p}{a}") for p in pushes), F.col(f"v{a}") + F.col(f"a{a}"))
                for a in "xy"
            },
            "_wander": _next_wander(config, tick),
        }
    ).drop(*[f"{p}{a}" for p in pushes for a in "xy"])
    v = (F.col("_vx"), F.col("_vy"))
    held = V.ensure_length(v, config.min_speed, config.max_speed)
    still = V.norm_sq(v) == 0
    jolt = [(noise(F.col("id"), tick, s, config.seed) * 2 - 1) * config.max_speed for s in (2, 3)]
    if config.min_speed > 0:
        held = tuple(F.when(still, jolt[i]).otherwise(held[i]) for i in (0, 1))
    moved = pushed.withColumns({"vx": held[0], "vy": held[1]}).drop("_vx", "_vy")
    if not config.stop_movement:
        moved = moved.withColumns(
            {
                "x": F.col("x") + F.col("vx") * config.baseline_speed,
                "y": F.col("y") + F.col("vy") * config.baseline_speed,
            }
        )
    moved = moved.withColumns({"ax": F.lit(0.0), "ay": F.lit(0.0), "wander": F.col("_wander")})
    sums = [f"{r}_{c}" for r in ("sep", "coh", "ali") for c in ("x", "y", "n")]
    return moved.withColumns(_boundary(config)).drop("_wander", *sums)


def tick(
    state: DataFrame,
    config: FlockConfig,
    number: int,
    frame: Sequence[str] = ("time",),
    *,
    skew: Skew | None = Skew(),
) -> DataFrame:
    """The state after one tick. n_neighbours was counted before the move."""
    bare = state.drop("n_neighbours")
    return advance(perceive(bare, config, frame, skew=skew), config, number)


def as_state(steps: DataFrame) -> DataFrame:
    """Rows with displacements as agent state: the step becomes the velocity."""
    zero = F.lit(0.0)
    return steps.withColumnsRenamed({"dx": "vx", "dy": "vy"}).withColumns(
        {"ax": zero, "ay": zero, "wander": zero}
    )


def mark_neighbours(
    points: DataFrame, chosen: int, radius: float, config: FlockConfig, frame: Sequence[str] = ("time",)
) -> DataFrame:
    """Flags the neighbours of one selected agent; it is looked up by frame, no grid needed."""
    one = points.where(F.col("id") == chosen).select(
        *frame, F.col("x").alias("_cx"), F.col("y").alias("_cy")
    )
    joined = skew_join(points, cut(one), frame, spread_by=["id"])
    d = V.delta(F.col("_cx"), F.col("_cy"), F.col("x"), F.col("y"), config.world)
    near = V.norm_sq(d) <= float(radius) ** 2
    return (
        joined.withColumn("marked", F.coalesce(near & (F.col("id") != chosen), F.lit(False)))
        .drop("_cx", "_cy")
    )


def disrupt(nearest: DataFrame) -> DataFrame:
    """Ten times the plain vector to the nearest agent."""
    return nearest.withColumns(
        {"push_x": (F.col("x2") - F.col("x")) * 10, "push_y": (F.col("y2") - F.col("y")) * 10}
    )
