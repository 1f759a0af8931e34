"""Vector algebra on a plane that may wrap around, as Column expressions.

A vector is a pair of Columns. Zero vectors normalise to zero, never to NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.schema import World

Vector = tuple[Column, Column]


def wrap_delta(a: Column, b: Column, size: float) -> Column:
    """Shortest signed step from a to b; a step of exactly half the size stays as it is."""
    d = b - a
    shift = F.when(d < 0, F.lit(float(size))).otherwise(F.lit(-float(size)))
    return F.when(F.abs(d) > size / 2, d + shift).otherwise(d)


def wrapped(value: Column, size: float) -> Column:
    """The same place of a wrapping axis, inside the world; values inside keep every bit."""
    half = F.lit(size / 2)
    inside = (value >= -half) & (value < half)
    return F.when(inside, value).otherwise(F.pmod(value + half, F.lit(float(size))) - half)


def delta(ax: Column, ay: Column, bx: Column, by: Column, world: World) -> Vector:
    """Vector from a to b under the world's distance."""
    if world.toroidal:
        return wrap_delta(ax, bx, world.width), wrap_delta(ay, by, world.height)
    return bx - ax, by - ay


def norm_sq(v: Vector) -> Column:
    return v[0] * v[0] + v[1] * v[1]


def norm(v: Vector) -> Column:
    return F.sqrt(norm_sq(v))


def distance(ax: Column, ay: Column, bx: Column, by: Column, world: World) -> Column:
    return norm(delta(ax, ay, bx, by, world))


def add(*vectors: Vector) -> Vector:
    x, y = vectors[0]
    for v in vectors[1:]:
        x, y = x + v[0], y + v[1]
    return x, y


def scale(v: Vector, k) -> Vector:
    return v[0] * k, v[1] * k


def rescale(v: Vector, length) -> Vector:
    """Same direction, given length; zero stays zero."""
    return scale(v, F.coalesce(F.try_divide(F.lit(float(length)), norm(v)), F.lit(0.0)))


def normalize(v: Vector) -> Vector:
    return rescale(v, 1.0)


def limit_length(v: Vector, longest: float) -> Vector:
    over = norm(v) > longest
    r = rescale(v, longest)
    return F.when(over, r[0]).otherwise(v[0]), F.when(over, r[1]).otherwise(v[1])


def ensure_length(v: Vector, shortest: float, longest: float) -> Vector:
    n = norm(v)
    hi, lo = rescale(v, longest), rescale(v, shortest)
    return tuple(
        F.when(n > longest, hi[i]).when(n < shortest, lo[i]).otherwise(v[i]) for i in (0, 1)
    )


def rotate(v: Vector, by: Vector) -> Vector:
    """Complex product: turns v by the angle of ``by`` and scales by its length."""
    return v[0] * by[0] - v[1] * by[1], v[1] * by[0] + v[0] * by[1]


def wedge(a: Vector, b: Vector) -> Column:
    """Sine of the turn from a to b; NULL where either has no direction."""
    return F.try_divide(a[0] * b[1] - a[1] * b[0], norm(a) * norm(b))


def nearest_image(px: Column, py: Column, qx: Column, qy: Column, world: World) -> Vector:
    """The copy of p on the wrapped plane that lies closest to q."""
    d = delta(qx, qy, px, py, World(world.width, world.height))
    return qx + d[0], qy + d[1]


# Fixed value: squared gap between wrapped and plain step that counts as a crossing.
CROSSING_GAP_SQ = 0.00025


def crosses_boundary(ax: Column, ay: Column, bx: Column, by: Column, world: World) -> Column:
    """True when the shortest step from a to b goes over an edge of the world."""
    wrapped = delta(ax, ay, bx, by, World(world.width, world.height))
    plain = (bx - ax, by - ay)
    return norm_sq((wrapped[0] - plain[0], wrapped[1] - plain[1])) > CROSSING_GAP_SQ


def near_edge(x: Column, y: Column, margin: float, world: World) -> Column:
    return (F.abs(x) > world.width / 2 - margin) | (F.abs(y) > world.height / 2 - margin)


def in_view(d: Vector, v: Vector, degrees: float) -> Column:
    """Whether an agent moving along v sees a point at offset d, strictly inside its cone.

    An agent at rest looks nowhere; the full circle of 360 degrees means no filter.
    """
    if degrees == 360:
        return F.lit(True)
    seen = (norm_sq(d) >= 1e-4) & (norm_sq(v) > 0)
    u, w = normalize(v), normalize(d)
    half = F.cos(F.lit(degrees * 0.5) * F.pi() / 180)
    return seen & (u[0] * w[0] + u[1] * w[1] > half)


def soft_falloff(ratio: Column) -> Column:
    """Separation weight with a soft knee; fixed values alpha 4, beta 1."""
    return 1.0 - 1.0 * F.exp(4.0 * ratio - 4.0)


def sigmoid_falloff(ratio: Column) -> Column:
    """Separation weight falling along a sigmoid; fixed values alpha 15, beta 0.6."""
    return 1.0 - 1.0 / (1.0 + F.exp(-15.0 * (ratio - 0.6)))
