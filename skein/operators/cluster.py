"""Density clustering and connected components per frame.

Both work on a grid so fine that all agents of one cell are within the radius.
Then a cell with enough agents is core as a whole and belongs to one cluster, so
crowded cells need no pairs inside them; only cells are linked, and the graph
has one node per occupied cell with a bounded number of touching cells.

Two cells are linked when any two of their core positions are within the radius.
That is decided on bounding boxes of sub-cells: boxes surely within or surely
beyond the radius need no positions; only undecided box pairs are split further.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators.skew import Skew, skew_join
from skein.operators.spatial import Grid, cell_join, with_cell
from skein.schema import World
from skein.session import cut

SPLIT = 8  # sub-cells per side and level
LEVELS = 5


SMALL_GRAPH = 200_000  # nodes whose labels Spark may broadcast, about 5 MB


def connected(nodes: DataFrame, edges: DataFrame, frame: Sequence[str]) -> DataFrame:
    """(frame, node, label): label is the smallest node of the component.

    Every round offers a node's label to its neighbours and to their current
    roots, and moves every node on to its root's root; labels settle after about
    log(diameter) rounds. A root may carry most nodes, so large graphs look
    roots up with the skew-safe join.
    """
    frame = list(frame)
    key = [*frame, "node"]
    links = cut(edges.union(edges.select(*frame, "v", "u")).toDF(*frame, "u", "v").distinct())
    labels = cut(nodes.select(*key, F.col("node").alias("label")))
    small = labels.count() <= SMALL_GRAPH
    while True:
        of_v = labels.select(*frame, F.col("node").alias("v"), F.col("label").alias("offer"))
        of_u = labels.select(*frame, F.col("node").alias("u"), F.col("label").alias("lu"))
        offers = (
            links.join(of_v, [*frame, "v"])
            .join(of_u, [*frame, "u"])
            .where("offer < lu")
            .select(*frame, F.explode(F.array("u", "lu")).alias("node"), "offer")
            .groupBy(*key)
            .agg(F.min("offer").alias("offer"))
        )
        roots = labels.select(
            *frame, F.col("node").alias("label"), F.col("label").alias("root")
        ).where("root < label")
        up = [*frame, "label"]
        if small:
            moved = labels.join(roots, up, "left")
        else:
            moved = skew_join(labels, roots, up, spread_by=["node"])
        labels = cut(
            moved.join(offers, key, "left").select(
                *key,
                F.least("label", "root", "offer").alias("label"),
                (F.least("root", "offer") < F.col("label")).alias("changed"),
            )
        )
        if labels.where("changed").isEmpty():
            return labels.drop("changed")
        labels = labels.drop("changed")


def _gap(a: str, b: str, lo: str, hi: str) -> Column:
    return F.greatest(
        F.col(f"{b}.{lo}") - F.col(f"{a}.{hi}"), F.col(f"{a}.{lo}") - F.col(f"{b}.{hi}"), F.lit(0.0)
    )


def _span(a: str, b: str, lo: str, hi: str) -> Column:
    return F.greatest(F.col(f"{b}.{hi}") - F.col(f"{a}.{lo}"), F.col(f"{a}.{hi}") - F.col(f"{b}.{lo}"))


def _sub_cells(spots: DataFrame, grid: Grid, level: int) -> DataFrame:
    """Adds sx, sy: the sub-cell of each position at a level of splitting."""
    parts = SPLIT**level

    def index(value: str, cell: str, low: float, step: float) -> Column:
        inside = (F.col(value) - F.lit(low)) / F.lit(step) - F.col(cell)
        i = F.floor(inside * parts).cast("long")
        return F.greatest(F.lit(0), F.least(i, F.lit(parts - 1)))

    return spots.withColumns(
        {
            "sx": index("x", "cx", -grid.world.width / 2, grid.dx),
            "sy": index("y", "cy", -grid.world.height / 2, grid.dy),
        }
    )


def _boxes(spots: DataFrame, grid: Grid, frame: Sequence[str], level: int) -> DataFrame:
    """Bounding boxes of sub-cells at a level, with the sub-cell one level up."""
    return (
        _sub_cells(spots, grid, level)
        .groupBy(*frame, "cx", "cy", "node", "sx", "sy")
        .agg(
            F.min("x").alias("x0"),
            F.max("x").alias("x1"),
            F.min("y").alias("y0"),
            F.max("y").alias("y1"),
        )
        .withColumns({"px": F.expr(f"sx div {SPLIT}"), "py": F.expr(f"sy div {SPLIT}")})
    )


def _moved(boxes: DataFrame, grid: Grid) -> DataFrame:
    """The half stencil of touching cells; wrapped boxes move to the far cell's side."""
    span = range(-grid.reach, grid.reach + 1)
    half = [(i, j) for i in span for j in span if i > 0 or (i == 0 and j > 0)]
    steps = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half])
    )
    out = boxes.withColumn("_o", steps)
    tx, ty = F.col("cx") + F.col("_o.i"), F.col("cy") + F.col("_o.j")
    if not grid.world.toroidal:
        return out.select(
            "*", tx.alias("tx"), ty.alias("ty"), F.lit(0).alias("wx"), F.lit(0).alias("wy")
        ).drop("_o")
    return out.select(
        "*",
        F.pmod(tx, F.lit(grid.nx)).alias("tx"),
        F.pmod(ty, F.lit(grid.ny)).alias("ty"),
        F.floor(tx / grid.nx).cast("int").alias("wx"),
        F.floor(ty / grid.ny).cast("int").alias("wy"),
    ).drop("_o")


def _shift(boxes: DataFrame, world: World) -> DataFrame:
    return boxes.withColumns(
        {
            "x0": F.col("x0") - F.col("wx") * world.width,
            "x1": F.col("x1") - F.col("wx") * world.width,
            "y0": F.col("y0") - F.col("wy") * world.height,
            "y1": F.col("y1") - F.col("wy") * world.height,
        }
    )


def cell_links(spots: DataFrame, grid: Grid, radius: float, frame: Sequence[str]) -> DataFrame:
    """(frame, u, v): cells, named by ``node``, with two positions within the radius.

    ``spots`` has one row per core position with its cell and the cell's node.
    """
    frame = list(frame)
    limit = F.lit(float(radius) ** 2)
    gx, gy = _gap("a", "b", "x0", "x1"), _gap("a", "b", "y0", "y1")
    sx, sy = _span("a", "b", "x0", "x1"), _span("a", "b", "y0", "y1")
    maybe = gx * gx + gy * gy <= limit
    sure = sx * sx + sy * sy <= limit
    ends = [F.col("a.node").alias("u"), F.col("b.node").alias("v")]
    trace = [
        *[F.col(f"a.{c}").alias(f"a_{c}") for c in ("cx", "cy", "sx", "sy", "wx", "wy")],
        *[F.col(f"b.{c}").alias(f"b_{c}") for c in ("cx", "cy", "sx", "sy")],
    ]

    spots = cut(spots)
    first = _boxes(spots, grid, frame, 1)
    a = _shift(_moved(first, grid), grid.world).alias("a")
    same = [F.col(f"a.{f}") == F.col(f"b.{f}") for f in frame]
    on = (F.col("a.tx") == F.col("b.cx")) & (F.col("a.ty") == F.col("b.cy")) & maybe
    for c in same:
        on = on & c
    tested = cut(
        a.join(first.alias("b"), on).select(
            *[F.col(f"a.{f}").alias(f) for f in frame], *ends, sure.alias("sure"), *trace
        )
    )
    links = tested.where("sure").select(*frame, "u", "v").distinct()
    for level in range(2, LEVELS + 1):
        open_pairs = cut(
            tested.where("not sure").join(links, [*frame, "u", "v"], "left_anti")
        )
        if open_pairs.isEmpty():
            break
        boxes = cut(_boxes(spots, grid, frame, level))
        left = boxes.select(
            *frame,
            *[F.col(c).alias(f"a_{c}") for c in ("cx", "cy")],
            F.col("px").alias("a_sx"),
            F.col("py").alias("a_sy"),
            F.struct("node", "cx", "cy", "sx", "sy", "x0", "x1", "y0", "y1").alias("abox"),
        )
        right = boxes.select(
            *frame,
            *[F.col(c).alias(f"b_{c}") for c in ("cx", "cy")],
            F.col("px").alias("b_sx"),
            F.col("py").alias("b_sy"),
            F.struct("node", "cx", "cy", "sx", "sy", "x0", "x1", "y0", "y1").alias("b"),
        )
        pairs = open_pairs.join(left, [*frame, "a_cx", "a_cy", "a_sx", "a_sy"]).join(
            right, [*frame, "b_cx", "b_cy", "b_sx", "b_sy"]
        )
        width, height = grid.world.width, grid.world.height
        moved = pairs.withColumn(
            "a",
            F.struct(
                *[F.col(f"abox.{c}").alias(c) for c in ("node", "cx", "cy", "sx", "sy")],
                F.col("a_wx").alias("wx"),
                F.col("a_wy").alias("wy"),
                *[(F.col(f"abox.{c}") - F.col("a_wx") * width).alias(c) for c in ("x0", "x1")],
                *[(F.col(f"abox.{c}") - F.col("a_wy") * height).alias(c) for c in ("y0", "y1")],
            ),
        )
        tested = cut(moved.where(maybe).select(*frame, *ends, sure.alias("sure"), *trace))
        links = links.union(tested.where("sure").select(*frame, "u", "v").distinct())
    else:
        # the last boxes are LEVELS splits deep; what is open there is decided by positions
        links = links.union(_by_position(tested, spots, links, grid, limit, frame))
    return links.distinct()


def _by_position(tested, spots, links, grid: Grid, limit: Column, frame: list[str]) -> DataFrame:
    """Links among the box pairs still open at the deepest level, position by position."""
    open_pairs = tested.where("not sure").join(links, [*frame, "u", "v"], "left_anti")
    deep = _sub_cells(spots, grid, LEVELS)

    def side(s: str) -> DataFrame:
        renamed = [F.col(c).alias(f"{s}_{c}") for c in ("cx", "cy", "sx", "sy")]
        return deep.select(*frame, *renamed, F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))

    d = V.delta(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), grid.world)
    return (
        open_pairs.join(side("a"), [*frame, "a_cx", "a_cy", "a_sx", "a_sy"])
        .join(side("b"), [*frame, "b_cx", "b_cy", "b_sx", "b_sy"])
        .where(V.norm_sq(d) <= limit)
        .select(*frame, "u", "v")
        .distinct()
    )


def dbscan(
    points: DataFrame,
    radius: float,
    min_pts: int,
    world: World,
    frame: Sequence[str] = ("time",),
    *,
    skew: Skew = Skew(),
) -> DataFrame:
    """``points`` with cluster_id: 0 is noise, else 1 + the smallest core agent of the cluster.

    An agent counts itself; neighbours at exactly the radius count. A border
    agent joins the cluster with the largest id among its core neighbours.
    Distances follow the world, so clusters across a seam are one cluster. Positions may
    lie outside the world: a plane goes on there, a torus wraps around.
    """
    frame = list(frame)
    rows = points.drop("cluster_id")
    if world.toroidal:
        inside = {"x": V.wrapped(F.col("x"), world.width), "y": V.wrapped(F.col("y"), world.height)}
        rows = rows.withColumns({"_x": F.col("x"), "_y": F.col("y")}).withColumns(inside)
        points = points.withColumns(inside)
    grid = Grid.within_radius(world, radius)
    cell = [*frame, "cx", "cy"]
    position = [*frame, "x", "y"]

    bare = with_cell(points.select(*frame, "id", "x", "y"), grid)
    spots = cut(
        bare.groupBy(*cell, "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    )
    # work per cell is linear in its agents, so cells are held to the limit of lookups
    hot_rows = skew.needed(spots.agg(F.sum("n")).first()[0] or 0).key_rows
    in_cell = spots.groupBy(*cell).agg(F.sum("n").alias("n_cell"))
    counted = skew_join(spots, in_cell, cell, spread_by=["x", "y"], hot_rows=hot_rows)
    counted = counted.withColumn("id", F.xxhash64("x", "y"))

    # only agents of cells below min_pts need counting: at most min_pts - 1 per cell
    sparse = counted.where(F.col("n_cell") < min_pts).select(
        *cell, F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    d = V.delta(F.col("a.x"), F.col("a.y"), F.col("b.x2"), F.col("b.y2"), world)
    near = V.norm_sq(d) <= F.lit(float(radius) ** 2)
    degree = (
        cell_join(counted, sparse, grid, frame, near, hot_rows=hot_rows)
        .groupBy(*frame, F.col("x2").alias("x"), F.col("y2").alias("y"))
        .agg(F.sum("n").alias("degree"))
    )
    is_core = (F.col("n_cell") >= min_pts) | (F.coalesce("degree", F.lit(0)) >= min_pts)
    ranked = cut(counted.join(degree, position, "left").withColumn("core", is_core))
    core = ranked.where("core")
    nodes = cut(core.groupBy(*cell).agg(F.min("first_id").alias("node")))
    placed = skew_join(core, nodes, cell, spread_by=["x", "y"], hot_rows=hot_rows)
    links = cell_links(placed.select(*cell, "x", "y", "node"), grid, radius, frame)
    found = connected(nodes.select(*frame, "node"), links, frame)
    cell_label = nodes.join(found, [*frame, "node"]).select(*cell, "label")
    labelled = cut(
        skew_join(
            core.select(*cell, "x", "y", "id"), cell_label, cell, spread_by=["x", "y"], hot_rows=hot_rows
        )
    )

    border = ranked.where("not core").select(*cell, F.col("x").alias("x2"), F.col("y").alias("y2"))
    joined = (
        cell_join(labelled, border, grid, frame, near, hot_rows=hot_rows)
        .groupBy(*frame, F.col("x2").alias("x"), F.col("y2").alias("y"))
        .agg(F.max("label").alias("label"))
    )
    table = labelled.select(*position, "label").union(joined.select(*position, "label"))
    if hot_rows:
        table = cut(table)
    found = (
        skew_join(rows, table, position, spread_by=["id"], hot_rows=hot_rows)
        .withColumn("cluster_id", F.coalesce(F.col("label") + 1, F.lit(0)))
        .drop("label")
    )
    if world.toroidal:
        found = found.withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y")
    return found


def components(
    points: DataFrame, radius: float, world: World, frame: Sequence[str] = ("time",), **options
) -> DataFrame:
    """``points`` with component: the smallest agent reachable by steps within the radius."""
    every = dbscan(points, radius, 1, world, frame, **options)
    return every.withColumn("component", F.col("cluster_id") - 1).drop("cluster_id")


def cluster_sizes(clustered: DataFrame, frame: Sequence[str] = ("time",)) -> DataFrame:
    return clustered.groupBy(*frame, "cluster_id").agg(F.count(F.lit(1)).alias("agents"))
