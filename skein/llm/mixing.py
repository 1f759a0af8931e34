"""Mixing sources to target weights by proportionate fair scheduling, in DataFrame code only.

A source's rows are cut into blocks. Time runs in slots of one block. With a share of
c blocks in a cycle of L slots, block i of a source is released at floor(i L / c) and due
at ceil((i + 1) L / c); each slot goes to the released block that is due first. The
shares of a cycle sum to L, so every block meets its window and at any slot each
source is less than one block away from its share.

Shares: given weights become whole blocks of the shortest cycle that holds them exactly, as decimals, if it
has at most LONGEST slots; else the nearest blocks of a cycle of that length, which is off by less than a
block a cycle. Weights from row counts become ``round(weight * cycle)`` blocks, at least one. A phase runs
cycles until the block that uses up a source; from the next slot on the others go on at the same
proportions, with the bound counted from there. So no row is dropped or repeated. The
schedule of a cycle is computed once per phase, by one expression over the slots of a cycle
and the sources, whatever the number of rows: cycle * sources ** 2 steps in one task, which is meant for
tens of sources.

Rows are put into blocks in a pseudo-random, repeatable order. Ranks inside a source are
taken in slices, so a source that holds most rows is ranked by many tasks.

A null source is a source of its own, called ''. A null doc_id and a null text are kept.
Equal rows follow each other. Sources without a target weight get weight 0 if weights are
given: one block a cycle. Other columns are ignored by ``mix`` and kept by ``mixed``.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import NO_ID
from skein.session import cut

CYCLE = 1000  # slots of a full cycle, apart from rounding of the shares
BLOCK = 16  # rows of a block
LONGEST = 10_000  # slots of the cycle that given weights may need
SLICES = 1024  # of a source's rows, for ranking
DAMPING = 0.5  # without given weights: a source's weight is its row count to this power


def whole_shares(weights: Mapping[str, float], longest: int) -> dict[str, int]:
    """The weights as blocks of a cycle of at most ``longest`` slots: exact ones if there are any, else the nearest."""
    exact = {s: Fraction(str(w)) for s, w in weights.items() if w > 0}
    total = sum(exact.values())
    parts = {s: w / total for s, w in exact.items()}
    slots = lcm(*[x.denominator for x in parts.values()])
    if slots <= longest:
        return {s: int(x * slots) for s, x in parts.items()}
    down = {s: int(x * longest) for s, x in parts.items()}
    order = sorted(parts, key=lambda s: (down[s] - parts[s] * longest, s))
    up = set(order[: longest - sum(down.values())])
    return {s: max(n + (s in up), 1) for s, n in down.items()}


def sources(ranked: DataFrame, block: int, weights: Mapping[str, float] | None, cycle: int) -> DataFrame:
    """One row: ``names``, ``blocks`` and ``shares``, arrays over the sources."""
    counts = ranked.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = f"cast(round(x.w * {cycle} / nullif(aggregate(s, 0D, (t, x) -> t + x.w), 0)) as bigint)"
        weight = F.pow("n", F.lit(DAMPING))
    else:
        share = "cast(x.w as bigint)"
        items = [F.lit(x) for s, n in whole_shares(weights, LONGEST).items() for x in (s, float(n))]
        weight = F.coalesce(F.create_map(*items)[F.col("src")] if items else F.lit(0.0), F.lit(0.0))
    one = counts.select("src", "n", weight.cast("double").alias("w")).agg(
        F.array_sort(F.collect_list(F.struct("src", "n", "w"))).alias("s")
    )
    return one.select(
        F.expr("s.src").alias("names"),
        F.expr(f"transform(s, x -> cast(ceil(x.n / {block}) as bigint))").alias("blocks"),
        F.expr(f"transform(s, x -> greatest(1L, {share}, 1L))").alias("shares"),
    )


# Earliest deadline first over one cycle: the source of each slot. Ties go to the larger share.
PICKS = """
aggregate(
  sequence(0L, slots - 1),
  named_struct('done', transform(alloc, x -> 0L), 'picks', cast(array() as array<int>)),
  (now, t) -> element_at(transform(array(
      array_min(filter(transform(alloc, (c, s) -> CASE
          WHEN now.done[s] < c AND (now.done[s] * slots) div c <= t
          THEN struct(((now.done[s] + 1) * slots + c - 1) div c AS due, -c AS heavy, s AS s) END),
        x -> x IS NOT NULL))
    ), p -> named_struct(
      'done', transform(now.done, (d, s) -> CASE WHEN s = p.s THEN d + 1 ELSE d END),
      'picks', concat(now.picks, array(p.s)))), 1),
  now -> now.picks)
"""
# What a phase needs, each from those before: shares of the sources left, slots of a cycle, whole cycles, the
# cycle's sources, the slot of the next cycle that uses a source up, the part of it until there, blocks placed.
STEPS = {
    "alloc": "zip_with(st.rest, shares, (r, c) -> CASE WHEN r > 0 THEN c ELSE 0L END)",
    "slots": "aggregate(alloc, 0L, (t, x) -> t + x)",
    "m": "array_min(zip_with(st.rest, alloc, (r, c) -> CASE WHEN c > 0 THEN r div c END))",
    "picks": PICKS,
    "ends": """array_min(transform(zip_with(st.rest, alloc, (r, c) -> CASE WHEN r - m * c < c THEN r - m * c END),
      (x, s) -> CASE WHEN x = 0 THEN 0 WHEN x > 0 THEN
        element_at(filter(sequence(1, size(picks)), j -> picks[j - 1] = s), cast(x as int)) END))""",
    "last": "slice(picks, 1, ends)",
    "used": "transform(alloc, (c, s) -> m * c + size(filter(last, x -> x = s)))",
}
NEXT = """named_struct(
  'rest', zip_with(st.rest, used, (r, u) -> r - u),
  'at', st.at + m * slots + ends,
  'done', zip_with(st.done, used, (d, u) -> d + u),
  'out', concat(st.out, filter(array(
    named_struct('start', st.at, 'cycles', m, 'picks', picks, 'placed', st.done),
    named_struct('start', st.at + m * slots, 'cycles', 1L, 'picks', last,
      'placed', zip_with(st.done, alloc, (d, c) -> d + m * c))
  ), p -> p.cycles > 0 AND size(p.picks) > 0)))"""
PHASE = "struct<start:bigint,cycles:bigint,picks:array<int>,placed:array<bigint>>"


def bound(names: Mapping[str, str], result: str) -> str:
    """SQL of ``result`` with names bound one after the other, each computed once."""
    for name, value in reversed(names.items()):
        result = f"element_at(transform(array({value}), {name} -> {result}), 1)"
    return result


# The state goes from phase to phase: blocks left, next slot, blocks placed, phases so far. A phase has
# whole cycles (if any) and a last one that ends with the block that uses a source up.
PHASES = f"""
aggregate(
  sequence(1, size(names)),
  named_struct('rest', blocks, 'at', 0L, 'done', transform(blocks, x -> 0L), 'out', cast(array() as array<{PHASE}>)),
  (st, i) -> CASE WHEN array_max(st.rest) = 0 THEN st ELSE {bound(STEPS, NEXT)} END,
  st -> st.out)
"""


def schedule(shares: DataFrame) -> DataFrame:
    """(src, first, last, per, start, slots, at): where the blocks of a source go.

    Blocks ``first`` to ``last`` (exclusive) of the source, ``per`` a cycle; block ``first + k``
    goes to slot ``start + (k div per) * slots + at[k mod per]``.
    """
    phases = shares.select("names", F.explode(F.expr(PHASES)).alias("p")).select("names", "p.*")
    per_source = phases.select(
        "start", "cycles", "picks", F.posexplode(F.arrays_zip("names", "placed")).alias("s", "x")
    ).withColumn("at", F.expr("filter(sequence(0, size(picks) - 1), i -> picks[i] = s)"))
    return per_source.where("size(at) > 0").select(
        F.col("x.names").alias("src"),
        F.col("x.placed").alias("first"),
        (F.col("x.placed") + F.col("cycles") * F.size("at")).alias("last"),
        F.size("at").cast("long").alias("per"),
        "start",
        F.size("picks").cast("long").alias("slots"),
        "at",
    )


def ranked_rows(docs: DataFrame) -> DataFrame:
    """(did, key, copy, src, rank): the place of each row inside its source.

    ``key`` is 64 bits of the row's id and text. Slices of a source are ranges of another
    hash, so the rank is the number of rows in earlier slices plus the rank in the slice.
    """
    rows = docs.select(
        docs["doc_id"].alias("did"),
        F.coalesce(docs["source"], F.lit("")).alias("src"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("key"),
    )
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(SLICES)).cast("int"))
    before = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        sliced.groupBy("src", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("src", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    )
    inside = Window.partitionBy("src", "slice").orderBy("key", "did")
    copies = Window.partitionBy("src", "slice", "key", "did").orderBy("key")
    return (
        sliced.withColumn("r", F.row_number().over(inside))
        .withColumn("copy", F.row_number().over(copies))
        .join(sizes, ["src", "slice"])
        .select("did", "key", "copy", "src", (F.col("earlier") + F.col("r") - 1).alias("rank"))
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block: int = BLOCK,
    cycle: int = CYCLE,
) -> DataFrame:
    """(doc_id, source, key, copy, block, slot, position) for every row.

    ``position`` is the row's place in the mix: rows go by slot, then by rank in their block.
    """
    ranked = cut(ranked_rows(docs))
    plan = schedule(sources(ranked, block, weights, cycle))
    blocks = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    # The plan has at most two rows for each source and phase, with a cycle's slots in all.
    placed = (
        blocks.select("src", "block").distinct()
        .join(plan, (blocks["src"] == plan["src"]) & blocks["block"].between(plan["first"], plan["last"] - 1))
        .select(
            blocks["src"],
            blocks["block"],
            F.expr("start + ((block - first) div per) * slots + at[cast((block - first) % per as int)]").alias("slot"),
        )
    )
    return blocks.join(placed, ["src", "block"]).select(
        F.col("did").alias("doc_id"),
        F.col("src").alias("source"),
        "key",
        "copy",
        "block",
        "slot",
        (F.col("slot") * block + F.col("rank") % block).alias("position"),
    )


def mixed(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block: int = BLOCK,
    cycle: int = CYCLE,
) -> DataFrame:
    """``docs`` in the order of the mix; rows equal in doc_id and text stand together."""
    names = docs.columns
    same = [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("did"), "key"]
    order = mix(docs, weights, block, cycle).groupBy(*same).agg(F.min("position").alias("position"))
    packed = docs.select(
        F.coalesce(docs["doc_id"], F.lit(NO_ID)).alias("did"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("key"),
        F.struct(*[docs[n] for n in names]).alias("row"),
    )
    placed = packed.join(order.hint("shuffle_hash"), ["did", "key"]).orderBy("position", "key")
    return placed.select(*[F.col(f"row.`{n}`").alias(n) for n in names])


def placed(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block: int = BLOCK,
    cycle: int = CYCLE,
) -> DataFrame:
    """(doc_id, text, slot, position), one row per row of ``docs``, in no order.

    Places follow from the rows alone, not from their order, so they are those that ``mixed`` sorted by
    before its result was written and read again. Rows equal in doc_id and text share one row of texts.
    """
    did = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("did")
    places = mix(docs, weights, block, cycle).select(did, "key", "slot", "position")
    key = F.xxhash64(docs["doc_id"], docs["text"]).alias("key")
    texts = docs.select(did, key, docs["doc_id"], docs["text"]).dropDuplicates(["did", "key"])
    return texts.join(places.hint("merge"), ["did", "key"]).select("doc_id", "text", "slot", "position")
