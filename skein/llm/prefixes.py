"""The trie of conversation prefixes by ROLLUP over positional turn columns.

1. Turns get their place in the conversation from a sort by ranges, so a conversation of any
   length is spread over tasks. A turn is known by 128 bits of role and text; ties of one turn number go
   by these.
2. A conversation becomes block rows of BLOCK turn columns. A block row carries the key of the node
   where the block before ends, which is the exclusive-or of position-bound hashes of all turns before.
   So the blocks of all depths are in one table and need no rounds.
3. GROUP BY that key and ROLLUP of the turn columns counts the members of all prefixes at once;
   grouping_id tells the depth. Copies are aggregated before the shuffle.
4. A node belongs to its smallest member, and the nodes of one conversation are the lower end of its
   path. So the sum over a subtree is the sum of what its members own, one more ROLLUP, less what
   the smallest member owns above the node.
5. The members that end at a node are sorted by ranges, joined to short strings and hashed one
   string after the other; no task holds a group.

A null conv_id is one conversation of its own, which sorts before all others, is left as it
is, and is written as an empty string in digests. Null roles and texts are empty, a null turn
comes first, repeated rows are turns of their own. Other columns are ignored. An empty table gives an empty
table. Keys have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import NO_ID, arrow_schema, partitions, sha256, written

BLOCK = 8  # turn columns of a block row
SLICE = 1 << 15  # blocks or nodes of one conversation that a window takes
CHUNK = 8192  # bytes of the strings that ids are joined to
TURNS = [f"t{i}" for i in range(BLOCK)]
KEY = ["depth", "ka", "kb"]
HEAD = 3  # turns that a conversation takes from another one at most

#: conversation -> (number of turns it takes from another one in place of its own first ones, that one's id)
Heads = Callable[[Column], tuple[Column, Column]]


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def planted(conv: Column) -> tuple[Column, Column]:
    """The query's rule: up to three turns come from the conversation whose id is the next multiple of 20 towards zero."""
    h = F.when(conv == NO_ID, 0).otherwise(F.crc32(conv.cast("string").cast("binary")) % 4)
    return h.cast("long"), conv - conv % 20


def no_heads(conv: Column) -> tuple[Column, Column]:
    return F.lit(0).cast("long"), conv


def sorted_turns(rows: DataFrame) -> DataFrame:
    """(conv, pid, mid, a, b, w): the turns, numbered within the ranges they are sorted by. Written once."""
    turns = rows.select(
        F.coalesce(rows["conv_id"].cast("long"), F.lit(NO_ID)).alias("conv"),
        rows["turn"].alias("turn"),
        F.coalesce(rows["role"], F.lit("")).alias("role"),
        F.coalesce(rows["text"], F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("scan"),  # spreads repeated rows
    ).select(
        "conv",
        "turn",
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit(1), "role", "text").alias("b"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"),
        "scan",
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "a", "b", "scan"]
    ranges = turns.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return written(ranges.select("conv", F.shiftright(number, 33).alias("pid"), number.alias("mid"), "a", "b", "w"))


def rebuilt(rows: DataFrame, heads: Heads) -> tuple[DataFrame, DataFrame]:
    """(conv, at, m, a, b, w): the turns after heads were exchanged, and the conversations that have none left."""
    turns = sorted_turns(rows)
    stretches = turns.groupBy("conv", "pid").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    before = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    h, base = heads(F.col("conv"))
    stretches = stretches.select(
        "conv", "pid", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("own")
    )
    convs = stretches.where("before = 0").select("conv", "own", h.alias("h"), base.alias("base"))
    sizes = convs.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = convs.join(sizes, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), "own"
    )
    convs = convs.withColumn("m", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    placed = turns.join(
        stretches.select("conv", "pid", "first", "before").join(convs.select("conv", "h", "taken", "m"), "conv"), ["conv", "pid"]
    ).withColumn("at", F.col("mid") - F.col("first") + F.col("before"))
    own = placed.where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "m", "a", "b", "w")
    lent = placed.where(F.col("at") < HEAD).select(F.col("conv").alias("base"), "at", "a", "b", "w")
    takers = convs.where("taken > 0").select("conv", "base", "h", "m")
    taken = lent.join(takers, "base").where("at < h").select("conv", "at", "m", "a", "b", "w")
    return own.unionByName(taken), convs.where("m = 0").select("conv", "m")


def running(
    df: DataFrame, key: str, at: str, values: dict[str, Column], backwards: bool = False
) -> DataFrame:
    """Adds running aggregates over ``key`` in the order of ``at``: in slices, and over the totals of slices."""
    add = {n: F.bit_xor if n.startswith("x") else F.sum for n in values}
    here = df.select("*", *[v.alias(f"_{n}") for n, v in values.items()], F.floor(F.col(at) / SLICE).alias("_slice"))
    totals = here.groupBy(key, "_slice").agg(*[add[n](f"_{n}").alias(f"_{n}_before") for n in values])
    order = F.col("_slice").desc() if backwards else F.col("_slice")
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_slice", *[add[n](f"_{n}_before").over(earlier).alias(f"_{n}_before") for n in values])
    inside = Window.partitionBy(key, "_slice").orderBy(F.col(at).desc() if backwards else F.col(at))
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = here.withColumns({f"_{n}": add[n](f"_{n}").over(inside) for n in values}).join(totals, [key, "_slice"])
    for n in values:
        first, rest = F.coalesce(f"_{n}_before", F.lit(0)), F.col(f"_{n}")
        out = out.withColumn(n, first.bitwiseXOR(rest) if n.startswith("x") else first + rest)
    return out.select(*df.columns, *values)


def turn_hashes(at: Column, turn: Column) -> tuple[Column, Column]:
    """What a turn at a place adds to the two halves of a node's key; 0 for no turn."""
    return tuple(
        F.when(turn.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), at, turn["a"], turn["b"])) for seed in (2, 3)
    )


def blocks(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """Block rows: conv, m, first place, key of the node before, BLOCK turns (null beyond the end). Written once."""
    turn = F.struct("a", "b", "w")
    xa, xb = turn_hashes(F.col("at"), turn)
    rows = turns.select("conv", "m", F.floor(F.col("at") / BLOCK).alias("k"), (F.col("at") % BLOCK).alias("i"), turn.alias("t"), xa.alias("xa"), xb.alias("xb"))
    rows = rows.groupBy("conv", "k").agg(
        F.max("m").alias("m"),
        F.bit_xor("xa").alias("oa"),
        F.bit_xor("xb").alias("ob"),
        *[F.max(F.when(F.col("i") == i, F.col("t"))).alias(t) for i, t in enumerate(TURNS)],
    )
    rows = running(rows, "conv", "k", {"xa": F.col("oa"), "xb": F.col("ob")})
    rows = rows.select(
        "conv", "m", (F.col("k") * BLOCK).alias("base"),
        F.col("xa").bitwiseXOR(F.col("oa")).alias("ba"), F.col("xb").bitwiseXOR(F.col("ob")).alias("bb"), *TURNS,
    )
    zero = F.lit(0).cast("long")
    none = [F.lit(None).cast(rows.schema[t].dataType).alias(t) for t in TURNS]
    root = turnless.select("conv", "m", zero.alias("base"), zero.alias("ba"), zero.alias("bb"), *none)
    return written(rows.unionByName(root))


def rolled_up(rows: DataFrame, aggregates: Sequence[str]) -> DataFrame:
    """Aggregates of all prefixes: depth, ka, kb (the node's key), qa, qb (its parent's), w (words of its last turn)."""
    turns = ", ".join(TURNS)
    groups = rows.sparkSession.sql(
        f"SELECT base, ba, bb, {turns}, {BLOCK} - bit_count(grouping_id()) AS level, {', '.join(aggregates)} "
        f"FROM {{rows}} GROUP BY base, ba, bb, ROLLUP ({turns})",
        rows=rows,
    )
    last = F.coalesce(*[F.when(F.col("level") == i + 1, F.col(t)) for i, t in enumerate(TURNS)])
    # A prefix of fewer turns than its level is no prefix; a later block's empty one is the node before it.
    groups = groups.withColumn("last", last).where("CASE WHEN level = 0 THEN base = 0 ELSE last IS NOT NULL END")
    ka, kb = F.col("ba"), F.col("bb")
    for i, t in enumerate(TURNS):
        a, b = turn_hashes(F.col("base") + i, F.col(t))
        ka, kb = ka.bitwiseXOR(a), kb.bitwiseXOR(b)
    depth = (F.col("base") + F.col("level")).alias("depth")
    la, lb = turn_hashes(F.col("base") + F.col("level") - 1, F.col("last"))
    names = [c for c in groups.columns if c not in {"base", "ba", "bb", "level", "last", *TURNS}]
    keyed = groups.select(depth, ka.alias("ka"), kb.alias("kb"), la.alias("la"), lb.alias("lb"), F.coalesce("last.w", F.lit(0)).alias("w"), *names)
    qa, qb = F.col("ka").bitwiseXOR(F.col("la")), F.col("kb").bitwiseXOR(F.col("lb"))
    return keyed.select(*KEY, qa.alias("qa"), qb.alias("qb"), "w", *names)


def ends(rows: DataFrame) -> DataFrame:
    """(depth, ka, kb, conv): the node where each conversation ends."""
    here = rows.where("m = 0 OR base = (m - 1) div %d * %d" % (BLOCK, BLOCK))
    ka, kb = F.col("ba"), F.col("bb")
    for i, t in enumerate(TURNS):
        a, b = turn_hashes(F.col("base") + i, F.col(t))
        ka, kb = ka.bitwiseXOR(a), kb.bitwiseXOR(b)
    return here.select(F.col("m").alias("depth"), ka.alias("ka"), kb.alias("kb"), "conv")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, object]]:
    """(node, last column) of rows, by batches of plain values."""
    for batch in batches:
        columns = batch.to_pydict()
        *key, value = columns.values()
        yield from zip(zip(*key), value)


def ends_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending, joined by commas."""
    spark = members.sparkSession
    n = partitions(spark)
    schema, digests = "depth long, ka long, kb long, first long, ids string", "depth long, ka long, kb long, ends_sha256 string"
    strings, hashed = arrow_schema(spark, schema), arrow_schema(spark, digests)

    def batch_of(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        node, first, ids, size = None, None, [], 0
        for key, conv in _runs(batches):
            if ids and (key != node or size >= CHUNK):
                out.append((*node, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                node, first = key, conv
            ids.append("" if conv == NO_ID else str(conv))
            size += len(ids[-1]) + 1
            if len(out) >= 5000:
                yield batch_of(out, strings)
                out = []
        if ids:
            out.append((*node, first, ",".join(ids)))
        if out:
            yield batch_of(out, strings)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        node, state = None, None
        for key, ids in _runs(batches):
            if key == node:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append((*node, state.hexdigest()))
            node, state = key, hashlib.sha256(ids.encode())
            if len(out) >= 5000:
                yield batch_of(out, hashed)
                out = []
        if state is not None:
            out.append((*node, state.hexdigest()))
        if out:
            yield batch_of(out, hashed)

    order = [*KEY, "conv"]
    joined = members.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(join, schema)
    pieces = joined.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").drop("first")
    return pieces.mapInArrow(digest, digests)


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds ``parent``, the smallest member of a node's parent. Written once."""
    root = nodes.where("depth = 0").select("conv").first()
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("ka").alias("qa"), F.col("kb").alias("qb"), F.col("conv").alias("parent")
    )
    deep = nodes.where("depth > 1").join(parents.where("depth > 1"), ["depth", "qa", "qb"])
    of_root = F.when(F.col("depth") == 1, F.lit(root["conv"] if root else None)).cast("long")
    top = nodes.where("depth <= 1").withColumn("parent", of_root)  # the root may have most nodes as children
    return written(deep.select(top.columns).unionByName(top))


def trie(rows: DataFrame, heads: Heads = no_heads) -> tuple[DataFrame, DataFrame]:
    """Nodes (KEY, parent's key qa and qb, conv, parent, n_convs, n_children, n_leaves, saved) and (KEY, conv) of the ends."""
    block_rows = blocks(*rebuilt(rows, heads))
    nodes = rolled_up(block_rows, ["count(1) AS n_convs", "min(conv) AS conv"])
    nodes = written(nodes)
    up = [(F.col("depth") - 1).alias("depth"), F.col("qa").alias("ka"), F.col("qb").alias("kb")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").fillna(0, ["n_children"])
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("w")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = with_parents(written(nodes))
    owned = nodes.groupBy("conv").agg(F.sum("saved").alias("owns_saved"), F.sum("leaf").alias("owns_leaf"))
    of_members = rolled_up(
        block_rows.join(owned, "conv", "left").fillna(0, ["owns_saved", "owns_leaf"]),
        ["sum(owns_saved) AS all_saved", "sum(owns_leaf) AS all_leaf"],
    ).select(*KEY, "all_saved", "all_leaf")
    below = running(nodes, "conv", "depth", {"s_saved": F.col("saved"), "s_leaf": F.col("leaf")}, backwards=True)
    below = below.join(owned, "conv").join(of_members, KEY)
    out = below.select(
        *KEY, "qa", "qb", "conv", "parent", "n_convs", "n_children",
        (F.col("all_leaf") - F.col("owns_leaf") + F.col("s_leaf")).alias("n_leaves"),
        (F.col("all_saved") - F.col("owns_saved") + F.col("s_saved")).alias("saved"),
    )
    return out, ends(block_rows)


def summary(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """A row per node with its relatives, sums and the digest of the conversations that end there."""

    def public(name: str, out: str) -> Column:
        return F.when(F.col(name) != NO_ID, F.col(name)).alias(out)

    return nodes.join(ends_digests(members), KEY, "left").select(
        public("conv", "conv_id"),
        "depth",
        public("parent", "parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(""))).alias("ends_sha256"),
    )
