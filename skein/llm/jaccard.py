"""N-gram Jaccard join by chosen paths.

Documents become sets of hashed five-word shingles; equal sets become one record. A
record is embedded as COORDINATES sampled tokens, its smallest hashes, so two records agree on
a coordinate with the probability of their similarity. A run starts with a bucket for each value of a
coordinate of its own. A bucket over LIMIT records is split: its path chooses a few coordinates, more than
1/threshold of them, and records go on to a bucket for each value they have there. So a pair at the
threshold goes on, on average, with more than one common bucket a step. Each step has coordinates that no
run and no other step uses. Buckets of at most LIMIT records are leaves. A bucket that hardly shrinks on any
of its coordinates holds much alike records: it is not split, but cut into blocks of which all pairs are
compared, as is a bucket that is still larger after DEPTH steps. The number of runs follows from the
target recall at the threshold, by the chance over all coordinates that a pair is lost in every run.

A leaf compares signatures first, then exact sets of what is left, and a pair is counted in
the first leaf that both records have in common, so no pair is written out: a leaf gives, per
record, the number of its links, and a spanning forest of the links. Classes are
the connected components of the forests.

Words are maximal runs of other than white space, unchanged. A text of one to four words is one
shingle; a text without words (also a null) links to nothing. A null doc_id counts as smaller
than every other id. Rows that share a doc_id are copies if their texts are equal, and else
different texts that may link. A link joins different texts. Other columns are ignored by
``join`` and kept by ``one_per_class``. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import (
    NO_ID, arrow_schema, groups, id_text, mix, partitions, public_id, runs, text_buffers, with_row_key, written,
)

SHINGLE = 5  # words
THRESHOLD = 0.8
RECALL = 0.99999  # of pairs at the threshold
COORDINATES = 64
LIMIT = 256  # records of a leaf
BLOCK = 1024  # records of a block, where a bucket can't be split down to a leaf
DEPTH = 5
SHRINKS = 0.75  # share of a bucket in one of its parts from which it counts as hardly shrinking
SLACK = 5  # standard deviations by which a signature may understate a similarity
TEXTS = 200  # hashed at a time
WIDTH = 4096  # columns of an incidence matrix


def picks(threshold: float) -> int:
    """Coordinates that a split chooses, on more than one of which a pair at the threshold agrees on average."""
    return math.floor(1 / threshold) + 1


def step_coordinates(runs: int, depth: int, step: int) -> range:
    """The coordinates of split ``step`` (from 1): the runs have the first ones, the splits equal shares of the others."""
    each = (COORDINATES - runs) // max(1, depth - 1)
    return range(runs + (step - 1) * each, runs + step * each)


def missed(threshold: float, depth: int, runs: int) -> float:
    """The chance that no run keeps a pair at the threshold together through all ``depth`` steps.

    Paths share the coordinates of a step, so the chance is the mean over the numbers of those that agree.
    """
    each, chosen = len(step_coordinates(runs, depth, 1)), picks(threshold)
    agree = [math.comb(each, a) * threshold**a * (1 - threshold) ** (each - a) for a in range(each + 1)]
    kept = {1.0: 1.0}  # chance to stay together from a step on -> its weight
    for _ in range(depth - 1):
        earlier: dict[float, float] = {}
        for s, weight in kept.items():
            for a, w in enumerate(agree):
                ways = [math.comb(a, j) * math.comb(each - a, chosen - j) for j in range(chosen + 1)]
                lost = sum(n * (1 - s) ** j for j, n in enumerate(ways)) / math.comb(each, chosen)
                stays = math.floor(1e4 * (1 - lost)) / 1e4
                earlier[stays] = earlier.get(stays, 0.0) + weight * w
        kept = earlier
    return sum(weight * (1 - threshold * s) ** runs for s, weight in kept.items())


def survival(threshold: float, depth: int) -> float:
    """The chance that a pair at the threshold has a common bucket after ``depth`` steps of a run."""
    return 1 - missed(threshold, depth, 1)


def runs_needed(threshold: float, depth: int, recall: float) -> int:
    runs = 1
    while len(step_coordinates(runs, depth, 1)) >= picks(threshold):
        if missed(threshold, depth, runs) <= 1 - recall:
            return runs
        runs += 1
    raise ValueError(f"{COORDINATES} coordinates do not give a recall of {recall} at {threshold}")


def shingles(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, sorted distinct shingle hashes) of each text."""
    for lo in range(0, len(ends) - 1, TEXTS):
        hi = min(lo + TEXTS, len(ends) - 1)
        split = [data[a:b].tobytes().split() for a, b in zip(ends[lo:hi].tolist(), ends[lo + 1 : hi + 1].tolist())]
        words = [w for x in split for w in x]
        known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        whole = _chained(hashes, SHINGLE)
        end = 0
        for i, x in enumerate(split, lo):
            begin, end = end, end + len(x)
            if len(x) >= SHINGLE:
                yield i, np.unique(whole[begin : end - SHINGLE + 1])
            else:
                yield i, _chained(hashes[begin:end], len(x))


def _chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n < 1 or not size:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    return out


SEEDS = mix(np.arange(2 * COORDINATES, dtype=np.uint64), 21)
FACTORS, SHIFTS = SEEDS[:COORDINATES] | np.uint64(1), SEEDS[COORDINATES:]


def signature(tokens: np.ndarray) -> np.ndarray:
    """The smallest of COORDINATES hashes of the tokens, 32 bits each."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(tokens), 2048):
            block = tokens[lo : lo + 2048, None] * FACTORS + SHIFTS
            out = np.minimum(out, (block >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def signed(rows: DataFrame) -> DataFrame:
    """(did, rid, a, b, th, sig): 128 bits of the shingle set (null without words), of the text, and the signature."""
    schema = "did long, rid long, th long, a long, b long, sig binary"

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_buffers(batch.column(3))
            a, b, sigs = [], [], []
            for _, tokens in shingles(data, ends):
                raw = tokens.tobytes()
                whole = xxhash.xxh3_128_intdigest(raw)
                a.append((whole >> 64) - (1 << 63) if len(tokens) else None)
                b.append((whole & (2**64 - 1)) - (1 << 63) if len(tokens) else None)
                sigs.append(signature(tokens).tobytes() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sigs, pa.binary())],
                schema=target,
            )

    target = arrow_schema(rows.sparkSession, schema)
    keyed = rows.select("did", "rid", F.xxhash64(F.lit(1), "text").alias("th"), "text")
    return keyed.mapInArrow(task, schema)


def chosen(coordinates: range, count: int) -> Column:
    """The ``count`` of the coordinates that the path ``parent`` chooses."""
    ranked = f"transform(sequence({coordinates[0]}, {coordinates[-1]}), c -> struct(xxhash64(parent, c) AS h, c AS c))"
    return F.expr(f"transform(slice(array_sort({ranked}), 1, {count}), x -> x.c)")


def leaves(records: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(rec, leaf, size) of the records that are not alone in their leaf.

    Each step writes the buckets that go on; their records are joined with the signatures again.
    """
    needed = runs_needed(threshold, DEPTH, recall)
    signatures = records.select("rec", "sig")
    value = F.col("sig").substr(F.col("at") * 4 + 1, F.lit(4))
    roots = signatures.select("rec", "sig", F.explode(F.expr(f"sequence(0, {needed - 1})")).alias("at"))
    paths = written(roots.select("rec", F.xxhash64("at", value).alias("path")))
    sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = written(paths.join(sizes, "path").select("rec", "path", "size"))
    done, large = sized.where(F.col("size") <= LIMIT), sized.where(F.col("size") > LIMIT)
    for step in range(1, DEPTH):
        if large.isEmpty():
            break
        parents = large.select("rec", F.col("path").alias("parent"), F.col("size").alias("held"))
        at = chosen(step_coordinates(needed, DEPTH, step), picks(threshold))
        kids = written(
            parents.join(signatures, "rec")
            .select("rec", "parent", "held", "sig", F.posexplode(at).alias("nth", "at"))
            .select("rec", "parent", "held", "nth", F.xxhash64("parent", "at", value).alias("path"))
        )
        counted = written(kids.groupBy("parent", "held", "nth", "path").agg(F.count(F.lit(1)).alias("size")))
        widest = counted.groupBy("parent", "held", "nth").agg(F.max("size").alias("widest"))
        whole = widest.groupBy("parent").agg((F.min(F.col("widest") / F.col("held")) >= SHRINKS).alias("whole"))
        fates = counted.join(whole, "parent").where("whole OR size > 1").select("path", "size", "whole")
        sized = written(kids.join(fates, "path"))
        ended = sized.where("whole AND nth = 0").select("rec", F.col("parent").alias("path"), F.col("held").alias("size"))
        on = sized.where("NOT whole").select("rec", "path", "size")
        last = on if step == DEPTH - 1 else on.where(F.col("size") <= LIMIT)
        done = done.unionByName(ended).unionByName(last)
        large = on.where(F.col("size") > LIMIT)
    return done.select("rec", F.col("path").alias("leaf"), "size")


def dealt(members: DataFrame, extra: list[str]) -> DataFrame:
    """(cell, x, y, side, rec, ...) sorted by cell: leaves, or pairs of blocks of large leaves.

    A leaf over BLOCK records is cut into blocks by record; the cell of blocks x <= y
    compares the records of x with those of y (``side`` tells them apart).
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rec", "leaf"), F.col("blocks")).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("own", own)
    others = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = others.select(
        "leaf", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        (F.col("own") > F.col("other")).alias("side"), "rec", *extra,
    )
    cell = F.xxhash64("leaf", "x", "y").alias("cell")
    return (
        cells.select(cell, "*")
        .repartition(partitions(members.sparkSession), "cell")
        .sortWithinPartitions("cell", "leaf", "x", "y", "rec")
    )


def _first_common(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Of the pairs (i, j), those whose first common leaf is ``leaf``."""
    before = [x[x < leaf] for x in lists]
    names, codes, often = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in before])
    shared = often[codes] > 1
    return _common(owner[shared], codes[shared], len(lists), i, j) == 0


def _common(owner: np.ndarray, codes: np.ndarray, n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many codes both owners of each pair have; (owner, code) pairs are distinct."""
    both = np.zeros(len(i), np.float32)
    _, codes = np.unique(codes, return_inverse=True)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    for lo in range(0, int(codes[-1]) + 1 if len(codes) else 0, WIDTH):
        a, b = np.searchsorted(codes, (lo, lo + WIDTH))
        block = np.zeros((n, min(WIDTH, int(codes[-1]) + 1 - lo)), np.float32)
        block[owner[a:b], codes[a:b] - lo] = 1
        both += (block @ block.T)[i, j]
    return both


def _candidates(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell's rows whose signatures agree on ``least`` coordinates and that belong here."""
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
    leaf = table.column("leaf")[0].as_py()
    side = table.column("side").to_numpy()
    one_block = table.column("x")[0].as_py() == table.column("y")[0].as_py()
    found_i, found_j = [], []
    for i in range(len(sigs) - 1 if one_block else len(sigs)):
        if one_block:
            others = np.arange(i + 1, len(sigs))
        elif not side[i]:
            others = np.flatnonzero(side)
        else:
            continue
        alike = others[(sigs[others] == sigs[i]).sum(axis=1) >= least]
        found_i.append(np.full(len(alike), i))
        found_j.append(alike)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    if not len(i):
        return i, j
    lists = [np.array(x, np.int64) for x in table.column("all").to_pylist()]
    here = _first_common(lists, i, j, leaf)
    return i[here], j[here]


def _exact(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose sets reach the threshold."""
    sizes = np.array([len(s) for s in sets])
    _, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    useful = often[codes] > 1  # a token of one set adds to no intersection
    both = _common(owner[useful], codes[useful], len(sets), i, j)
    good = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-6
    return i[good], j[good]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among n rows."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def hopeful(threshold: float):
    """(leaf, x, y, side, rec) of the rows of a cell that have a candidate partner."""
    deviation = math.sqrt(threshold * (1 - threshold) / COORDINATES)
    least = math.floor(COORDINATES * (threshold - SLACK * deviation))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            i, j = _candidates(table, least)
            rows = np.union1d(i, j)
            if len(rows):
                picked = table.select(["leaf", "x", "y", "side", "rec", "all", "sig", "n_texts"]).take(pa.array(rows))
                yield from picked.combine_chunks().to_batches()

    return task, least


def linked(threshold: float, least: int):
    """(rec, n, other) per record the texts it links to in a cell (``other`` null), and forest edges (``n`` 0)."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            i, j = _candidates(table, least)
            if not len(i):
                continue
            data, ends = text_buffers(table.column("text").combine_chunks())
            sets = [tokens for _, tokens in shingles(data, ends)]
            i, j = _exact(sets, i, j, threshold)
            if not len(i):
                continue
            rec, weight = table.column("rec").to_numpy(), table.column("n_texts").to_numpy()
            n = np.zeros(len(rec), np.int64)
            np.add.at(n, i, weight[j])
            np.add.at(n, j, weight[i])
            has = np.flatnonzero(n)
            edges = np.array(forest(len(rec), i, j), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[rec[has], rec[edges[:, 0]]]),
                    pa.array(np.r_[n[has], np.zeros(len(edges), np.int64)]),
                    pa.array([*[None] * len(has), *rec[edges[:, 1]].tolist()], pa.int64()),
                ],
                names=["rec", "n", "other"],
            )

    return task


def components(edges: DataFrame) -> DataFrame:
    """(rec, class): the smallest record that each record of ``edges`` (a, b) is connected with.

    Each round lets a record point at the smallest label among its neighbours' labels and halves the way
    to it; labels are written every round, and the rounds end when no label changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        closer = labels.join(near, "a").select("a", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        new = written(
            closer.join(jump, "label", "left").select("a", F.least("label", "further").alias("label"), "old")
        )
        labels = new.select("a", "label")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return labels.select(F.col("a").alias("rec"), F.col("label").alias("class"))


def records_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (did, rid, text), their sets (did, rid, th, a, b), and records (rec, rid, a, b, n_texts, sig).

    A record is a set; ``rec`` is the smallest did that has it, with ``rid`` of one such row.
    Rows of one did with several sets give several records: ``rec`` is then told apart by ``rid``.
    """
    rows = with_row_key(id_text(docs))
    sets = written(signed(rows))
    texts = sets.where("a is not null").groupBy("a", "b", "th").agg(F.min(F.struct("did", "rid", "sig")).alias("one"))
    records = texts.groupBy("a", "b").agg(F.min("one").alias("one"), F.count(F.lit(1)).alias("n_texts"))
    return rows, sets, written(records.select("one.*", "a", "b", "n_texts"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(did, rid, class, n_links) for every row: the smallest did of its class, and the texts it links to."""
    rows, sets, records = records_of(docs)
    records = records.withColumn("rec", F.xxhash64("did", "rid", "a", "b"))
    members = written(leaves(records.select("rec", "sig"), threshold, recall))
    lists = members.groupBy("rec").agg(F.array_sort(F.collect_set("leaf")).alias("all"))
    carried = lists.join(records.select("rec", "sig", "n_texts"), "rec")
    full = members.join(carried, "rec")
    task, least = hopeful(threshold)
    kept = "leaf long, x int, y int, side boolean, rec long, all array<long>, sig binary, n_texts long"
    hopes = written(dealt(full, ["all", "sig", "n_texts"]).mapInArrow(task, kept))
    wanted = hopes.select("rec").distinct().join(records.select("rec", "did", "rid"), "rec")
    texts = rows.join(wanted.hint("shuffle_hash"), ["did", "rid"]).groupBy("rec").agg(F.min("text").alias("text"))
    cells = (
        hopes.join(texts, "rec")
        .select(F.xxhash64("leaf", "x", "y").alias("cell"), "leaf", "x", "y", "side", "rec", "all", "sig", "n_texts", "text")
        .repartition(partitions(docs.sparkSession), "cell")
        .sortWithinPartitions("cell", "leaf", "x", "y", "rec")
    )
    found = written(cells.mapInArrow(linked(threshold, least), "rec long, n long, other long"))
    counts = found.where("other is null").groupBy("rec").agg(F.sum("n").alias("n"))
    ids = records.select("rec", "did", "rid")
    edges = found.where("other is not null").select(F.col("rec").alias("a"), F.col("other").alias("b"))
    labels = components(edges)
    least_did = labels.join(ids, "rec").groupBy("class").agg(F.min("did").alias("class_did"))
    classes = labels.join(least_did, "class").select("rec", "class_did")
    per_record = (
        records.select("rec", "a", "b", "did", "n_texts")
        .join(classes, "rec", "left")
        .join(counts, "rec", "left")
        .select(
            "a", "b",
            F.coalesce("class_did", "did").alias("class"),
            (F.coalesce("n", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"),
        )
    )
    # Copies of one text may hold a third of the rows; the join deals a skewed set anew.
    return sets.join(per_record, ["a", "b"], "left").select(
        "did", "rid", F.coalesce("class", "did").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def summary(joined: DataFrame) -> DataFrame:
    return joined.select(
        public_id(), F.when(F.col("class") != NO_ID, F.col("class")).alias("class_id"), "n_links"
    )


def one_per_class(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of ``docs`` for each class, that of the smallest doc_id; rows without words all stay."""
    names = docs.columns
    kept = (
        join(docs, threshold, recall)
        .groupBy("class")
        .agg(F.min(F.struct("did", "rid")).alias("one"))
        .select("one.did", "one.rid")
    )
    packed = docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("did"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
        F.struct(*[docs[n] for n in names]).alias("row"),
    )
    chosen_rows = with_row_key(packed).select("did", "rid", "row").join(kept.hint("shuffle_hash"), ["did", "rid"])
    once = chosen_rows.dropDuplicates(["did", "rid"])  # repeated rows are copies, too
    return once.select(*[F.col(f"row.`{n}`").alias(n) for n in names])
