"""Best-fit packing of token sequences by hierarchical residual packing.

1. Every text becomes token ids and one closing id; texts over CAPACITY tokens are cut into pieces, where the
   first piece takes what full pieces leave over. Pieces (numbers only, no ids) are written once.
2. Pieces are dealt to nodes of about NODE pieces by a hash of row and piece, so a source, a
   sorted table or repeated rows leave every node with the same mix of lengths. A node packs
   them best-fit, longest first. Bins with at most SLACK tokens left are finished.
3. Underfull bins are the items of the next round: FAN nodes merge into one and pack them best-fit
   again, until one node is left. At most one bin of a node is at most half full, as two would have been
   packed together. So a merge has at most FAN bins that can move into others, which need at
   most FAN bins of each fill; what a node has beyond that is finished. A merge
   thus holds at most FAN * FAN * CAPACITY bins, however large the table.
4. Places are read from the top: the place of a bin in its parent, the place of that in its own, down to
   the pieces of underfull bins. Pieces of finished bins never leave their node again.

Ids are those of the tokenizers library. A second library encodes with the same vocabulary
and is faster; texts with characters or stretches on which the two might differ, or which the
second takes long for, go through the first.

A null text counts as empty and still has its closing id; a null doc_id stays null; repeated
rows are packed each; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bpe import specification, to_bytes
from skein.llm.common import arrow_schema, groups, id_text, partitions, public_id, runs, written

CAPACITY = 2048  # tokens of a sequence
CLOSING = 0  # id after each document
SLACK = 2  # tokens a bin may have left to count as full
NODE = 1 << 14  # pieces of a node, about
FAN = 16  # nodes that merge into one
BIN_BITS = 20  # of a bin's number within its node
STRETCH = 1000  # characters without a border between white space and others that the library alone encodes
SPACES = re.compile(r"\s{%d}" % STRETCH)

PIECES = "row long, did long, piece int, start long, length long, ids_crc32 long"


@cache
def _settled(letter: str) -> bool:
    """Whether a character has had its category since an early version of Unicode, so all tables agree on it."""
    return unicodedata.category(letter) == unicodedata.ucd_3_2_0.category(letter)


def _long_stretch(text: str) -> bool:
    if len(text) < STRETCH:
        return False
    sizes = list(map(len, text.split()))
    if max(sizes, default=0) >= STRETCH:
        return True
    # A long stretch of white space leaves more of it than one character between words.
    return len(text) - sum(sizes) - len(sizes) >= STRETCH - 2 and SPACES.search(text) is not None


class Encoder:
    """Token ids of texts."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec, special = specification(path)
        # Fixed value: the pattern that the vocabulary's pre-tokenizer uses.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def ids(self, text: str) -> np.ndarray:
        if _long_stretch(text) or not (text.isascii() or all(map(_settled, set(text)))):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of every row: its number, did, number of the piece, ids before it, its length and checksum."""
    target = arrow_schema(docs.sparkSession, PIECES)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        encode = encoder(path).ids
        for batch in batches:
            out: list[tuple] = []
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(CLOSING)).astype("<u4", copy=False)
                end = (len(ids) - 1) % CAPACITY + 1
                start = piece = 0
                while start < len(ids):
                    out.append((row, did, piece, start, end - start, zlib.crc32(ids[start:end])))
                    start, end, piece = end, end + CAPACITY, piece + 1
                row += 1
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), target)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return id_text(docs).mapInArrow(task, PIECES)


def best_fit(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first, each into the fullest bin that has room: (bin, offset) of each item and the fills of the bins."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    open_: list[list[int]] = [[] for _ in range(CAPACITY + 1)]  # bins by the room they have
    rooms = 0  # bit r: some bin has room r
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            room, b = CAPACITY, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if room > size:
            open_[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def finished(fills: np.ndarray) -> np.ndarray:
    """Which bins of a node no later round needs: the nearly full ones, and more than FAN of the same fill."""
    order = np.argsort(fills, kind="stable")
    starts = runs([fills[order]])
    rank = np.empty(len(fills), np.int64)
    rank[order] = np.arange(len(fills)) - np.repeat(starts, np.diff(np.r_[starts, len(fills)]))
    return (CAPACITY - fills <= SLACK) | (rank >= FAN)


def _by_node(rows: DataFrame, schema: str, pack) -> DataFrame:
    """``pack`` over the rows of each ``node``, the first column."""
    target = arrow_schema(rows.sparkSession, schema)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            columns = pack(table)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "node").sortWithinPartitions("node", *rows.columns[1:3]).mapInArrow(task, schema)


def packed_locally(rows: DataFrame, nodes: int) -> DataFrame:
    """The pieces with their ``bin`` and ``offset``, and whether the bin is finished."""

    def pack(table: pa.Table) -> list:
        node = table.column(0)[0].as_py()
        sizes = table.column("length").to_numpy()
        bins, offsets, fills = best_fit(sizes)
        done = finished(fills)
        return [*table.columns[3:], (node << BIN_BITS) + bins, offsets, fills[bins], done[bins]]

    node = F.pmod(F.xxhash64("row", "piece"), F.lit(nodes)).alias("node")
    columns = ["did", "start", "length", "ids_crc32"]
    schema = "did long, start long, length long, ids_crc32 long, piece int, bin long, offset long, fill long, done boolean"
    return _by_node(rows.select(node, "row", "piece", *columns, F.col("piece").alias("part")), schema, pack)


def merged(bins: DataFrame, last: bool) -> DataFrame:
    """One round over (node, bin, fill): the ``parent`` bin of each bin, its ``offset`` there, the parent's fill and whether it is finished."""

    def pack(table: pa.Table) -> list:
        bins = table.column("bin").to_numpy()
        parents, offsets, fills = best_fit(table.column("fill").to_numpy())
        hosts = np.empty(len(fills), np.int64)
        first = offsets == 0
        hosts[parents[first]] = bins[first]  # a bin is known by its first item
        done = finished(fills) | last
        return [table.column(0), bins, hosts[parents], offsets, fills[parents], done[parents]]

    return _by_node(bins, "node long, bin long, parent long, offset long, fill long, done boolean", pack)


def pack(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where every piece of every row goes."""
    rows = written(pieces(docs, path))
    nodes = max(1, -(-rows.count() // NODE))
    local = written(packed_locally(rows, nodes))
    done = local["done"] if nodes > 1 else F.lit(True)
    columns = ["piece", "start", "length", "ids_crc32"]
    out = local.where(done).select(public_id(), *columns, F.col("bin").alias("sequence_id"), "offset")
    if nodes == 1:
        return out
    rest = local.where(~local["done"])
    level = rest.where("offset = 0").select(F.shiftright("bin", BIN_BITS).alias("node"), "bin", "fill")
    rounds = []
    while nodes > 1:
        nodes = -(-nodes // FAN)
        level = level.select(F.floor(F.col("node") / FAN).alias("node"), "bin", "fill")
        rounds.append(written(merged(level, nodes == 1)))
        level = rounds[-1].where("offset = 0 and not done").select("node", F.col("parent").alias("bin"), "fill")
    place = None  # of the bins that a round finished or a later one moved
    for table in reversed(rounds):
        here = table.select("bin", F.col("parent").alias("sequence_id"), "offset", "done")
        if place is None:
            place = here.drop("done")
            continue
        moved = here.where("not done").withColumnRenamed("sequence_id", "parent").withColumnRenamed("offset", "inner")
        above = place.withColumnRenamed("bin", "parent")
        moved = moved.join(above, "parent").select("bin", "sequence_id", (F.col("offset") + F.col("inner")).alias("offset"))
        place = here.where("done").drop("done").unionByName(moved)
    inside = rest.select("did", *columns, "bin", F.col("offset").alias("inner")).join(place, "bin")
    return out.unionByName(inside.select(public_id(), *columns, "sequence_id", (F.col("offset") + F.col("inner")).alias("offset")))
