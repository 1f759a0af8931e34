"""Which stretches of a text an earlier document has: the flow shared by the dedup operators.

1. A document ships the hashes of its anchors. Those found in two or more different texts
   come back to their documents.
2. Windows of fixed length around such anchors are gathered into neighbourhoods, by an owner
   hash that depends on the window alone. Equal neighbourhoods are pre-aggregated to the
   smallest document that has them.
3. Distinct neighbourhoods are dealt by owner, and some owners at a time make a shard, which finds,
   per window, the smallest document that has it. Owners with more than CROWD distinct
   neighbourhoods pass by the shards: their windows are matched by a grouped aggregate.
4. Verdicts go back to the occurrences of a neighbourhood, then as spans to the rows.

What belongs to one method is in a ``Method``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import (
    arrow, arrow_schema, by_row, first_copies, groups, id_text, mix, partitions, runs, with_row_key, written,
)

CROWD = 20_000  # distinct neighbourhoods of an owner that a shard takes
SHARD = 2_500  # distinct neighbourhoods that fill a shard
TABLE = 22  # bits of a name by which most hashes that are not shared are told
NAMES = ["owner", "nh", "around", "did", "least"]
VERDICT = "owner long, nh long, around binary, did long, least binary"


@dataclass(frozen=True)
class Method:
    length: int  # of a window
    #: Texts -> (text, anchor hash) arrays.
    anchors: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    #: Texts, test of (text, anchor hash) arrays for shared anchors -> text, first window, owner and
    #: content of each neighbourhood.
    around: Callable[[pa.Array, Callable], tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]
    #: Content of a neighbourhood -> number of windows.
    windows: Callable[[bytes], int]
    #: Content of a neighbourhood, window -> bytes that stand for the window.
    window: Callable[[bytes, int], bytes]
    #: Contents, dids -> the smallest did of each window of each content, one after the other.
    least: Callable[[list[bytes], np.ndarray], np.ndarray]


def ship_hashes(shards: int, per_text):
    """Sends to each shard the hashes of its share: per document its did, text key and number of hashes.

    ``per_text(batch)`` gives (row of the batch, hash) arrays. Payload layout: int64 dids,
    int64 text keys, uint32 counts, uint64 hashes.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, hashes = per_text(batch.column(2))
            if not len(doc):
                continue
            # Sorted by shard, then text; equal hashes of a text come together.
            order = np.argsort(doc.astype(np.uint64) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF))
            shard = ((hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.min_scalar_type(shards))
            order = order[np.argsort(shard[order], kind="stable")]
            doc, hashes, shard = doc[order], hashes[order], shard[order]
            once = runs([shard, doc, hashes])
            doc, hashes, shard = doc[once], hashes[once], shard[once]
            did = batch.column(0).to_numpy()
            key = batch.column(1).to_numpy()
            starts = runs([shard])
            blobs = []
            for a, b in zip(starts, np.r_[starts[1:], len(shard)]):
                part = doc[a:b]
                first = runs([part])
                rows = part[first]
                n = np.diff(np.r_[first, len(part)]).astype(np.uint32)
                blobs.append(
                    struct.pack("<q", len(rows)) + did[rows].tobytes() + key[rows].tobytes() + n.tobytes() + hashes[a:b].tobytes()
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[starts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["shard", "blob"]
            )

    return task


def shared_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, hashes) of the hashes that two different texts have, from blobs sorted by shard."""
    for table in groups(batches):
        parts = []
        for blob in table.column(1):
            raw = blob.as_py()
            (n,) = struct.unpack_from("<q", raw)
            did, key = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
            count = np.frombuffer(raw, np.uint32, n, 8 + 16 * n)
            hashes = np.frombuffer(raw, np.uint64, -1, 8 + 20 * n)
            parts.append((np.repeat(did, count), np.repeat(key, count), hashes))
        did, key, hashes = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(hashes)
        did, key, hashes = did[order], key[order], hashes[order]
        starts = runs([hashes])
        differ = np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts)
        often = np.repeat(differ, np.diff(np.r_[starts, len(hashes)]))
        did, hashes = did[often], hashes[often]
        if not len(did):
            continue
        order = np.argsort(did)
        did, hashes = did[order], hashes[order]
        starts = runs([did])
        cuts = np.r_[starts, len(did)]
        blobs = [hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(did[starts]), pa.array(blobs, pa.binary())], names=["did", "hashes"])


def anchored(rows: DataFrame, per_text) -> DataFrame:
    """(did, hashes): per document the anchors that it shares with a different text."""
    n = partitions(rows.sparkSession)
    blobs = rows.select("did", F.xxhash64("text").alias("key"), "text").mapInArrow(
        ship_hashes(4 * n, per_text), "shard int, blob binary"
    )
    dealt = blobs.repartition(n, "shard").sortWithinPartitions("shard")
    found = dealt.mapInArrow(shared_hashes, "did long, hashes binary")
    return found.groupBy("did").agg(F.collect_list("hashes").alias("hashes"))


def member(names: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A test whether 64-bit hashes are among ``names``, which are sorted."""
    shift = np.uint64(64 - TABLE)
    table = np.zeros(1 << TABLE, bool)
    table[names >> shift] = True

    def test(hashes: np.ndarray) -> np.ndarray:
        found = table[hashes >> shift]
        at = np.flatnonzero(found)
        place = np.minimum(np.searchsorted(names, hashes[at]), len(names) - 1)
        found[at] = names[place] == hashes[at]
        return found

    return test


AROUND = "did long, rid long, start int, owner long, nh long, around binary"


def neighbourhoods(docs: DataFrame, method: Method) -> DataFrame:
    """(did, rid, start, owner, nh, around); ``docs`` has (did, rid, text, hashes)."""

    def pairs(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(hashes + mix(doc.astype(np.uint64), 3))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(b"".join(x), np.uint64) for x in batch.column(3).to_pylist()]
            if not lists:
                continue
            owners = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            is_shared = member(np.unique(pairs(owners, np.concatenate(lists))))
            doc, start, owner, around = method.around(
                batch.column(2), lambda doc, hashes: is_shared(pairs(doc, hashes))
            )
            if not len(doc):
                continue
            names = np.array([xxhash.xxh3_64_intdigest(x) for x in around], np.uint64)
            columns = (
                batch.column(0).to_numpy()[doc], batch.column(1).to_numpy()[doc], start.astype(np.int32),
                owner.view(np.int64), names.view(np.int64),
            )
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(around, pa.binary())], schema=target)

    target = arrow_schema(docs.sparkSession, AROUND)
    return docs.select("did", "rid", "text", "hashes").mapInArrow(task, AROUND)


def stretches(owner: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(from, to, complete) in a batch sorted by owner.

    The first owner, the last, and those with more than CROWD rows come alone; all others are
    complete and come together, about SHARD rows at a time.
    """
    starts = runs([owner])
    alone = np.diff(np.r_[starts, len(owner)]) > CROWD
    alone[[0, -1]] = True
    fills = np.r_[0, np.diff(starts // SHARD)] > 0
    cut = np.flatnonzero(alone | np.r_[True, alone[:-1]] | fills)
    yield from zip(starts[cut].tolist(), [*starts[cut[1:]].tolist(), len(owner)], (~alone[cut]).tolist())


def verdicts(method: Method):
    """(owner, nh, around, did, least): per distinct neighbourhood the smallest did of each window, as int64 bytes.

    Rows come sorted by owner and are taken some owners at a time. Those of an owner with more than
    CROWD of them pass with a null ``least``. A decided row stays only if some document loses by it,
    and without its content.
    """

    def decided(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        table = pa.concat_tables(parts)
        owner, nh, did, last = (table.column(c).to_numpy() for c in ("owner", "nh", "did", "last"))
        contents = table.column("around").to_pylist()
        least = method.least(contents, did)
        starts = np.cumsum([0, *map(method.windows, contents)])[:-1]
        useful = np.flatnonzero(np.minimum.reduceat(least, starts) < last).tolist()
        cuts = [*starts.tolist(), len(least)]
        blobs = [least[cuts[i] : cuts[i + 1]].tobytes() for i in useful]
        if useful:
            none = pa.nulls(len(useful), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[useful]), pa.array(nh[useful]), none, pa.array(did[useful]), pa.array(blobs, pa.binary())],
                names=NAMES,
            )

    def passed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = table.select(NAMES[:-1]).append_column("least", pa.nulls(table.num_rows, pa.binary()))
        yield from columns.combine_chunks().to_batches()

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.Table] = []  # whole owners
        open_parts: list[pa.Table] = []  # of the last owner so far
        n_ready = n_open = 0
        crowd, last = False, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            owner = batch.column(0).to_numpy()
            for a, b, complete in stretches(owner):
                part = table.slice(a, b - a)
                if owner[a] != last:
                    ready += open_parts
                    n_ready += n_open
                    open_parts, n_open, crowd, last = [], 0, False, owner[a]
                    if n_ready >= SHARD:
                        yield from decided(ready)
                        ready, n_ready = [], 0
                if complete:
                    ready.append(part)
                    n_ready += part.num_rows
                    last = None
                    continue
                open_parts.append(part)
                n_open += part.num_rows
                if crowd or n_open > CROWD:
                    crowd = True
                    for x in open_parts:
                        yield from passed(x)
                    open_parts, n_open = [], 0
        yield from decided(ready + open_parts)

    return task


def crowded_verdicts(names: DataFrame, method: Method) -> DataFrame:
    """What ``verdicts`` gives, for neighbourhoods of owners that have too many of them for one shard."""

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, nh, around, did = (c.to_pylist() for c in batch.columns)
            for lo in range(0, len(around), 1000):
                rows = [
                    (owner[i], nh[i], x, method.window(around[i], x), did[i])
                    for i in range(lo, min(lo + 1000, len(around)))
                    for x in range(method.windows(around[i]))
                ]
                if rows:
                    yield arrow(rows, target)

    schema = "owner long, nh long, place int, string binary, did long"
    target = arrow_schema(names.sparkSession, schema)
    strings = names.select("owner", "nh", "around", "did").mapInArrow(cut_up, schema)
    least = strings.groupBy("string").agg(F.min("did").alias("least"))
    per_window = strings.select("owner", "nh", "place", "string").join(least, "string")
    listed = per_window.groupBy("owner", "nh").agg(F.array_sort(F.collect_list(F.struct("place", "least"))).alias("w"))

    def pack():
        return lambda owner, nh, least: (owner, nh, np.array(least, np.int64).tobytes())

    return by_row(
        listed.select("owner", "nh", F.col("w.least").alias("least")), pack, ["owner", "nh", "least"],
        "owner long, nh long, least binary",
    )



SPAN = "did long, rid long, start int, end int"


def _occurrence_spans(length: int):
    """What each occurrence loses: runs of its windows, each to the end of its last window."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            did, rid, start = (batch.column(i).to_numpy() for i in range(3))
            blobs = batch.column(3).to_pylist()
            sizes = np.array([len(x) // 8 for x in blobs])
            owner = np.repeat(np.arange(len(blobs)), sizes)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            lost = np.frombuffer(b"".join(blobs), np.int64) < did[owner]
            owner, place = owner[lost], place[lost]
            if not len(owner):
                continue
            gap = np.r_[True, (owner[1:] != owner[:-1]) | (np.diff(place) > length)]
            first = np.flatnonzero(gap)
            rows = owner[first]
            last = np.r_[first[1:], len(owner)] - 1
            begin = start[rows] + place[first]
            end = start[rows] + place[last] + length
            yield pa.RecordBatch.from_arrays(
                [pa.array(did[rows]), pa.array(rid[rows]), pa.array(begin, pa.int32()), pa.array(end, pa.int32())],
                names=["did", "rid", "start", "end"],
            )

    return task


def covered(rows: DataFrame, method: Method) -> DataFrame:
    """(did, rid, spans) of each first copy of a text; ``rows`` has (did, rid, text).

    ``spans`` are the covered bytes as (start, end), unordered and overlapping, or null.
    """
    firsts = written(first_copies(rows))
    shared = anchored(rows, method.anchors)
    listed = written(firsts.join(shared, "did"))
    # The smaller side is built into a table per partition, so texts are neither sorted nor copied.
    chosen = rows.join(listed.hint("shuffle_hash"), ["did", "rid"])
    around = written(neighbourhoods(chosen, method))
    names = around.groupBy("owner", "nh").agg(
        F.first("around").alias("around"), F.min("did").alias("did"), F.max("did").alias("last")
    )
    dealt = names.repartition(partitions(rows.sparkSession), "owner").sortWithinPartitions("owner")
    told = written(dealt.mapInArrow(verdicts(method), VERDICT))
    crowded = crowded_verdicts(told.where("least is null"), method)
    told = told.where("least is not null").select("owner", "nh", "least").unionByName(crowded)
    found = (
        around.select("did", "rid", "start", "owner", "nh")
        .join(told, ["owner", "nh"])
        .select("did", "rid", "start", "least")
        .mapInArrow(_occurrence_spans(method.length), SPAN)
    )
    per_row = found.groupBy("did", "rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return written(firsts.join(per_row, ["did", "rid"], "left"))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def merged_lists(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of each row's (start, end) structs, by row and start."""
    sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    pairs = spans.flatten()
    row = np.repeat(np.arange(len(sizes)) << 32, sizes)
    start, end = (row | pairs.field(i).to_numpy().astype(np.int64) for i in range(2))
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if len(start) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(start)][: len(first)] - 1
    low = (1 << 32) - 1
    return start[first] >> 32, start[first] & low, reach[last] & low


def dedup(docs: DataFrame, method: Method) -> DataFrame:
    """(did, text, whole, spans): ``whole`` is true where the text repeats that of a smaller did."""
    rows = with_row_key(id_text(docs))
    found = covered(rows, method).withColumn("first", F.lit(True))
    joined = rows.join(found.hint("shuffle_hash"), ["did", "rid"], "left")
    return joined.select("did", "text", F.col("first").isNull().alias("whole"), "spans")
