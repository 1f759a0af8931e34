"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks where a chunk may end; before the normal
length a rarer mark is asked for, after it a commoner one, so lengths gather around the
normal length. Boundaries depend on nearby bytes only, so text that moves keeps its
chunks. A fingerprint is the list of distinct chunks in order of first appearance,
each as 16 hex digits of its digest and the length in 3. Likeness is the length of
the shared chunks over the length of all chunks of both; containment is the length
of the shared chunks over that of one side.

A null text counts as empty; empty texts have the empty fingerprint and are alike. A
null doc_id comes first and stays null; rows with equal ids follow each other by text.
Other columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import arrow, arrow_schema, id_text, mix, partitions, public_id, sha256

LEAST, NORMAL, MOST = 16, 64, 256  # bytes of a chunk
RARE, COMMON = 1 << 24, 1 << 28  # marks: a gear hash below 2^32 / 256, or / 16
GEAR = (mix(np.arange(256, dtype=np.uint64), 11) >> np.uint64(32)).astype(np.uint32)


def gear(data: bytes) -> np.ndarray:
    """The gear hash after each byte: the sum of GEAR[byte] << age over the last 32 bytes."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for age in (1, 2, 4, 8, 16):
        if len(h) > age:
            h[age:] += h[:-age] << np.uint32(age)
    return h


def ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    h = gear(data)
    marks = np.flatnonzero(h < COMMON)
    rare = (h[marks] < RARE).tolist()
    out, start = [], 0
    for mark, strong in zip((marks + 1).tolist(), rare):
        while mark - start > MOST:
            start += MOST
            out.append(start)
        length = mark - start
        if length >= NORMAL or strong and length >= LEAST:
            out.append(mark)
            start = mark
    while len(data) - start > MOST:
        start += MOST
        out.append(start)
    if start < len(data):
        out.append(len(data))
    return out


def chunks(text: str) -> dict[int, int]:
    """Digest and length of each distinct chunk."""
    data, out, start = text.encode(), {}, 0
    for end in ends(data):
        out[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    return out


def written(found: dict[int, int]) -> str:
    return "".join([f"{digest:016x}{length:03x}" for digest, length in found.items()])


def shared(a: dict[int, int], b: dict[int, int]) -> int:
    return sum(a[x] for x in a.keys() & b.keys())


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    both = shared(a, b)
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 1.0


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """How much of ``a`` is in ``b``."""
    whole = sum(a.values())
    return shared(a, b) / whole if whole else 1.0


def neighbours_in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (did, text) dealt by ranges of did, sorted, each range closed by its successor.

    Adds ``bucket`` and ``tail``; a tail row repeats the first row of the next range
    that has rows (of the first range after the last), so each row's successor is the
    next row of its partition. Ranges come from quantiles of the ids, one per bucket.
    """
    spark = rows.sparkSession
    buckets = 4 * partitions(spark)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(rows.approxQuantile("did", shares, 1 / (8 * buckets))))
    bucket = F.lit(0)
    if bounds:
        limits = F.array(*[F.lit(int(b)) for b in bounds])
        bucket = F.size(F.filter(limits, lambda b: b < F.col("did")))
    placed = rows.withColumn("bucket", bucket)
    # One row per bucket: as many as there are bounds.
    firsts = placed.groupBy("bucket").agg(F.min("did").alias("did"))
    order = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    firsts = firsts.withColumn("target", before).select("did", "target")
    tails = (
        rows.join(F.broadcast(firsts), "did")
        .groupBy("did", "target")
        .agg(F.min("text").alias("text"))
        .select("did", "text", F.col("target").alias("bucket"), F.lit(True).alias("tail"))
    )
    return (
        placed.select("did", "text", "bucket", F.lit(False).alias("tail"))
        .unionByName(tails)
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "tail", "did", "text")
    )


SCHEMA = (
    "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained double"
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text's last half is replaced by as much of the next document.
    """
    target = arrow_schema(docs.sparkSession, SCHEMA)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            for did, text, bucket, tail in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = chunks(text)
                if held and held[0] == bucket:
                    rows.append(_compared(*held[1:], text, found))
                held = None if tail else (bucket, did, text, found)
            if rows:
                yield arrow(rows, target)

    ordered = neighbours_in_order(id_text(docs)).select("did", "text", "bucket", "tail")
    out = ordered.mapInArrow(task, SCHEMA)
    return out.select(public_id(), *out.columns[1:])


def _compared(did: int, text: str, found: dict[int, int], after: str, next_found: dict[int, int]) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = chunks(edited)
    return (
        did, len(text), sha256(edited), written(found), written(changed),
        likeness(found, changed), likeness(found, next_found), containment(found, changed),
    )
