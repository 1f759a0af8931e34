"""Line dedup by sorted hashes.

Each line of enough code points becomes (key hash, document, position). The rows are
range-partitioned by hash and document and sorted by hash, then document from the largest
down, then position, so a task streams a key's documents in order: the first document
keeps its lines, the others lose theirs once a third document shows that the key is
frequent. A key that a range border may have cut (the first and the last of a partition)
leaves its rows with their partial counts instead; those partials, two keys a partition
at most, are summed and decide. So a key that holds a third of all lines is spread
over as many tasks as its rows need. Only document ids and positions come back: per
document a keep bitmap, one bit a line, compressed, and absent where every line stays.

A null text counts as empty, and an empty text is one empty line. A null doc_id counts as
smaller than every other id. Rows that share a doc_id are one document when documents
are counted; each row keeps or loses its own lines. Other columns are ignored by
``keep_bitmaps`` and kept by ``drop_lines``. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import (
    NO_ID, SPACES, arrow_schema, by_row, id_text, partitions, public_id, sha256, text_key,
)
from skein.session import cut

LEAST_CHARS = 20
LEAST_DOCS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, LOWER)


def hashed_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(a, b, did, ta, tb, pos) for each line long enough: 128 bits of the key, document, text, place."""
    lines = rows.select("did", text_key(), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("did", "th", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= least_chars).select(
        F.xxhash64("key").alias("a"),
        F.xxhash64(F.lit(1), "key").alias("b"),
        "did",
        F.col("th.a").alias("ta"),
        F.col("th.b").alias("tb"),
        "pos",
    )


FOUND = "a long, b long, did long, ta long, tb long, pos int, docs long, largest long"


def _stream(least_docs: int, target: pa.Schema):
    """Drops inside a partition; rows of border keys with ``docs`` and ``largest`` of their part.

    A border row has ``docs`` >= 1 on the first row of its document in this partition
    and 0 on the others, so the sum over a key counts its documents.
    """

    def dropped(block: np.ndarray) -> np.ndarray:
        """Lines to drop of whole keys, rows sorted by key and document downwards."""
        key = np.flatnonzero(np.r_[True, (block[1:, :2] != block[:-1, :2]).any(1)])
        new_doc = np.r_[True, (block[1:, :3] != block[:-1, :3]).any(1)]
        sizes = np.diff(np.r_[key, len(block)])
        docs = np.repeat(np.add.reduceat(new_doc, key, dtype=np.int64), sizes)
        largest = np.repeat(block[key, 2], sizes)
        return block[(docs >= least_docs) & (block[:, 2] != largest)]

    def border(block: np.ndarray) -> np.ndarray:
        new_doc = np.r_[True, block[1:, 2] != block[:-1, 2]].astype(np.int64)
        return np.column_stack([block, new_doc, np.full(len(block), block[0, 2])])

    def rows(block: np.ndarray) -> pa.RecordBatch:
        if block.shape[1] == 6:
            block = np.column_stack([block, np.full(len(block), -1), np.full(len(block), -1)])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()).cast(f.type) for c, f in zip(block.T, target)], schema=target
        )

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the last key so far, not ended
        first = True  # whether ``held`` starts with the partition's first key
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            block = block if held is None else np.concatenate([held, block])
            starts = np.flatnonzero(np.r_[True, (block[1:, :2] != block[:-1, :2]).any(1)])
            if first and len(starts) > 1:
                yield rows(border(block[: starts[1]]))
                block, starts, first = block[starts[1] :], starts[1:] - starts[1], False
            if len(starts) > 1:
                out = dropped(block[: starts[-1]])
                if len(out):
                    yield rows(out)
                block = block[starts[-1] :]
            held = block
        if held is not None:
            yield rows(border(held))

    return task


def drops(rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(did, ta, tb, pos) of the lines to drop."""
    target = arrow_schema(rows.sparkSession, FOUND)
    ranged = (
        hashed_lines(rows, least_chars)
        .repartitionByRange(partitions(rows.sparkSession), F.col("a"), F.col("b"), F.col("did").desc())
        .sortWithinPartitions("a", "b", F.col("did").desc(), "pos")
    )
    # Written, because both the partial counts and the rows of border keys are read.
    found = cut(ranged.mapInArrow(_stream(least_docs, target), FOUND))
    borders = found.where("docs >= 0")
    # A border key has a row in at most two keys a partition, so this table is small.
    whole = (
        borders.groupBy("a", "b")
        .agg(F.sum("docs").alias("n"), F.max("largest").alias("top"))
        .where(F.col("n") >= least_docs)
    )
    late = borders.join(F.broadcast(whole), ["a", "b"]).where(F.col("did") != F.col("top"))
    names = ["did", "ta", "tb", "pos"]
    return found.where("docs < 0").select(*names).unionByName(late.select(*names))


def bitmap(n_lines: int, dropped: Iterable[int]) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[list(dropped)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept(bits: bytes | None, n_lines: int) -> np.ndarray | None:
    """Which lines stay; None for all."""
    if bits is None:
        return None
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(did, ta, tb, keep) for each document that loses a line."""
    lost = (
        drops(id_text(docs), least_chars, least_docs)
        .groupBy("did", "ta", "tb")
        .agg(F.collect_set("pos").alias("lost"))
    )

    def make():
        # The bitmap ends at the last lost line; lines after it stay.
        return lambda did, ta, tb, lost: (did, ta, tb, max(lost) + 1, bitmap(max(lost) + 1, lost))

    return by_row(lost, make, lost.columns, "did long, ta long, tb long, covered int, keep binary")


def _texts_with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All rows of ``docs`` with their bitmaps, if any, in columns of this operator's own."""
    names = docs.columns
    packed = docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("did"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
        F.struct(*[docs[n] for n in names if n != "text"]).alias("rest"),
    )
    keyed = packed.select("*", text_key()).select(
        "did", F.col("th.a").alias("ta"), F.col("th.b").alias("tb"), "text", "rest"
    )
    return keyed.join(bitmaps, ["did", "ta", "tb"], "left")


def _left(text: str, covered: int | None, bits: bytes | None) -> tuple[list[str], list[str]]:
    lines = text.split("\n")
    keep = kept(bits, covered or 0)
    if keep is None:
        return lines, lines
    return lines, [x for x, k in zip(lines, keep) if k] + lines[len(keep) :]


def summary(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per document its lines, the dropped ones, and the digest of what stays."""

    def make():
        def row(did, text, covered, bits):
            lines, left = _left(text, covered, bits)
            return did, len(lines), len(lines) - len(left), sha256("\n".join(left))

        return row

    joined = _texts_with_bitmaps(docs.select("doc_id", "text"), bitmaps)
    out = by_row(
        joined, make, ["did", "text", "covered", "keep"],
        "did long, n_lines long, n_dropped long, kept_sha256 string",
    )
    return out.select(public_id(), *out.columns[1:])


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as ``text``; a row that loses every line keeps an empty text."""

    joined = _texts_with_bitmaps(docs, bitmaps).select("text", "covered", "keep", "rest")

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)
            texts = pa.array(["\n".join(_left(*row)[1]) for row in rows], pa.string())
            yield pa.RecordBatch.from_arrays([texts, batch.column(3)], names=["text", "rest"])

    schema = joined.select("text", "rest").schema
    done = joined.mapInArrow(task, schema)
    return done.select(*[F.col("text") if n == "text" else F.col(f"rest.`{n}`").alias(n) for n in docs.columns])
