"""What the document operators share: input frames, partition counts, Arrow helpers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import cut

NO_ID = -(1 << 63)  # stands for a null doc_id inside the operators: before every other id
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, *carried: str) -> DataFrame:
    """``did`` and ``text`` without nulls, then ``carried``; other columns, whatever their names, are left out."""
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("did"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
        *[docs[c] for c in carried],
    )


def public_id(name: str = "did") -> Column:
    """The id as the caller knows it: null again where it was null."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias("doc_id")


def text_key() -> Column:
    """128 bits that stand for a text."""
    return F.struct(
        F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")
    ).alias("th")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def by_row(
    frame: DataFrame, make: Callable[[], Callable[..., tuple]], inputs: Sequence[str], schema: str
) -> DataFrame:
    """One output row per input row, in Arrow batches.

    ``make`` runs once per task and returns the function of one row; what that
    function keeps between rows must be bounded.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(inputs))]
            rows = [function(*row) for row in zip(*columns, strict=True)]
            if rows:
                yield arrow(rows, target)

    target = arrow_schema(frame.sparkSession, schema)
    return frame.select(*inputs).mapInArrow(task, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def arrow(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def written(df: DataFrame) -> DataFrame:
    """``cut``, after which the shuffle files of the write are removed at once.

    Only files that belong to the write itself go; its result is in the shared folder.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return cut(df)
    finally:
        conf.set(name, before)


def first_copies(rows: DataFrame) -> DataFrame:
    """(did, rid): of each distinct text of ``rows`` (did, rid, text) the row with the smallest did."""
    one = rows.groupBy(text_key()).agg(F.min(F.struct("did", "rid")).alias("one"))
    return one.select("one.did", "one.rid")


def with_row_key(rows: DataFrame) -> DataFrame:
    """Adds ``rid``: with ``did`` it tells a row from all others but its repetitions."""
    return rows.withColumn("rid", F.xxhash64("did", "text"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins (one more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, ends


def runs(sorted_columns: Sequence[np.ndarray]) -> np.ndarray:
    """Where the runs of equal rows start."""
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def groups(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The rows of each value of column ``key``, where rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        starts = runs([values])
        for a, b in zip(starts, np.r_[starts[1:], len(values)]):
            if held and values[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield pa.Table.from_batches(held)


def joined_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on, put together from powers of two."""
    mask = 2**64 - 1
    out, size, power = words, 1, base
    whole, done = None, 0  # what the low bits of ``length`` gave so far
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if whole is None:
                    whole, done = out, size
                else:
                    n = len(words) - done - size + 1
                    if n < 1:
                        return np.zeros(0, np.uint64)
                    scale = np.uint64(pow(base, done, mask + 1))
                    whole, done = out[:n] * scale + whole[size : size + n], done + size
            if 2 * size > length:
                return mix(whole) if len(words) >= length else np.zeros(0, np.uint64)
            n = len(out) - size
            if n < 1:
                return np.zeros(0, np.uint64)
            out = out[:n] * np.uint64(power) + out[size : size + n]
            power, size = power * power & mask, 2 * size
