"""Reading and writing position samples, preprocessed samples and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.tracks import preprocess
from skein.schema import PREPROCESSED, SAMPLES, World
from skein.sources.config import FlockConfig

# Stem of sample files and the prefix of preprocessed ones.
FILE_STEM = "boids-data"
PREPROCESSED_PREFIX = "prepro_"


def file_name(stamp: datetime | None = None) -> str:
    """Name of a recording, with the epoch milliseconds of ``stamp`` when given."""
    millis = "" if stamp is None else f"_{round(stamp.timestamp() * 1000)}"
    return f"{FILE_STEM}{millis}.csv"


def recording_name(instant: str):
    """The same name as a column expression over a timestamp without zone, taken as UTC."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.format_string(f"{FILE_STEM}_%d.csv", F.timestamp_diff("MILLISECOND", epoch, instant))


def write_samples(samples: DataFrame, path: str) -> None:
    """One folder per run, CSV with a header inside; replaces what was there.

    Rebalancing gathers a run's rows and still splits a run that is too large.
    """
    columns = [f.name for f in SAMPLES.fields]
    samples.select("run_id", *columns).hint("rebalance", "run_id").write.mode("overwrite").partitionBy("run_id").option(
        "header", True
    ).csv(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples written by ``write_samples``; the folder names give the run."""
    return spark.read.schema(_with_run(SAMPLES)).option("header", True).csv(path)


def _with_run(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("run_id", T.LongType())])


def read_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """Every raw recording in a folder, one run per file named by ``run_name``."""
    raw = (
        spark.read.schema(SAMPLES)
        .option("header", True)
        .option("pathGlobFilter", f"{FILE_STEM}*.csv")
        .csv(folder)
    )
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.csv$", 1)
    return raw.select("*", name.alias("run_name"))


def write_recordings(samples: DataFrame, folder: str, name: Column, mode: str = "overwrite") -> None:
    """One CSV recording per value of ``name``, a column of names as ``file_name`` gives them.

    A recording is a folder of part files called after it, so a long run is written by many tasks.
    Prepared recordings hold the columns of PREPROCESSED; all others those of SAMPLES.
    """
    columns = (PREPROCESSED if "dx" in samples.columns else SAMPLES).names
    samples.select(name.alias("recording"), *columns).hint("rebalance", "recording").write.mode(mode).partitionBy(
        "recording"
    ).option("header", True).csv(folder)


def recordings(spark: SparkSession, folder: str, world: World, names: Sequence[str] | None = None) -> DataFrame:
    """Every recording in a folder as prepared samples: run_name, prepared, run_id and the columns of PREPROCESSED.

    A recording is a file ``boids-data*.csv`` or a folder of part files called like that. Where it has a prepared
    twin (``prepro_`` before the name), the twin is read and the raw one is not. The number in the name is the run;
    a name without one gives its hash. ``names`` (without prefix and ending) restricts the files that are read.
    """
    path = F.col("_metadata.file_path")
    stem = rf"[/=]({PREPROCESSED_PREFIX})?({FILE_STEM}[^/]*)\.csv(/|$)"

    def read(schema: T.StructType, prepared: bool) -> DataFrame:
        run_name = F.regexp_extract(path, stem, 2)
        rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(folder)
        kept = (run_name != "") & ((F.regexp_extract(path, stem, 1) != "") == F.lit(prepared))
        if names is not None:
            kept = kept & run_name.isin(list(names))
        return rows.where(kept).select(run_name.alias("run_name"), F.lit(prepared).alias("prepared"), "*")

    number = F.regexp_extract("run_name", r"_(\d+)$", 1).try_cast("long")
    run_id = F.coalesce(number, F.xxhash64("run_name"))
    # names of files, not rows: the driver holds the list of files anyway
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    twins = files.where(F.regexp_extract("path", stem, 1) != "").select(
        F.regexp_extract("path", stem, 2).alias("run_name")
    )
    raw = read(SAMPLES, False).join(F.broadcast(twins.distinct()), "run_name", "left_anti")
    steps = preprocess(raw.withColumn("run_id", run_id), world)
    return read(PREPROCESSED, True).withColumn("run_id", run_id).unionByName(steps)


def write_preprocessed(samples: DataFrame, world: World, path: str) -> None:
    """Samples with displacements as a Parquet table, one folder per run.

    Rows are sorted by (time, id) inside each file; no global sort is needed.
    """
    columns = [f.name for f in PREPROCESSED.fields]
    preprocess(samples, world).select("run_id", *columns).hint("rebalance", "run_id").sortWithinPartitions(
        "run_id", "time", "id"
    ).write.mode("overwrite").partitionBy("run_id").parquet(path)


def read_preprocessed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_with_run(PREPROCESSED)).parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").option("header", True).csv(path)


def write_config(spark: SparkSession, config: FlockConfig, path: str) -> None:
    config.to_frame(spark).write.mode("overwrite").json(path)


def check_samples(samples: DataFrame) -> DataFrame:
    """Per run and time: samples seen, and whether the frame is complete.

    A frame is complete when it holds the agents of its run's largest frame (the first of equals),
    each exactly once. Replay needs complete frames.
    """
    once = samples.groupBy("run_id", "time", "id").agg(F.count(F.lit(1)).alias("_n"))
    frames = once.groupBy("run_id", "time").agg(
        F.sum("_n").alias("agents"),
        F.count(F.lit(1)).alias("_ids"),
        F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("_set"),
    )
    largest = F.max(F.struct("_ids", -F.col("time"), "_set")).alias("_top")
    runs = frames.groupBy("run_id").agg(largest).select(
        "run_id", F.col("_top._ids").alias("expected"), F.col("_top._set").alias("_wanted")
    )
    full = (F.col("agents") == F.col("expected")) & (F.col("_ids") == F.col("expected")) & (
        F.col("_set") == F.col("_wanted")
    )
    return frames.join(runs, "run_id").withColumn("complete", full).drop("_ids", "_set", "_wanted")
