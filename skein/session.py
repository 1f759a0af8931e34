"""Session helpers: settings every job relies on, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("skein")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back on a temporary folder, because there the driver is the executor.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="skein-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


_tables: list[str] = []  # what ``cut`` has written and ``discard_cuts`` has not removed


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it back.

    Later jobs start from the table: a lost executor costs no recomputation, and
    the optimiser knows the table's size when it chooses between join strategies.
    The table stays until ``discard_cuts``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_cuts(spark: SparkSession) -> int:
    """Removes the tables that ``cut`` has written, once the results built on them are stored."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    removed = 0
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        removed += path.getFileSystem(conf).delete(path, True)
    return removed
