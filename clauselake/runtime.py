"""Session settings, shared scratch space, and size checks."""

from __future__ import annotations

import functools
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows up to which a side may be broadcast or shipped to every task
BROADCAST_ROWS = 100_000
#: bytes of their texts up to which they may
BROADCAST_BYTES = 64 << 20


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("clauselake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    A local session is one machine, so without that setting it uses one temporary folder; a cluster must name its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="clauselake-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder of the session."""
    return f"{shared_folder(spark)}/clauselake/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor does not replay earlier rounds."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "lineage"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the folder is there, in whatever store Spark reads it from."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def row_bound(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when the table has at most ``limit`` rows; stops counting right after that."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the table has at most ``limit`` rows and its texts at most ``max_bytes``; reads no more than that many rows."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(16 * len(df.columns)))
    n, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return n <= limit and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the rows and their bytes are proven to be few."""
    return F.broadcast(df) if small_enough(df, limit) else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table that is stored in fewer splits than the session has cores.

    Text expressions are CPU-bound, so a small file is worth dealing its rows
    out evenly; a table with enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ship_by_value(module_name: str) -> None:
    """Send a module's functions with each job, so workers need no installed copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
