"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that :func:`spread` may move.
SPREAD_BYTES = 64 * 2**20

_MARKED: set[str] = set()


def build_session(app: str = "reelmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session for jobs and tests; on a cluster the master and memory come from spark-submit.

    ``SPARK_MASTER``, ``SPARK_SHUFFLE_PARTITIONS`` and ``SPARK_DRIVER_MEMORY`` override the defaults.
    """
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("SPARK_MASTER")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if "SPARK_SHUFFLE_PARTITIONS" in os.environ:
        settings["spark.sql.shuffle.partitions"] = os.environ["SPARK_SHUFFLE_PARTITIONS"]
    if "SPARK_DRIVER_MEMORY" in os.environ:
        settings["spark.driver.memory"] = os.environ["SPARK_DRIVER_MEMORY"]
    for key, value in {**settings, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode (tests) and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="reelmill-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends."""
    path = f"{work_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(where)
        system.deleteOnExit(where)
        _MARKED.add(path)
    return path


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Unlike a checkpoint the result is columnar, so a reader that needs two columns reads two columns.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of ``df``, from the sizes of its files; 2**60 and more where it knows none."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is small and its files, which can't be split, give less than half as many tasks.

    For scans that work long on each row: a small table in one file would otherwise keep one core busy. Beyond
    SPREAD_BYTES nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) > SPREAD_BYTES or 2 * df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores)
