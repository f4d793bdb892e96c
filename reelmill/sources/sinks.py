"""Optional sinks, for which the caller brings the connector, and retention of audit tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.operators.metrics import gauge


def publish(df: DataFrame, key: str, options: dict[str, str]) -> None:
    """Rows as keyed JSON messages of a Kafka topic: all states of a key go to one partition, in order."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.format("kafka").options(**{"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "gzip", **options}).save()


def stage_jdbc(df: DataFrame, table: str, options: dict[str, str]) -> None:
    """Replace a staging table's rows and keep the table."""
    df.write.format("jdbc").options(**{"dbtable": table, "truncate": "true", **options}).mode("overwrite").save()


def retained(runs: DataFrame, results: DataFrame, journal: DataFrame, now: datetime, days: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of the last ``days`` with their results, and the journal of the last run only."""
    kept = runs.where(F.col("started_at") >= F.lit(now - timedelta(days=days)))
    last = runs.groupBy().agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return kept, results.join(kept.select("run_id"), "run_id", "left_semi"), journal.join(F.broadcast(last), "run_id", "left_semi")


def lake_gauges(volumes: DataFrame, at: Column) -> DataFrame:
    """Volumes of the lake as samples, one gauge per measure."""
    labels = ("source", "dataset")
    out = None
    for measure in ("rows", "rows_latest", "size_bytes", "files", "partitions"):
        one = gauge(volumes, f"lake_{measure}", measure, labels, at)
        out = one if out is None else out.unionByName(one)
    return out.unionByName(gauge(volumes.withColumn("last", F.unix_timestamp(F.col("last_ingest").cast("timestamp"))), "lake_last_ingest", "last", labels, at))
