"""Landing a stream of messages in the raw zone, batch by batch, and rates over event time."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelmill import schemas
from reelmill.operators.relational import leading
from reelmill.sources.files import Files
from reelmill.sources.lake import write_manifest


def message_stream(spark: SparkSession, source: str, max_files: int = 100, kafka: dict[str, str] | None = None) -> DataFrame:
    """Envelopes as a stream: of files below ``source``, or of a Kafka topic where its connector is on the class path."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**{"startingOffsets": "earliest", **kafka}).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schemas.envelope()).alias("m"), "partition", "offset").select("m.*", F.col("partition").alias("log_partition"), F.col("offset").alias("log_offset"))
    return spark.readStream.schema(schemas.envelope()).option("maxFilesPerTrigger", max_files).json(source)


def land(stream: DataFrame, base: str, checkpoint: str, source: str, dataset: str, seconds: int | None = None) -> StreamingQuery:
    """Write every micro-batch as gzipped JSON lines into the day's partition, with a manifest; empty batches leave nothing.

    A batch's folder is named after its number and replaced as a whole, so a batch that is run again after a failure
    lands once. ``seconds`` is the age at which a batch is flushed; None works off what is there and stops.
    """

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        files = Files(batch.sparkSession)
        day = datetime.now(timezone.utc).date().isoformat()
        directory = os.path.join(base, source, dataset, f"ingest_date={day}")
        target = os.path.join(directory, f"batch={number:09d}")
        columns = [c for c in batch.columns if not c.startswith("log_")]
        batch.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").option("compression", "gzip").text(target)
        # counted from what was written: an observation would have to run the batch's source again
        held = batch.sparkSession.read.text(target).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("value"))).first()
        rows = held[0]
        offsets = []
        if "log_offset" in batch.columns:
            offsets = [r.asDict() for r in batch.groupBy("log_partition").agg(F.min("log_offset").alias("first"), F.max("log_offset").alias("last")).collect()]
        size = sum(files.size(f"{target}/{n}") for n in files.names(target) if n.startswith("part-"))
        write_manifest(directory, f"batch-{number:09d}", {"source": source, "dataset": dataset, "batch": number, "rows": rows, "checksum": held[1], "size_bytes": size, "offsets": offsets, "written_at": datetime.now(timezone.utc).isoformat()})

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


def upsert_latest(stream: DataFrame, target: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Keep the latest row per key of a stream in a Parquet table, merged per micro-batch with versions and a pointer."""
    pointer = f"{target}/current.json"

    def write(batch: DataFrame, number: int) -> None:
        spark, files = batch.sparkSession, Files(batch.sparkSession)
        rows, held = batch, json.loads(files.read(pointer) or "null")
        if held is not None:
            if held["batch"] >= number:
                return  # this batch is in already
            rows = batch.unionByName(spark.read.parquet(f"{target}/{held['version']}"))
        version = f"v{number:09d}"
        leading(rows, [key], [F.col(order).desc_nulls_last(), F.xxhash64(*rows.columns)]).write.mode("overwrite").parquet(f"{target}/{version}")
        files.replace(pointer, json.dumps({"version": version, "batch": number}))
        if held is not None:
            files.delete(f"{target}/{held['version']}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per type and window of event time; on a stream, windows close ``late`` after the last event seen."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    out = timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def stop(query: StreamingQuery) -> None:
    """End a query once what its source holds by now is landed, so that no open batch is lost."""
    query.processAllAvailable()
    query.stop()


def lag(query: StreamingQuery) -> int | None:
    """Messages the source holds beyond what the query has read, where the source reports offsets."""
    progress = query.lastProgress
    if not progress:
        return None
    total = 0
    for s in progress["sources"]:
        for topic, parts in ((s.get("latestOffset") or {}) if isinstance(s.get("latestOffset"), dict) else {}).items():
            end = (s.get("endOffset") or {}).get(topic, {})
            total += sum(int(v) - int(end.get(p, 0)) for p, v in parts.items())
    return total
