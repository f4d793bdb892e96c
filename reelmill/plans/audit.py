"""Run audit, and the lock that lets one job work on the lake at a time."""

from __future__ import annotations

import contextlib
import fcntl
import os
import time
import uuid
from collections.abc import Iterator
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession

RUNS = (
    "run_id string, job string, ingest_date date, raw_rows_in bigint, distinct_movies_in bigint, clean_rows_out bigint, rejected_rows bigint, imdb_matched bigint, "
    "started_at timestamp, finished_at timestamp, duration_seconds decimal(10,2), status string, message string"
)


class Skip(Exception):
    """Raised within a run that has nothing to do; the run is recorded as skipped."""


class LoadRun:
    """A context that appends one row per run; a failure is recorded and goes on up, a Skip ends the run quietly."""

    def __init__(self, spark: SparkSession, path: str, job: str) -> None:
        self.spark, self.path, self.job = spark, path, job
        self.counts: dict[str, int | None] = dict.fromkeys(("raw_rows_in", "distinct_movies_in", "clean_rows_out", "rejected_rows", "imdb_matched"))
        self.ingest_date: date | None = None
        self.message: str | None = None

    def __enter__(self) -> LoadRun:
        self.run_id, self.started = str(uuid.uuid4()), datetime.now(timezone.utc)
        return self

    def __exit__(self, kind, error, _trace) -> bool:
        finished = datetime.now(timezone.utc)
        status = "success" if kind is None else "skipped" if issubclass(kind, Skip) else "failed"
        message = self.message if error is None else str(error)[:500]
        from decimal import Decimal

        took = Decimal(f"{(finished - self.started).total_seconds():.2f}")
        row = (self.run_id, self.job, self.ingest_date, *self.counts.values(), self.started, finished, took, status, message)
        try:
            self.spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(self.path)
        except Exception:  # noqa: BLE001
            if kind is None:
                raise  # an audit that fails must not hide the job's own failure
        return status == "skipped"


class NoOpenRun(RuntimeError):
    """Raised where something is to be recorded outside a run."""


def current_run(run: LoadRun | None) -> str:
    """The number of the run in whose scope the caller works."""
    if run is None or not hasattr(run, "run_id"):
        raise NoOpenRun("no run is open")
    return run.run_id


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    if not os.path.isdir(path):
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).parquet(path)


@contextlib.contextmanager
def pipeline_lock(path: str, wait_seconds: float = 0) -> Iterator[bool]:
    """Whether the lock was got within ``wait_seconds``. The system frees it when its holder dies."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    until = time.monotonic() + wait_seconds
    with open(path, "w") as f:
        held = False
        while not held:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                held = True
            except BlockingIOError:
                if time.monotonic() >= until:
                    break
                time.sleep(0.1)
        try:
            yield held
        finally:
            if held:
                fcntl.flock(f, fcntl.LOCK_UN)
