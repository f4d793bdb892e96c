"""The raw zone and the snapshot zone of the lake: partitioned directories with manifests.

``raw/<source>/<dataset>/ingest_date=YYYY-MM-DD/`` holds immutable files, beside them ``_manifest*.json``, one per data
file; ``aggregated/<dataset>/ingest_date=.../`` holds full Parquet snapshots.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill import schemas

_PARTITION = re.compile(r"^ingest_date=(\d{4}-\d{2}-\d{2})$")


def partitions(base: str) -> list[str]:
    """The partition dates below ``base`` in order; of a missing directory, none."""
    if not os.path.isdir(base):
        return []
    return sorted(m[1] for m in map(_PARTITION.match, os.listdir(base)) if m)


def has_data(base: str) -> bool:
    """Whether any partition holds a data file."""
    return any(not name.startswith(("_", ".")) for p in partitions(base) for name in os.listdir(os.path.join(base, f"ingest_date={p}")))


def latest_partition(base: str) -> str | None:
    found = partitions(base)
    return os.path.join(base, f"ingest_date={found[-1]}") if found else None


def read_documents(spark: SparkSession, base: str) -> DataFrame:
    """All messages of all partitions under the declared schema; a line that isn't JSON is a row of nulls."""
    return spark.read.schema(schemas.envelope()).option("basePath", base).json(base)


def _read_tsv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    # no quoting: a stray quote in a title must not swallow the fields after it
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", "\\N").option("quote", "").schema(schemas.struct_type(ddl)).csv(path)


def read_ratings(spark: SparkSession, base: str) -> DataFrame | None:
    """``(tconst, imdb_average_rating, imdb_num_votes)`` of the newest partition, one row per title; None if there is none."""
    path = latest_partition(base)
    if path is None:
        return None
    rows = _read_tsv(spark, path, schemas.RATINGS_DDL).where("tconst is not null")
    typed = rows.select("tconst", F.expr("try_cast(averageRating as decimal(3,1))").alias("imdb_average_rating"), F.expr("try_cast(numVotes as int)").alias("imdb_num_votes"))
    # of a title given twice the row with most votes stays: an aggregate, merged below the shuffle
    best = typed.groupBy("tconst").agg(F.max(F.struct("imdb_num_votes", "imdb_average_rating")).alias("r"))
    return best.select("tconst", "r.imdb_average_rating", "r.imdb_num_votes")


def read_titles(spark: SparkSession, base: str) -> DataFrame | None:
    """``(tconst, imdb_start_year, imdb_runtime_minutes, imdb_genres)`` of the films in the newest partition."""
    path = latest_partition(base)
    if path is None:
        return None
    rows = _read_tsv(spark, path, schemas.TITLES_DDL).where("tconst is not null and titleType = 'movie'")
    typed = rows.select("tconst", F.expr("try_cast(startYear as smallint)").alias("imdb_start_year"), F.expr("try_cast(runtimeMinutes as int)").alias("imdb_runtime_minutes"), F.split("genres", ",").alias("imdb_genres"))
    best = typed.groupBy("tconst").agg(F.max(F.struct("imdb_start_year", "imdb_runtime_minutes", "imdb_genres")).alias("r"))
    return best.select("tconst", "r.*")


def write_snapshot(df: DataFrame, base: str) -> None:
    """Replace the partitions ``df`` holds, and only those."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ingest_date").parquet(base)


def read_snapshot(spark: SparkSession, base: str, on: str | None = None) -> DataFrame | None:
    """The snapshot of ``on`` or the newest one; the filter prunes all other partitions."""
    found = partitions(base)
    if not found:
        return None
    return spark.read.parquet(base).where(F.col("ingest_date") == F.lit(on or found[-1]).cast("date"))


def write_manifest(directory: str, name: str, content: dict) -> str:
    """Write a manifest beside its data file; readers of data skip names that begin with an underscore."""
    path = os.path.join(directory, f"_manifest-{name}.json")
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(content, f)
    os.replace(path + ".tmp", path)
    return path


def land_file(lines: Iterable[str], base: str, source: str, dataset: str, on: date, name: str) -> dict:
    """Land a text file whole or not at all, with its manifest; a file already there is left as it is."""
    directory = os.path.join(base, source, dataset, f"ingest_date={on.isoformat()}")
    os.makedirs(directory, exist_ok=True)
    target = os.path.join(directory, name)
    digest, rows, size = hashlib.sha256(), 0, 0
    if os.path.exists(target):
        return {"path": target, "rows": None, "skipped": True}
    with open(os.path.join(directory, f".{name}.tmp"), "w", encoding="utf-8") as f:
        for line in lines:
            text = line.rstrip("\n") + "\n"
            digest.update(text.encode())
            size += len(text.encode())
            rows += 1
            f.write(text)
    os.replace(os.path.join(directory, f".{name}.tmp"), target)
    content = {"source": source, "dataset": dataset, "file": name, "rows": rows, "size_bytes": size, "sha256": digest.hexdigest(), "written_at": datetime.now(timezone.utc).isoformat()}
    write_manifest(directory, name, content)
    return {"path": target, "rows": rows, "skipped": False}


def manifests(spark: SparkSession, raw: str) -> DataFrame:
    """``(source, dataset, ingest_date, rows, size_bytes)`` of every manifest below ``raw``.

    Spark skips names with an underscore, so the paths are listed on the driver: one per landed file, not per row.
    """
    paths = [os.path.join(d, n) for d, _, names in os.walk(raw) for n in names if n.startswith("_manifest-") and n.endswith(".json")]
    rows = []
    for p in sorted(paths):
        with open(p, encoding="utf-8") as f:
            m = json.load(f)
        day = _PARTITION.match(os.path.basename(os.path.dirname(p)))
        rows.append((m.get("source"), m.get("dataset"), date.fromisoformat(day[1]) if day else None, m.get("rows"), m.get("size_bytes")))
    return spark.createDataFrame(rows, "source string, dataset string, ingest_date date, rows bigint, size_bytes bigint")


def lake_volumes(spark: SparkSession, raw: str) -> DataFrame:
    """Per dataset: rows, bytes, files and partitions, the newest partition and its rows."""
    held = manifests(spark, raw)
    per_day = held.groupBy("source", "dataset", "ingest_date").agg(F.sum("rows").alias("rows"), F.sum("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("files"))
    return per_day.groupBy("source", "dataset").agg(F.sum("rows").alias("rows"), F.sum("size_bytes").alias("size_bytes"), F.sum("files").alias("files"), F.count(F.lit(1)).alias("partitions"), F.max("ingest_date").alias("last_ingest"), F.max_by("rows", "ingest_date").alias("rows_latest"))
