"""Queries over samples of time series: ``(metric string, labels map<string,string>, ts timestamp, value double)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _series() -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))


def matching(samples: DataFrame, metric: str, equal: dict[str, str] | None = None, differ: dict[str, str] | None = None) -> DataFrame:
    """Samples of one metric whose labels have (and haven't) the given values; an absent label is the empty text."""
    out = samples.where(F.col("metric") == metric)
    label = lambda k: F.coalesce(F.col("labels")[k], F.lit(""))
    for k, v in (equal or {}).items():
        out = out.where(label(k) == v)
    for k, v in (differ or {}).items():
        out = out.where(label(k) != v)
    return out.withColumn("series", _series())


def latest(samples: DataFrame) -> DataFrame:
    """The last sample of each series of :func:`matching`, as an aggregate that is merged below the shuffle."""
    last = samples.groupBy("series").agg(F.max(F.struct("ts", "value")).alias("r"))  # maps have no order: labels come from the series
    return last.select("series", F.from_json("series", "map<string,string>").alias("labels"), "r.ts", "r.value")


def combined(samples: DataFrame, how: str, by: tuple[str, ...] = ()) -> DataFrame:
    """sum, min, max, avg or count of the latest samples, by labels."""
    keys = [F.coalesce(F.col("labels")[k], F.lit("")).alias(k) for k in by]
    value = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count}[how]("value").alias("value")
    return latest(samples).groupBy(*keys).agg(value)


def increase(samples: DataFrame, seconds: int, end: Column) -> DataFrame:
    """``(series, labels, increase, rate)`` of counters over the ``seconds`` before ``end``; a drop is a restart from 0."""
    inside = samples.where((F.col("ts") <= end) & (F.unix_timestamp("ts") > F.unix_timestamp(end) - seconds))
    line = Window.partitionBy("series").orderBy("ts")
    step = F.col("value") - F.lag("value").over(line)
    inside = inside.withColumn("step", F.when(step < 0, F.col("value")).otherwise(step))
    grown = inside.groupBy("series").agg(F.first("labels").alias("labels"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("increase"))
    return grown.withColumn("rate", F.col("increase") / seconds)


def changes(samples: DataFrame, seconds: int, end: Column) -> DataFrame:
    """``(series, changes)``: how often the value changed in the ``seconds`` before ``end``."""
    inside = samples.where((F.col("ts") <= end) & (F.unix_timestamp("ts") > F.unix_timestamp(end) - seconds))
    line = Window.partitionBy("series").orderBy("ts")
    changed = F.col("value") != F.lag("value").over(line)
    return inside.withColumn("changed", changed).groupBy("series").agg(F.count_if("changed").alias("changes"))


def guarded_ratio(part: Column, whole: Column, least: float = 1.0) -> Column:
    """part / whole, with the whole clamped from below."""
    return part / F.greatest(whole, F.lit(least))


def gauge(df: DataFrame, metric: str, value: str, labels: tuple[str, ...], at: Column) -> DataFrame:
    """Rows of a report as samples of a gauge."""
    pairs = [x for k in labels for x in (F.lit(k), F.coalesce(F.col(k).cast("string"), F.lit("")))]
    held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.lit(metric).alias("metric"), held.alias("labels"), at.cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
