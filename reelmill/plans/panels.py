"""The dashboards' panels: each is a query over samples of time series, with one value per series it shows.

A panel is declared as terms; a term selects a metric's series by their labels, takes their latest value or their rate,
and combines them by labels. All panels of one kind are evaluated over samples that are read once per term.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.operators import metrics as M


@dataclass(frozen=True)
class Term:
    """``of``: latest, rate or changes (per series); ``how``: how series are combined (None: as they are); ``scale`` times the value plus ``shift``."""

    metric: str
    equal: dict[str, str] = field(default_factory=dict)
    differ: dict[str, str] = field(default_factory=dict)
    of: str = "latest"
    seconds: int = 300
    how: str | None = None
    by: tuple[str, ...] = ()
    scale: float = 1.0
    shift: float = 0.0
    #: a ratio's denominator, of which at least 1 counts; plus: what is added to it
    over: Term | None = None
    plus: Term | None = None
    #: 1 - ratio
    rest: bool = False


def evaluate(samples: DataFrame, term: Term, end: Column) -> DataFrame:
    """``(series, value)``: ``series`` are the labels that tell the results apart, as JSON."""
    held = M.matching(samples, term.metric, term.equal, term.differ)
    if term.of == "latest":
        values = M.latest(held).select("labels", "value")
    elif term.of == "rate":
        values = M.increase(held, term.seconds, end).select("labels", F.col("rate").alias("value"))
    else:
        values = M.changes(held, term.seconds, end).select(F.from_json("series", "map<string,string>").alias("labels"), F.col("changes").cast("double").alias("value"))
    if term.how is None:
        out = values.select(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))).alias("series"), "value")
    else:
        keys = [F.coalesce(F.col("labels")[k], F.lit("")).alias(k) for k in term.by]
        combine = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count}[term.how]
        out = values.groupBy(*keys).agg(combine("value").cast("double").alias("value"))
        out = out.select((F.to_json(F.struct(*term.by)) if term.by else F.lit("{}")).alias("series"), "value")
    if term.over is not None:
        below = evaluate(samples, term.over, end).select("series", F.col("value").alias("below"))
        if term.plus is not None:
            more = evaluate(samples, term.plus, end).select("series", F.col("value").alias("more"))
            below = below.join(more, "series").select("series", (F.col("below") + F.col("more")).alias("below"))
        out = out.join(below, "series").select("series", M.guarded_ratio(F.col("value"), F.col("below")).alias("value"))
        if term.rest:
            out = out.withColumn("value", 1 - F.col("value"))
    return out.where("value is not null").select("series", (F.col("value") * term.scale + term.shift).alias("value"))


def _run(metric: str, job: str | None = None, **more) -> Term:
    return Term(f"pipeline_load_run_{metric}", {"job": job} if job else {}, **more)


def _score(phase: str, equal: str | None = None, differ: str | None = None) -> Term:
    return Term("pipeline_dq_dimension_score", {"phase": phase} | ({"dimension": equal} if equal else {}), {"dimension": differ} if differ else {})


def _anomalies(phase: str, by: tuple[str, ...] = ()) -> Term:
    return Term("pipeline_dq_control_anomalies", {"phase": phase}, how="sum", by=by)


def _clean(table: str, **more) -> Term:
    return Term("pipeline_clean_rows", {"table_name": table}, **more)


_RAW = Term("pipeline_raw_rows", how="sum")
_RAW_FILMS = Term("pipeline_raw_rows", {"source": "documents"}, how="sum")
_DB = {"datname": "films"}


def _db(metric: str, **more) -> Term:
    return Term(f"pg_stat_database_{metric}", _DB, **more)


#: Panel -> its terms. Panels that show a table of the mart or its audit are functions of :mod:`reports`.
PANELS: dict[str, tuple[Term, ...]] = {
    "raw rows": (_RAW,),
    "raw film messages": (_RAW_FILMS,),
    "clean films": (_clean("movies"),),
    "films with second rating": (_clean("movies_with_imdb"),),
    "rejected rows": (_run("rejected_rows", "aggregate"),),
    "last runs succeeded": (_run("success", how="min"),),
    "raw to clean": (_RAW_FILMS, _run("distinct_movies_in", "aggregate"), _clean("movies")),
    "share loaded": (_clean("movies", how="sum", over=_run("distinct_movies_in", "aggregate", how="sum"), scale=100.0),),
    "consumer lag": (Term("pipeline_kafka_consumer_lag", how="sum"),),
    "oldest run": (_run("age_seconds", how="max"),),
    "messages a minute": (Term("pipeline_kafka_messages_produced_total", of="rate", scale=60.0), Term("pipeline_kafka_messages_consumed_total", of="rate", scale=60.0)),
    "lake volume": (Term("pipeline_raw_bytes"), Term("pipeline_aggregated_bytes")),
    "run durations": (_run("duration_seconds"),),
    "score before": (_score("before", "global"),),
    "score after": (_score("after", "global"),),
    "anomalies before": (_anomalies("before"),),
    "anomalies after": (_anomalies("after"),),
    "age of the audit": (_run("age_seconds", "quality"),),
    "scores by dimension": (_score("before", differ="global"), _score("after", differ="global")),
    "anomalies by dimension before": (_anomalies("before", ("dimension",)),),
    "anomalies by dimension after": (_anomalies("after", ("dimension",)),),
    "database up": (Term("pg_up"),),
    "connections": (_db("numbackends", how="sum"),),
    "database size": (Term("pg_database_size_bytes", _DB),),
    "cache hits": (_db("blks_hit", how="sum", over=_db("blks_hit", how="sum"), plus=_db("blks_read", how="sum"), scale=100.0),),
    "deadlocks": (_db("deadlocks", how="sum"),),
    "transactions": (_db("xact_commit", of="rate"), _db("xact_rollback", of="rate")),
    "tuples": (_db("tup_fetched", of="rate"), _db("tup_inserted", of="rate"), _db("tup_updated", of="rate")),
    "rows by table": (Term("pipeline_clean_rows"),),
    "films over time": (_clean("movies"), _clean("movies_with_imdb")),
    "targets up": (Term("up", how="sum"), Term("up", how="count")),
    "targets": (Term("up"),),
    "memory in use": (Term("node_memory_MemAvailable_bytes", how="sum", over=Term("node_memory_MemTotal_bytes", how="sum"), rest=True, scale=100.0),),
    "processor by container": (Term("container_cpu_usage_seconds_total", differ={"name": ""}, of="rate", how="sum", by=("name",), scale=100.0),),
    "memory by container": (Term("container_memory_working_set_bytes", differ={"name": ""}),),
    "processor in use": (Term("node_cpu_seconds_total", {"mode": "idle"}, of="rate", how="avg", scale=-100.0, shift=100.0),),
    "restarts by container": (Term("container_start_time_seconds", differ={"name": ""}, of="changes", seconds=3600, how="sum", by=("name",)),),
}


def panels(samples: DataFrame, end: Column, names: tuple[str, ...] | None = None) -> DataFrame:
    """``(panel, term, metric, series, value)`` of the panels named, or all."""
    out = None
    for name in names or PANELS:
        for i, term in enumerate(PANELS[name], 1):
            one = evaluate(samples, term, end).select(F.lit(name).alias("panel"), F.lit(i).alias("term"), F.lit(term.metric).alias("metric"), "series", F.col("value").cast("double").alias("value"))
            out = one if out is None else out.unionByName(one)
    return out
