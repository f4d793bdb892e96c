"""python -m reelmill aggregate | load | quality [--wait] | report DIR | run [--once]

The lake is at $DATALAKE_DIR, the mart below it. Jobs take a lock, so that one works at a time; they end with 0 when
they succeed or have nothing to do.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from datetime import date, datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from reelmill.operators import controls as C
from reelmill.plans import catalogue, mart, quality, reports, views
from reelmill.plans.audit import LoadRun, Skip, current_run, pipeline_lock
from reelmill.session import build_session
from reelmill.sources import lake


class Paths:
    def __init__(self, root: str) -> None:
        self.root = root
        #: Folders of the two sources below raw/.
        self.documents = os.path.join(root, os.environ.get("DOCUMENTS_DATASET", "raw/documents/movies"))
        self.ratings = os.path.join(root, os.environ.get("RATINGS_DATASET", "raw/titles/title.ratings"))
        self.titles = os.path.join(root, os.environ.get("TITLES_DATASET", "raw/titles/title.basics"))
        self.snapshots = os.path.join(root, "aggregated/movies")
        self.mart, self.staged, self.curated = (os.path.join(root, "mart", x) for x in ("live", "staged", "curated"))
        self.runs, self.results, self.journal = (os.path.join(root, "audit", x) for x in ("load_runs", "results", "corrections"))
        self.matrix, self.evidence, self.summaries = (os.path.join(root, "audit", x) for x in ("controls", "anomalies", "runs"))
        self.lock = os.path.join(root, "audit", "pipeline.lock")


def today() -> date:
    return datetime.now(timezone.utc).date()


def aggregate(spark: SparkSession, paths: Paths, run: LoadRun) -> None:
    if not lake.has_data(paths.documents):
        raise Skip("no documents yet")
    films, seen = catalogue.aggregate(lake.read_documents(spark, paths.documents), lake.read_ratings(spark, paths.ratings), lake.read_titles(spark, paths.titles), today().isoformat())
    lake.write_snapshot(films, paths.snapshots)
    written = lake.read_snapshot(spark, paths.snapshots).agg(F.count(F.lit(1)), F.count_if("has_imdb_match")).first()
    raw, usable = seen.get["raw_rows"], seen.get["usable_rows"]
    run.ingest_date = today()
    run.counts.update(raw_rows_in=raw, rejected_rows=raw - usable, distinct_movies_in=written[0], clean_rows_out=written[0], imdb_matched=written[1])


def load(spark: SparkSession, paths: Paths, run: LoadRun) -> None:
    snapshot = lake.read_snapshot(spark, paths.snapshots)
    if snapshot is None:
        raise Skip("no snapshot yet")
    staged = mart.load(spark, snapshot, mart.MartStore(spark, paths.mart))
    mart.MartStore(spark, paths.staged).commit(staged)
    counts = {r["table_name"]: r["n_rows"] for r in views.row_counts(staged).collect()}
    run.counts.update(clean_rows_out=counts["movies"], imdb_matched=counts["movies_with_imdb"])
    run.message = ", ".join(f"{k} {v}" for k, v in counts.items() if v)


def audit(spark: SparkSession, paths: Paths, run: LoadRun) -> None:
    live = mart.MartStore(spark, paths.mart).read()
    if live["movies"].isEmpty():
        raise Skip("the mart is empty")
    staged = mart.MartStore(spark, paths.staged).read()
    held = quality.controls(today())
    with_load = {**live, **{f"staged:{k}": v for k, v in staged.items()}}
    before = C.results(with_load, held)
    curated, journal = quality.clean(live, today(), staged)
    broken = C.violations(curated, quality.target_constraints(today())).where("violations > 0").collect()
    if broken:
        raise RuntimeError("constraints don't hold: " + "; ".join(f"{r['name']}: {r['violations']}" for r in broken[:10]))
    mart.MartStore(spark, paths.curated).commit(curated)
    after = C.results({**curated, **{f"staged:{k}": v for k, v in staged.items()}}, held)
    for phase, df in (("before", before), ("after", after)):
        df.select(F.lit(run.run_id).alias("run_id"), F.lit(phase).alias("phase"), "*", F.current_timestamp().alias("executed_at")).coalesce(1).write.mode("append").parquet(paths.results)
    number = current_run(run)
    journal.select(F.lit(number).alias("run_id"), "*").write.mode("overwrite").parquet(paths.journal)
    C.matrix(spark, held).coalesce(1).write.mode("overwrite").parquet(paths.matrix)
    phases = (("before", with_load), ("after", {**curated, **{f"staged:{k}": v for k, v in staged.items()}}))
    for mode, (phase, tables) in zip(("overwrite", "append"), phases):
        C.anomalies(tables, held, quality.KEYS).select(F.lit(number).alias("run_id"), F.lit(phase).alias("phase"), "*").write.mode(mode).parquet(paths.evidence)
    totals = reports.run_summary(live, curated, C.verdicts(before, after, held), journal)
    totals.select(F.lit(number).alias("run_id"), F.lit(run.started).alias("started_at"), "*").coalesce(1).write.mode("append").parquet(paths.summaries)


def report(spark: SparkSession, paths: Paths, target: str) -> None:
    """Export the last audit, the catalogue and the profile of the mart as CSV files, and print the verdicts."""
    results = spark.read.parquet(paths.results)
    last = results.orderBy(F.col("executed_at").desc()).first()["run_id"]
    results = results.where(F.col("run_id") == last)
    held = quality.controls(today())
    dimension = spark.createDataFrame([(c.control_id, c.dimension) for c in held], "control_id string, dimension string")
    before, after = (results.where(F.col("phase") == p).drop("run_id", "phase", "executed_at") for p in ("before", "after"))
    live, curated = mart.MartStore(spark, paths.mart).read(), mart.MartStore(spark, paths.curated).read()
    judged, scores = C.verdicts(before, after, held), C.dimension_scores(results.join(dimension, "control_id"))
    exports = {
        "run": spark.read.parquet(paths.summaries).where(F.col("run_id") == last),
        "controls": spark.read.parquet(paths.matrix),
        "before_after": judged,
        "verdicts": reports.verdict_counts(judged),
        "ranked_anomalies": reports.ranked_anomalies(judged),
        "dimension_scores": scores,
        "score_comparison": reports.score_comparison(scores),
        "tables": reports.table_counts(live, curated),
        "columns": views.columns_of(live, "mart"),
        "constraints": reports.constraint_catalogue(spark, quality.target_constraints(today())),
        "code_coverage": reports.code_coverage(live),
        "match_coverage": reports.match_coverage(live),
        "fill_movies": reports.fill_profile(live["movies"]),
        "fill_people": reports.fill_profile(live["people"]),
        "status": reports.status_counts(live, today().isoformat()),
        "numbers": reports.numeric_profile(live),
        "smallest_money": reports.smallest_money(live),
        "vote_buckets": reports.vote_buckets(live),
        "languages": reports.top_languages(live),
        "genders": reports.gender_share(live),
        "departments": reports.department_counts(live),
        "malformed_texts": reports.malformed_texts(live),
        "corrections": views.corrections_summary(spark.read.parquet(paths.journal)),
        "volumes": views.volumes(live, curated),
        "kpi_impact": views.kpi_impact(live, curated),
        "genre_impact": views.genre_impact(live, curated),
        "examples": views.examples(spark.read.parquet(paths.evidence).where("phase = 'before'")),
        "cardinalities": views.cardinalities(live),
    }
    for name, df in exports.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(target, name))
    for r in reports.verdict_counts(judged).orderBy("verdict").collect():
        print(f"{r['verdict']}: {r['controls']} controls, {r['anomalies_before']} anomalies before, {r['anomalies_after']} after")


JOBS = {"aggregate": aggregate, "load": load, "quality": audit}


def run_job(spark: SparkSession, paths: Paths, name: str, wait: float = 0) -> int:
    try:
        with LoadRun(spark, paths.runs, name) as run, pipeline_lock(paths.lock, wait) as held:
            if not held:
                raise Skip("another job is at work")
            JOBS[name](spark, paths, run)
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"{name} failed: {e}", file=sys.stderr)
        return 1


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="reelmill")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in JOBS:
        p = commands.add_parser(name)
        if name == "quality":
            p.add_argument("--wait", action="store_true")
    commands.add_parser("report").add_argument("directory")
    commands.add_parser("run").add_argument("--once", action="store_true")
    a = parser.parse_args(arguments)
    paths = Paths(os.environ.get("DATALAKE_DIR", "datalake"))
    spark = build_session()
    if a.command == "report":
        report(spark, paths, a.directory)
        return 0
    if a.command == "run":
        while True:
            failed = [run_job(spark, paths, name) for name in JOBS]
            if a.once:
                return int(any(failed))
            time.sleep(60 * float(os.environ.get("SPARK_INTERVAL_MINUTES", "5")))
    wait = float(os.environ.get("QUALITY_WAIT_SECONDS", "600")) if getattr(a, "wait", False) else 0
    return run_job(spark, paths, a.command, wait)


if __name__ == "__main__":
    sys.exit(main())
