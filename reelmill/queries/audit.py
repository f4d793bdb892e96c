"""The 49 controls, the cleaning, the constraints, the reports and the dashboards over a mart made of the test tables as they are.

The mart is left dirty: films from ``movies``, genres from ``genres``, people as ``people_records`` saw them first, all
else from the messages of ``raw_movies``; the messages of the last day are the staged load.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill import schemas
from reelmill.operators import controls as C
from reelmill.plans import panels as P
from reelmill.plans import quality, reports, views
from reelmill.plans.audit import RUNS
from reelmill.plans.mart import LINKS
from reelmill.queries.problems import table
from reelmill.session import scratch_table

AS_OF = date(2026, 9, 20)


@cache
def controls() -> list[C.Control]:
    return quality.controls(AS_OF)  # needs a session, which parses the schemas


#: link -> (path of the payload's array, {column: expression over the element})
_LINKED = {
    "movie_genres": ("genres", {"genre_id": "id"}),
    "movie_production_companies": ("production_companies", {"company_id": "id"}),
    "movie_production_countries": ("production_countries", {"country_id": "iso_3166_1"}),
    "movie_spoken_languages": ("spoken_languages", {"language_id": "iso_639_1"}),
}
_REFERENCED = {
    "production_companies": ("production_companies", "id", ("name", "origin_country", "logo_path")),
    "countries": ("production_countries", "iso_3166_1", ("name",)),
    "languages": ("spoken_languages", "iso_639_1", ("name", "english_name")),
}
_CREDITS = {"movie_cast": ("credits.cast", {"character": "character", "cast_order": "`order`"}), "movie_crew": ("credits.crew", {"department": "department", "job": "job"})}


def _links(raw: DataFrame) -> dict[str, DataFrame]:
    films = raw.where("payload is not null").select(F.col("movie_id").cast("int").alias("movie_id"), "payload")
    out = {}
    for name, (path, columns) in _LINKED.items():
        (column, key), = columns.items()
        out[name] = films.select("movie_id", F.inline(f"payload.{path}")).select("movie_id", F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
    for name, (path, columns) in _CREDITS.items():
        credits = films.select("movie_id", F.inline(f"payload.{path}")).where("credit_id is not null and credit_id <> ''")
        out[name] = credits.groupBy("credit_id").agg(F.min("movie_id").alias("movie_id"), F.min("id").alias("person_id"), *[F.min(e).alias(c) for c, e in columns.items()])
    return out


def dirty_mart(spark: SparkSession, sf_dir: str) -> tuple[C.Tables, C.Tables]:
    """The mart and the staged load, written once."""
    raw = table(spark, sf_dir, "raw_movies")
    m = _links(raw)
    m["movies"], m["genres"] = table(spark, sf_dir, "movies"), table(spark, sf_dir, "genres")
    people = table(spark, sf_dir, "people_records").where("id is not null")
    first = people.groupBy("id").agg(F.min(F.struct("record_id", "name", "original_name", "gender", "known_for_department", "popularity", "profile_path")).alias("r"))
    m["people"] = first.select("id", "r.name", "r.original_name", "r.gender", "r.known_for_department", F.col("r.popularity").try_cast("decimal(10,3)").alias("popularity"), "r.profile_path")
    payload = raw.where("payload is not null").select("payload")
    c = payload.select("payload.belongs_to_collection.*").where("id is not null")
    m["collections"] = c.groupBy("id").agg(*[F.min(x).alias(x) for x in ("name", "poster_path", "backdrop_path")])
    for name, (path, key, columns) in _REFERENCED.items():
        m[name] = payload.select(F.inline(f"payload.{path}")).where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(x).alias(x) for x in columns])
    last = raw.agg(F.max("ingest_date")).first()[0]
    load = raw.where(F.col("ingest_date") == F.lit(last))
    s = _links(load)
    s["movies"] = m["movies"].join(load.select(F.col("movie_id").cast("int").alias("id")).distinct(), "id", "left_semi")
    mart = {name: scratch_table(m[name], name) for name in schemas.MART}
    return mart, {name: scratch_table(df, f"staged-{name}") for name, df in s.items()}


def _with_load(mart: C.Tables, staged: C.Tables) -> C.Tables:
    return {**mart, **{f"staged:{k}": v for k, v in staged.items()}}


class Audit:
    """Everything one audit gives, made once per call of a query."""

    def __init__(self, spark: SparkSession, sf_dir: str, after: bool = True) -> None:
        self.mart, self.staged = dirty_mart(spark, sf_dir)
        self.before = C.results(_with_load(self.mart, self.staged), controls())
        if after:
            self.curated, journal = quality.clean(self.mart, AS_OF, self.staged)
            self.journal = scratch_table(journal, "journal")
            self.after = C.results(_with_load(self.curated, self.staged), controls())
            self.judged = C.verdicts(self.before, self.after, controls())
            dimension = spark.createDataFrame([(c.control_id, c.dimension) for c in controls()], "control_id string, dimension string")
            both = self.before.withColumn("phase", F.lit("before")).unionByName(self.after.withColumn("phase", F.lit("after")))
            self.results = both.join(F.broadcast(dimension), "control_id")
            self.scores = C.dimension_scores(self.results)


def control_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 49 controls of the mart."""
    return Audit(spark, sf_dir, after=False).before


def control_results_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 49 controls of the cleaned copy."""
    return _audit(spark, sf_dir).after


def cleaning_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrections by control, action, table and column."""
    mart, staged = dirty_mart(spark, sf_dir)
    return views.corrections_summary(quality.clean(mart, AS_OF, staged)[1])


def cleaned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after cleaning."""
    mart, staged = dirty_mart(spark, sf_dir)
    return views.volumes(mart, quality.clean(mart, AS_OF, staged)[0])


def cleaned_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned films themselves."""
    mart, staged = dirty_mart(spark, sf_dir)
    m = quality.clean(mart, AS_OF, staged)[0]["movies"]
    big = lambda c: F.col(c).cast("bigint").alias(c)
    real = lambda c: F.col(c).cast("double").alias(c)
    return m.select(
        big("id"), "imdb_id", "original_language", "overview", "status", F.date_format("release_date", "yyyy-MM-dd").alias("release_date"), big("runtime"), "budget", "revenue", real("popularity"), real("vote_average"), big("vote_count"), "homepage",
        "poster_path", big("collection_id"), real("imdb_average_rating"), big("imdb_num_votes"), "has_imdb_match", real("rating_gap"), real("votes_ratio"),
    )


def control_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = Audit(spark, sf_dir).judged
    return judged.select("control_id", "dimension", "severity", "treatment", "checked_before", "anomalies_before", "pct_before", "checked_after", "anomalies_after", "pct_after", F.col("priority").cast("double").alias("priority"), "verdict")


def control_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).scores


def control_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing rows of the controls on columns, with what was observed."""
    mart, staged = dirty_mart(spark, sf_dir)
    held = [c for c in controls() if c.control_id in ("VAL-01", "VAL-12", "VAL-15", "VAL-16")]
    return C.anomalies(_with_load(mart, staged), held, quality.KEYS)


def mart_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the cleaned copy's constraints by the mart before it is cleaned, by kind."""
    mart, _ = dirty_mart(spark, sf_dir)
    found = C.violations(mart, quality.target_constraints(AS_OF))
    return found.groupBy("kind", "table_name").agg(F.count(F.lit(1)).alias("constraints"), F.sum("violations").alias("violations"))


def audit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run audit as the jobs of the raw days would have left it: one row of each job per day."""
    raw = table(spark, sf_dir, "raw_movies").groupBy("ingest_date").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("movie_id").alias("films"), F.count("payload").alias("usable"))
    rows = None
    for job, hour in (("aggregate", 1), ("load", 2), ("quality", 3)):
        started = F.col("ingest_date").cast("timestamp") + F.expr(f"interval {hour} hours")
        one = raw.select(
            F.concat(F.lit(f"{job}-"), F.col("ingest_date").cast("string")).alias("run_id"), F.lit(job).alias("job"), "ingest_date", F.col("n").alias("raw_rows_in"), F.col("films").alias("distinct_movies_in"), F.col("usable").alias("clean_rows_out"),
            (F.col("n") - F.col("usable")).alias("rejected_rows"), F.lit(0).cast("bigint").alias("imdb_matched"), started.alias("started_at"), (started + F.expr("interval 90 seconds")).alias("finished_at"), F.lit(90).cast("decimal(10,2)").alias("duration_seconds"),
            F.lit("success").alias("status"), F.lit(None).cast("string").alias("message"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows.select(*[c.split()[0] for c in RUNS.split(", ")])


NOW = datetime(2026, 4, 1)


def last_run_of_each_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.last_runs(audit_runs(spark, sf_dir), F.lit(NOW))
    return out.select("job", "status", F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_date"), "raw_rows_in", "distinct_movies_in", "clean_rows_out", "rejected_rows", F.col("age_seconds").cast("bigint").alias("age_seconds"), F.col("clean_ratio").cast("double").alias("clean_ratio"))


def last_finished_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_run(audit_runs(spark, sf_dir)).select("run_id", "job")


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _audit(spark, sf_dir)
    out = reports.run_summary(a.mart, a.curated, a.judged, a.journal)
    return out.withColumn("mart_ingest_date", F.date_format("mart_ingest_date", "yyyy-MM-dd"))


def _of_mart(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(dirty_mart(spark, sf_dir)[0])

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


_AUDITS: dict[tuple[str, str], Audit] = {}


def _audit(spark: SparkSession, sf_dir: str) -> Audit:
    """The audit the reports of a session are about, made once; its tables lie in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _AUDITS:
        _AUDITS[key] = Audit(spark, sf_dir)
    return _AUDITS[key]


def _of_audit(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(_audit(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def report_columns(mart: C.Tables) -> DataFrame:
    return views.columns_of(mart, "mart").select("table_name", "column_name")


def report_schema_diff(mart: C.Tables) -> DataFrame:
    """What the mart of the test tables lacks or adds beside the declared one."""
    spark = mart["movies"].sparkSession
    declared = {t: spark.createDataFrame([], schemas.struct_type(ddl)) for t, (_, ddl) in schemas.MART.items()}
    diff = views.schema_diff(views.columns_of(declared, "declared"), views.columns_of(mart, "mart"))
    return diff.where("left_type is null or right_type is null or split_part(left_type, '(', 1) <> split_part(right_type, '(', 1)").select("table_name", "column_name", "left_type", "right_type")


def report_constraints(mart: C.Tables) -> DataFrame:
    return reports.constraints_by_kind(reports.constraint_catalogue(mart["movies"].sparkSession, quality.target_constraints(AS_OF)))


def report_relations(mart: C.Tables) -> DataFrame:
    every = [(a, b) for a, _, b, _ in schemas.FOREIGN_KEYS]
    return reports.relations(mart["movies"].sparkSession, {"mart": every, "curated": every, "links": [(a, b) for a, b in every if a in LINKS]})


def report_code_coverage(mart: C.Tables) -> DataFrame:
    return reports.code_coverage(mart)


def report_match_coverage(mart: C.Tables) -> DataFrame:
    return reports.match_coverage(mart)


def report_fill_films(mart: C.Tables) -> DataFrame:
    return reports.fill_profile(mart["movies"])


def report_fill_people(mart: C.Tables) -> DataFrame:
    return reports.fill_profile(mart["people"])


def report_status(mart: C.Tables) -> DataFrame:
    return reports.status_counts(mart, AS_OF.isoformat())


def report_numbers(mart: C.Tables) -> DataFrame:
    return reports.numeric_profile(mart)


def report_smallest_money(mart: C.Tables) -> DataFrame:
    return reports.smallest_money(mart).select(F.col("id").cast("bigint").alias("id"), "title", "budget", "revenue", F.col("vote_count").cast("bigint").alias("vote_count"))


def report_vote_buckets(mart: C.Tables) -> DataFrame:
    return reports.vote_buckets(mart)


def report_languages(mart: C.Tables) -> DataFrame:
    return reports.top_languages(mart).select("original_language", "films", "listed")


def report_genders(mart: C.Tables) -> DataFrame:
    return reports.gender_share(mart).withColumn("gender", F.col("gender").cast("bigint"))


def report_departments(mart: C.Tables) -> DataFrame:
    return reports.department_counts(mart)


def report_cardinalities(mart: C.Tables) -> DataFrame:
    return views.cardinalities(mart)


def report_malformed(mart: C.Tables) -> DataFrame:
    return reports.malformed_texts(mart)


def view_enriched(mart: C.Tables) -> DataFrame:
    return views.movies_enriched(mart).select(F.col("id").cast("bigint").alias("id"), "release_year", F.col("tmdb_rating").cast("double").alias("tmdb_rating"), F.col("imdb_votes").cast("bigint").alias("imdb_votes"), "collection", "genres", "directors")


def view_gaps(mart: C.Tables) -> DataFrame:
    """The 20 widest gaps (a top list)."""
    return views.rating_gap_top(mart).limit(20).select(F.col("id").cast("bigint").alias("id"), "title", "genres", F.col("rating_gap").cast("double").alias("rating_gap"))


def view_people(mart: C.Tables) -> DataFrame:
    return views.top_people(mart).withColumn("id", F.col("id").cast("bigint"))


def view_genre_stats(mart: C.Tables) -> DataFrame:
    return views.genre_stats(mart)


def view_yearly(mart: C.Tables) -> DataFrame:
    return views.yearly(mart)


def card_pipeline(mart: C.Tables) -> DataFrame:
    """The cards on the mart as (card, item, value)."""
    spark = mart["movies"].sparkSession
    cards = reports.pipeline_cards(mart, spark.createDataFrame([], RUNS))
    shown = {"films in the mart": ("'films'", "films"), "match coverage": ("state", "films"), "ratings by genre": ("genre", "avg_tmdb_rating"), "people in most casts": ("person", "films")}
    return reports._union([cards[name].select(F.lit(name).alias("card"), F.expr(item).alias("item"), F.col(value).cast("double").alias("value")) for name, (item, value) in shown.items()])


def report_kpis(a: Audit) -> DataFrame:
    return views.kpi_impact(a.mart, a.curated)


def report_genres(a: Audit) -> DataFrame:
    return views.genre_impact(a.mart, a.curated)


def report_verdicts(a: Audit) -> DataFrame:
    return reports.verdict_counts(a.judged)


def report_ranked(a: Audit) -> DataFrame:
    return reports.ranked_anomalies(a.judged).select("control_id", "severity", "anomalies_before", "pct_before", "anomalies_after", "pct_after", "verdict")


def report_scores(a: Audit) -> DataFrame:
    return reports.score_comparison(a.scores)


def report_actions(a: Audit) -> DataFrame:
    return reports.corrections_by_action(views.corrections_summary(a.journal))


def report_tables(a: Audit) -> DataFrame:
    return reports.table_counts(a.mart, a.curated)


def card_quality(a: Audit) -> DataFrame:
    """The cards on the audit as (card, item, value)."""
    history = views.history(a.results.withColumn("run_id", F.lit("run")))
    cards = reports.quality_cards(a.mart, a.curated, a.judged, a.scores, history, a.journal)
    shown = {
        "anomalies before": ("''", "anomalies"), "anomalies after": ("''", "anomalies"), "controls to do": ("''", "controls"), "treatments": ("treatment", "controls"), "scores": ("dimension", "score_after"), "ranked controls": ("control_id", "anomalies_after"),
        "effect on genres": ("genre", "tmdb_curated"), "effect on indicators": ("indicator", "delta"), "history": ("dimension", "anomalies"), "corrections": ("concat_ws('/', control_id, action, table_name, column_name)", "corrections"),
    }
    return reports._union([cards[name].select(F.lit(name).alias("card"), F.expr(item).alias("item"), F.col(value).cast("double").alias("value")) for name, (item, value) in shown.items()])


#: Panels on the mart, the run audit and the controls; the others watch machines.
_OWN = tuple(n for n, terms in P.PANELS.items() if all(t.metric.startswith(("pipeline_clean", "pipeline_load", "pipeline_dq", "pipeline_raw_rows")) for t in terms))
_MACHINES = tuple(n for n in P.PANELS if n not in _OWN)


def panels_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _audit(spark, sf_dir)
    at = F.lit(NOW)
    raw = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("source"), "n") for t, s in (("raw_movies", "documents"), ("raw_ratings", "titles"))]
    samples = reports.exported(a.mart, audit_runs(spark, sf_dir), a.results, a.scores, at).unionByName(P.M.gauge(reports._union(raw), "pipeline_raw_rows", "n", ("source",), at))
    samples = scratch_table(samples, "samples")
    return P.panels(samples, at, _OWN)


#: metric -> labels of its series beside the event's type; events stand for machines.
_WATCHED = {t.metric: dict(t.equal) for name in _MACHINES for term in P.PANELS[name] for t in (term, term.over, term.plus) if t is not None}


def panels_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id is not null and ts is not null and value is not null").groupBy("event_type", F.col("ts").cast("timestamp").alias("ts")).agg(F.max("value").cast("double").alias("value"))
    series = [F.struct(F.lit(m).alias("metric"), F.create_map(F.lit("name"), F.col("event_type"), *[F.lit(x) for kv in labels.items() for x in kv]).alias("labels")) for m, labels in _WATCHED.items()]
    samples = scratch_table(e.select(F.inline(F.array(*series)), "ts", "value").select("metric", "labels", "ts", "value"), "samples")
    end = F.lit(e.agg(F.max("ts")).first()[0])
    out = P.panels(samples, end, _MACHINES)
    name = F.coalesce(F.get_json_object("series", "$.name"), F.lit(""))
    return out.select("panel", F.col("term").cast("bigint").alias("term"), name.alias("name"), F.round("value", 4).alias("value"))


_MART_FUNCTIONS = (
    report_columns, report_schema_diff, report_constraints, report_relations, report_code_coverage, report_match_coverage, report_fill_films, report_fill_people, report_status, report_numbers, report_smallest_money, report_vote_buckets, report_languages,
    report_genders, report_departments, report_cardinalities, report_malformed, view_enriched, view_gaps, view_people, view_genre_stats, view_yearly, card_pipeline,
)
_AUDIT_FUNCTIONS = (report_kpis, report_genres, report_verdicts, report_ranked, report_scores, report_actions, report_tables, card_quality)

QUERIES = {f.__name__: f for f in (control_results, control_results_cleaned, cleaning_journal, cleaned_tables, cleaned_films, control_verdicts, control_scores, control_evidence, mart_constraints, last_run_of_each_job, last_finished_run, run_report, panels_pipeline, panels_machines)}
QUERIES |= {f.__name__: _of_mart(f) for f in _MART_FUNCTIONS} | {f.__name__: _of_audit(f) for f in _AUDIT_FUNCTIONS}

from reelmill.queries.audit_sql import SQL  # noqa: E402, F401
