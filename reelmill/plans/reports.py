"""Reports on a mart and its audit, and the questions of the dashboards; each is a function of tables.

``results`` are rows (phase, control_id, dimension, checked_rows, anomaly_rows, anomaly_rate, passed), ``judged`` those
of :func:`controls.verdicts`, ``journal`` the corrections of a cleaning, ``runs`` the run audit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelmill import schemas
from reelmill.operators.controls import Constraint
from reelmill.operators.metrics import gauge
from reelmill.operators.relational import with_membership
from reelmill.plans import views
from reelmill.plans.mart import LINKS, Mart


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100.0 * F.try_divide(part, whole), digits)


# --- catalogue ------------------------------------------------------------------------------------------------------


def table_counts(before: Mart, after: Mart) -> DataFrame:
    """``(table_name, kind, mart_rows, curated_rows, mart_columns)``."""
    spark = before["movies"].sparkSession
    meta = spark.createDataFrame([(t, "link" if t in LINKS else "entity", len(before[t].columns)) for t in schemas.MART], "table_name string, kind string, mart_columns int")
    counts = views.volumes(before, after)
    return meta.join(counts.select("table_name", F.col("before").alias("mart_rows"), F.col("after").alias("curated_rows")), "table_name")


def constraint_catalogue(spark: SparkSession, constraints: list[Constraint]) -> DataFrame:
    """``(table_name, kind, definition)`` of the declared constraints."""
    rows = []
    for c in constraints:
        text = f"{c.columns[0]} references {c.parent} ({c.parent_key})" if c.kind == "foreign key" else c.predicate if c.kind == "check" else f"({', '.join(c.columns)})"
        rows.append((c.table, c.kind, text))
    return spark.createDataFrame(rows, "table_name string, kind string, definition string")


def relations(spark: SparkSession, layers: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """``(relation, <layer>...)``: which layer declares which foreign key, ``layers`` being pairs of a table and its parent."""
    edges = _union([spark.createDataFrame([(layer, f"{a} -> {b}") for a, b in pairs], "layer string, relation string") for layer, pairs in layers.items()])
    return edges.groupBy("relation").agg(*[F.bool_or(F.col("layer") == layer).alias(layer) for layer in layers])


def constraints_by_kind(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("kind").agg(F.count(F.lit(1)).alias("curated"))


def code_coverage(mart: Mart) -> DataFrame:
    """Codes that are linked to no reference table, and how many of them are in it."""
    films = with_membership(mart["movies"], "original_language", mart["languages"], "iso_639_1", "known")
    companies = with_membership(mart["production_companies"], "origin_country", mart["countries"], "iso_3166_1", "known")
    a = films.agg(F.count("original_language").alias("filled"), F.count_if("known").alias("known")).select(F.lit("movies.original_language -> languages").alias("attribute"), "*")
    b = companies.agg(F.count_if(F.trim("origin_country") != "").alias("filled"), F.count_if("known").alias("known")).select(F.lit("production_companies.origin_country -> countries").alias("attribute"), "*")
    return a.unionByName(b)


def match_coverage(mart: Mart) -> DataFrame:
    n = F.count(F.lit(1))
    return mart["movies"].agg(n.alias("films"), F.count("imdb_id").alias("with_key"), F.count_if("has_imdb_match").alias("with_rating"), F.count("imdb_start_year").alias("with_title_data"), _share(F.count_if("has_imdb_match"), n).alias("coverage_pct"))


# --- profiling ------------------------------------------------------------------------------------------------------


def fill_profile(df: DataFrame) -> DataFrame:
    """``(column_name, filled, blank, useful_pct)`` of every column, whatever its type, in one aggregation."""
    n, parts = F.count(F.lit(1)), []
    for i, f in enumerate(df.schema):
        blank = F.count_if(F.col(f"`{f.name}`") == "") if f.dataType.typeName() == "string" else F.lit(0).cast("bigint")
        parts += [F.count(F.col(f"`{f.name}`")).alias(f"f{i}"), blank.alias(f"b{i}")]
    cells = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"f{i}").alias("filled"), F.col(f"b{i}").alias("blank"), _share(F.col(f"f{i}") - F.col(f"b{i}"), F.col("n")).alias("useful_pct")) for i, f in enumerate(df.schema)])
    return df.agg(n.alias("n"), *parts).select(F.inline(cells))


def status_counts(mart: Mart, as_of: str) -> DataFrame:
    m = mart["movies"].groupBy(F.coalesce("status", F.lit("(NULL)")).alias("status"))
    return m.agg(F.count(F.lit(1)).alias("films"), F.count_if(F.col("release_date") > F.lit(as_of).cast("date")).alias("dated_ahead"), F.count_if(F.coalesce("vote_count", F.lit(0)) == 0).alias("without_votes"))


# The measures of the numeric profile.
MEASURES = {
    "runtime (min)": "runtime", "vote_average": "vote_average", "vote_count": "vote_count", "imdb_average_rating": "imdb_average_rating", "budget (USD)": "budget", "revenue (USD)": "revenue",
    "release_date (year)": "year(release_date)",
}


def numeric_profile(mart: Mart) -> DataFrame:
    """``(measure, n, least, median, most)``; all in one aggregation, a median being a value that occurs."""
    parts = []
    for i, e in enumerate(MEASURES.values()):
        x = F.expr(f"cast({e} as double)")
        parts += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.expr(f"percentile_disc(0.5) within group (order by cast({e} as double))").alias(f"mid{i}"), F.max(x).alias(f"hi{i}")]
    cells = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(f"n{i}").alias("n"), F.col(f"lo{i}").alias("least"), F.col(f"mid{i}").alias("median"), F.col(f"hi{i}").alias("most")) for i, name in enumerate(MEASURES)])
    return mart["movies"].agg(*parts).select(F.inline(cells))


def smallest_money(mart: Mart, below: int = 100_000, n: int = 10) -> DataFrame:
    m = mart["movies"].where((F.col("budget") < below) | (F.col("revenue") < below))
    least = F.least(F.coalesce("budget", "revenue"), F.coalesce("revenue", "budget"))
    return m.select("id", "title", "budget", "revenue", "vote_count").orderBy(least, "id").limit(n)


def vote_buckets(mart: Mart) -> DataFrame:
    v = F.col("vote_count")
    bucket = F.when(v == 0, "no vote").when(v < 10, "1 to 9 votes").when(v < 100, "10 to 99 votes").otherwise("100 votes and more")
    return mart["movies"].groupBy(bucket.alias("votes")).agg(F.count(F.lit(1)).alias("films"), F.count_if(F.col("vote_average") == 0).alias("rated_zero"), views._mean("vote_average").alias("mean_rating"))


def top_languages(mart: Mart, n: int = 10) -> DataFrame:
    known = with_membership(mart["movies"].groupBy("original_language").agg(F.count(F.lit(1)).alias("films")), "original_language", mart["languages"], "iso_639_1", "listed")
    return known.orderBy(F.col("films").desc(), F.col("original_language").asc_nulls_last()).limit(n)


def gender_share(mart: Mart) -> DataFrame:
    label = F.when(F.col("gender") == 0, "not stated").when(F.col("gender") == 1, "woman").when(F.col("gender") == 2, "man").when(F.col("gender") == 3, "non-binary")
    counted = mart["people"].groupBy("gender").agg(F.count(F.lit(1)).alias("people"))
    total = F.sum("people").over(Window.partitionBy(F.lit(1)))  # one row per gender
    return counted.select("gender", label.alias("label"), "people", _share(F.col("people"), total).alias("pct"))


def department_counts(mart: Mart) -> DataFrame:
    return mart["people"].groupBy(F.coalesce("known_for_department", F.lit("(NULL)")).alias("known_for_department")).agg(F.count(F.lit(1)).alias("people"))


def malformed_texts(mart: Mart) -> DataFrame:
    """``(table_name, column_name, n_values, example)`` of blank and padded texts, one scan per table."""
    parts = []
    for table, df in mart.items():
        names = [f.name for f in df.schema if f.dataType.typeName() == "string"]
        bad = F.array_compact(F.array(*[F.when((F.trim(F.col(c)) == "") | (F.col(c) != F.trim(F.col(c))), F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))) for c in names])) if names else None
        if bad is not None:
            parts.append(df.select(F.lit(table).alias("table_name"), F.inline(bad)))
    return _union(parts).groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n_values"), F.min("value").alias("example"))


# --- before and after -----------------------------------------------------------------------------------------------


def last_run(runs: DataFrame) -> DataFrame:
    """The run that was started last of those that are finished."""
    return runs.where("finished_at is not null").orderBy(F.col("started_at").desc(), "run_id").limit(1)


def run_summary(before: Mart, after: Mart, judged: DataFrame, journal: DataFrame) -> DataFrame:
    """``(mart_ingest_date, mart_movies, curated_movies, anomalies_before, anomalies_after, corrections)``: one row."""
    a = before["movies"].agg(F.max("ingest_date").alias("mart_ingest_date"), F.count(F.lit(1)).alias("mart_movies"))
    b = after["movies"].agg(F.count(F.lit(1)).alias("curated_movies"))
    c = judged.agg(F.sum("anomalies_before").alias("anomalies_before"), F.sum("anomalies_after").alias("anomalies_after"))
    d = journal.agg(F.count(F.lit(1)).alias("corrections"))
    one = lambda df: df.withColumn("__k", F.lit(1))
    return one(a).join(one(b), "__k").join(one(c), "__k").join(one(d), "__k").drop("__k")


def verdict_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("controls"), F.sum("anomalies_before").alias("anomalies_before"), F.sum("anomalies_after").alias("anomalies_after"))


def ranked_anomalies(judged: DataFrame) -> DataFrame:
    found = judged.where("anomalies_before > 0 or anomalies_after > 0")
    return found.select("control_id", "dimension", "severity", "anomalies_before", "pct_before", "anomalies_after", "pct_after", "treatment", "verdict", "priority").orderBy(F.col("priority").desc(), "control_id")


def score_comparison(scores: DataFrame, global_row: bool = True) -> DataFrame:
    """``(dimension, score_before, score_after, passed_before, passed_after)``; the dashboards leave the row of all dimensions out."""
    side = lambda phase: scores.where(F.col("phase") == phase).select("dimension", F.col("score").alias(f"score_{phase}"), F.concat(F.col("controls_passed").cast("string"), F.lit("/"), F.col("controls").cast("string")).alias(f"passed_{phase}"))
    a, b = side("before"), side("after").withColumnRenamed("dimension", "__d")
    same = F.col("dimension").eqNullSafe(F.col("__d")) if global_row else F.col("dimension") == F.col("__d")
    return a.join(b, same).select(F.coalesce("dimension", F.lit("global")).alias("dimension"), "score_before", "score_after", "passed_before", "passed_after")


def corrections_by_action(summary: DataFrame) -> DataFrame:
    return summary.groupBy("action").agg(F.countDistinct("control_id").alias("controls"), F.sum("corrections").alias("n_rows"))


# --- questions of the dashboards ------------------------------------------------------------------------------------


def pipeline_cards(mart: Mart, runs: DataFrame) -> dict[str, DataFrame]:
    people = views.top_people(mart).select(F.col("name").alias("person"), F.col("movies").alias("films"), "id")
    return {
        "films in the mart": mart["movies"].agg(F.count(F.lit(1)).alias("films")),
        "match coverage": mart["movies"].groupBy(F.when(F.col("has_imdb_match"), "matched").otherwise("unmatched").alias("state")).agg(F.count(F.lit(1)).alias("films")),
        "volumes": views.last_runs(runs).select("job", "status", "raw_rows_in", "distinct_movies_in", "clean_rows_out", "rejected_rows", "imdb_matched", "finished_at").orderBy("job"),
        "widest gaps": views.rating_gap_top(mart).limit(20),
        "ratings by genre": views.genre_stats(mart).orderBy(F.col("movies").desc(), "genre").limit(12).select("genre", "avg_tmdb_rating", "avg_imdb_rating"),
        "people in most casts": people.orderBy(F.col("films").desc(), "person", "id").limit(15).drop("id"),
    }


def quality_cards(before: Mart, after: Mart, judged: DataFrame, scores: DataFrame, history: DataFrame, journal: DataFrame) -> dict[str, DataFrame]:
    effect = views.genre_impact(before, after)
    return {
        "anomalies before": judged.agg(F.sum("anomalies_before").alias("anomalies")),
        "anomalies after": judged.agg(F.sum("anomalies_after").alias("anomalies")),
        "controls to do": judged.agg(F.count_if(F.col("verdict") == "to do").alias("controls")),
        "treatments": judged.groupBy("treatment").agg(F.count(F.lit(1)).alias("controls")),
        "scores": score_comparison(scores, global_row=False).select("dimension", "score_before", "score_after"),
        "ranked controls": ranked_anomalies(judged),
        "effect on genres": effect.orderBy(F.col("films_mart").desc(), "genre").limit(12).select("genre", "tmdb_mart", "tmdb_curated"),
        "effect on indicators": views.kpi_impact(before, after).select("indicator", "mart", "curated", "delta"),
        "history": history.where("phase = 'before'").select("run_id", "dimension", "anomalies"),
        "corrections": views.corrections_summary(journal).orderBy(F.col("corrections").desc(), "control_id", "table_name", "column_name"),
    }


def exported(mart: Mart, runs: DataFrame, results: DataFrame, scores: DataFrame, at: Column) -> DataFrame:
    """The samples the exporter reads off the mart and its audit: clean rows, last runs, anomalies, scores."""
    last = views.last_runs(runs, at).withColumn("success", (F.col("status") != "failed").cast("int"))
    parts = [gauge(views.row_counts(mart), "pipeline_clean_rows", "n_rows", ("table_name",), at)]
    for metric, column in (("raw_rows_in", "raw_rows_in"), ("distinct_movies_in", "distinct_movies_in"), ("clean_rows_out", "clean_rows_out"), ("rejected_rows", "rejected_rows"), ("success", "success"), ("duration_seconds", "duration_seconds"), ("age_seconds", "age_seconds")):
        parts.append(gauge(last.where(F.col(column).isNotNull()), f"pipeline_load_run_{metric}", column, ("job",), at))
    parts.append(gauge(results, "pipeline_dq_control_anomalies", "anomaly_rows", ("control_id", "dimension", "phase"), at))
    parts.append(gauge(scores.withColumn("dimension", F.coalesce("dimension", F.lit("global"))), "pipeline_dq_dimension_score", "score", ("dimension", "phase"), at))
    return _union(parts)
