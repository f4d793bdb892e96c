"""Views over a mart and reports over its audit; each is a function of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill import schemas
from reelmill.operators.relational import contains_text, unpivot
from reelmill.plans.mart import LINKS, Mart


def _rounded(c: Column, digits: int = 2) -> Column:
    return F.round(c.cast("double"), digits)


def _mean(column: str, digits: int = 2) -> Column:
    """A mean of decimals, exact before it is rounded half away from zero."""
    return F.round(F.avg(F.col(column).cast("decimal(20,6)")), digits).cast("double")


def _names_per_movie(mart: Mart) -> tuple[DataFrame, DataFrame]:
    genres = mart["movie_genres"].join(mart["genres"], F.col("genre_id") == F.col("id")).groupBy("movie_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("genres"))
    directors = mart["movie_crew"].where("job = 'Director'").join(mart["people"], F.col("person_id") == F.col("id")).groupBy("movie_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("directors"))
    return genres, directors


def movies_enriched(mart: Mart) -> DataFrame:
    """Films with both ratings side by side, their collection, genres and directors as text."""
    genres, directors = _names_per_movie(mart)
    c = mart["collections"].select(F.col("id").alias("__c"), F.col("name").alias("collection"))
    out = mart["movies"].join(c, F.col("collection_id") == F.col("__c"), "left")
    out = out.join(genres.withColumnRenamed("movie_id", "__g"), F.col("id") == F.col("__g"), "left")
    out = out.join(directors.withColumnRenamed("movie_id", "__d"), F.col("id") == F.col("__d"), "left")
    return out.select(
        "id", "title", "original_title", "release_date", F.year("release_date").alias("release_year"), "runtime", "budget", "revenue", "popularity", F.col("vote_average").alias("tmdb_rating"), F.col("vote_count").alias("tmdb_votes"),
        F.col("imdb_average_rating").alias("imdb_rating"), F.col("imdb_num_votes").alias("imdb_votes"), "rating_gap", "votes_ratio", "has_imdb_match", "imdb_id", "collection", "genres", "directors", "ingest_date", "loaded_at",
    )


def rating_gap_top(mart: Mart, votes: int = 50, second_votes: int = 100) -> DataFrame:
    """Films both sources rate on enough votes, the widest gap first."""
    rated = movies_enriched(mart).where((F.col("has_imdb_match")) & (F.col("tmdb_votes") >= votes) & (F.col("imdb_votes") >= second_votes))
    return rated.select("id", "title", "release_year", "genres", "tmdb_rating", "tmdb_votes", "imdb_rating", "imdb_votes", "rating_gap").orderBy(F.abs("rating_gap").desc_nulls_last(), "id")


def _of_genres(mart: Mart) -> DataFrame:
    films = mart["movies"].select(F.col("id").alias("movie_id"), "vote_average", "imdb_average_rating", "rating_gap", "has_imdb_match")
    return mart["movie_genres"].join(films, "movie_id").join(mart["genres"].select(F.col("id").alias("genre_id"), F.col("name").alias("genre")), "genre_id")


def genre_stats(mart: Mart) -> DataFrame:
    return _of_genres(mart).groupBy("genre").agg(F.count(F.lit(1)).alias("movies"), _mean("vote_average").alias("avg_tmdb_rating"), _mean("imdb_average_rating").alias("avg_imdb_rating"), _mean("rating_gap").alias("avg_rating_gap"), F.count_if("has_imdb_match").alias("with_imdb"))


def genre_ratings(mart: Mart) -> DataFrame:
    """The averages of :func:`genre_stats` to three digits, as the effect of a cleaning is measured on them."""
    three = lambda c: _mean(c, 3)
    return _of_genres(mart).groupBy("genre").agg(F.count(F.lit(1)).alias("films"), three("vote_average").alias("tmdb"), three("imdb_average_rating").alias("imdb"), three("rating_gap").alias("gap"))


def yearly(mart: Mart) -> DataFrame:
    dated = mart["movies"].where("release_date is not null").groupBy(F.year("release_date").alias("release_year"))
    return dated.agg(F.count(F.lit(1)).alias("movies"), _mean("vote_average").alias("avg_tmdb_rating"), _mean("imdb_average_rating").alias("avg_imdb_rating"), F.sum("revenue").alias("total_revenue"), F.sum("budget").alias("total_budget"))


def top_people(mart: Mart) -> DataFrame:
    """Actors by the number of their films; ratings are averaged over credits."""
    films = mart["movies"].select(F.col("id").alias("movie_id"), "vote_average", "imdb_average_rating")
    # counted per person before names are joined
    per = mart["movie_cast"].join(films, "movie_id").groupBy("person_id").agg(F.countDistinct("movie_id").alias("movies"), _mean("vote_average").alias("avg_tmdb_rating"), _mean("imdb_average_rating").alias("avg_imdb_rating"))
    return mart["people"].join(per, F.col("id") == F.col("person_id")).select("id", "name", "known_for_department", "movies", "avg_tmdb_rating", "avg_imdb_rating")


def row_counts(mart: Mart) -> DataFrame:
    """``(table_name, n_rows)`` of every table, and of the films with a match."""
    out = None
    for name, df in [*((n, mart[n]) for n in schemas.MART), ("movies_with_imdb", mart["movies"].where("has_imdb_match"))]:
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def last_runs(runs: DataFrame, now: Column | None = None) -> DataFrame:
    """Each job's last run, its age at ``now`` and the share of its input that came out clean."""
    last = runs.groupBy("job").agg(F.max(F.struct("started_at", *[c for c in runs.columns if c not in ("job", "started_at")])).alias("r")).select("job", "r.*")
    age = F.unix_timestamp(F.current_timestamp() if now is None else now) - F.unix_timestamp(F.coalesce("finished_at", "started_at"))
    return last.withColumn("age_seconds", age).withColumn("clean_ratio", F.round(F.try_divide("clean_rows_out", "raw_rows_in"), 4))


def find_movies(mart: Mart, title: str, limit: int = 20) -> DataFrame:
    m = mart["movies"].where(contains_text(F.col("title"), title) | contains_text(F.col("original_title"), title))
    return m.select("id", "title", "release_date", "vote_average", "vote_count").orderBy(F.col("vote_count").desc_nulls_last(), "id").limit(limit)


def list_movies(mart: Mart, limit: int = 50) -> DataFrame:
    return movies_enriched(mart).select("id", "title", "release_date", "genres", "tmdb_rating", "popularity").orderBy(F.col("popularity").desc_nulls_last(), "id").limit(limit)


def movie_detail(mart: Mart, movie_id: int) -> DataFrame:
    one = {name: df.where(F.col("movie_id") == movie_id) if name in LINKS else df for name, df in mart.items()}
    one["movies"] = mart["movies"].where(F.col("id") == movie_id)
    return movies_enriched(one)


def movie_cast(mart: Mart, movie_id: int, limit: int = 10) -> DataFrame:
    roles = mart["movie_cast"].where(F.col("movie_id") == movie_id).join(mart["people"].select(F.col("id").alias("person_id"), "name"), "person_id")
    return roles.select("name", "character", "cast_order").orderBy(F.col("cast_order").asc_nulls_last(), "name").limit(limit)


# --- reports on an audit --------------------------------------------------------------------------------------------

# The indicators of the catalogue, in order.
INDICATORS = ("films", "rated films", "mean rating", "mean second rating", "mean rating gap", "match coverage (%)", "films with runtime", "films with budget", "mean budget (USD)", "dated films")


def kpis(mart: Mart) -> DataFrame:
    """``(position, indicator, value)``."""
    n = F.count(F.lit(1))
    three = lambda c: _mean(c, 3)
    values = (
        n, F.count("vote_average"), three("vote_average"), three("imdb_average_rating"), three("rating_gap"), F.round(100.0 * F.try_divide(F.count_if("has_imdb_match"), n), 2),
        F.count("runtime"), F.count("budget"), F.round(F.avg("budget"), 0), F.count("release_date"),
    )
    return unpivot(mart["movies"].agg(*[v.cast("double").alias(name) for name, v in zip(INDICATORS, values)]), INDICATORS, "indicator", "value")


def kpi_impact(before: Mart, after: Mart) -> DataFrame:
    """``(position, indicator, mart, curated, delta)``."""
    a = kpis(after).select("indicator", F.col("value").alias("curated"))
    return kpis(before).withColumnRenamed("value", "mart").join(a, "indicator", "left").select("position", "indicator", "mart", "curated", F.round(F.col("curated") - F.col("mart"), 3).alias("delta")).orderBy("position")


def genre_impact(before: Mart, after: Mart) -> DataFrame:
    """Films and ratings of each genre on either side, and the effect on its rating."""
    sides = [genre_ratings(m).select("genre", *[F.col(c).alias(f"{c}_{side}") for c in ("films", "tmdb", "gap")]) for m, side in ((before, "mart"), (after, "curated"))]
    j = sides[0].join(sides[1], "genre", "left").withColumn("effect", F.round(F.col("tmdb_curated") - F.col("tmdb_mart"), 3))
    return j.orderBy(F.abs(F.coalesce("effect", F.lit(0.0))).desc(), F.col("films_mart").desc(), "genre")


def volumes(before: Mart, after: Mart) -> DataFrame:
    a = row_counts(after).withColumnRenamed("n_rows", "after")
    return row_counts(before).withColumnRenamed("n_rows", "before").join(a, "table_name").withColumn("delta", F.col("after") - F.col("before"))


def corrections_summary(journal: DataFrame) -> DataFrame:
    return journal.groupBy("control_id", "action", "table_name", "column_name").agg(F.count(F.lit(1)).alias("corrections"))


def history(results: DataFrame) -> DataFrame:
    """Anomalies and failed controls per run, phase and dimension, of rows (run_id, phase, dimension, anomaly_rows, passed)."""
    return results.groupBy("run_id", "phase", "dimension").agg(F.sum("anomaly_rows").alias("anomalies"), F.count_if(~F.col("passed")).alias("failed"))


def examples(anomalies: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` record keys of each control."""
    line = Window.partitionBy("control_id").orderBy("record_key", "table_name")
    return anomalies.withColumn("n", F.row_number().over(line)).where(F.col("n") <= n)


def columns_of(tables: Mart, schema_name: str) -> DataFrame:
    """The catalog: ``(schema_name, table_name, position, column_name, data_type)``."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(schema_name, t, i, f.name, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema, 1)]
    return spark.createDataFrame(rows, "schema_name string, table_name string, position int, column_name string, data_type string")


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns only one catalog has, or of another type in the other."""
    keys = ["table_name", "column_name"]
    j = a.select(*keys, F.col("data_type").alias("left_type")).join(b.select(*keys, F.col("data_type").alias("right_type")), keys, "full")
    return j.where(~F.col("left_type").eqNullSafe(F.col("right_type")))


def cardinalities(mart: Mart) -> DataFrame:
    """Least, mean and greatest number of links per film, of each relation; films without any count as 0."""
    out = None
    for name in LINKS:
        links = mart[name].groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"))
        per = mart["movies"].select(F.col("id").alias("movie_id")).join(links, "movie_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
        one = per.agg(F.min("n").alias("least"), _rounded(F.avg("n"), 2).alias("mean"), F.max("n").alias("most")).select(F.lit(name).alias("relation"), "least", "mean", "most")
        out = one if out is None else out.unionByName(one)
    return out
