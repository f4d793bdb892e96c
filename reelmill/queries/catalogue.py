"""Queries through the film pipeline's own operators: snapshot, mart, controls, cleaning, metrics, streams."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.operators import controls as C
from reelmill.operators import metrics as M
from reelmill.operators import rejects
from reelmill.plans import catalogue, mart, views
from reelmill.queries.problems import _LINES, table
from reelmill.session import scratch_dir, scratch_table
from reelmill.streaming import landing

AS_OF = date(2026, 9, 20)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second source: each title's last valid line of the ratings file, as the loader of problem 7 reads it."""
    lines = table(spark, sf_dir, "raw_ratings")
    valid = rejects.loaded(lines).where("tconst is not null").join(lines.select("line_id", "ingest_date"), "line_id")
    last = valid.groupBy("tconst").agg(F.max(F.struct("ingest_date", "line_id", "averageRating", "numVotes")).alias("r"))
    return last.select("tconst", F.col("r.averageRating").cast("decimal(3,1)").alias("imdb_average_rating"), F.col("r.numVotes").alias("imdb_num_votes"))


def _films(spark: SparkSession, sf_dir: str) -> DataFrame:
    films, _ = catalogue.aggregate(table(spark, sf_dir, "raw_movies"), ratings(spark, sf_dir), None, AS_OF.isoformat())
    return films


def film_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Films joined with the second source, and what follows from both."""
    f = _films(spark, sf_dir)
    return f.select(F.col("id").cast("bigint").alias("id"), F.col("imdb_average_rating").cast("double").alias("imdb_rating"), F.col("imdb_num_votes").cast("bigint").alias("imdb_votes"), "has_imdb_match", F.col("rating_gap").cast("double").alias("rating_gap"), F.col("votes_ratio").cast("double").alias("votes_ratio"))


def mart_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people that survive: the freshest sighting of each."""
    p = _mart(spark, sf_dir)["people"]
    return p.select(F.col("id").cast("bigint").alias("id"), "name", F.col("gender").cast("bigint").alias("gender"), F.col("popularity").cast("double").alias("popularity"))


def mart_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The credits that survive, one per role or job."""
    m = _mart(spark, sf_dir)
    cast = m["movie_cast"].select("credit_id", F.col("movie_id").cast("bigint").alias("movie_id"), F.col("person_id").cast("bigint").alias("person_id"), F.col("character").alias("part"))
    crew = m["movie_crew"].select("credit_id", F.col("movie_id").cast("bigint").alias("movie_id"), F.col("person_id").cast("bigint").alias("person_id"), F.col("job").alias("part"))
    return cast.unionByName(crew)


def snapshot_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last usable state of every film, cleaned."""
    f = _films(spark, sf_dir)
    return f.select(F.col("id").cast("bigint").alias("id"), F.date_format("source_fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))


def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = F.count_if(catalogue.is_usable())
    return table(spark, sf_dir, "raw_movies").agg(F.count(F.lit(1)).alias("raw_rows"), usable.alias("usable_rows"), (F.count(F.lit(1)) - usable).alias("rejected_rows"), F.countDistinct(F.when(catalogue.is_usable(), F.col("movie_id"))).alias("films"))


def _mart(spark: SparkSession, sf_dir: str) -> mart.Mart:
    return mart.build_tables(scratch_table(_films(spark, sf_dir), "films"))


def mart_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.row_counts(_mart(spark, sf_dir))


def mart_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mart after two loads of the snapshot: every table merged, links and orphans purged, versions swapped."""
    store = mart.MartStore(spark, f"{scratch_dir(spark)}/mart-{uuid.uuid4().hex}")
    films = scratch_table(_films(spark, sf_dir), "films")
    for _ in range(2):
        mart.load(spark, films, store)
    return views.row_counts(store.read())


def mart_genre_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.genre_stats(_mart(spark, sf_dir))


def mart_top_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 people of most films (a top list)."""
    return views.top_people(_mart(spark, sf_dir)).orderBy(F.col("movies").desc(), "name", "id").limit(15).select("id", "name", "movies")


def mart_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.yearly(_mart(spark, sf_dir))


def mart_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cardinalities(_mart(spark, sf_dir))


# controls over the driver's tables; the same engine audits the mart
DRIVER_CONTROLS = [
    C.Control("COM-A", "completeness", "major", 0.05, "keep", (C.Branch("orders", "o_orderpriority is null"),)),
    C.Control("COM-B", "completeness", "minor", 0.3, "keep", (C.Branch("customer", "c_acctbal < 0"),)),
    C.Control("VAL-A", "validity", "critical", 0.0, "null", (C.Branch("lineitem", "l_quantity not between 1 and 45", "l_quantity is not null"),)),
    C.Control("VAL-B", "validity", "major", 0.5, "null", (C.Branch("orders", "o_orderstatus not in ('O', 'F')", "o_orderstatus is not null"), C.Branch("lineitem", "l_returnflag not in ('A', 'N')", "l_returnflag is not null"))),
    C.Control("COH-A", "coherence", "minor", 0.1, "correct", (C.Branch("lineitem", "l_discount > l_tax", "l_tax > 0"),)),
    C.Control("UNI-A", "uniqueness", "critical", 0.0, "delete", relational=lambda t: (t["orders"].agg(F.count(F.lit(1)).alias("population")), t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 20").select(F.col("o_custkey").alias("record_key")))),
    C.Control("INT-A", "integrity", "critical", 0.0, "delete", relational=lambda t: (t["customer"].agg(F.count(F.lit(1)).alias("population")), t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("record_key")))),
]


def _tables(spark: SparkSession, sf_dir: str) -> C.Tables:
    return {t: table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem")}


def dq_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.results(_tables(spark, sf_dir), DRIVER_CONTROLS)


def _cleaned(spark: SparkSession, sf_dir: str) -> tuple[C.Tables, C.Tables, DataFrame]:
    before = _tables(spark, sf_dir)
    lines = before["lineitem"].withColumn("l_rowkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    fixed = C.fix(lines, [C.Fix("VAL-A", "null", "l_quantity", "null", "l_quantity not between 1 and 45"), C.Fix("VAL-B", "null", "l_returnflag", "null", "l_returnflag not in ('A', 'N')"), C.Fix("COH-A", "correct", "l_discount", "l_tax", "l_tax > 0 and l_discount > l_tax and l_quantity is not null")])
    cleaned, journal = C.close_journal(fixed, "lineitem", "l_rowkey")
    return before, {**before, "lineitem": cleaned}, journal


def dq_clean_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes each fix made; the discount is corrected only where the quantity is still there."""
    journal = _cleaned(spark, sf_dir)[2]
    return journal.groupBy("control_id", "column_name", "action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("old_value").alias("n_old"))


def dq_verdict_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after, _ = _cleaned(spark, sf_dir)
    out = C.verdicts(C.results(before, DRIVER_CONTROLS), C.results(after, DRIVER_CONTROLS), DRIVER_CONTROLS)
    return out.select("control_id", "anomalies_before", "anomalies_after", F.col("priority").cast("double").alias("priority"), "verdict")


CONSTRAINTS = [
    C.Constraint("primary key", "orders", ("o_orderkey",)),
    C.Constraint("primary key", "lineitem", ("l_orderkey", "l_linenumber")),
    C.Constraint("foreign key", "orders", ("o_custkey",), parent="customer", parent_key="c_custkey"),
    C.Constraint("not null", "orders", ("o_totalprice",)),
    C.Constraint("unique", "customer", ("c_name",)),
    C.Constraint("check", "lineitem", ("l_tax",), "l_tax < 0.08"),
]


def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.violations(_tables(spark, sf_dir), CONSTRAINTS).select("name", "violations")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_id is not null")
    labels = F.create_map(F.lit("type"), F.col("event_type"))
    return e.select(F.lit("events_value").alias("metric"), labels.alias("labels"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


def metric_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = M.matching(_samples(spark, sf_dir), "events_value", differ={"type": "view"})
    out = M.latest(held.groupBy("metric", "labels", "series", "ts").agg(F.max("value").alias("value")))
    return out.select(F.col("labels")["type"].alias("type"), F.round("value", 4).alias("value"))


def metric_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises, with drops as restarts, over the week before the last event of all."""
    samples = _samples(spark, sf_dir)
    held = M.matching(samples, "events_value").groupBy("series", "labels", "ts").agg(F.max("value").alias("value"))
    end = F.lit(samples.agg(F.max("ts")).first()[0])
    out = M.increase(held, 7 * 86400, end)
    return out.select(F.col("labels")["type"].alias("type"), F.round("increase", 2).alias("increase"), F.round("rate", 6).alias("rate"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the events read as a stream, worked off to its end; the same rows as a batch gives."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_as_directory(spark, sf_dir, "events"))
    closed = landing.tumbling_counts(events)
    target = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    # windows are written when the watermark has passed them; one that is still open at the end is counted from its own rows
    closed.writeStream.outputMode("append").format("parquet").option("path", f"{target}/result").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(closed.schema).parquet(f"{target}/result")
    rest = landing.tumbling_counts(table(spark, sf_dir, "events")).join(done.select("start", "event_type"), ["start", "event_type"], "left_anti")
    out = done.unionByName(rest.select(done.columns))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def _as_directory(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A stream reads folders: the table is one as it is, or is written as one."""
    import os

    if os.path.isdir(f"{sf_dir}/{name}.parquet"):
        return f"{sf_dir}/{name}.parquet"
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table(spark, sf_dir, name).write.parquet(path)
    return path


QUERIES = {f.__name__: f for f in (snapshot_films, film_matches, mart_people, mart_credits, message_counts, mart_counts, mart_reload, mart_genre_stats, mart_top_people, mart_yearly, mart_cardinalities, dq_results, dq_clean_journal, dq_verdict_priority, constraint_check, metric_latest, metric_increase, stream_tumbling)}

_USABLE = "payload.id IS NOT NULL AND trim(coalesce(payload.title, '')) <> ''"
# films as the pipeline keeps them, but for the choice between equal moments
_LATEST = f"WITH usable AS (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY CAST(fetched_at AS TIMESTAMPTZ) DESC, fetched_at DESC, payload.vote_count DESC NULLS LAST) AS rn FROM raw_movies WHERE {_USABLE}), films AS (SELECT payload, CAST(fetched_at AS TIMESTAMPTZ) AS seen FROM usable WHERE rn = 1)"
_RESULTS = """
WITH counts AS (
SELECT 'COM-A' AS control_id, count(*) AS checked, count(*) FILTER (WHERE o_orderpriority IS NULL) AS found, 0.05 AS t FROM orders
UNION ALL SELECT 'COM-B', count(*), count(*) FILTER (WHERE c_acctbal < 0), 0.3 FROM customer
UNION ALL SELECT 'VAL-A', count(l_quantity), count(*) FILTER (WHERE l_quantity NOT BETWEEN 1 AND 45), 0.0 FROM lineitem
UNION ALL SELECT 'VAL-B', a.n + b.n, a.f + b.f, 0.5 FROM (SELECT count(o_orderstatus) AS n, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS f FROM orders) a, (SELECT count(l_returnflag) AS n, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) AS f FROM lineitem) b
UNION ALL SELECT 'COH-A', count(*) FILTER (WHERE l_tax > 0), count(*) FILTER (WHERE l_tax > 0 AND l_discount > l_tax), 0.1 FROM lineitem
UNION ALL SELECT 'UNI-A', (SELECT count(*) FROM orders), count(*), 0.0 FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 20)
UNION ALL SELECT 'INT-A', (SELECT count(*) FROM customer), count(*), 0.0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
"""

_FIXED = "lines AS (SELECT *, CASE WHEN l_quantity NOT BETWEEN 1 AND 45 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN NULL ELSE l_returnflag END AS f FROM lineitem), fixed AS (SELECT *, l_tax > 0 AND l_discount > l_tax AND q IS NOT NULL AS hit FROM lines)"

SQL = {
    "snapshot_films": _LATEST + ", per AS (SELECT payload.id AS id, max(seen) AS seen FROM films GROUP BY 1) SELECT CAST(id AS BIGINT) AS id, strftime(seen AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS fetched_at FROM per",
    "message_counts": f"SELECT count(*) AS raw_rows, count(*) FILTER (WHERE {_USABLE}) AS usable_rows, count(*) - count(*) FILTER (WHERE {_USABLE}) AS rejected_rows, count(DISTINCT CASE WHEN {_USABLE} THEN movie_id END) AS films FROM raw_movies",
    "dq_results": _RESULTS + "SELECT control_id, checked AS checked_rows, found AS anomaly_rows, round(CASE WHEN checked > 0 THEN found / checked::DOUBLE END, 6) AS anomaly_rate, CASE WHEN checked > 0 THEN found / checked::DOUBLE <= t END AS passed FROM counts",
    "dq_clean_journal": f"WITH {_FIXED} SELECT 'VAL-A' AS control_id, 'l_quantity' AS column_name, 'null' AS action, count(*) AS n, count(DISTINCT l_quantity) AS n_old FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 45 UNION ALL SELECT 'VAL-B', 'l_returnflag', 'null', count(*), count(DISTINCT l_returnflag) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'COH-A', 'l_discount', 'correct', count(*), count(DISTINCT l_discount) FROM fixed WHERE hit",
    "dq_verdict_priority": _RESULTS
    + f", {_FIXED}, after AS (SELECT control_id, CASE control_id WHEN 'VAL-A' THEN 0 WHEN 'VAL-B' THEN (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')) WHEN 'COH-A' THEN found - (SELECT count(*) FROM fixed WHERE hit) ELSE found END AS found_after FROM counts), rated AS (SELECT c.*, found_after, round(found / checked::DOUBLE, 6) AS rate, CASE WHEN control_id LIKE 'VAL-B' THEN checked - (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')) WHEN control_id = 'VAL-A' THEN checked - found ELSE checked END AS checked_after, CASE control_id WHEN 'COM-A' THEN 3 WHEN 'COM-B' THEN 2 WHEN 'VAL-B' THEN 3 WHEN 'COH-A' THEN 2 ELSE 4 END AS weight FROM counts c JOIN after USING (control_id)) "
    "SELECT control_id, found AS anomalies_before, found_after AS anomalies_after, round(weight * 100 * rate, 2) AS priority, CASE WHEN checked = 0 AND checked_after = 0 THEN 'not evaluable' WHEN found = 0 AND found_after = 0 THEN 'compliant' WHEN found_after = 0 THEN 'fixed' WHEN control_id LIKE 'COM%' OR found_after / checked_after::DOUBLE <= t THEN 'accepted' ELSE 'to do' END AS verdict FROM rated",
    "constraint_check": "SELECT 'orders.o_orderkey primary key' AS name, count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1 OR o_orderkey IS NULL) UNION ALL SELECT 'lineitem.l_orderkey+l_linenumber primary key', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL) UNION ALL SELECT 'orders.o_custkey foreign key', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'orders.o_totalprice not null', count(*) FROM orders WHERE o_totalprice IS NULL UNION ALL SELECT 'customer.c_name unique', count(*) FROM (SELECT c_name FROM customer WHERE c_name IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'lineitem.l_tax check l_tax < 0.08', count(*) FROM lineitem WHERE NOT (l_tax < 0.08)",
    "metric_latest": "SELECT type, round(value, 4) AS value FROM (SELECT event_type AS type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC NULLS LAST) AS rn FROM events WHERE event_id IS NOT NULL AND coalesce(event_type, '') <> 'view') WHERE rn = 1",
    "metric_increase": "WITH s AS (SELECT event_type AS type, ts, max(value) AS value FROM events WHERE event_id IS NOT NULL AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY 1, 2), d AS (SELECT type, value, value - lag(value) OVER (PARTITION BY type ORDER BY ts) AS step FROM s) SELECT type, round(coalesce(sum(CASE WHEN step < 0 THEN value ELSE step END), 0), 2) AS increase, round(coalesce(sum(CASE WHEN step < 0 THEN value ELSE step END), 0) / 604800, 6) AS rate FROM d GROUP BY 1",
    "stream_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}

# The mart's tables in SQL, from the last usable state of each film.
_LISTS = {
    "genres": ("payload.genres", "e.id", "nullif(trim(e.name), '')"),
    "production_companies": ("payload.production_companies", "e.id", "nullif(trim(e.name), '')"),
    "production_countries": ("payload.production_countries", "nullif(substr(upper(trim(e.iso_3166_1)), 1, 2), '')", "true"),
    "spoken_languages": ("payload.spoken_languages", "nullif(lower(substr(trim(e.iso_639_1), 1, 2)), '')", "true"),
}
_RATED = _LINES.strip().removeprefix("WITH ") + """,
rated AS (SELECT tconst, CAST(rating AS DECIMAL(3,1)) AS imdb_rating, imdb_votes FROM (SELECT nullif(vs[1], '\\N') AS tconst, CAST(nullif(vs[2], '\\N') AS DOUBLE) AS rating, CAST(nullif(vs[3], '\\N') AS BIGINT) AS imdb_votes,
  row_number() OVER (PARTITION BY vs[1] ORDER BY ingest_date DESC NULLS LAST, line_id DESC) AS rn FROM judged JOIN raw_ratings USING (line_id) WHERE reason IS NULL AND vs[1] <> '\\N') WHERE rn = 1)"""
_BASE = _LATEST + ", " + _RATED + """,
one AS (SELECT payload, seen, row_number() OVER (PARTITION BY payload.id ORDER BY seen DESC) AS k FROM films),
m AS (SELECT *, imdb_rating IS NOT NULL AS matched, CAST(round(rating - imdb_rating, 2) AS DECIMAL(4,2)) AS gap FROM (SELECT payload.id AS id, payload, seen, imdb_rating, imdb_votes, try_cast(nullif(trim(payload.release_date), '') AS DATE) AS released,
  CASE WHEN payload.vote_count > 0 THEN CAST(payload.vote_average AS DECIMAL(4,2)) END AS rating,
  CASE WHEN payload.budget >= 1000 THEN payload.budget END AS budget, CASE WHEN payload.revenue >= 1000 THEN payload.revenue END AS revenue FROM one LEFT JOIN rated ON tconst = nullif(trim(payload.imdb_id), '') WHERE k = 1))"""
for _name, (_path, _key, _label) in _LISTS.items():
    _BASE += f", l_{_name} AS (SELECT DISTINCT id AS movie_id, {_key} AS k FROM (SELECT id, unnest({_path}) AS e FROM m) WHERE {_key} IS NOT NULL)"
    _BASE += f", r_{_name} AS (SELECT {_key} AS k, max({_label}) AS label FROM (SELECT unnest({_path}) AS e FROM m) WHERE {_key} IS NOT NULL AND {_label} IS NOT NULL GROUP BY 1)"
for _role, _group in (("cast", "character"), ("crew", "job")):
    _order = 'e."order" ASC NULLS LAST, e.credit_id' if _role == "cast" else "e.credit_id"
    _BASE += f""", c_{_role} AS (SELECT id AS movie_id, e FROM (SELECT id, unnest(payload.credits."{_role}") AS e FROM m) WHERE nullif(trim(e.credit_id), '') IS NOT NULL AND e.id IS NOT NULL)
, k_{_role} AS (SELECT DISTINCT trim(credit) AS credit_id, person_id, movie_id FROM (SELECT movie_id, e.credit_id AS credit, e.id AS person_id, row_number() OVER (PARTITION BY movie_id, e.id, nullif(trim(e.{_group}), '') ORDER BY {_order}) AS rn FROM c_{_role}) WHERE rn = 1)"""
_BASE += """, p AS (SELECT id, name FROM (SELECT e.id AS id, nullif(trim(e.name), '') AS name FROM (SELECT unnest(payload.credits."cast") AS e FROM m) UNION ALL SELECT e.id, nullif(trim(e.name), '') FROM (SELECT unnest(payload.credits.crew) AS e FROM m)) WHERE id IS NOT NULL AND name IS NOT NULL)"""

_COUNTS = {
    "genres": "SELECT count(*) FROM r_genres",
    "collections": "SELECT count(DISTINCT payload.belongs_to_collection.id) FROM m WHERE nullif(trim(payload.belongs_to_collection.name), '') IS NOT NULL",
    "production_companies": "SELECT count(*) FROM r_production_companies",
    "countries": "SELECT count(DISTINCT k) FROM l_production_countries",
    "languages": "SELECT count(DISTINCT k) FROM l_spoken_languages",
    "people": "SELECT count(DISTINCT id) FROM p",
    "movies": "SELECT count(*) FROM m",
    "movie_genres": "SELECT count(*) FROM l_genres",
    "movie_production_companies": "SELECT count(*) FROM l_production_companies",
    "movie_production_countries": "SELECT count(*) FROM l_production_countries",
    "movie_spoken_languages": "SELECT count(*) FROM l_spoken_languages",
    "movie_cast": "SELECT count(DISTINCT credit_id) FROM k_cast",
    "movie_crew": "SELECT count(DISTINCT credit_id) FROM k_crew",
    "movies_with_imdb": "SELECT count(*) FROM m WHERE matched",
}
_CARDINALITY = {"movie_genres": "l_genres", "movie_production_companies": "l_production_companies", "movie_production_countries": "l_production_countries", "movie_spoken_languages": "l_spoken_languages", "movie_cast": "k_cast", "movie_crew": "k_crew"}

SQL |= {
    "mart_counts": _BASE + " " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, ({q}) AS n_rows" for t, q in _COUNTS.items()),
    # what no film refers to is dropped: all references of the snapshot are referred to
    "mart_reload": _BASE + " " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, ({q}) AS n_rows" for t, q in _COUNTS.items()),
    "mart_yearly": _BASE + " SELECT CAST(year(released) AS INTEGER) AS release_year, count(*) AS movies, CAST(round(CAST(avg(rating) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_tmdb_rating, CAST(round(CAST(avg(imdb_rating) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_imdb_rating, CAST(sum(revenue) AS BIGINT) AS total_revenue, CAST(sum(budget) AS BIGINT) AS total_budget FROM m WHERE released IS NOT NULL GROUP BY 1",
    "mart_genre_stats": _BASE + " SELECT label AS genre, count(*) AS movies, CAST(round(CAST(avg(rating) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_tmdb_rating, CAST(round(CAST(avg(imdb_rating) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_imdb_rating, CAST(round(CAST(avg(gap) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_rating_gap, count(*) FILTER (WHERE matched) AS with_imdb FROM l_genres JOIN m ON movie_id = id JOIN r_genres USING (k) GROUP BY 1",
    "film_matches": _BASE + " SELECT CAST(id AS BIGINT) AS id, CAST(imdb_rating AS DOUBLE) AS imdb_rating, imdb_votes, matched AS has_imdb_match, CAST(gap AS DOUBLE) AS rating_gap, CAST(CAST(round(payload.vote_count / nullif(imdb_votes, 0)::DOUBLE, 4) AS DECIMAL(10,4)) AS DOUBLE) AS votes_ratio FROM m",
    "mart_people": _BASE + " SELECT CAST(id AS BIGINT) AS id, name, CAST(gender AS BIGINT) AS gender, CAST(TRY_CAST(popularity AS DECIMAL(10,3)) AS DOUBLE) AS popularity FROM (SELECT e.id AS id, nullif(trim(e.name), '') AS name, CASE WHEN e.gender IN (1, 2, 3) THEN e.gender END AS gender, e.popularity AS popularity, row_number() OVER (PARTITION BY e.id ORDER BY seen DESC NULLS LAST, e.popularity DESC NULLS LAST, nullif(trim(e.name), ''), e.gender IS NULL) AS rn FROM (SELECT seen, unnest(payload.credits.\"cast\") AS e FROM m UNION ALL SELECT seen, struct_pack(id := c.id, credit_id := c.credit_id, name := c.name, original_name := c.original_name, gender := c.gender, known_for_department := c.known_for_department, popularity := c.popularity, profile_path := c.profile_path, character := NULL, \"order\" := NULL) FROM (SELECT seen, unnest(payload.credits.crew) AS c FROM m)) WHERE e.id IS NOT NULL AND nullif(trim(e.name), '') IS NOT NULL) WHERE rn = 1",
    "mart_credits": _BASE + " SELECT trim(e.credit_id) AS credit_id, CAST(movie_id AS BIGINT) AS movie_id, CAST(e.id AS BIGINT) AS person_id, part FROM (SELECT movie_id, e, nullif(trim(e.character), '') AS part, row_number() OVER (PARTITION BY movie_id, e.id, nullif(trim(e.character), '') ORDER BY e.\"order\" ASC NULLS LAST, e.credit_id) AS rn FROM c_cast) WHERE rn = 1 UNION ALL SELECT trim(e.credit_id), CAST(movie_id AS BIGINT), CAST(e.id AS BIGINT), part FROM (SELECT movie_id, e, nullif(trim(e.job), '') AS part, row_number() OVER (PARTITION BY movie_id, e.id, nullif(trim(e.job), '') ORDER BY e.credit_id) AS rn FROM c_crew) WHERE rn = 1",
    "mart_top_people": _BASE + ", people AS (SELECT id, max(name) AS name FROM p GROUP BY 1) SELECT id, name, movies FROM (SELECT k.person_id AS id, min(q.name) AS name, count(DISTINCT k.movie_id) AS movies FROM k_cast k JOIN people q ON q.id = k.person_id GROUP BY 1) ORDER BY movies DESC, name, id LIMIT 15",
    "mart_cardinalities": _BASE + " " + " UNION ALL ".join(f"SELECT '{t}' AS relation, min(n) AS least, round(avg(n), 2) AS mean, max(n) AS most FROM (SELECT id, count(movie_id) AS n FROM m LEFT JOIN {v} ON id = movie_id GROUP BY 1)" for t, v in _CARDINALITY.items()),
}
