"""Queries of the data-processing problems 1 to 4, 6 and 7, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.operators import nested, profile, redelivery, rejects, snapshots, unpack
from reelmill.session import scratch_table

RELATIONS = [
    nested.Relation("genre", "payload.genres", "id", ("id", "name")),
    nested.Relation("company", "payload.production_companies", "id", ("id", "name", "origin_country", "logo_path")),
    nested.Relation("country", "payload.production_countries", "iso_3166_1", ("iso_3166_1", "name")),
    nested.Relation("language", "payload.spoken_languages", "iso_639_1", ("iso_639_1", "name", "english_name")),
    nested.Relation("collection", "payload.belongs_to_collection", "id", ("id", "name", "poster_path", "backdrop_path")),
    nested.Relation("cast", "payload.credits.cast", "credit_id", ("credit_id", "id", "name", "character", "order")),
    nested.Relation("crew", "payload.credits.crew", "credit_id", ("credit_id", "id", "name", "department", "job")),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.link_table(table(spark, sf_dir, "raw_movies"), RELATIONS, "movie_id")


def p1_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of cast credits, every delivery of every state."""
    flat = nested.flat_table(table(spark, sf_dir, "raw_movies"), RELATIONS[5], "movie_id")
    return flat.select("movie_id", F.col("cast_index").cast("bigint").alias("cast_index"), "credit_id", F.col("id").cast("bigint").alias("person_id"), "character", F.col("order").cast("bigint").alias("cast_order"))


def p1_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = nested.flat_table(table(spark, sf_dir, "raw_movies"), RELATIONS[1], "movie_id")
    return flat.select("movie_id", F.col("production_companies_index").cast("bigint").alias("company_index"), F.col("id").cast("bigint").alias("company_id"), "name", "origin_country")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivery.redelivered(table(spark, sf_dir, "raw_movies"))


SNAPSHOT_TIMES = ("source_fetched_at", "loaded_at")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changes(table(spark, sf_dir, "movie_snapshots"), "movie_id", "ingest_date", SNAPSHOT_TIMES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _changes(spark, sf_dir)
    return found.select(F.col("k").cast("bigint").alias("movie_id"), F.date_format("s", "yyyy-MM-dd").alias("ingest_date"), "change")


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new values of the columns that changed."""
    df = table(spark, sf_dir, "movie_snapshots")
    compared = [c for c in df.columns if c not in ("movie_id", "ingest_date", *SNAPSHOT_TIMES)]
    cells = snapshots.fetch_old_values(df, _changes(spark, sf_dir), "movie_id", "ingest_date", compared)
    return cells.select(F.col("k").cast("bigint").alias("movie_id"), F.date_format("s", "yyyy-MM-dd").alias("ingest_date"), "column_name", "old_value", "new_value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.departures(table(spark, sf_dir, "avant_apres"), "ingest_date", ("run_id",))
    return found.select(F.date_format("load", "yyyy-MM-dd").alias("ingest_date"), "column_name").distinct()


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.profile(table(spark, sf_dir, "avant_apres"), "ingest_date")
    return out.select(F.date_format("load", "yyyy-MM-dd").alias("ingest_date"), "column_name", "n_rows", "n_null", "n_distinct", "top_count", "n_negative", "n_forms")


RULES = [
    profile.Constraint("control number", "control_id", "control_id rlike '^[A-Z]{3}-[0-9]{2}$'"),
    profile.Constraint("severity", "severity", "severity in ('critical', 'major', 'minor', 'info')"),
    profile.Constraint("threshold is a share", "threshold", "threshold between 0 and 1"),
    profile.Constraint("anomalies are checked rows", "anomalies_before", "anomalies_before between 0 and checked_before"),
    profile.Constraint("percentage", "pct_before", "pct_before between 0 and 100"),
    profile.Constraint("filled", "verdict", "verdict is not null and trim(verdict) <> ''"),
]


def p4_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a declared rule, per load; counted in the scan that makes the state."""
    held = profile.sketches(table(spark, sf_dir, "avant_apres"), "ingest_date", sorted({r.column for r in RULES}), RULES)
    out = profile.broken_constraints(held)
    return out.select(F.date_format("load", "yyyy-MM-dd").alias("ingest_date"), "column_name", F.col("constraint").alias("rule_name"), "checked_rows", "broken_rows")


def p4_control_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics outside the control limits of the loads before."""
    out = profile.control_limits(table(spark, sf_dir, "avant_apres"), "ingest_date", ("run_id",))
    return out.select(F.date_format("load", "yyyy-MM-dd").alias("ingest_date"), "column_name", "metric", *[F.round(c, 6).alias(c) for c in ("value", "centre", "spread")])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unpack.unpack(table(spark, sf_dir, "movies"), "id", "imdb_genres")
    return found.select(F.col("owner").cast("bigint").alias("movie_id"), "pos", "value")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(table(spark, sf_dir, "raw_ratings"))


def p7_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.loaded(table(spark, sf_dir, "raw_ratings")).select("line_id", "tconst", "averageRating", F.col("numVotes").cast("bigint").alias("numVotes"))


QUERIES = {f.__name__: f for f in (p1_found, p1_cast, p1_companies, p2_found, p3_found, p3_values, p4_found, p4_profile, p4_constraints, p4_control_limits, p6_found, p7_found, p7_loaded)}


def _links() -> str:
    parts = []
    for r in RELATIONS:
        path = ".".join(f'"{p}"' if p == "cast" else p for p in r.path.split("."))
        elements = path if r.name != "collection" else f"[{path}]"
        parts.append(f"SELECT DISTINCT movie_id, '{r.name}' AS relation, CAST(e.{r.key} AS VARCHAR) AS child_id FROM (SELECT movie_id, unnest({elements}) AS e FROM raw_movies) WHERE e.{r.key} IS NOT NULL AND CAST(e.{r.key} AS VARCHAR) <> ''")
    return " UNION ALL ".join(parts)


_SNAPSHOT_COLUMNS = ("imdb_id", "title", "original_language", "tagline", "status", "release_date", "runtime", "budget", "revenue", "popularity", "vote_average", "vote_count", "adult", "collection_id", "imdb_average_rating", "imdb_num_votes", "has_imdb_match")

_STATES = f"""
days AS (SELECT ingest_date, row_number() OVER (ORDER BY ingest_date) AS n FROM (SELECT DISTINCT ingest_date FROM movie_snapshots)),
states AS (SELECT DISTINCT movie_id, n, {", ".join(_SNAPSHOT_COLUMNS)} FROM movie_snapshots JOIN days USING (ingest_date) WHERE movie_id IS NOT NULL)
"""

_DIFFERS = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in _SNAPSHOT_COLUMNS)


def _text(c: str, side: str) -> str:
    return f"CAST({side}.{c} AS VARCHAR)"


_FORM = "regexp_replace(regexp_replace(regexp_replace({c}, '\\p{{Lu}}+', 'A', 'g'), '\\p{{Ll}}+', 'a', 'g'), '\\p{{Nd}}+', '9', 'g')"
_TEXTS = ("control_id", "dimension", "table_name", "column_name", "rule", "severity", "treatment", "verdict")
_NUMBERS = ("threshold", "checked_before", "anomalies_before", "pct_before", "checked_after", "anomalies_after", "pct_after", "priority")


def _profile_sql() -> str:
    parts = []
    for c in ("run_id", *_TEXTS, *_NUMBERS):
        negative = f"count(*) FILTER (WHERE {c} < 0)" if c in _NUMBERS else "0"
        forms = f"count(DISTINCT {_FORM.format(c=c)})" if c not in _NUMBERS else "0"
        parts.append(
            f"SELECT strftime(d.ingest_date, '%Y-%m-%d') AS ingest_date, '{c}' AS column_name, n_rows, n_null, n_distinct, top_count, n_negative, n_forms FROM "
            f"(SELECT ingest_date, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, {negative} AS n_negative, {forms} AS n_forms FROM avant_apres WHERE ingest_date IS NOT NULL GROUP BY 1) d "
            f"LEFT JOIN (SELECT ingest_date, max(n) AS top_count FROM (SELECT ingest_date, {c}, count(*) AS n FROM avant_apres WHERE {c} IS NOT NULL GROUP BY 1, 2) GROUP BY 1) t ON d.ingest_date = t.ingest_date"
        )
    return " UNION ALL ".join(parts)


def _drift_sql() -> str:
    """Shares and medians per load, compared with the load before."""
    metrics = []
    for c in (*_TEXTS, *_NUMBERS):
        metrics.append(f"SELECT ingest_date, '{c}' AS col, 'null' AS kind, '' AS item, 1 - count({c}) / count(*)::DOUBLE AS share FROM avant_apres GROUP BY 1")
        metrics.append(f"SELECT a.ingest_date, '{c}', 'value', item, n / filled::DOUBLE FROM (SELECT ingest_date, CAST({c} AS VARCHAR) AS item, count(*) AS n FROM avant_apres WHERE {c} IS NOT NULL GROUP BY 1, 2) a JOIN (SELECT ingest_date, count({c}) AS filled FROM avant_apres GROUP BY 1) b USING (ingest_date)")
        if c in _NUMBERS:
            metrics.append(f"SELECT ingest_date, '{c}', 'negative', '', count(*) FILTER (WHERE {c} < 0) / count({c})::DOUBLE FROM avant_apres GROUP BY 1 HAVING count({c}) > 0")
        else:
            metrics.append(f"SELECT a.ingest_date, '{c}', 'form', item, n / filled::DOUBLE FROM (SELECT ingest_date, {_FORM.format(c=c)} AS item, count(*) AS n FROM avant_apres WHERE {c} IS NOT NULL GROUP BY 1, 2) a JOIN (SELECT ingest_date, count({c}) AS filled FROM avant_apres GROUP BY 1) b USING (ingest_date)")
    middles = " UNION ALL ".join(f"SELECT ingest_date, '{c}' AS col, quantile_disc(abs(CAST({c} AS DOUBLE)), 0.5) AS m FROM avant_apres WHERE {c} IS NOT NULL AND {c} <> 0 AND NOT isnan(CAST({c} AS DOUBLE)) GROUP BY 1" for c in _NUMBERS)
    return f"""
WITH days AS (SELECT ingest_date, row_number() OVER (ORDER BY ingest_date) AS n FROM (SELECT DISTINCT ingest_date FROM avant_apres)),
shares AS (SELECT n, col, kind, item, share FROM ({" UNION ALL ".join(metrics)}) JOIN days USING (ingest_date)),
middles AS (SELECT n, col, m FROM ({middles}) JOIN days USING (ingest_date)),
both_ways AS (
  SELECT n, col, kind, item, share, 0.0 AS was FROM shares
  UNION ALL SELECT n + 1, col, kind, item, 0.0, share FROM shares),
moved AS (SELECT n, col FROM (SELECT n, col, kind, item, sum(share) - sum(was) AS d FROM both_ways GROUP BY 1, 2, 3, 4) WHERE abs(d) >= 0.15
  UNION SELECT a.n, a.col FROM middles a JOIN middles b ON a.col = b.col AND a.n = b.n + 1 WHERE greatest(a.m / b.m, b.m / a.m) >= 3)
SELECT DISTINCT strftime(ingest_date, '%Y-%m-%d') AS ingest_date, col AS column_name FROM moved JOIN days USING (n) WHERE n > 1"""


_LINES = """
WITH raw AS (SELECT line_id, raw_line, string_split(raw_line, chr(9)) AS fs FROM raw_ratings),
cut AS (SELECT line_id, fs, list_transform(fs, lambda f: regexp_replace(f, '^\\s+|\\s+$', '', 'g')) AS gs FROM raw),
bare AS (SELECT line_id, len(fs) AS n, gs,
  len(list_filter(gs, lambda g: contains(g, '"') AND NOT regexp_full_match(g, '"([^"]|"")*"'))) AS bad_quotes,
  list_transform(gs, lambda g: CASE WHEN regexp_full_match(g, '"([^"]|"")*"') THEN regexp_replace(replace(g[2:-2], '""', '"'), '^\\s+|\\s+$', '', 'g') ELSE g END) AS vs FROM cut),
judged AS (SELECT line_id, vs, CASE
  WHEN bad_quotes > 0 THEN 'quoting'
  WHEN n IS NULL OR n <> 3 THEN 'columns'
  WHEN vs[2] <> '\\N' AND NOT coalesce(regexp_full_match(vs[2], '[0-9]+(\\.[0-9]*)?|\\.[0-9]+') AND try_cast(vs[2] AS DOUBLE) BETWEEN 1 AND 10, false) THEN 'rating'
  WHEN vs[3] <> '\\N' AND NOT coalesce(regexp_full_match(vs[3], '[0-9]+') AND try_cast(vs[3] AS HUGEINT) <= 2147483647, false) THEN 'votes' END AS reason FROM bare)
"""

def _control_sql() -> str:
    """Each metric with mean and deviation of the loads before."""
    parts = []
    for c in (*_TEXTS, *_NUMBERS):
        parts.append(f"SELECT ingest_date, '{c}' AS column_name, 'null_share' AS metric, 1 - count({c}) / count(*)::DOUBLE AS value FROM avant_apres WHERE ingest_date IS NOT NULL GROUP BY 1")
        if c in _NUMBERS:
            parts.append(f"SELECT ingest_date, '{c}', 'negative_share', count(*) FILTER (WHERE {c} < 0) / count({c})::DOUBLE FROM avant_apres WHERE ingest_date IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE {c} < 0) > 0")
            parts.append(f"SELECT ingest_date, '{c}', 'log_median', ln(quantile_disc(abs(CAST({c} AS DOUBLE)), 0.5)) FROM avant_apres WHERE ingest_date IS NOT NULL AND {c} <> 0 AND NOT isnan(CAST({c} AS DOUBLE)) GROUP BY 1")
    return f"""
WITH m AS ({" UNION ALL ".join(parts)}),
w AS (SELECT *, count(value) OVER p AS history, avg(value) OVER p AS centre, greatest(stddev_pop(value) OVER p, 0.01) AS spread FROM m
  WINDOW p AS (PARTITION BY column_name, metric ORDER BY ingest_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT strftime(ingest_date, '%Y-%m-%d') AS ingest_date, column_name, metric, round(value, 6) AS value, round(centre, 6) AS centre, round(spread, 6) AS spread FROM w WHERE history >= 3 AND abs(value - centre) > 3 * spread"""


_RULES_SQL = {
    "control number": "NOT regexp_full_match(control_id, '[A-Z]{3}-[0-9]{2}')",
    "severity": "severity NOT IN ('critical', 'major', 'minor', 'info')",
    "threshold is a share": "threshold NOT BETWEEN 0 AND 1",
    "anomalies are checked rows": "anomalies_before NOT BETWEEN 0 AND checked_before",
    "percentage": "pct_before NOT BETWEEN 0 AND 100",
    "filled": "verdict IS NULL OR trim(verdict) = ''",
}

SQL = {
    "p4_constraints": " UNION ALL ".join(f"SELECT strftime(ingest_date, '%Y-%m-%d') AS ingest_date, '{r.column}' AS column_name, '{r.name}' AS rule_name, count(*) AS checked_rows, count(*) FILTER (WHERE {_RULES_SQL[r.name]}) AS broken_rows FROM avant_apres WHERE ingest_date IS NOT NULL GROUP BY 1" for r in RULES),
    "p4_control_limits": _control_sql(),
    "p1_found": _links(),
    "p1_cast": "SELECT movie_id, CAST(i - 1 AS BIGINT) AS cast_index, e.credit_id AS credit_id, CAST(e.id AS BIGINT) AS person_id, e.character AS character, CAST(e.\"order\" AS BIGINT) AS cast_order FROM (SELECT movie_id, unnest(payload.credits.\"cast\") AS e, generate_subscripts(payload.credits.\"cast\", 1) AS i FROM raw_movies) WHERE e IS NOT NULL",
    "p1_companies": "SELECT movie_id, CAST(i - 1 AS BIGINT) AS company_index, CAST(e.id AS BIGINT) AS company_id, e.name AS name, e.origin_country AS origin_country FROM (SELECT movie_id, unnest(payload.production_companies) AS e, generate_subscripts(payload.production_companies, 1) AS i FROM raw_movies) WHERE e IS NOT NULL",
    "p2_found": "SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY movie_id, CAST(fetched_at AS TIMESTAMPTZ) ORDER BY delivery_id) AS rn FROM raw_movies WHERE movie_id IS NOT NULL AND fetched_at IS NOT NULL) WHERE rn > 1",
    "p3_found": f"WITH {_STATES}, moved AS (SELECT coalesce(a.movie_id, b.movie_id) AS movie_id, coalesce(a.n, b.n + 1) AS n, CASE WHEN b.movie_id IS NULL THEN 'added' WHEN a.movie_id IS NULL THEN 'removed' WHEN {_DIFFERS} THEN 'changed' END AS change FROM states a FULL JOIN states b ON a.movie_id = b.movie_id AND a.n = b.n + 1) SELECT CAST(movie_id AS BIGINT) AS movie_id, strftime(ingest_date, '%Y-%m-%d') AS ingest_date, change FROM moved JOIN days USING (n) WHERE change IS NOT NULL AND n > 1",
    "p3_values": f"WITH {_STATES}, both_states AS ({' UNION ALL '.join(f'''SELECT a.movie_id, a.n, '{c}' AS column_name, {_text(c, 'b')} AS old_value, {_text(c, 'a')} AS new_value FROM states a JOIN states b ON a.movie_id = b.movie_id AND a.n = b.n + 1 WHERE a.{c} IS DISTINCT FROM b.{c}''' for c in _SNAPSHOT_COLUMNS)}) SELECT CAST(movie_id AS BIGINT) AS movie_id, strftime(ingest_date, '%Y-%m-%d') AS ingest_date, column_name, old_value, new_value FROM both_states JOIN days USING (n)",
    "p4_found": _drift_sql(),
    "p4_profile": _profile_sql(),
    "p7_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p7_loaded": _LINES + "SELECT line_id, nullif(vs[1], '\\N') AS tconst, CAST(nullif(vs[2], '\\N') AS DOUBLE) AS \"averageRating\", CAST(nullif(vs[3], '\\N') AS BIGINT) AS \"numVotes\" FROM judged WHERE reason IS NULL",
}
