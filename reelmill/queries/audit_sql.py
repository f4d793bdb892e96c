"""The SQL of the audit queries: the mart of the test tables, its controls, its cleaning and its reports, written apart from the operators."""

from __future__ import annotations

from reelmill.plans.panels import PANELS, Term

# Text columns of the mart's tables.
_TEXT = {
    "genres": ["name"],
    "collections": ["name", "poster_path", "backdrop_path"],
    "production_companies": ["name", "origin_country", "logo_path"],
    "countries": ["iso_3166_1", "name"],
    "languages": ["iso_639_1", "name", "english_name"],
    "people": ["name", "original_name", "known_for_department", "profile_path"],
    "movies": ["imdb_id", "title", "original_title", "original_language", "overview", "tagline", "status", "homepage", "poster_path", "backdrop_path"],
    "movie_genres": [],
    "movie_production_companies": [],
    "movie_production_countries": ["country_id"],
    "movie_spoken_languages": ["language_id"],
    "movie_cast": ["credit_id", "character"],
    "movie_crew": ["credit_id", "department", "job"],
}
_LINKS = {
    "movie_genres": (("movie_id", "genre_id"), ("genre_id", "genres", "id")),
    "movie_production_companies": (("movie_id", "company_id"), ("company_id", "production_companies", "id")),
    "movie_production_countries": (("movie_id", "country_id"), ("country_id", "countries", "iso_3166_1")),
    "movie_spoken_languages": (("movie_id", "language_id"), ("language_id", "languages", "iso_639_1")),
    "movie_cast": (("credit_id",), ("person_id", "people", "id")),
    "movie_crew": (("credit_id",), ("person_id", "people", "id")),
}
_STATUS = "('Rumored', 'Planned', 'In Production', 'Post Production', 'Released', 'Canceled')"
_DEPARTMENTS = "'Acting', 'Directing', 'Writing', 'Production', 'Camera', 'Editing', 'Sound', 'Art', 'Costume & Make-Up', 'Visual Effects', 'Lighting', 'Crew'"
_KEY, _SITE, _IMAGE = "tt[0-9]{7,}", r"https?://\S+", r"/[A-Za-z0-9_-]+\.(jpg|jpeg|png|svg)"
_TODAY, _LATEST = "DATE '2026-09-20'", "DATE '2031-09-20'"
_GAP = "CAST(round(vote_average - imdb_average_rating, 2) AS DECIMAL(4,2))"
_RATIO = "CAST(round(vote_count / nullif(imdb_num_votes, 0)::DOUBLE, 4) AS DECIMAL(10,4))"


def _links(p: str, source: str) -> list[str]:
    lists = {"movie_genres": ("genres", "id"), "movie_production_companies": ("production_companies", "id"), "movie_production_countries": ("production_countries", "iso_3166_1"), "movie_spoken_languages": ("spoken_languages", "iso_639_1")}
    out = [f"{p}{t} AS (SELECT DISTINCT movie_id, e.{k} AS {_LINKS[t][0][1]} FROM (SELECT movie_id, unnest(payload.{path}) AS e FROM {source}) WHERE e.{k} IS NOT NULL)" for t, (path, k) in lists.items()]
    for t, role, rest in (("movie_cast", "cast", 'min(e.character) AS character, min(e."order") AS cast_order'), ("movie_crew", "crew", "min(e.department) AS department, min(e.job) AS job")):
        out.append(f"{p}{t} AS (SELECT e.credit_id AS credit_id, min(movie_id) AS movie_id, min(e.id) AS person_id, {rest} FROM (SELECT movie_id, unnest(payload.credits.\"{role}\") AS e FROM {source}) WHERE e.credit_id IS NOT NULL AND e.credit_id <> '' GROUP BY 1)")
    return out


def _dirty() -> list[str]:
    ref = lambda t, path, k, cs: f"d_{t} AS (SELECT e.{k} AS {k}, {', '.join(f'min(e.{c}) AS {c}' for c in cs)} FROM (SELECT unnest(payload.{path}) AS e FROM every_message) WHERE e.{k} IS NOT NULL GROUP BY 1)"
    return [
        "every_message AS (SELECT CAST(movie_id AS INTEGER) AS movie_id, payload, ingest_date FROM raw_movies WHERE payload IS NOT NULL)",
        "last_load AS (SELECT CAST(movie_id AS INTEGER) AS movie_id, payload FROM raw_movies WHERE ingest_date = (SELECT max(ingest_date) FROM raw_movies))",
        "last_messages AS (SELECT * FROM last_load WHERE payload IS NOT NULL)",
        "d_movies AS (SELECT * FROM movies)",
        "d_genres AS (SELECT * FROM genres)",
        "d_people AS (SELECT id, name, original_name, gender, known_for_department, TRY_CAST(popularity AS DECIMAL(10,3)) AS popularity, profile_path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY record_id) AS rn FROM people_records WHERE id IS NOT NULL) WHERE rn = 1)",
        "d_collections AS (SELECT e.id AS id, min(e.name) AS name, min(e.poster_path) AS poster_path, min(e.backdrop_path) AS backdrop_path FROM (SELECT payload.belongs_to_collection AS e FROM every_message) WHERE e.id IS NOT NULL GROUP BY 1)",
        ref("production_companies", "production_companies", "id", ("name", "origin_country", "logo_path")),
        ref("countries", "production_countries", "iso_3166_1", ("name",)),
        ref("languages", "spoken_languages", "iso_639_1", ("name", "english_name")),
        *_links("d_", "every_message"),
        "s_movies AS (SELECT * FROM movies WHERE id IN (SELECT movie_id FROM last_load))",
        *_links("s_", "last_messages"),
    ]


def _full(c: str, pattern: str) -> str:
    return f"regexp_full_match({c}, '{pattern}')"


def _controls(p: str) -> dict[str, tuple[str, str]]:
    """Control -> (population, anomalies) over the tables with prefix ``p``."""
    m = f"{p}movies"
    n = lambda t, where="true": f"(SELECT count(*) FROM {p}{t} WHERE {where})"
    one = lambda anomaly, population="true": (n("movies", population), n("movies", f"({population}) AND ({anomaly})"))
    column = lambda *parts: (" + ".join(n(t, f"{c} IS NOT NULL") for t, c, _ in parts), " + ".join(n(t, a) for t, _, a in parts))
    without = lambda link, where="true": (n("movies"), f"(SELECT count(*) FROM {m} m WHERE NOT EXISTS (SELECT 1 FROM {p}{link} l WHERE l.movie_id = m.id AND {where}))")
    groups = lambda t, by, where: f"(SELECT count(*) FROM (SELECT 1 FROM {p}{t} WHERE {where} GROUP BY {by} HAVING count(*) > 1))"
    ranked = lambda t, by, order: f"(SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {p}{t}) WHERE rn > 1)"
    total = lambda *ts: " + ".join(n(t) for t in ts)
    orphan = lambda t, k, *users: f"(SELECT count(*) FROM {p}{t} r WHERE " + " AND ".join(f"NOT EXISTS (SELECT 1 FROM {p}{u} u WHERE u.{c} = r.{k})" for u, c in users) + ")"
    broken = " + ".join(f"(SELECT count(*) FROM {p}{t} l WHERE NOT EXISTS (SELECT 1 FROM {m} x WHERE x.id = l.movie_id) OR NOT EXISTS (SELECT 1 FROM {p}{parent} x WHERE x.{k} = l.{c}))" for t, (_, (c, parent, k)) in _LINKS.items())
    stale = " + ".join(f"(SELECT count(*) FROM {p}{t} l WHERE movie_id IN (SELECT id FROM s_movies) AND NOT EXISTS (SELECT 1 FROM s_{t} s WHERE {' AND '.join(f's.{k} = l.{k}' for k in keys)}))" for t, (keys, _) in _LINKS.items())
    bad = lambda c, pattern: f"NOT {_full(c, pattern)}"
    images = [("movies", "poster_path"), ("movies", "backdrop_path"), ("collections", "poster_path"), ("collections", "backdrop_path"), ("people", "profile_path"), ("production_companies", "logo_path")]
    return {
        "COM-01": one("imdb_id IS NULL"), "COM-02": one("release_date IS NULL"), "COM-03": one("runtime IS NULL"), "COM-04": one("overview IS NULL"), "COM-05": one("budget IS NULL OR revenue IS NULL"),
        "COM-06": without("movie_genres"), "COM-07": without("movie_cast"), "COM-08": without("movie_crew", "job = 'Director'"),
        "COM-09": (n("people"), n("people", "gender IS NULL OR gender = 0")), "COM-10": (n("production_companies"), n("production_companies", "origin_country IS NULL OR trim(origin_country) = ''")),
        "COM-11": one("imdb_average_rating IS NULL", "imdb_id IS NOT NULL"),
        "UNI-01": (n("movies"), groups("movies", "id", "true")), "UNI-02": (n("movies", "imdb_id IS NOT NULL"), groups("movies", "imdb_id", "imdb_id IS NOT NULL")),
        "UNI-03": (n("movies", "release_date IS NOT NULL"), groups("movies", "lower(trim(coalesce(original_title, title))), year(release_date)", "release_date IS NOT NULL")),
        "UNI-04": (n("movie_cast"), ranked("movie_cast", "movie_id, person_id, character", "cast_order NULLS LAST, credit_id")), "UNI-05": (n("movie_crew"), ranked("movie_crew", "movie_id, person_id, job", "credit_id")),
        "UNI-06": (total("genres", "collections", "production_companies"), " + ".join(groups(t, "lower(trim(name))", "true") for t in ("genres", "collections", "production_companies"))),
        "VAL-01": column(("movies", "imdb_id", bad("imdb_id", _KEY))), "VAL-02": column(("movies", "vote_average", "vote_average NOT BETWEEN 0 AND 10")), "VAL-03": column(("movies", "imdb_average_rating", "imdb_average_rating NOT BETWEEN 1 AND 10")),
        "VAL-04": one("coalesce(vote_count, 0) < 0 OR coalesce(imdb_num_votes, 0) < 0"), "VAL-05": column(("movies", "runtime", "runtime NOT BETWEEN 1 AND 600")),
        "VAL-06": column(("movies", "release_date", f"release_date NOT BETWEEN DATE '1888-01-01' AND {_LATEST}")), "VAL-07": column(("movies", "status", f"status NOT IN {_STATUS}")),
        "VAL-08": column(*[(t, c, bad(c, "[a-z]{2}")) for t, c in (("movies", "original_language"), ("languages", "iso_639_1"), ("movie_spoken_languages", "language_id"))]),
        "VAL-09": column(*[(t, c, bad(c, "[A-Z]{2}")) for t, c in (("production_companies", "origin_country"), ("countries", "iso_3166_1"), ("movie_production_countries", "country_id"))]),
        "VAL-10": one("coalesce(budget, 1000) < 1000 OR coalesce(revenue, 1000) < 1000", "budget IS NOT NULL OR revenue IS NOT NULL"),
        "VAL-11": column(("movies", "homepage", bad("homepage", _SITE))), "VAL-12": column(*[(t, c, bad(c, _IMAGE)) for t, c in images]),
        "VAL-13": column(("people", "gender", "gender NOT IN (1, 2, 3)")), "VAL-14": column(("movies", "popularity", "popularity < 0"), ("people", "popularity", "popularity < 0"), ("movie_cast", "cast_order", "cast_order < 0")),
        "VAL-15": column(("movie_crew", "department", f"department NOT IN ({_DEPARTMENTS})"), ("people", "known_for_department", f"known_for_department NOT IN ({_DEPARTMENTS}, 'Creator')")),
        "VAL-16": column(*[(t, c, f"trim({c}) = '' OR {c} <> trim({c})") for t, cs in _TEXT.items() for c in cs]),
        "COH-01": one("coalesce(vote_count, 0) = 0 AND vote_average IS NOT NULL"), "COH-02": one("has_imdb_match <> (imdb_average_rating IS NOT NULL) OR (has_imdb_match AND imdb_id IS NULL)"),
        "COH-03": one(f"rating_gap IS DISTINCT FROM {_GAP}"), "COH-04": one(f"votes_ratio IS DISTINCT FROM {_RATIO}"), "COH-05": one(f"release_date > {_TODAY}", "status = 'Released'"), "COH-06": one("revenue IS NOT NULL", "status <> 'Released'"),
        "COH-07": one("abs(runtime - imdb_runtime_minutes) > 30", "runtime IS NOT NULL AND imdb_runtime_minutes IS NOT NULL"), "COH-08": one("abs(year(release_date) - imdb_start_year) > 1", "release_date IS NOT NULL AND imdb_start_year IS NOT NULL"),
        "COH-09": (" + ".join(n(t, "movie_id IN (SELECT id FROM s_movies)") for t in _LINKS), stale), "COH-10": one("source_fetched_at > loaded_at OR ingest_date < CAST(source_fetched_at AS DATE)"),
        "INT-01": (total(*_LINKS), broken), "INT-02": (n("movies", "collection_id IS NOT NULL"), n("movies", f"collection_id IS NOT NULL AND collection_id NOT IN (SELECT id FROM {p}collections)")),
        "INT-03": (total("genres", "collections", "production_companies", "countries", "languages"), " + ".join((orphan("genres", "id", ("movie_genres", "genre_id")), orphan("collections", "id", ("movies", "collection_id")), orphan("production_companies", "id", ("movie_production_companies", "company_id")), orphan("countries", "iso_3166_1", ("movie_production_countries", "country_id")), orphan("languages", "iso_639_1", ("movie_spoken_languages", "language_id"))))),
        "INT-04": (n("people"), orphan("people", "id", ("movie_cast", "person_id"), ("movie_crew", "person_id"))),
        "INT-05": (n("movies", "original_language IS NOT NULL"), f"(SELECT count(*) FROM {m} m WHERE original_language IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p}languages x WHERE x.iso_639_1 = m.original_language))"),
        "INT-06": (n("production_companies", "trim(origin_country) <> ''"), f"(SELECT count(*) FROM {p}production_companies c WHERE trim(origin_country) <> '' AND NOT EXISTS (SELECT 1 FROM {p}countries x WHERE x.iso_3166_1 = c.origin_country))"),
    }


# Fixed values: (dimension, severity, threshold, treatment) of each control.
_MATRIX = {
    "COM": ("completeness", {1: ("major", 0.05, "keep"), 2: ("major", 0.05, "keep"), 3: ("minor", 0.05, "impute"), 4: ("minor", 0.10, "keep"), 5: ("info", 1, "keep"), 6: ("minor", 0.02, "keep"), 7: ("minor", 0.05, "keep"), 8: ("minor", 0.05, "keep"), 9: ("info", 1, "keep"), 10: ("info", 1, "keep"), 11: ("major", 0.05, "keep")}),
    "UNI": ("uniqueness", {1: ("critical", 0, "delete"), 2: ("critical", 0, "correct"), 3: ("major", 0, "keep"), 4: ("minor", 0, "delete"), 5: ("minor", 0, "delete"), 6: ("info", 1, "keep")}),
    "VAL": ("validity", {1: ("major", 0, "null"), 2: ("critical", 0, "null"), 3: ("critical", 0, "null"), 4: ("critical", 0, "null"), 5: ("major", 0, "null"), 6: ("major", 0, "null"), 7: ("major", 0, "null"), 8: ("minor", 0, "null"), 9: ("major", 0, "null"), 10: ("major", 0, "null"), 11: ("minor", 0, "null"), 12: ("minor", 0, "null"), 13: ("minor", 0, "null"), 14: ("minor", 0, "null"), 15: ("minor", 0, "null"), 16: ("minor", 0, "correct")}),
    "COH": ("coherence", {1: ("major", 0, "null"), 2: ("critical", 0, "correct"), 3: ("major", 0, "correct"), 4: ("minor", 0, "correct"), 5: ("major", 0, "keep"), 6: ("minor", 0, "keep"), 7: ("minor", 0.05, "keep"), 8: ("minor", 0.05, "keep"), 9: ("major", 0, "delete"), 10: ("minor", 0, "keep")}),
    "INT": ("integrity", {1: ("critical", 0, "delete"), 2: ("critical", 0, "null"), 3: ("minor", 0, "delete"), 4: ("minor", 0, "delete"), 5: ("info", 1, "keep"), 6: ("info", 1, "keep")}),
}


def _measured(p: str) -> str:
    rows = []
    for k, (population, found) in _controls(p).items():
        dimension, held = _MATRIX[k[:3]]
        severity, threshold, treatment = held[int(k[4:])]
        rows.append(f"SELECT '{k}' AS control_id, '{dimension}' AS dimension, '{severity}' AS severity, {float(threshold)}::DOUBLE AS threshold, '{treatment}' AS treatment, CAST({population} AS BIGINT) AS checked_rows, CAST({found} AS BIGINT) AS anomaly_rows")
    return " UNION ALL ".join(rows)


_MEASURE = "round(CASE WHEN checked_rows > 0 THEN anomaly_rows / checked_rows::DOUBLE END, 6) AS anomaly_rate, CASE WHEN checked_rows > 0 THEN anomaly_rows / checked_rows::DOUBLE <= threshold END AS passed"


def _t(c: str) -> str:
    return f"nullif(trim({c}), '')"


def _if(test: str, c: str) -> str:
    return f"CASE WHEN {test} THEN {c} END"


def _cleaned() -> list[str]:
    """The cleaning, stage by stage: t_ trimmed, v_ valid, c_ done."""
    out = []
    for t, texts in _TEXT.items():
        out.append(f"t_{t} AS (SELECT * REPLACE ({', '.join(f'{_t(c)} AS {c}' for c in texts)}) FROM d_{t})" if texts else f"t_{t} AS (SELECT * FROM d_{t})")
    image = lambda c: f"{_if(_full(c, _IMAGE), c)} AS {c}"
    least = lambda c, n: f"{_if(f'{c} >= {n}', c)} AS {c}"
    coded = lambda c, p: f"{c} IS NULL OR {_full(c, p)}"
    out += [
        "v_genres AS (SELECT * FROM t_genres)",
        f"v_collections AS (SELECT * REPLACE ({image('poster_path')}, {image('backdrop_path')}) FROM t_collections)",
        f"v_production_companies AS (SELECT * REPLACE ({_if(_full('origin_country', '[A-Z]{2}'), 'origin_country')} AS origin_country, {image('logo_path')}) FROM t_production_companies)",
        f"v_countries AS (SELECT * FROM t_countries WHERE {coded('iso_3166_1', '[A-Z]{2}')})",
        f"v_languages AS (SELECT * FROM t_languages WHERE {coded('iso_639_1', '[a-z]{2}')})",
        f"v_people AS (SELECT * REPLACE ({_if('gender IN (1, 2, 3)', 'gender')} AS gender, {least('popularity', 0)}, {_if(f'known_for_department IN ({_DEPARTMENTS}, {chr(39)}Creator{chr(39)})', 'known_for_department')} AS known_for_department, {image('profile_path')}) FROM t_people)",
        "v_movie_genres AS (SELECT * FROM t_movie_genres)",
        "v_movie_production_companies AS (SELECT * FROM t_movie_production_companies)",
        f"v_movie_production_countries AS (SELECT * FROM t_movie_production_countries WHERE {coded('country_id', '[A-Z]{2}')})",
        f"v_movie_spoken_languages AS (SELECT * FROM t_movie_spoken_languages WHERE {coded('language_id', '[a-z]{2}')})",
        f"v_movie_cast AS (SELECT * REPLACE ({least('cast_order', 0)}) FROM t_movie_cast)",
        f"v_movie_crew AS (SELECT * REPLACE ({_if(f'department IN ({_DEPARTMENTS})', 'department')} AS department) FROM t_movie_crew)",
        f"v_movies AS (SELECT * REPLACE ({_if(_full('imdb_id', _KEY), 'imdb_id')} AS imdb_id, {_if('vote_average BETWEEN 0 AND 10', 'vote_average')} AS vote_average, {_if('imdb_average_rating BETWEEN 1 AND 10', 'imdb_average_rating')} AS imdb_average_rating, {least('vote_count', 0)}, {least('imdb_num_votes', 0)}, "
        f"{_if('runtime BETWEEN 1 AND 600', 'runtime')} AS runtime, {_if(f'release_date BETWEEN DATE {chr(39)}1888-01-01{chr(39)} AND {_LATEST}', 'release_date')} AS release_date, {_if(f'status IN {_STATUS}', 'status')} AS status, {_if(_full('original_language', '[a-z]{2}'), 'original_language')} AS original_language, "
        f"{least('budget', 1000)}, {least('revenue', 1000)}, {_if(_full('homepage', _SITE), 'homepage')} AS homepage, {image('poster_path')}, {image('backdrop_path')}, {least('popularity', 0)}) FROM t_movies)",
        "m1 AS (SELECT * REPLACE (CASE WHEN coalesce(vote_count, 0) > 0 THEN vote_average END AS vote_average) FROM v_movies)",
        "m2 AS (SELECT * REPLACE (CASE WHEN row_number() OVER (PARTITION BY imdb_id ORDER BY coalesce(vote_count, 0) DESC, id DESC) = 1 THEN imdb_id END AS imdb_id, CASE WHEN collection_id IN (SELECT id FROM v_collections) THEN collection_id END AS collection_id) FROM m1)",
        "m3 AS (SELECT * REPLACE (coalesce(runtime, CASE WHEN imdb_runtime_minutes BETWEEN 1 AND 600 THEN imdb_runtime_minutes END) AS runtime) FROM m2)",
        "m4 AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN imdb_id IS NOT NULL THEN {c} END AS {c}" for c in ("imdb_average_rating", "imdb_num_votes", "imdb_start_year", "imdb_runtime_minutes", "imdb_genres")) + ") FROM m3)",
        "m5 AS (SELECT * REPLACE (CASE WHEN has_imdb_match IS NOT NULL THEN imdb_average_rating IS NOT NULL END AS has_imdb_match) FROM m4)",
        f"c_movies AS (SELECT * REPLACE ({_GAP} AS rating_gap, {_RATIO} AS votes_ratio) FROM m5)",
    ]
    for t, (keys, (c, parent, k)) in _LINKS.items():
        same = " AND ".join(f"s.{x} = l.{x}" for x in keys)
        out.append(f"k_{t} AS (SELECT * FROM v_{t} l WHERE NOT (movie_id IN (SELECT id FROM s_movies) AND NOT EXISTS (SELECT 1 FROM s_{t} s WHERE {same})))")
        kept = f"k_{t}"
        if t in ("movie_cast", "movie_crew"):
            by, order = ("character", "cast_order NULLS LAST, credit_id") if t == "movie_cast" else ("job", "credit_id")
            out.append(f"u_{t} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY movie_id, person_id, {by} ORDER BY {order}) AS rn FROM {kept}) WHERE rn = 1)")
            kept = f"u_{t}"
        out.append(f"c_{t} AS (SELECT * FROM {kept} l WHERE EXISTS (SELECT 1 FROM c_movies x WHERE x.id = l.movie_id) AND EXISTS (SELECT 1 FROM v_{parent} x WHERE x.{k} = l.{c}))")
    used = {"genres": ("id", [("movie_genres", "genre_id")]), "collections": ("id", [("movies", "collection_id")]), "production_companies": ("id", [("movie_production_companies", "company_id")]), "countries": ("iso_3166_1", [("movie_production_countries", "country_id")]), "languages": ("iso_639_1", [("movie_spoken_languages", "language_id")]), "people": ("id", [("movie_cast", "person_id"), ("movie_crew", "person_id")])}
    for t, (k, users) in used.items():
        out.append(f"c_{t} AS (SELECT * FROM v_{t} r WHERE " + " OR ".join(f"EXISTS (SELECT 1 FROM c_{u} u WHERE u.{c} = r.{k})" for u, c in users) + ")")
    return out


def _journal() -> str:
    """``(control_id, action, table_name, column_name, corrections)`` with zeros."""
    row = lambda control, action, t, c, n: f"SELECT '{control}' AS control_id, '{action}' AS action, '{t}' AS table_name, {repr(c) if c else 'CAST(NULL AS VARCHAR)'} AS column_name, CAST({n} AS BIGINT) AS corrections"
    rows = [row("VAL-16", "trim", t, c, f"(SELECT count(*) FROM d_{t} WHERE trim({c}) = '' OR {c} <> trim({c}))") for t, cs in _TEXT.items() for c in cs]
    lost = lambda a, b, t, c, k="id": f"(SELECT count({c}) FROM {a}{t}) - (SELECT count({c}) FROM {b}{t})"
    for control, t, c in (
        ("VAL-01", "movies", "imdb_id"), ("VAL-02", "movies", "vote_average"), ("VAL-03", "movies", "imdb_average_rating"), ("VAL-04", "movies", "vote_count"), ("VAL-04", "movies", "imdb_num_votes"), ("VAL-05", "movies", "runtime"), ("VAL-06", "movies", "release_date"),
        ("VAL-07", "movies", "status"), ("VAL-08", "movies", "original_language"), ("VAL-09", "production_companies", "origin_country"), ("VAL-10", "movies", "budget"), ("VAL-10", "movies", "revenue"), ("VAL-11", "movies", "homepage"), ("VAL-12", "movies", "poster_path"),
        ("VAL-12", "movies", "backdrop_path"), ("VAL-12", "collections", "poster_path"), ("VAL-12", "collections", "backdrop_path"), ("VAL-12", "people", "profile_path"), ("VAL-12", "production_companies", "logo_path"), ("VAL-13", "people", "gender"),
        ("VAL-14", "movies", "popularity"), ("VAL-14", "people", "popularity"), ("VAL-14", "movie_cast", "cast_order"), ("VAL-15", "movie_crew", "department"), ("VAL-15", "people", "known_for_department"),
    ):
        rows.append(row(control, "null", t, c, lost("t_", "v_", t, c)))
    step = lambda a, b, c: f"(SELECT count({c}) FROM {a}) - (SELECT count({c}) FROM {b})"
    rows.append(row("COH-01", "null", "movies", "vote_average", step("v_movies", "m1", "vote_average")))
    rows.append(row("UNI-02", "null", "movies", "imdb_id", step("m1", "m2", "imdb_id")))
    rows.append(row("INT-02", "null", "movies", "collection_id", step("m1", "m2", "collection_id")))
    rows.append(row("COM-03", "impute", "movies", "runtime", step("m3", "m2", "runtime")))
    rows += [row("COH-02", "null", "movies", c, step("m3", "m4", c)) for c in ("imdb_average_rating", "imdb_num_votes", "imdb_start_year", "imdb_runtime_minutes", "imdb_genres")]
    rows.append(row("COH-02", "correct", "movies", "has_imdb_match", "(SELECT count(*) FROM m4 a JOIN m5 b USING (id) WHERE a.has_imdb_match <> b.has_imdb_match)"))
    for control, c in (("COH-03", "rating_gap"), ("COH-04", "votes_ratio")):
        rows.append(row(control, "correct", "movies", c, f"(SELECT count(*) FROM m5 a JOIN c_movies b USING (id) WHERE a.{c} IS DISTINCT FROM b.{c})"))
    gone = lambda a, b: f"(SELECT count(*) FROM {a}) - (SELECT count(*) FROM {b})"
    for control, t in (("VAL-08", "languages"), ("VAL-08", "movie_spoken_languages"), ("VAL-09", "countries"), ("VAL-09", "movie_production_countries")):
        rows.append(row(control, "delete", t, None, gone(f"t_{t}", f"v_{t}")))
    for t in _LINKS:
        rows.append(row("COH-09", "delete", t, None, gone(f"v_{t}", f"k_{t}")))
        last = f"k_{t}"
        if t in ("movie_cast", "movie_crew"):
            rows.append(row("UNI-04" if t == "movie_cast" else "UNI-05", "delete", t, None, gone(last, f"u_{t}")))
            last = f"u_{t}"
        rows.append(row("INT-01", "delete", t, None, gone(last, f"c_{t}")))
    rows += [row("INT-04" if t == "people" else "INT-03", "delete", t, None, gone(f"v_{t}", f"c_{t}")) for t in ("genres", "collections", "production_companies", "countries", "languages", "people")]
    return " UNION ALL ".join(rows)


_D = "WITH " + ", ".join(_dirty())
_C = _D + ", " + ", ".join(_cleaned())
_BEFORE = f"b AS (SELECT *, {_MEASURE} FROM ({_measured('d_')}))"
_AFTER = f"a AS (SELECT *, {_MEASURE} FROM ({_measured('c_')}))"
_JUDGED = """j AS (SELECT b.control_id, b.dimension, b.severity, b.treatment, b.checked_rows AS checked_before, b.anomaly_rows AS anomalies_before, round(100 * b.anomaly_rate, 2) AS pct_before, a.checked_rows AS checked_after, a.anomaly_rows AS anomalies_after, round(100 * a.anomaly_rate, 2) AS pct_after,
round(CASE b.severity WHEN 'critical' THEN 4 WHEN 'major' THEN 3 WHEN 'minor' THEN 2 ELSE 1 END * 100 * coalesce(b.anomaly_rate, 0), 2) AS priority,
CASE WHEN b.checked_rows = 0 AND a.checked_rows = 0 THEN 'not evaluable' WHEN b.anomaly_rows = 0 AND a.anomaly_rows = 0 THEN 'compliant' WHEN a.anomaly_rows = 0 THEN 'fixed' WHEN b.treatment = 'keep' OR a.passed THEN 'accepted' ELSE 'to do' END AS verdict
FROM b JOIN a USING (control_id))"""
_SCORES = """scores AS (SELECT phase, dimension, count(passed) AS controls, count(*) FILTER (WHERE passed) AS controls_passed, CAST(sum(anomaly_rows) AS BIGINT) AS anomalies, round(100 * avg(1 - anomaly_rate), 2) AS score
FROM (SELECT 'before' AS phase, * FROM b UNION ALL SELECT 'after', * FROM a) GROUP BY GROUPING SETS ((phase, dimension), (phase)))"""
_JOURNAL = f"journal AS (SELECT * FROM ({_journal()}) WHERE corrections > 0)"
_ALL = f"{_C}, {_BEFORE}, {_AFTER}, {_JUDGED}, {_SCORES}, {_JOURNAL}"


def _kpis(p: str) -> list[str]:
    r = lambda e, n=3: f"CAST(round(CAST(avg({e}) AS DECIMAL(28,10)), {n}) AS DOUBLE)"
    return ["count(*)", "count(vote_average)", r("vote_average"), r("imdb_average_rating"), r("rating_gap"), "round(100.0 * count(*) FILTER (WHERE has_imdb_match) / count(*), 2)", "count(runtime)", "count(budget)", r("budget", 0), "count(release_date)"]


_INDICATORS = ("films", "rated films", "mean rating", "mean second rating", "mean rating gap", "match coverage (%)", "films with runtime", "films with budget", "mean budget (USD)", "dated films")
_KPI = "kpi AS (" + " UNION ALL ".join(f"SELECT {i} AS position, '{name}' AS indicator, CAST((SELECT {e} FROM d_movies) AS DOUBLE) AS mart, CAST((SELECT {e} FROM c_movies) AS DOUBLE) AS curated" for i, (name, e) in enumerate(zip(_INDICATORS, _kpis("")))) + ")"


def _genre_ratings(p: str) -> str:
    return f"SELECT g.name AS genre, count(*) AS films, CAST(round(CAST(avg(vote_average) AS DECIMAL(20,10)), 3) AS DOUBLE) AS tmdb, CAST(round(CAST(avg(rating_gap) AS DECIMAL(20,10)), 3) AS DOUBLE) AS gap FROM {p}movies m JOIN {p}movie_genres l ON l.movie_id = m.id JOIN {p}genres g ON g.id = l.genre_id GROUP BY 1"


_GENRES = f"""effect AS (SELECT x.genre, x.films AS films_mart, x.tmdb AS tmdb_mart, x.gap AS gap_mart, y.films AS films_curated, y.tmdb AS tmdb_curated, y.gap AS gap_curated, round(y.tmdb - x.tmdb, 3) AS effect
FROM ({_genre_ratings('d_')}) x LEFT JOIN ({_genre_ratings('c_')}) y USING (genre))"""
_ENRICHED = """enriched AS (SELECT m.id, m.title, year(m.release_date) AS release_year, vote_average, vote_count, imdb_average_rating, imdb_num_votes, rating_gap, has_imdb_match, c.name AS collection,
(SELECT string_agg(g.name, ', ' ORDER BY g.name) FROM d_movie_genres l JOIN d_genres g ON g.id = l.genre_id WHERE l.movie_id = m.id) AS genres,
(SELECT string_agg(name, ', ' ORDER BY name) FROM (SELECT DISTINCT p.name FROM d_movie_crew l JOIN d_people p ON p.id = l.person_id WHERE l.movie_id = m.id AND l.job = 'Director')) AS directors
FROM d_movies m LEFT JOIN d_collections c ON c.id = m.collection_id)"""
_TABLES = tuple(_TEXT)
_PEOPLE = "people_films AS (SELECT p.id, p.name, p.known_for_department, count(DISTINCT l.movie_id) AS movies, CAST(round(CAST(avg(vote_average) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_tmdb_rating, CAST(round(CAST(avg(imdb_average_rating) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_imdb_rating FROM d_movie_cast l JOIN d_people p ON p.id = l.person_id JOIN d_movies m ON m.id = l.movie_id GROUP BY ALL)"
_STATS = "stats AS (SELECT g.name AS genre, count(*) AS movies, CAST(round(CAST(avg(vote_average) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_tmdb_rating, CAST(round(CAST(avg(imdb_average_rating) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_imdb_rating, CAST(round(CAST(avg(rating_gap) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_rating_gap, count(*) FILTER (WHERE has_imdb_match) AS with_imdb FROM d_movies m JOIN d_movie_genres l ON l.movie_id = m.id JOIN d_genres g ON g.id = l.genre_id GROUP BY 1)"
_RUNS = "days AS (SELECT ingest_date, count(*) AS n, count(DISTINCT movie_id) AS films, count(payload) AS usable FROM raw_movies GROUP BY 1), runs AS (SELECT job || '-' || CAST(ingest_date AS VARCHAR) AS run_id, job, ingest_date, n, films, usable, ingest_date + h * INTERVAL 1 HOUR AS started FROM days, (VALUES ('aggregate', 1), ('load', 2), ('quality', 3)) AS jobs(job, h))"
_LAST_RUNS = "last_runs AS (SELECT *, date_diff('second', started + INTERVAL 90 SECOND, TIMESTAMP '2026-04-01 00:00:00') AS age FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY started DESC) AS rn FROM runs) WHERE rn = 1)"


def _fill(t: str, columns: list[tuple[str, bool]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS filled, count(*) FILTER (WHERE {c + chr(32) + '=' + chr(32) + chr(39) * 2 if text else 'false'}) AS blank, round(100.0 * (count({c}) - count(*) FILTER (WHERE {c + chr(32) + '=' + chr(32) + chr(39) * 2 if text else 'false'})) / count(*), 1) AS useful_pct FROM d_{t}" for c, text in columns)


# Columns of two tables, and whether they are text.
_FILMS = [(c, c in _TEXT["movies"] or c == "imdb_genres") for c in "id imdb_id title original_title original_language overview tagline status release_date runtime budget revenue popularity vote_average vote_count adult homepage poster_path backdrop_path collection_id imdb_average_rating imdb_num_votes imdb_start_year imdb_runtime_minutes imdb_genres has_imdb_match rating_gap votes_ratio source_fetched_at ingest_date loaded_at".split()]
_PERSONS = [(c, c in _TEXT["people"]) for c in "id name original_name gender known_for_department popularity profile_path".split()]
_COLUMNS = {
    "genres": "id name", "collections": "id name poster_path backdrop_path", "production_companies": "id name origin_country logo_path", "countries": "iso_3166_1 name", "languages": "iso_639_1 name english_name",
    "people": " ".join(c for c, _ in _PERSONS), "movies": " ".join(c for c, _ in _FILMS), "movie_genres": "movie_id genre_id", "movie_production_companies": "movie_id company_id", "movie_production_countries": "movie_id country_id",
    "movie_spoken_languages": "movie_id language_id", "movie_cast": "credit_id movie_id person_id character cast_order", "movie_crew": "credit_id movie_id person_id department job",
}
_MEASURES = {"runtime (min)": "runtime", "vote_average": "vote_average", "vote_count": "vote_count", "imdb_average_rating": "imdb_average_rating", "budget (USD)": "budget", "revenue (USD)": "revenue", "release_date (year)": "year(release_date)"}
_CARDS = {"movie_genres": "genre_id", "movie_production_companies": "company_id", "movie_production_countries": "country_id", "movie_spoken_languages": "language_id", "movie_cast": "credit_id", "movie_crew": "credit_id"}
_PARENTS = ["movies -> collections", "movie_genres -> movies", "movie_genres -> genres", "movie_production_companies -> movies", "movie_production_companies -> production_companies", "movie_production_countries -> movies", "movie_production_countries -> countries", "movie_spoken_languages -> movies", "movie_spoken_languages -> languages", "movie_cast -> movies", "movie_cast -> people", "movie_crew -> movies", "movie_crew -> people"]


def _evidence() -> str:
    key = {"genres": "id", "collections": "id", "production_companies": "id", "people": "id", "movies": "id", "countries": "iso_3166_1", "languages": "iso_639_1", "movie_cast": "credit_id", "movie_crew": "credit_id"}
    rows = []
    images = [("movies", "poster_path"), ("movies", "backdrop_path"), ("collections", "poster_path"), ("collections", "backdrop_path"), ("people", "profile_path"), ("production_companies", "logo_path")]
    targets = [("VAL-01", "movies", "imdb_id", f"NOT {_full('imdb_id', _KEY)}")] + [("VAL-12", t, c, f"NOT {_full(c, _IMAGE)}") for t, c in images]
    targets += [("VAL-15", "movie_crew", "department", f"department NOT IN ({_DEPARTMENTS})"), ("VAL-15", "people", "known_for_department", f"known_for_department NOT IN ({_DEPARTMENTS}, 'Creator')")]
    targets += [("VAL-16", t, c, f"trim({c}) = '' OR {c} <> trim({c})") for t, cs in _TEXT.items() for c in cs]
    for control, t, c, bad in targets:
        k = f"CAST({key[t]} AS VARCHAR)" if t in key else f"concat_ws('-', {', '.join(f'CAST({x} AS VARCHAR)' for x in _LINKS[t][0])})"
        rows.append(f"SELECT '{control}' AS control_id, '{t}' AS table_name, {k} AS record_key, '{c} = ' || {c} AS observed_value FROM d_{t} WHERE {bad}")
    return " UNION ALL ".join(rows)


def _constraints() -> str:
    """``(kind, table_name, constraints, violations)`` of the mart before cleaning."""
    rows = []
    add = lambda kind, t, n: rows.append(f"SELECT '{kind}' AS kind, '{t}' AS table_name, {n} AS violations")
    for t, keys in {**{t: ("id",) for t in ("genres", "collections", "production_companies", "people", "movies")}, "countries": ("iso_3166_1",), "languages": ("iso_639_1",), **{t: keys for t, (keys, _) in _LINKS.items()}}.items():
        add("primary key", t, f"(SELECT count(*) FROM (SELECT {', '.join(keys)} FROM d_{t} GROUP BY ALL HAVING count(*) > 1 OR {' OR '.join(f'any_value({k}) IS NULL' for k in keys)}))")
    fk = lambda t, c, parent, k: add("foreign key", t, f"(SELECT count(*) FROM d_{t} l WHERE l.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_{parent} x WHERE x.{k} = l.{c}))")
    fk("movies", "collection_id", "collections", "id")
    for t, (_, (c, parent, k)) in _LINKS.items():
        fk(t, "movie_id", "movies", "id")
        fk(t, c, parent, k)
    filled = {**{t: ["name"] for t in ("genres", "collections", "production_companies", "countries", "people")}, "movies": ["title", "adult", "has_imdb_match", "loaded_at"], "movie_cast": ["movie_id", "person_id"], "movie_crew": ["movie_id", "person_id"]}
    for t, cs in filled.items():
        for c in cs:
            add("not null", t, f"(SELECT count(*) FROM d_{t} WHERE {c} IS NULL)")
    add("unique", "movies", "(SELECT count(*) FROM (SELECT imdb_id FROM d_movies WHERE imdb_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1))")
    for t, by in (("movie_cast", "character"), ("movie_crew", "job")):
        add("unique group", t, f"(SELECT count(*) FROM (SELECT 1 FROM d_{t} GROUP BY movie_id, person_id, {by} HAVING count(*) > 1))")
    images = [("movies", "poster_path"), ("movies", "backdrop_path"), ("collections", "poster_path"), ("collections", "backdrop_path"), ("people", "profile_path"), ("production_companies", "logo_path")]
    checks = [
        ("movies", f"NOT {_full('imdb_id', _KEY)}"), ("movies", "vote_average NOT BETWEEN 0 AND 10"), ("movies", "imdb_average_rating NOT BETWEEN 1 AND 10"), ("movies", "vote_count < 0 OR imdb_num_votes < 0"), ("movies", "runtime NOT BETWEEN 1 AND 600"),
        ("movies", "release_date < DATE '1888-01-01'"), ("movies", f"status NOT IN {_STATUS}"), ("movies", f"NOT {_full('original_language', '[a-z]{2}')}"), ("languages", f"NOT {_full('iso_639_1', '[a-z]{2}')}"), ("movie_spoken_languages", f"NOT {_full('language_id', '[a-z]{2}')}"),
        ("production_companies", f"NOT {_full('origin_country', '[A-Z]{2}')}"), ("countries", f"NOT {_full('iso_3166_1', '[A-Z]{2}')}"), ("movie_production_countries", f"NOT {_full('country_id', '[A-Z]{2}')}"), ("movies", "budget < 1000"), ("movies", "revenue < 1000"), ("movies", f"NOT {_full('homepage', _SITE)}"),
        *[(t, f"NOT {_full(c, _IMAGE)}") for t, c in images], ("people", "gender NOT IN (1, 2, 3)"), ("movies", "popularity < 0"), ("people", "popularity < 0"), ("movie_cast", "cast_order < 0"), ("movie_crew", f"department NOT IN ({_DEPARTMENTS})"), ("people", f"known_for_department NOT IN ({_DEPARTMENTS}, 'Creator')"),
        *[(t, f"trim({c}) = '' OR {c} <> trim({c})") for t, cs in _TEXT.items() for c in cs],
        ("movies", "coalesce(vote_count, 0) = 0 AND vote_average IS NOT NULL"), ("movies", "has_imdb_match <> (imdb_average_rating IS NOT NULL) OR (has_imdb_match AND imdb_id IS NULL)"), ("movies", f"rating_gap IS DISTINCT FROM {_GAP}"), ("movies", f"votes_ratio IS DISTINCT FROM {_RATIO}"),
    ]
    for t, bad in checks:
        add("check", t, f"(SELECT count(*) FROM d_{t} WHERE {bad})")
    return f"SELECT kind, table_name, count(*) AS constraints, CAST(sum(violations) AS BIGINT) AS violations FROM ({' UNION ALL '.join(rows)}) GROUP BY 1, 2"


def _machines() -> str:
    """Each panel's terms over the events, which all metrics and their labels share."""
    base = "WITH s AS (SELECT event_type AS name, ts, max(value) AS value FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2), top AS (SELECT max(ts) AS t FROM s), latest AS (SELECT name, arg_max(value, ts) AS v FROM s GROUP BY 1)"
    for seconds in (300, 3600):
        base += f", w{seconds} AS (SELECT name, value, value - lag(value) OVER (PARTITION BY name ORDER BY ts) AS step, value IS DISTINCT FROM lag(value) OVER (PARTITION BY name ORDER BY ts) AND lag(value) OVER (PARTITION BY name ORDER BY ts) IS NOT NULL AS moved FROM s, top WHERE epoch_us(date_trunc('second', ts)) > epoch_us(date_trunc('second', t)) - {seconds * 1_000_000})"
        base += f", rate{seconds} AS (SELECT name, coalesce(sum(CASE WHEN step < 0 THEN value ELSE step END), 0) / {seconds} AS v FROM w{seconds} GROUP BY 1), changes{seconds} AS (SELECT name, count(*) FILTER (WHERE moved) AS v FROM w{seconds} GROUP BY 1)"
    own = ("pipeline_clean", "pipeline_load", "pipeline_dq", "pipeline_raw_rows")

    def term(t: Term) -> str:
        source = "latest" if t.of == "latest" else f"{t.of}{t.seconds}"
        differ = " WHERE name <> ''" if "name" in t.differ else ""
        if t.how is None:
            out = f"SELECT name, CAST(v AS DOUBLE) AS v FROM {source}{differ}"
        elif t.by:
            out = f"SELECT name, CAST({t.how}(v) AS DOUBLE) AS v FROM {source}{differ} GROUP BY name"
        else:
            out = f"SELECT '' AS name, CAST({t.how}(v) AS DOUBLE) AS v FROM {source}{differ}"
        if t.over is not None:
            below = term(t.over)
            if t.plus is not None:
                below = f"SELECT x.name, x.v + y.v AS v FROM ({below}) x JOIN ({term(t.plus)}) y USING (name)"
            out = f"SELECT x.name, x.v / greatest(y.v, 1) AS v FROM ({out}) x JOIN ({below}) y USING (name)"
            if t.rest:
                out = f"SELECT name, 1 - v AS v FROM ({out})"
        return f"SELECT name, v * {t.scale} + {t.shift} AS v FROM ({out}) WHERE v IS NOT NULL"

    rows = []
    for name, terms in PANELS.items():
        if not all(t.metric.startswith(own) for t in terms):
            rows += [f"SELECT '{name}' AS panel, {i} AS term, name, round(v, 4) AS value FROM ({term(t)})" for i, t in enumerate(terms, 1)]
    return base + " " + " UNION ALL ".join(rows)


def _pipeline_panels() -> str:
    """The panels on the mart, the runs and the audit, row by row."""
    one = lambda panel, term, metric, series, value, rest="": f"SELECT '{panel}' AS panel, {term} AS term, '{metric}' AS metric, {series} AS series, CAST({value} AS DOUBLE) AS value {rest}"
    clean, run, score, found = "pipeline_clean_rows", "pipeline_load_run_{}", "pipeline_dq_dimension_score", "pipeline_dq_control_anomalies"
    films, matched = "(SELECT count(*) FROM d_movies)", "(SELECT count(*) FROM d_movies WHERE has_imdb_match)"
    table = lambda t: f"'{{\"table_name\":\"{t}\"}}'"
    job = "'{\"job\":\"' || job || '\"}'"
    messages = "(SELECT count(*) FROM raw_movies)"
    distinct = one("{}", 2, run.format("distinct_movies_in"), job, "films", "FROM last_runs WHERE job = 'aggregate'")
    dims = "'{\"dimension\":\"' || coalesce(dimension, 'global') || '\",\"phase\":\"' || phase || '\"}'"
    rows = [
        one("raw rows", 1, "pipeline_raw_rows", "'{}'", f"{messages} + (SELECT count(*) FROM raw_ratings)"), one("raw film messages", 1, "pipeline_raw_rows", "'{}'", messages),
        one("clean films", 1, clean, table("movies"), films), one("films with second rating", 1, clean, table("movies_with_imdb"), matched),
        one("rejected rows", 1, run.format("rejected_rows"), job, "n - usable", "FROM last_runs WHERE job = 'aggregate'"), one("last runs succeeded", 1, run.format("success"), "'{}'", "1"),
        one("raw to clean", 1, "pipeline_raw_rows", "'{}'", messages), distinct.replace("'{}' AS panel", "'raw to clean' AS panel"), one("raw to clean", 3, clean, table("movies"), films),
        one("share loaded", 1, clean, "'{}'", f"100.0 * {films} / greatest((SELECT sum(films) FROM last_runs WHERE job = 'aggregate'), 1)"),
        one("oldest run", 1, run.format("age_seconds"), "'{}'", "(SELECT max(age) FROM last_runs)"), one("run durations", 1, run.format("duration_seconds"), job, "90", "FROM last_runs"),
        one("age of the audit", 1, run.format("age_seconds"), job, "age", "FROM last_runs WHERE job = 'quality'"),
        one("films over time", 1, clean, table("movies"), films), one("films over time", 2, clean, table("movies_with_imdb"), matched),
        one("rows by table", 1, clean, table("movies_with_imdb"), matched), *[one("rows by table", 1, clean, table(t), f"(SELECT count(*) FROM d_{t})") for t in _TABLES],
    ]
    for i, phase in enumerate(("before", "after"), 1):
        rows.append(one(f"score {phase}", 1, score, dims, "score", f"FROM scores WHERE phase = '{phase}' AND dimension IS NULL"))
        rows.append(one(f"anomalies {phase}", 1, found, "'{}'", f"(SELECT anomalies FROM scores WHERE phase = '{phase}' AND dimension IS NULL)"))
        rows.append(one("scores by dimension", i, score, dims, "score", f"FROM scores WHERE phase = '{phase}' AND dimension IS NOT NULL"))
        rows.append(one(f"anomalies by dimension {phase}", 1, found, "'{\"dimension\":\"' || dimension || '\"}'", "anomalies", f"FROM scores WHERE phase = '{phase}' AND dimension IS NOT NULL"))
    return f"{_ALL}, {_RUNS}, {_LAST_RUNS} " + " UNION ALL ".join(rows)


_CARD = lambda card, item, value, rest: f"SELECT '{card}' AS card, {item} AS item, CAST({value} AS DOUBLE) AS value FROM {rest}"

SQL = {
    "control_results": f"{_D}, {_BEFORE} SELECT control_id, checked_rows, anomaly_rows, anomaly_rate, passed FROM b",
    "control_results_cleaned": f"{_C}, {_AFTER} SELECT control_id, checked_rows, anomaly_rows, anomaly_rate, passed FROM a",
    "cleaning_journal": f"{_C}, {_JOURNAL} SELECT * FROM journal",
    "cleaned_tables": f"{_C} " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM d_{t}) AS before, (SELECT count(*) FROM c_{t}) AS after, (SELECT count(*) FROM c_{t}) - (SELECT count(*) FROM d_{t}) AS delta" for t in _TABLES) + " UNION ALL SELECT 'movies_with_imdb', b, a, a - b FROM (SELECT (SELECT count(*) FROM d_movies WHERE has_imdb_match) AS b, (SELECT count(*) FROM c_movies WHERE has_imdb_match) AS a)",
    "cleaned_films": f"{_C} SELECT CAST(id AS BIGINT) AS id, imdb_id, original_language, overview, status, strftime(release_date, '%Y-%m-%d') AS release_date, CAST(runtime AS BIGINT) AS runtime, budget, revenue, CAST(popularity AS DOUBLE) AS popularity, CAST(vote_average AS DOUBLE) AS vote_average, CAST(vote_count AS BIGINT) AS vote_count, homepage, poster_path, CAST(collection_id AS BIGINT) AS collection_id, CAST(imdb_average_rating AS DOUBLE) AS imdb_average_rating, CAST(imdb_num_votes AS BIGINT) AS imdb_num_votes, has_imdb_match, CAST(rating_gap AS DOUBLE) AS rating_gap, CAST(votes_ratio AS DOUBLE) AS votes_ratio FROM c_movies",
    "control_verdicts": f"{_C}, {_BEFORE}, {_AFTER}, {_JUDGED} SELECT * FROM j",
    "control_scores": f"{_C}, {_BEFORE}, {_AFTER}, {_SCORES} SELECT * FROM scores",
    "control_evidence": f"{_D} {_evidence()}",
    "mart_constraints": f"{_D} {_constraints()}",
    "last_run_of_each_job": f"WITH {_RUNS}, {_LAST_RUNS} SELECT job, 'success' AS status, strftime(ingest_date, '%Y-%m-%d') AS ingest_date, n AS raw_rows_in, films AS distinct_movies_in, usable AS clean_rows_out, n - usable AS rejected_rows, age AS age_seconds, round(usable / n::DOUBLE, 4) AS clean_ratio FROM last_runs",
    "last_finished_run": f"WITH {_RUNS} SELECT run_id, job FROM runs ORDER BY started DESC, run_id LIMIT 1",
    "run_report": f"{_ALL} SELECT (SELECT strftime(max(ingest_date), '%Y-%m-%d') FROM d_movies) AS mart_ingest_date, (SELECT count(*) FROM d_movies) AS mart_movies, (SELECT count(*) FROM c_movies) AS curated_movies, CAST(sum(anomalies_before) AS BIGINT) AS anomalies_before, CAST(sum(anomalies_after) AS BIGINT) AS anomalies_after, (SELECT CAST(sum(corrections) AS BIGINT) FROM journal) AS corrections FROM j",
    "report_columns": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name" for t, cs in _COLUMNS.items() for c in cs.split()),
    "report_schema_diff": "SELECT 'movies' AS table_name, 'imdb_genres' AS column_name, 'array<string>' AS left_type, 'string' AS right_type UNION ALL SELECT 'movies', c, 'timestamp', 'timestamp_ntz' FROM (VALUES ('source_fetched_at'), ('loaded_at')) AS x(c)",
    "report_constraints": "SELECT * FROM (VALUES ('primary key', 13), ('foreign key', 13), ('not null', 13), ('unique', 1), ('unique group', 2), ('check', 65)) AS x(kind, curated)",
    "report_relations": " UNION ALL ".join(f"SELECT '{r}' AS relation, true AS mart, true AS curated, {'false' if r.startswith('movies') else 'true'} AS links" for r in _PARENTS),
    "report_code_coverage": f"{_D} SELECT 'movies.original_language -> languages' AS attribute, count(original_language) AS filled, count(*) FILTER (WHERE original_language IN (SELECT iso_639_1 FROM d_languages)) AS known FROM d_movies UNION ALL SELECT 'production_companies.origin_country -> countries', count(*) FILTER (WHERE trim(origin_country) <> ''), count(*) FILTER (WHERE origin_country IN (SELECT iso_3166_1 FROM d_countries)) FROM d_production_companies",
    "report_match_coverage": f"{_D} SELECT count(*) AS films, count(imdb_id) AS with_key, count(*) FILTER (WHERE has_imdb_match) AS with_rating, count(imdb_start_year) AS with_title_data, round(100.0 * count(*) FILTER (WHERE has_imdb_match) / count(*), 1) AS coverage_pct FROM d_movies",
    "report_fill_films": f"{_D} {_fill('movies', _FILMS)}",
    "report_fill_people": f"{_D} {_fill('people', _PERSONS)}",
    "report_status": f"{_D} SELECT coalesce(status, '(NULL)') AS status, count(*) AS films, count(*) FILTER (WHERE release_date > {_TODAY}) AS dated_ahead, count(*) FILTER (WHERE coalesce(vote_count, 0) = 0) AS without_votes FROM d_movies GROUP BY 1",
    "report_numbers": f"{_D} " + " UNION ALL ".join(f"SELECT '{name}' AS measure, count({e}) AS n, CAST(min({e}) AS DOUBLE) AS least, CAST(quantile_disc({e}, 0.5) AS DOUBLE) AS median, CAST(max({e}) AS DOUBLE) AS most FROM d_movies" for name, e in _MEASURES.items()),
    "report_smallest_money": f"{_D} SELECT CAST(id AS BIGINT) AS id, title, budget, revenue, CAST(vote_count AS BIGINT) AS vote_count FROM d_movies WHERE budget < 100000 OR revenue < 100000 ORDER BY least(coalesce(budget, revenue), coalesce(revenue, budget)), id LIMIT 10",
    "report_vote_buckets": f"{_D} SELECT CASE WHEN vote_count = 0 THEN 'no vote' WHEN vote_count < 10 THEN '1 to 9 votes' WHEN vote_count < 100 THEN '10 to 99 votes' ELSE '100 votes and more' END AS votes, count(*) AS films, count(*) FILTER (WHERE vote_average = 0) AS rated_zero, CAST(round(CAST(avg(vote_average) AS DECIMAL(20,10)), 2) AS DOUBLE) AS mean_rating FROM d_movies GROUP BY 1",
    "report_languages": f"{_D} SELECT original_language, count(*) AS films, CASE WHEN original_language IS NOT NULL THEN original_language IN (SELECT iso_639_1 FROM d_languages) END AS listed FROM d_movies GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10",
    "report_genders": f"{_D} SELECT CAST(gender AS BIGINT) AS gender, CASE gender WHEN 0 THEN 'not stated' WHEN 1 THEN 'woman' WHEN 2 THEN 'man' WHEN 3 THEN 'non-binary' END AS label, count(*) AS people, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM d_people GROUP BY gender",
    "report_departments": f"{_D} SELECT coalesce(known_for_department, '(NULL)') AS known_for_department, count(*) AS people FROM d_people GROUP BY 1",
    "report_cardinalities": f"{_D} " + " UNION ALL ".join(f"SELECT '{t}' AS relation, min(n) AS least, round(avg(n), 2) AS mean, max(n) AS most FROM (SELECT m.id, count(l.movie_id) AS n FROM d_movies m LEFT JOIN d_{t} l ON l.movie_id = m.id GROUP BY 1)" for t in _CARDS),
    "report_malformed": f"{_D} SELECT table_name, column_name, count(*) AS n_values, min(v) AS example FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS v FROM d_{t} WHERE trim({c}) = '' OR {c} <> trim({c})" for t, cs in {**_TEXT, "movies": [*_TEXT["movies"], "imdb_genres"]}.items() for c in cs) + ") GROUP BY 1, 2",
    "view_enriched": f"{_D}, {_ENRICHED} SELECT CAST(id AS BIGINT) AS id, release_year, CAST(vote_average AS DOUBLE) AS tmdb_rating, CAST(imdb_num_votes AS BIGINT) AS imdb_votes, collection, genres, directors FROM enriched",
    "view_gaps": f"{_D}, {_ENRICHED} SELECT CAST(id AS BIGINT) AS id, title, genres, CAST(rating_gap AS DOUBLE) AS rating_gap FROM enriched WHERE has_imdb_match AND vote_count >= 50 AND imdb_num_votes >= 100 ORDER BY abs(rating_gap) DESC NULLS LAST, id LIMIT 20",
    "view_people": f"{_D}, {_PEOPLE} SELECT * REPLACE (CAST(id AS BIGINT) AS id) FROM people_films",
    "view_genre_stats": f"{_D}, {_STATS} SELECT * FROM stats",
    "view_yearly": f"{_D} SELECT CAST(year(release_date) AS INTEGER) AS release_year, count(*) AS movies, CAST(round(CAST(avg(vote_average) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_tmdb_rating, CAST(round(CAST(avg(imdb_average_rating) AS DECIMAL(20,10)), 2) AS DOUBLE) AS avg_imdb_rating, CAST(sum(revenue) AS BIGINT) AS total_revenue, CAST(sum(budget) AS BIGINT) AS total_budget FROM d_movies WHERE release_date IS NOT NULL GROUP BY 1",
    "card_pipeline": f"{_D}, {_PEOPLE}, {_STATS} " + " UNION ALL ".join((_CARD("films in the mart", "'films'", "count(*)", "d_movies"), _CARD("match coverage", "CASE WHEN has_imdb_match THEN 'matched' ELSE 'unmatched' END", "count(*)", "d_movies GROUP BY 2"), _CARD("ratings by genre", "genre", "avg_tmdb_rating", "(SELECT * FROM stats ORDER BY movies DESC, genre LIMIT 12)"), _CARD("people in most casts", "name", "movies", "(SELECT * FROM people_films ORDER BY movies DESC, name, id LIMIT 15)"))),
    "report_kpis": f"{_C}, {_KPI} SELECT position, indicator, mart, curated, round(curated - mart, 3) AS delta FROM kpi",
    "report_genres": f"{_C}, {_GENRES} SELECT * FROM effect",
    "report_verdicts": f"{_C}, {_BEFORE}, {_AFTER}, {_JUDGED} SELECT verdict, count(*) AS controls, CAST(sum(anomalies_before) AS BIGINT) AS anomalies_before, CAST(sum(anomalies_after) AS BIGINT) AS anomalies_after FROM j GROUP BY 1",
    "report_ranked": f"{_C}, {_BEFORE}, {_AFTER}, {_JUDGED} SELECT control_id, severity, anomalies_before, pct_before, anomalies_after, pct_after, verdict FROM j WHERE anomalies_before > 0 OR anomalies_after > 0",
    "report_scores": f"{_C}, {_BEFORE}, {_AFTER}, {_SCORES} SELECT coalesce(x.dimension, 'global') AS dimension, x.score AS score_before, y.score AS score_after, x.controls_passed || '/' || x.controls AS passed_before, y.controls_passed || '/' || y.controls AS passed_after FROM scores x JOIN scores y ON x.dimension IS NOT DISTINCT FROM y.dimension WHERE x.phase = 'before' AND y.phase = 'after'",
    "report_actions": f"{_C}, {_JOURNAL} SELECT action, count(DISTINCT control_id) AS controls, CAST(sum(corrections) AS BIGINT) AS n_rows FROM journal GROUP BY 1",
    "report_tables": f"{_C} " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{'link' if t in _LINKS else 'entity'}' AS kind, (SELECT count(*) FROM d_{t}) AS mart_rows, (SELECT count(*) FROM c_{t}) AS curated_rows, {len(cs.split())} AS mart_columns" for t, cs in _COLUMNS.items()),
    "card_quality": f"{_ALL}, {_KPI}, {_GENRES} "
    + " UNION ALL ".join(
        (
            _CARD("anomalies before", "''", "sum(anomalies_before)", "j"), _CARD("anomalies after", "''", "sum(anomalies_after)", "j"), _CARD("controls to do", "''", "count(*) FILTER (WHERE verdict = 'to do')", "j"), _CARD("treatments", "treatment", "count(*)", "j GROUP BY treatment"),
            _CARD("scores", "dimension", "score", "scores WHERE phase = 'after' AND dimension IS NOT NULL"), _CARD("ranked controls", "control_id", "anomalies_after", "j WHERE anomalies_before > 0 OR anomalies_after > 0"), _CARD("effect on genres", "genre", "tmdb_curated", "(SELECT * FROM effect ORDER BY films_mart DESC, genre LIMIT 12)"),
            _CARD("effect on indicators", "indicator", "round(curated - mart, 3)", "kpi"), _CARD("history", "dimension", "anomalies", "scores WHERE phase = 'before' AND dimension IS NOT NULL"), _CARD("corrections", "concat_ws('/', control_id, action, table_name, column_name)", "corrections", "journal"),
        )
    ),
    "panels_pipeline": _pipeline_panels(),
    "panels_machines": _machines(),
}
