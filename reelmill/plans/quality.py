"""The mart's 49 controls, its cleaning sequence and the 94 constraints of the cleaned copy."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill import schemas
from reelmill.operators.controls import JOURNAL, SCANS, Branch, Constraint, Control, Fix, Tables, close_journal, fix, removed
from reelmill.operators.relational import leading, missing_any, trailing
from reelmill.plans.mart import LINKS, REFERENCES
from reelmill.session import scratch_table

#: Each table's record key as text.
KEYS = {name: "concat_ws('-', " + ", ".join(f"cast({k} as string)" for k in keys) + ")" for name, (keys, _) in schemas.MART.items()}

# Domains and patterns of the source, and the severities, thresholds and treatments in controls().
STATUSES = ("Rumored", "Planned", "In Production", "Post Production", "Released", "Canceled")
DEPARTMENTS = ("Acting", "Directing", "Writing", "Production", "Camera", "Editing", "Sound", "Art", "Costume & Make-Up", "Visual Effects", "Lighting", "Crew")
TITLE_KEY = r"^tt[0-9]{7,}\\z"
HOMEPAGE = r"^https?://\\S+\\z"
IMAGE = r"^/[A-Za-z0-9_-]+\\.(jpg|jpeg|png|svg)\\z"
LANGUAGE = r"^[a-z]{2}\\z"
COUNTRY = r"^[A-Z]{2}\\z"
EARLIEST = "1888-01-01"

#: (table, column) of codes and image paths.
LANGUAGE_CODES = (("movies", "original_language"), ("languages", "iso_639_1"), ("movie_spoken_languages", "language_id"))
COUNTRY_CODES = (("production_companies", "origin_country"), ("countries", "iso_3166_1"), ("movie_production_countries", "country_id"))
IMAGES = (("movies", "poster_path"), ("movies", "backdrop_path"), ("collections", "poster_path"), ("collections", "backdrop_path"), ("people", "profile_path"), ("production_companies", "logo_path"))


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def text_columns(table: str) -> list[str]:
    return [f.name for f in schemas.struct_type(schemas.MART[table][1]) if f.dataType.typeName() == "string"]


def _null(control: str, dimension: str, severity: str, threshold: float, treatment: str, table: str, predicate: str, population: str = "true") -> Control:
    return Control(control, dimension, severity, threshold, treatment, (Branch(table, predicate, population),))


def _of_column(c: str, anomaly: str) -> tuple[str, str]:
    return anomaly.replace("{c}", c), f"{c} is not null"


def _counts(*parts: DataFrame) -> DataFrame:
    out = None
    for p in parts:
        one = p.selectExpr("count(1) as population")
        out = one if out is None else out.union(one)
    return out if len(parts) == 1 else out.selectExpr("sum(population) as population")


def _without(link: str, where: str = "true"):
    def run(t: Tables):
        gone = t["movies"].join(t[link].where(where), t["movies"]["id"] == t[link]["movie_id"], "left_anti")
        return _counts(t["movies"]), gone.select(F.col("id").alias("record_key"))

    return run


def _duplicates(table: str, by: dict[str, str], where: str):
    def run(t: Tables):
        rows = t[table].where(where)
        groups = rows.groupBy(*[F.expr(e).alias(n) for n, e in by.items()]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return _counts(rows), groups.select(F.concat_ws("-", *by).alias("record_key"))

    return run


CAST_GROUP, CREW_GROUP = ["movie_id", "person_id", "character"], ["movie_id", "person_id", "job"]


def _cast_order():
    return [F.col("cast_order").asc_nulls_last(), F.col("credit_id")]


def _repeated(table: str):
    def run(t: Tables):
        keys, order = (CAST_GROUP, _cast_order()) if table == "movie_cast" else (CREW_GROUP, [F.col("credit_id")])
        return _counts(t[table]), trailing(t[table], keys, order).select(F.col("credit_id").alias("record_key"))

    return run


def _same_names(t: Tables):
    found = None
    for table in ("genres", "collections", "production_companies"):
        one = t[table].groupBy(F.lower(F.trim("name")).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.concat(F.lit(f"{table}:"), "name").alias("record_key"))
        found = one if found is None else found.unionByName(one)
    return _counts(t["genres"], t["collections"], t["production_companies"]), found


def _stale_links(t: Tables, table: str) -> tuple[DataFrame, DataFrame]:
    """Links of the films of the last load, and those of them the load doesn't hold."""
    films = t["staged:movies"].select(F.col("id").alias("movie_id"))
    mine = t[table].join(films, "movie_id", "left_semi")
    return mine, mine.join(t[f"staged:{table}"], list(schemas.MART[table][0]), "left_anti")


def _stale(t: Tables):
    if "staged:movies" not in t:
        empty = t["movies"].where("false")
        return _counts(empty), empty.select(F.col("id").alias("record_key"))
    parts = [_stale_links(t, table) for table in LINKS]
    found = None
    for table, (_, gone) in zip(LINKS, parts):
        one = gone.select(F.concat(F.lit(f"{table}:"), F.expr(KEYS[table])).alias("record_key"))
        found = one if found is None else found.unionByName(one)
    return _counts(*[mine for mine, _ in parts]), found


def parents(table: str) -> list[tuple[str, str, str]]:
    return [(c, p, k) for t, c, p, k in schemas.FOREIGN_KEYS if t == table]


def _broken_links(t: Tables):
    found = None
    for table in LINKS:
        one = missing_any(t[table], [(c, t[p], k) for c, p, k in parents(table)]).select(F.concat(F.lit(f"{table}:"), F.expr(KEYS[table])).alias("record_key"))
        found = one if found is None else found.unionByName(one)
    return _counts(*[t[x] for x in LINKS]), found


def _missing(table: str, column: str, parent: str, key: str, filled: str = "{c} is not null"):
    def run(t: Tables):
        rows = t[table].where(filled.replace("{c}", column))
        return _counts(rows), rows.join(t[parent].select(F.col(key).alias("__p")).distinct(), F.col(column) == F.col("__p"), "left_anti").select(F.expr(KEYS[table]).alias("record_key"))

    return run


def _orphans(t: Tables, names: tuple[str, ...]):
    found = None
    for table, key, users in REFERENCES:
        if table in names:
            gone = t[table]
            for user, column in users:
                gone = gone.join(t[user].select(F.col(column).alias("__u")).distinct(), F.col(key) == F.col("__u"), "left_anti")
            one = gone.select(F.concat(F.lit(f"{table}:"), F.col(key).cast("string")).alias("record_key"))
            found = one if found is None else found.unionByName(one)
    return _counts(*[t[n] for n in names]), found


def controls(as_of: date) -> list[Control]:
    """All controls; ``as_of`` stands for today."""
    latest = date(as_of.year + 5, as_of.month, min(as_of.day, 28)).isoformat()
    today = as_of.isoformat()
    m = "movies"

    def branches(*targets: tuple[str, str, str]) -> tuple[Branch, ...]:
        return tuple(Branch(t, *_of_column(c, a), observed=f"concat('{c} = ', cast({c} as string))") for t, c, a in targets)

    bad = lambda p: "not {c} rlike '" + p + "'"
    money = "coalesce(budget, 1000) < 1000 or coalesce(revenue, 1000) < 1000"
    hygiene = tuple(Branch(t, f"trim({c}) = '' or {c} <> trim({c})", f"{c} is not null", f"concat('{c} = ', {c})") for t in schemas.MART for c in text_columns(t))
    return [
        _null("COM-01", "completeness", "major", 0.05, "keep", m, "imdb_id is null"),
        _null("COM-02", "completeness", "major", 0.05, "keep", m, "release_date is null"),
        _null("COM-03", "completeness", "minor", 0.05, "impute", m, "runtime is null"),
        _null("COM-04", "completeness", "minor", 0.10, "keep", m, "overview is null"),
        _null("COM-05", "completeness", "info", 1, "keep", m, "budget is null or revenue is null"),
        Control("COM-06", "completeness", "minor", 0.02, "keep", relational=_without("movie_genres")),
        Control("COM-07", "completeness", "minor", 0.05, "keep", relational=_without("movie_cast")),
        Control("COM-08", "completeness", "minor", 0.05, "keep", relational=_without("movie_crew", "job = 'Director'")),
        _null("COM-09", "completeness", "info", 1, "keep", "people", "gender is null or gender = 0"),
        _null("COM-10", "completeness", "info", 1, "keep", "production_companies", "origin_country is null or trim(origin_country) = ''"),
        _null("COM-11", "completeness", "major", 0.05, "keep", m, "imdb_average_rating is null", "imdb_id is not null"),
        Control("UNI-01", "uniqueness", "critical", 0, "delete", relational=_duplicates(m, {"id": "id"}, "true")),
        Control("UNI-02", "uniqueness", "critical", 0, "correct", relational=_duplicates(m, {"imdb_id": "imdb_id"}, "imdb_id is not null")),
        Control("UNI-03", "uniqueness", "major", 0, "keep", relational=_duplicates(m, {"name": "lower(trim(coalesce(original_title, title)))", "year": "year(release_date)"}, "release_date is not null")),
        Control("UNI-04", "uniqueness", "minor", 0, "delete", relational=_repeated("movie_cast")),
        Control("UNI-05", "uniqueness", "minor", 0, "delete", relational=_repeated("movie_crew")),
        Control("UNI-06", "uniqueness", "info", 1, "keep", relational=_same_names),
        Control("VAL-01", "validity", "major", 0, "null", branches((m, "imdb_id", bad(TITLE_KEY)))),
        Control("VAL-02", "validity", "critical", 0, "null", branches((m, "vote_average", "{c} not between 0 and 10"))),
        Control("VAL-03", "validity", "critical", 0, "null", branches((m, "imdb_average_rating", "{c} not between 1 and 10"))),
        _null("VAL-04", "validity", "critical", 0, "null", m, "coalesce(vote_count, 0) < 0 or coalesce(imdb_num_votes, 0) < 0"),
        Control("VAL-05", "validity", "major", 0, "null", branches((m, "runtime", "{c} not between 1 and 600"))),
        Control("VAL-06", "validity", "major", 0, "null", branches((m, "release_date", f"{{c}} not between date'{EARLIEST}' and date'{latest}'"))),
        Control("VAL-07", "validity", "major", 0, "null", branches((m, "status", f"{{c}} not in ({_listed(STATUSES)})"))),
        Control("VAL-08", "validity", "minor", 0, "null", branches(*[(t, c, bad(LANGUAGE)) for t, c in LANGUAGE_CODES])),
        Control("VAL-09", "validity", "major", 0, "null", branches(*[(t, c, bad(COUNTRY)) for t, c in COUNTRY_CODES])),
        _null("VAL-10", "validity", "major", 0, "null", m, money, "budget is not null or revenue is not null"),
        Control("VAL-11", "validity", "minor", 0, "null", branches((m, "homepage", bad(HOMEPAGE)))),
        Control("VAL-12", "validity", "minor", 0, "null", branches(*[(t, c, bad(IMAGE)) for t, c in IMAGES])),
        Control("VAL-13", "validity", "minor", 0, "null", branches(("people", "gender", "{c} not in (1, 2, 3)"))),
        Control("VAL-14", "validity", "minor", 0, "null", branches((m, "popularity", "{c} < 0"), ("people", "popularity", "{c} < 0"), ("movie_cast", "cast_order", "{c} < 0"))),
        Control("VAL-15", "validity", "minor", 0, "null", branches(("movie_crew", "department", f"{{c}} not in ({_listed(DEPARTMENTS)})"), ("people", "known_for_department", f"{{c}} not in ({_listed((*DEPARTMENTS, 'Creator'))})"))),
        Control("VAL-16", "validity", "minor", 0, "correct", hygiene),
        _null("COH-01", "coherence", "major", 0, "null", m, "coalesce(vote_count, 0) = 0 and vote_average is not null"),
        _null("COH-02", "coherence", "critical", 0, "correct", m, "has_imdb_match <> (imdb_average_rating is not null) or (has_imdb_match and imdb_id is null)"),
        _null("COH-03", "coherence", "major", 0, "correct", m, "rating_gap is distinct from cast(round(vote_average - imdb_average_rating, 2) as decimal(4,2))"),
        _null("COH-04", "coherence", "minor", 0, "correct", m, "votes_ratio is distinct from cast(round(try_divide(cast(vote_count as decimal(12,0)), nullif(imdb_num_votes, 0)), 4) as decimal(10,4))"),
        _null("COH-05", "coherence", "major", 0, "keep", m, f"release_date > date'{today}'", "status = 'Released'"),
        _null("COH-06", "coherence", "minor", 0, "keep", m, "revenue is not null", "status <> 'Released'"),
        _null("COH-07", "coherence", "minor", 0.05, "keep", m, "abs(runtime - imdb_runtime_minutes) > 30", "runtime is not null and imdb_runtime_minutes is not null"),
        _null("COH-08", "coherence", "minor", 0.05, "keep", m, "abs(year(release_date) - imdb_start_year) > 1", "release_date is not null and imdb_start_year is not null"),
        Control("COH-09", "coherence", "major", 0, "delete", relational=_stale),
        _null("COH-10", "coherence", "minor", 0, "keep", m, "source_fetched_at > loaded_at or ingest_date < cast(source_fetched_at as date)"),
        Control("INT-01", "integrity", "critical", 0, "delete", relational=_broken_links),
        Control("INT-02", "integrity", "critical", 0, "null", relational=_missing(m, "collection_id", "collections", "id")),
        Control("INT-03", "integrity", "minor", 0, "delete", relational=lambda t: _orphans(t, ("genres", "collections", "production_companies", "countries", "languages"))),
        Control("INT-04", "integrity", "minor", 0, "delete", relational=lambda t: _orphans(t, ("people",))),
        Control("INT-05", "integrity", "info", 1, "keep", relational=_missing(m, "original_language", "languages", "iso_639_1")),
        Control("INT-06", "integrity", "info", 1, "keep", relational=_missing("production_companies", "origin_country", "countries", "iso_3166_1", "trim({c}) <> ''")),
    ]


def _row_fixes(as_of: date) -> tuple[dict[str, list[Fix]], list[Fix], dict[str, tuple[str, str]]]:
    """Row-local fixes per table in their order; the films' later ones; rows to remove for a bad code (table: control, predicate)."""
    by_id = {c.control_id: c for c in controls(as_of)}
    first: dict[str, list[Fix]] = {t: [Fix("VAL-16", "trim", c, f"nullif(trim({c}), '')", f"trim({c}) = '' or {c} <> trim({c})") for c in text_columns(t)] for t in schemas.MART}
    gone: dict[str, tuple[str, str]] = {}

    def nulls(control: str, table: str, column: str, when: str) -> None:
        first[table].append(Fix(control, "null", column, "null", when))

    m = "movies"
    for control, column in (("VAL-01", "imdb_id"), ("VAL-02", "vote_average"), ("VAL-03", "imdb_average_rating")):
        nulls(control, m, column, by_id[control].branches[0].anomaly)
    nulls("VAL-04", m, "vote_count", "vote_count < 0")
    nulls("VAL-04", m, "imdb_num_votes", "imdb_num_votes < 0")
    for control, column in (("VAL-05", "runtime"), ("VAL-06", "release_date"), ("VAL-07", "status")):
        nulls(control, m, column, by_id[control].branches[0].anomaly)
    for control, codes in (("VAL-08", LANGUAGE_CODES), ("VAL-09", COUNTRY_CODES)):
        for (table, column), branch in zip(codes, by_id[control].branches):
            if column in schemas.MART[table][0]:
                gone[table] = (control, branch.anomaly)
            else:
                nulls(control, table, column, branch.anomaly)
    nulls("VAL-10", m, "budget", "budget < 1000")
    nulls("VAL-10", m, "revenue", "revenue < 1000")
    nulls("VAL-11", m, "homepage", by_id["VAL-11"].branches[0].anomaly)
    for control, columns in (("VAL-12", IMAGES), ("VAL-13", (("people", "gender"),)), ("VAL-14", ((m, "popularity"), ("people", "popularity"), ("movie_cast", "cast_order"))), ("VAL-15", (("movie_crew", "department"), ("people", "known_for_department")))):
        for (table, column), branch in zip(columns, by_id[control].branches):
            nulls(control, table, column, branch.anomaly)
    nulls("COH-01", m, "vote_average", "coalesce(vote_count, 0) = 0 and vote_average is not null")
    later = [Fix("COM-03", "impute", "runtime", "imdb_runtime_minutes", "runtime is null and imdb_runtime_minutes between 1 and 600")]
    for c in ("imdb_average_rating", "imdb_num_votes", "imdb_start_year", "imdb_runtime_minutes", "imdb_genres"):
        later.append(Fix("COH-02", "null", c, "null", f"imdb_id is null and {c} is not null"))
    later.append(Fix("COH-02", "correct", "has_imdb_match", "imdb_average_rating is not null", "has_imdb_match <> (imdb_average_rating is not null)"))
    gap, ratio = "cast(round(vote_average - imdb_average_rating, 2) as decimal(4,2))", "cast(round(try_divide(cast(vote_count as decimal(12,0)), nullif(imdb_num_votes, 0)), 4) as decimal(10,4))"
    later.append(Fix("COH-03", "correct", "rating_gap", gap, f"rating_gap is distinct from {gap}"))
    later.append(Fix("COH-04", "correct", "votes_ratio", ratio, f"votes_ratio is distinct from {ratio}"))
    return first, later, gone


def clean(mart: Tables, as_of: date, staged: Tables | None = None) -> tuple[Tables, DataFrame]:
    """The cleaned copy and the journal of every change.

    Stale links go before repeated credits, so that of a repeat the live credit stays; orphans go last. Each table is
    written to the shared folder after its row fixes and after its removals, which other tables' steps read; tables
    that don't read each other go at the same time.
    """
    first, later, gone = _row_fixes(as_of)
    out: Tables = {}
    journal: list[DataFrame] = []

    def settle(name: str, df: DataFrame) -> None:
        kept = scratch_table(df, f"clean-{name}")
        out[name], entries = close_journal(kept, name, KEYS[name])
        journal.append(entries)

    def fix_rows(name: str) -> None:
        df = fix(mart[name], first[name])
        if name in gone:
            control, when = gone[name]
            kept = scratch_table(df.withColumn("__bad", F.coalesce(F.expr(when), F.lit(False))), f"codes-{name}")
            journal.append(removed(kept.where("__bad").drop("__bad", "__journal"), control, name, KEYS[name]))
            out[name], entries = close_journal(kept.where("not __bad").drop("__bad"), name, KEYS[name])
            journal.append(entries)
        else:
            settle(name, df)

    def at_once(step, names) -> None:
        with ThreadPoolExecutor(SCANS) as pool:
            list(pool.map(step, names))

    at_once(fix_rows, [name for name in schemas.MART if name != "movies"])
    films = fix(mart["movies"], first["movies"])
    # a key held by several films stays with the one of most votes
    owner = leading(films.where("imdb_id is not null").select("imdb_id", "id", "vote_count"), ["imdb_id"], [F.coalesce("vote_count", F.lit(0)).desc(), F.col("id").desc()])
    films = films.join(owner.select(F.col("imdb_id").alias("__key"), F.col("id").alias("__owner")), F.col("imdb_id") == F.col("__key"), "left")
    films = fix(films, [Fix("UNI-02", "null", "imdb_id", "null", "imdb_id is not null and __owner <> id")]).drop("__key", "__owner")
    known = out["collections"].select(F.col("id").alias("__c"))
    films = films.join(known, F.col("collection_id") == F.col("__c"), "left")
    films = fix(films, [Fix("INT-02", "null", "collection_id", "null", "collection_id is not null and __c is null")]).drop("__c")
    settle("movies", fix(films, later))

    def take(name: str, bad: DataFrame, control: str) -> None:
        keys = list(schemas.MART[name][0])
        journal.append(removed(bad, control, name, KEYS[name]))
        gone = bad.select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))  # a code that was blank is null by now
        out[name] = scratch_table(out[name].join(gone, same, "left_anti").select(mart[name].columns), f"kept-{name}")

    def clean_links(name: str) -> None:
        if staged is not None:
            tables = {name: out[name], "staged:movies": staged["movies"], f"staged:{name}": staged[name]}
            take(name, _stale_links(tables, name)[1], "COH-09")
        if name == "movie_cast":
            take(name, trailing(out[name], CAST_GROUP, _cast_order()), "UNI-04")
        if name == "movie_crew":
            take(name, trailing(out[name], CREW_GROUP, [F.col("credit_id")]), "UNI-05")
        take(name, missing_any(out[name], [(c, out[p], k) for c, p, k in parents(name)]), "INT-01")

    def drop_unused(reference) -> None:
        name, key, users = reference
        bad = out[name]
        for user, column in users:
            bad = bad.join(out[user].select(F.col(column).alias("__u")).distinct(), F.col(key) == F.col("__u"), "left_anti")
        take(name, bad, "INT-04" if name == "people" else "INT-03")

    at_once(clean_links, LINKS)
    at_once(drop_unused, REFERENCES)
    spark = mart["movies"].sparkSession
    entries = spark.createDataFrame([], JOURNAL)
    for j in journal:
        entries = entries.unionByName(j)
    return out, entries


def target_constraints(as_of: date) -> list[Constraint]:
    """What holds of a cleaned mart: 94 constraints, and the columns that may not be null."""
    out = [Constraint("primary key", t, keys) for t, (keys, _) in schemas.MART.items()]
    out += [Constraint("foreign key", t, (c,), parent=p, parent_key=k) for t, c, p, k in schemas.FOREIGN_KEYS]
    out += [Constraint("not null", t, (c,)) for t, columns in schemas.NOT_NULL.items() for c in columns]
    out.append(Constraint("unique", "movies", ("imdb_id",)))
    out += [Constraint("unique group", "movie_cast", tuple(CAST_GROUP)), Constraint("unique group", "movie_crew", tuple(CREW_GROUP))]
    by_id = {c.control_id: c for c in controls(as_of)}
    for n in range(1, 16):
        for b in by_id[f"VAL-{n:02d}"].branches:
            if n == 4:
                out.append(Constraint("check", b.table, ("votes",), "vote_count >= 0 and imdb_num_votes >= 0"))
            elif n == 10:
                out += [Constraint("check", b.table, (c,), f"{c} >= 1000") for c in ("budget", "revenue")]
            elif n == 6:
                out.append(Constraint("check", b.table, ("release_date",), f"release_date >= date'{EARLIEST}'"))
            else:
                out.append(Constraint("check", b.table, (b.population.split()[0],), f"not ({b.anomaly})"))
    out += [Constraint("check", b.table, (b.population.split()[0],), f"not ({b.anomaly})") for b in by_id["VAL-16"].branches]
    out += [Constraint("check", "movies", (f"coh{n}",), f"not ({by_id[f'COH-{n:02d}'].branches[0].anomaly})") for n in range(1, 5)]
    return out


