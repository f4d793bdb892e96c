"""The film pipeline end to end on a small lake with traps, and the operators it is made of."""

import json
import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reelmill import __main__ as cli
from reelmill import schemas
from reelmill.operators import controls as C
from reelmill.operators import metrics as M
from reelmill.plans import catalogue, mart, quality, views
from reelmill.plans.audit import LoadRun, NoOpenRun, Skip, current_run, pipeline_lock, read_runs
from reelmill.sources import lake
from reelmill.streaming import landing

AS_OF = date(2026, 9, 20)


def person(pid, credit, **more):
    return {"id": pid, "credit_id": credit, "name": f"Person {pid}", "gender": 1, "popularity": 1.5, **more}


def message(movie_id, fetched, title="A film", **payload):
    return {"source": "s", "endpoint": f"/m/{movie_id}", "movie_id": movie_id, "fetched_at": fetched, "schema_version": 1, "payload": {"id": movie_id, "title": title, **payload}}


def messages():
    rich = dict(
        imdb_id="tt0000001", original_language="EN", release_date="2001-02-03", runtime=100, budget=7, revenue=5000, vote_average=7.25, vote_count=10, status="Released", unknown_field=1,
        genres=[{"id": 1, "name": "Drama"}, {"id": 2, "name": " War "}], belongs_to_collection={"id": 5, "name": "Saga"},
        production_companies=[{"id": 9, "name": "Co", "origin_country": ""}], production_countries=[{"iso_3166_1": "fr", "name": "France"}], spoken_languages=[{"iso_639_1": "en", "name": "English"}],
        credits={"cast": [person(100, "c1", character="Hero", order=0), person(101, "c2", character="", order=1, gender=0)], "crew": [person(102, "w1", job="Director", department="Directing"), person(102, "w0", job="Director", department="Directing")]},
    )
    return [
        message(1, "2026-09-18T10:00:00+00:00", **{**rich, "vote_average": 1.0}),
        message(1, "2026-09-18T14:00:00+02:00", **rich),
        message(2, "2026-09-18T10:00:00Z", title=None),
        message(3, "2026-09-18T10:00:00Z", title="No votes", runtime=90, imdb_id="tt0000003", vote_average=0.0, vote_count=0, release_date=""),
        message(4, "2026-09-18T10:00:00Z", title="Unmatched", runtime=90, imdb_id="tt0000004", vote_average=6.004, vote_count=3, genres=[{"id": 1, "name": "Drama"}]),
    ]


@pytest.fixture
def root(tmp_path):
    day = tmp_path / "raw/documents/movies/ingest_date=2026-09-19"
    day.mkdir(parents=True)
    (day / "part.jsonl").write_text("".join(json.dumps(m) + "\n" for m in messages()) + "not json\n")
    ratings = ["tconst\taverageRating\tnumVotes", "tt0000001\t6.0\t40", "tt0000001\t6.0\t30", "tt0000003\t\\N\t\\N", "tt0000009\t9.9\t1"]
    lake.land_file(ratings, str(tmp_path / "raw"), "titles", "title.ratings", date(2026, 9, 18), "r.tsv")
    return tmp_path


def test_snapshot(spark, root):
    raw = lake.read_documents(spark, str(root / "raw/documents/movies"))
    films, seen = catalogue.aggregate(raw, lake.read_ratings(spark, str(root / "raw/titles/title.ratings")), lake.read_titles(spark, str(root / "raw/none")), "2026-09-20")
    by = {r["id"]: r for r in films.collect()}
    assert seen.get == {"raw_rows": 6, "usable_rows": 4} and sorted(by) == [1, 3, 4]
    one = by[1]
    assert (one["vote_average"], one["imdb_average_rating"], one["imdb_num_votes"]) == (Decimal("7.25"), Decimal("6.0"), 40)
    assert (one["rating_gap"], one["votes_ratio"], one["has_imdb_match"]) == (Decimal("1.25"), Decimal("0.2500"), True)
    assert (one["budget"], one["revenue"], one["original_language"]) == (None, 5000, "en")
    three = by[3]
    assert (three["vote_average"], three["release_date"], three["has_imdb_match"], three["imdb_start_year"]) == (None, None, False, None)
    assert by[4]["vote_average"] == Decimal("6.00") and by[4]["imdb_num_votes"] is None


def test_titles_keep_stray_quotes(spark, tmp_path):
    lines = ["\t".join(schemas.TITLES_DDL.replace(" string", "").split(", ")), 'tt1\tmovie\tA "stray\tx\t0\t1999\t\\N\t90\tDrama,War,Sport', "tt2\tshort\tb\tx\t0\t1999\t\\N\t9\tDrama", "tt3\tmovie\tc\tx\t0\t\\N\t\\N\t\\N\t\\N", "tt3\tmovie\tc\tx\t0\t2000\t\\N\t\\N\t\\N"]
    lake.land_file(lines, str(tmp_path), "t", "basics", date(2026, 1, 1), "b.tsv")
    rows = {r["tconst"]: r for r in lake.read_titles(spark, str(tmp_path / "t/basics")).collect()}
    assert sorted(rows) == ["tt1", "tt3"] and rows["tt1"]["imdb_genres"] == ["Drama", "War", "Sport"] and rows["tt3"]["imdb_start_year"] == 2000


def test_jobs_end_to_end(spark, root):
    paths = cli.Paths(str(root))
    assert [cli.run_job(spark, paths, name) for name in ("aggregate", "load", "quality")] == [0, 0, 0]
    live = mart.MartStore(spark, paths.mart).read()
    counts = {r["table_name"]: r["n_rows"] for r in views.row_counts(live).collect()}
    assert counts == {
        "genres": 2, "collections": 1, "production_companies": 1, "countries": 1, "languages": 1, "people": 3, "movies": 3, "movie_genres": 3, "movie_production_companies": 1,
        "movie_production_countries": 1, "movie_spoken_languages": 1, "movie_cast": 2, "movie_crew": 1, "movies_with_imdb": 1,
    }
    assert live["movie_crew"].first()["credit_id"] == "w0" and live["countries"].first()["iso_3166_1"] == "FR"
    assert {r["character"] for r in live["movie_cast"].collect()} == {"Hero", None}
    assert live["production_companies"].first()["origin_country"] is None
    runs = {r["job"]: r for r in read_runs(spark, paths.runs).collect()}
    assert runs["aggregate"]["rejected_rows"] == 2 and runs["aggregate"]["imdb_matched"] == 1 and {r["status"] for r in runs.values()} == {"success"}
    assert {r["job"] for r in views.last_runs(read_runs(spark, paths.runs)).collect()} == set(runs)
    cli.report(spark, paths, str(root / "report"))
    verdicts = spark.read.option("header", True).csv(str(root / "report/before_after"))
    assert verdicts.count() == 49 and verdicts.where("verdict = 'to do'").count() == 0
    stats = {r["genre"]: r for r in views.genre_stats(live).collect()}
    assert stats["Drama"]["movies"] == 2 and stats["War"]["avg_rating_gap"] == 1.25
    assert views.movie_detail(live, 1).first()["directors"] == "Person 102"
    assert [r["name"] for r in views.movie_cast(live, 1).collect()] == ["Person 100", "Person 101"]
    assert [r["id"] for r in views.find_movies(live, "no v").collect()] == [3] and views.find_movies(live, "%").count() == 0
    assert views.rating_gap_top(live, 1, 1).count() == 1 and views.list_movies(live).count() == 3
    for name, n in (("controls", 49), ("run", 1), ("tables", 13), ("fill_movies", 31), ("numbers", 7)):
        assert spark.read.option("header", True).csv(str(root / "report" / name)).count() == n
    store = mart.MartStore(spark, paths.mart)
    one = lake.read_snapshot(spark, paths.snapshots).where("id = 1")
    mart.upsert_film(spark, one, store)
    assert {r["table_name"]: r["n_rows"] for r in views.row_counts(store.read()).collect()} == counts
    with pytest.raises(ValueError):
        mart.upsert_film(spark, one.where("false"), store)
    with pytest.raises(NoOpenRun):
        current_run(None)
    live = store.read()
    assert views.cardinalities(live).count() == 6 and views.kpi_impact(live, live).where("delta <> 0").count() == 0


def test_empty_lake_is_skipped(spark, tmp_path):
    paths = cli.Paths(str(tmp_path))
    assert [cli.run_job(spark, paths, n) for n in ("aggregate", "load", "quality")] == [0, 0, 0]
    assert {r["status"] for r in read_runs(spark, paths.runs).collect()} == {"skipped"}


def frame(spark, table, *rows):
    kind = schemas.struct_type(schemas.MART[table][1])
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)


def film(i, **more):
    return {"id": i, "title": f"Film {i}", "adult": False, "has_imdb_match": False, "loaded_at": datetime(2026, 1, 2), "source_fetched_at": datetime(2026, 1, 1), "ingest_date": date(2026, 1, 1), "status": "Released", **more}


def dirty(spark):
    t = {
        "genres": frame(spark, "genres", {"id": 1, "name": "Drama"}, {"id": 2, "name": " drama "}, {"id": 3, "name": "Orphan"}),
        "collections": frame(spark, "collections", {"id": 5, "name": "Saga", "poster_path": "bad.gif"}),
        "production_companies": frame(spark, "production_companies", {"id": 9, "name": "Co", "origin_country": "xx"}),
        "countries": frame(spark, "countries", {"iso_3166_1": "FR", "name": "France"}, {"iso_3166_1": "f", "name": "Bad"}),
        "languages": frame(spark, "languages", {"iso_639_1": "en", "name": "English"}, {"iso_639_1": "EN", "name": "Bad"}),
        "people": frame(spark, "people", {"id": 100, "name": "P", "gender": 7, "known_for_department": "Nowhere", "popularity": Decimal("-1")}, {"id": 101, "name": "Q", "gender": 1}, {"id": 102, "name": "Orphan", "gender": 1}),
        "movies": frame(
            spark, "movies",
            film(1, imdb_id="tt0000001", vote_count=5, vote_average=Decimal("11"), collection_id=5, original_language="zz", runtime=None, imdb_runtime_minutes=95, homepage="ftp://x", budget=5, status="Lost", tagline=" x "),
            film(2, imdb_id="tt0000001", vote_count=9, collection_id=77, release_date=date(1700, 1, 1), popularity=Decimal("-2")),
            film(3, imdb_id="nonsense", vote_count=0, vote_average=Decimal("5"), imdb_average_rating=Decimal("6"), imdb_num_votes=10, has_imdb_match=True, rating_gap=Decimal("3"), votes_ratio=Decimal("1")),
        ),
        "movie_genres": frame(spark, "movie_genres", {"movie_id": 1, "genre_id": 1}, {"movie_id": 1, "genre_id": 2}, {"movie_id": 8, "genre_id": 1}, {"movie_id": 3, "genre_id": 9}),
        "movie_production_companies": frame(spark, "movie_production_companies", {"movie_id": 1, "company_id": 9}),
        "movie_production_countries": frame(spark, "movie_production_countries", {"movie_id": 1, "country_id": "FR"}, {"movie_id": 2, "country_id": "fr"}),
        "movie_spoken_languages": frame(spark, "movie_spoken_languages", {"movie_id": 1, "language_id": "en"}),
        # the same role twice: the stale credit would win the order, so it must go first
        "movie_cast": frame(spark, "movie_cast", {"credit_id": "a", "movie_id": 1, "person_id": 100, "character": "X", "cast_order": 0}, {"credit_id": "b", "movie_id": 1, "person_id": 100, "character": "X", "cast_order": 3}, {"credit_id": "z", "movie_id": 1, "person_id": 101, "character": None, "cast_order": -1}),
        "movie_crew": frame(spark, "movie_crew", {"credit_id": "d1", "movie_id": 1, "person_id": 100, "department": "Directing", "job": "Director"}, {"credit_id": "d2", "movie_id": 1, "person_id": 100, "department": "Nowhere", "job": "Director"}),
    }
    staged = {name: df.where("false") for name, df in t.items()}
    for name in mart.LINKS:
        staged[name] = t[name]
    staged["movies"] = t["movies"].where("id = 1")
    staged["movie_cast"] = t["movie_cast"].where("credit_id <> 'a'")
    return t, staged


def test_cleaning_a_dirty_mart(spark):
    t, staged = dirty(spark)
    held = quality.controls(AS_OF)
    assert len(held) == 49 and len({c.control_id for c in held}) == 49
    with_load = lambda m: {**m, **{f"staged:{k}": v for k, v in staged.items()}}
    before = C.results(with_load(t), held)
    found = {r["control_id"]: r["anomaly_rows"] for r in before.collect()}
    expected = {
        "UNI-02": 1, "UNI-04": 1, "UNI-05": 1, "UNI-06": 1, "VAL-01": 1, "VAL-02": 1, "VAL-06": 1, "VAL-07": 1, "VAL-08": 1, "VAL-09": 3, "VAL-10": 1, "VAL-11": 1, "VAL-12": 1, "VAL-13": 1,
        "VAL-14": 3, "VAL-15": 2, "VAL-16": 2, "COH-01": 1, "COH-02": 0, "COH-03": 1, "COH-04": 1, "COH-09": 1, "INT-01": 3, "INT-02": 1, "INT-03": 3, "INT-04": 1,
    }
    assert {k: found[k] for k in expected} == expected
    evidence = C.anomalies(with_load(t), held, quality.KEYS).groupBy("control_id").count().collect()
    assert {r["control_id"]: r["count"] for r in evidence} == {k: n for k, n in found.items() if n}
    cleaned, journal = quality.clean(t, AS_OF, staged)
    entries = journal.collect()
    by = {r["id"]: r for r in cleaned["movies"].collect()}
    assert (by[1]["imdb_id"], by[2]["imdb_id"], by[3]["imdb_id"]) == (None, "tt0000001", None)
    assert (by[1]["runtime"], by[1]["collection_id"], by[2]["collection_id"], by[1]["tagline"], by[1]["vote_average"]) == (95, 5, None, "x", None)
    assert (by[3]["imdb_average_rating"], by[3]["has_imdb_match"], by[3]["rating_gap"], by[3]["votes_ratio"]) == (None, False, None, None)
    assert {r["credit_id"] for r in cleaned["movie_cast"].collect()} == {"b", "z"}
    assert {r["credit_id"] for r in cleaned["movie_crew"].collect()} == {"d1"}
    assert {r["id"] for r in cleaned["genres"].collect()} == {1, 2} and {r["id"] for r in cleaned["people"].collect()} == {100, 101}
    gone = {(e["table_name"], e["record_key"]) for e in entries if e["action"] == "delete"}
    kept = {(n, r["k"]) for n in t for r in cleaned[n].select(F.expr(quality.KEYS[n]).alias("k")).collect()}
    every = {(n, r["k"]) for n in t for r in t[n].select(F.expr(quality.KEYS[n]).alias("k")).collect()}
    assert every - kept == gone
    assert C.violations(cleaned, quality.target_constraints(AS_OF)).where("violations > 0").collect() == []
    after = C.results(with_load(cleaned), held)
    verdicts = {r["control_id"]: r["verdict"] for r in C.verdicts(before, after, held).collect()}
    assert {k for k, v in verdicts.items() if v == "to do"} == {"COM-03"}  # two of three films have no length to impute
    assert verdicts["INT-01"] == "fixed" and verdicts["UNI-06"] == "accepted"
    again, second = quality.clean(cleaned, AS_OF, staged)
    assert second.count() == 0
    labelled = before.withColumn("phase", F.lit("b")).join(spark.createDataFrame([(c.control_id, c.dimension) for c in held], "control_id string, dimension string"), "control_id")
    scores = C.dimension_scores(labelled).collect()
    assert len(scores) == 6 and any(r["dimension"] is None for r in scores)


def test_merge_keeps_absent_films_and_purges(spark):
    t, _ = dirty(spark)
    staged = {name: df.where("false") for name, df in t.items()}
    staged["movies"] = frame(spark, "movies", film(1, title="New title"))
    staged["movie_genres"] = frame(spark, "movie_genres", {"movie_id": 1, "genre_id": 1})
    out = mart.merge(t, staged)
    assert {r["id"]: r["title"] for r in out["movies"].collect()} == {1: "New title", 2: "Film 2", 3: "Film 3"}
    assert {tuple(r) for r in out["movie_genres"].collect()} == {(1, 1), (8, 1), (3, 9)}
    assert out["movie_cast"].count() == 0 and out["people"].count() == 0 and {r["id"] for r in out["genres"].collect()} == {1}
    gone = spark.createDataFrame([(3,)], "movie_id int")
    deleted = mart.delete_movies(t, gone)
    assert deleted["movies"].count() == 2 and deleted["movie_genres"].count() == 3
    assert {r["id"]: r["collection_id"] for r in mart.null_missing_collections(t)["movies"].collect()} == {1: 5, 2: None, 3: None}


def test_a_failed_commit_changes_nothing(spark, tmp_path):
    store = mart.MartStore(spark, str(tmp_path / "m"))
    t, _ = dirty(spark)
    store.commit(t)
    bad = dict(t)
    bad["people"] = t["people"].withColumn("gender", F.expr("cast(raise_error('no') as smallint)"))
    with pytest.raises(Exception):
        store.commit(bad)
    assert store.read()["people"].count() == 3


def test_runs_and_lock(spark, tmp_path):
    path = str(tmp_path / "runs")
    with pytest.raises(ZeroDivisionError), LoadRun(spark, path, "a"):
        1 / 0
    with LoadRun(spark, path, "b"):
        raise Skip("nothing")
    assert {(r["job"], r["status"]) for r in read_runs(spark, path).collect()} == {("a", "failed"), ("b", "skipped")}
    lock = str(tmp_path / "x" / "lock")
    with pipeline_lock(lock) as first, pipeline_lock(lock, 0.2) as second:
        assert first and not second
    with pipeline_lock(lock) as third:
        assert third


def test_stream_lands_once_with_manifests(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("".join(json.dumps(m) + "\n" for m in messages()))
    base, checkpoint = str(tmp_path / "raw"), str(tmp_path / "cp")
    for _ in range(2):
        landing.land(landing.message_stream(spark, str(source)), base, checkpoint, "documents", "movies").awaitTermination()
    landed = lake.read_documents(spark, os.path.join(base, "documents/movies"))
    assert landed.count() == 5
    volume = lake.lake_volumes(spark, base).first()
    assert (volume["rows"], volume["files"], volume["partitions"], volume["rows_latest"]) == (5, 1, 1, 5)


def test_latest_state_is_merged_from_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "cp")
    for k in range(2):
        (source / f"{k}.json").write_text("".join(json.dumps({"movie_id": i, "fetched_at": f"2026-01-0{k + 1}", "source": str(k)}) + "\n" for i in range(k, 3)))
        landing.upsert_latest(landing.message_stream(spark, str(source)).select("movie_id", "fetched_at", "source"), target, checkpoint, "movie_id", "fetched_at").awaitTermination()
    with open(os.path.join(target, "current.json")) as f:
        rows = spark.read.parquet(os.path.join(target, json.load(f)["version"])).collect()
    assert {r["movie_id"]: r["source"] for r in rows} == {0: "0", 1: "1", 2: "1"}


def test_tumbling_windows_as_stream_and_batch(spark, tmp_path):
    rows = [(datetime(2026, 1, 1, 0, m), "a", 1.0) for m in range(0, 59, 7)] + [(datetime(2026, 1, 1, 5), "b", 2.0)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double")
    events.write.parquet(str(tmp_path / "e"))
    batch = sorted(map(tuple, landing.tumbling_counts(events).collect()))
    stream = landing.tumbling_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("tumbling").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from tumbling").collect())) == batch[:1] and landing.lag(q) in (None, 0)


def test_metrics(spark):
    at = lambda s: datetime(2026, 1, 1, 0, 0, s)
    rows = [("c", {"job": "a"}, at(0), 1.0), ("c", {"job": "a"}, at(10), 5.0), ("c", {"job": "a"}, at(20), 2.0), ("c", {"job": "b"}, at(20), 7.0), ("d", {}, at(0), 9.0)]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double")
    held = M.matching(samples, "c")
    assert M.combined(held, "sum").first()["value"] == 9.0
    assert {r["job"]: r["value"] for r in M.combined(held, "max", ("job",)).collect()} == {"a": 2.0, "b": 7.0}
    assert M.combined(M.matching(samples, "c", equal={"job": "a"}), "count").first()["value"] == 1
    end = F.lit(at(20))
    grown = {r["labels"]["job"]: (r["increase"], r["rate"]) for r in M.increase(held, 60, end).collect()}
    assert grown == {"a": (6.0, 0.1), "b": (0.0, 0.0)}
    assert {r["changes"] for r in M.changes(held, 60, end).collect()} == {2, 0}
    assert spark.range(1).select(M.guarded_ratio(F.lit(3.0), F.lit(0.0))).first()[0] == 3.0
    gauge = M.gauge(spark.createDataFrame([("t", 3)], "table_name string, n int"), "rows", "n", ("table_name",), F.lit(at(0)))
    assert gauge.first()["labels"] == {"table_name": "t"}
