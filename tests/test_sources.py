"""Remote sources with a fake client, optional sinks, retention."""

import gzip
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from reelmill.sources import lake, remote, sinks


class FakeClient:
    lists = ["popular", "new"]

    def page(self, name, number):
        ids = {("popular", 1): [1, 2], ("popular", 2): [3], ("new", 1): [4]}[name, number]
        return [{"source": "s", "endpoint": name, "movie_id": i, "fetched_at": "2026-01-01T00:00:00Z", "schema_version": 1, "payload": {"id": i}} for i in ids], 2 if name == "popular" else 1


def test_walker_goes_around_and_resumes():
    walker = remote.CatalogueWalker({"client": "tests.test_sources:FakeClient", "batch": "3"})
    at = walker.initialOffset()
    seen = []
    for _ in range(3):
        rows, end = walker.read(at)
        rows = list(rows)
        assert rows == list(walker.readBetweenOffsets(at, end))
        seen += [r[2] for r in rows]
        at = end
    assert seen == [1, 2, 3, 4, 1, 2, 3, 4, 1]


def test_walker_as_a_stream(spark, tmp_path):
    spark.dataSource.register(remote.CatalogueSource)
    stream = spark.readStream.format("catalogue").option("client", "tests.test_sources:FakeClient").option("batch", "2").load()
    q = stream.writeStream.format("memory").queryName("walked").option("checkpointLocation", str(tmp_path)).start()
    try:
        for _ in range(60):
            rows = spark.sql("select movie_id, get_json_object(payload, '$.id') as id from walked").collect()
            if len(rows) >= 4 or q.awaitTermination(1):
                break
    finally:
        q.stop()
    assert len(rows) >= 4 and all(str(r["movie_id"]) == r["id"] for r in rows)


def test_requests_wait_when_told_to():
    answers, waits = [(429, {"Retry-After": "3"}, b""), (500, {}, b""), (200, {}, b'{"a": 1}')], []
    assert remote.get_json("u", opener=lambda u, h: answers.pop(0), sleep=waits.append) == {"a": 1}
    assert waits == [3.0, 2.0]
    with pytest.raises(remote.Unavailable):
        remote.get_json("u", opener=lambda u, h: (404, {}, b""), sleep=waits.append)


def test_download_lands_once(spark, tmp_path):
    body = gzip.compress("tconst\taverageRating\tnumVotes\ntt1\t5.0\t9\n".encode())
    calls = []
    opener = lambda u, h: calls.append(u) or (200, {}, body)
    first = remote.download("http://x/title.ratings.tsv.gz", str(tmp_path), "titles", "r", date(2026, 1, 1), opener)
    second = remote.download("http://x/title.ratings.tsv.gz", str(tmp_path), "titles", "r", date(2026, 1, 1), opener)
    assert (first["rows"], second["skipped"], len(calls)) == (2, True, 1)
    assert lake.read_ratings(spark, str(tmp_path / "titles/r")).first()["imdb_num_votes"] == 9
    assert "".join(x + "\n" for x in remote.inflated(iter([body[:10], body[10:]]))) == gzip.decompress(body).decode()
    manifest = json.loads(next((tmp_path / "titles/r/ingest_date=2026-01-01").glob("_manifest-*")).read_text())
    assert manifest["rows"] == 2
    gauges = sinks.lake_gauges(lake.lake_volumes(spark, str(tmp_path)), F.lit(datetime(2026, 1, 2)))
    assert {r["metric"]: r["value"] for r in gauges.collect()}["lake_rows"] == 2.0


def test_retention(spark):
    runs = spark.createDataFrame([("a", datetime(2026, 1, 1)), ("b", datetime(2026, 3, 1)), ("c", datetime(2026, 3, 9))], "run_id string, started_at timestamp")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "run_id string, n int")
    kept = sinks.retained(runs, rows, rows, datetime(2026, 3, 10))
    assert [sorted(r["run_id"] for r in df.collect()) for df in kept] == [["b", "c"], ["b", "c"], ["c"]]
