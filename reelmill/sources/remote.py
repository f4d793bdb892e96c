"""Remote sources: a paginated catalogue interface read as a stream, and bulk files landed in the raw zone.

Requests go through an ``opener(url, headers) -> (status, headers, body)``; the default uses urllib, tests pass their own.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from datetime import date, datetime, timezone

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from reelmill.sources.lake import land_file

Opener = Callable[[str, dict], tuple[int, dict, bytes]]


def open_url(url: str, headers: dict) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class Unavailable(Exception):
    """The source answered, but not with what was asked for."""


def get_json(url: str, headers: dict | None = None, opener: Opener = open_url, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON behind ``url``; waits as long as the source asks when it is asked too often."""
    for k in range(tries):
        status, answer, body = opener(url, headers or {})
        if status == 200:
            return json.loads(body)
        if status != 429 and status < 500:
            break
        named = {k.lower(): v for k, v in answer.items()}
        sleep(float(named.get("retry-after", 2**k)))
    raise Unavailable(f"{status} from {url}")


def inflated(chunks: Iterator[bytes]) -> Iterator[str]:
    """Lines of a gzipped stream, without holding it."""
    unzip, rest = zlib.decompressobj(wbits=47), b""
    for chunk in chunks:
        *whole, rest = (rest + unzip.decompress(chunk)).split(b"\n")
        for line in whole:
            yield line.decode("utf-8", "replace")
    rest += unzip.flush()
    if rest:
        yield rest.decode("utf-8", "replace")


def download(url: str, base: str, source: str, dataset: str, on: date | None = None, opener: Opener = open_url) -> dict:
    """Land a gzipped bulk file as the day's partition; a day that is there already is left alone."""
    day = on or datetime.now(timezone.utc).date()
    name = url.rsplit("/", 1)[-1].removesuffix(".gz")

    def lines() -> Iterator[str]:
        status, _, body = opener(url, {})
        if status != 200:
            raise Unavailable(f"{status} from {url}")
        yield from inflated(iter([body]))

    return land_file(lines(), base, source, dataset, day, name)


class CatalogueWalker(SimpleDataSourceStreamReader):
    """Walks pages of several lists for ever; the offset says where: ``{"list", "page", "item"}``.

    The client, ``module:factory`` in the option ``client``, has ``lists`` and ``page(list, number) -> (items, n_pages)``,
    where an item is a message of the envelope's form. After the last page of the last list the first list comes again.
    """

    def __init__(self, options: dict) -> None:
        module, factory = options["client"].split(":")
        self.client = getattr(importlib.import_module(module), factory)()
        self.batch = int(options.get("batch", "200"))

    def initialOffset(self) -> dict:
        return {"list": 0, "page": 1, "item": 0}

    def _walk(self, at: dict) -> Iterator[tuple[tuple, dict]]:
        """Messages from ``at`` on, each with the offset after it."""
        k, page, item = at["list"], at["page"], at["item"]
        while True:
            name = self.client.lists[k]
            items, n_pages = self.client.page(name, page)
            last = page >= n_pages
            for i in range(item, len(items)):
                m = items[i]
                nxt = {"list": k, "page": page, "item": i + 1}
                if i + 1 == len(items):
                    nxt = {"list": (k + 1) % len(self.client.lists), "page": 1, "item": 0} if last else {"list": k, "page": page + 1, "item": 0}
                yield (m["source"], m["endpoint"], m["movie_id"], m["fetched_at"], m["schema_version"], json.dumps(m["payload"])), nxt
            k, page, item = ((k + 1) % len(self.client.lists), 1, 0) if last else (k, page + 1, 0)
            if k == at["list"] and page == at["page"]:
                return  # once around: what is new waits for the next batch

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], start
        for row, nxt in self._walk(start):
            rows.append(row)
            end = nxt
            if len(rows) == self.batch:
                break
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same messages again, for a batch that is run a second time."""
        rows = []
        for row, nxt in self._walk(start):
            rows.append(row)
            if nxt == end or len(rows) == self.batch:
                break
        return iter(rows)


class CatalogueSource(DataSource):
    """``spark.readStream.format("catalogue").option("client", "module:factory")``; the payload comes as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "source string, endpoint string, movie_id bigint, fetched_at string, schema_version int, payload string"

    def simpleStreamReader(self, schema) -> CatalogueWalker:
        return CatalogueWalker(self.options)
