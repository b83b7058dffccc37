"""Web search as a Python data source; offline it reads recorded answers.

An engine is a class with ``search(query, limit)`` that returns hits
(``link``, ``title``, ``snippet``).  Engines are found by name.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENGINES: dict[str, type] = {}


def engine(name: str):
    """Register an engine under a name."""

    def add(cls: type) -> type:
        ENGINES[name] = cls
        return cls

    return add


@engine("recorded")
class Recorded:
    """Answers from a dictionary of queries, given as JSON."""

    def __init__(self, options: dict[str, str]):
        self.answers = json.loads(options.get("answers", "{}"))

    def search(self, query: str, limit: int) -> list[dict]:
        return self.answers.get(query, [])[:limit]


class Refused(Exception):
    """The service refused a key or asked for fewer calls (403, 429)."""


def http_post(url: str, headers: dict[str, str], payload: dict, timeout: float = 30) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {**headers, "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code in (403, 429):
            raise Refused(str(e.code)) from e
        raise


@engine("http")
class Http:
    """A search service that answers a POST with ``organic`` hits; options ``url``, ``keys`` (a JSON list), ``domains``, ``delay``, ``calls_per_key``, ``retries``.

    Keys take turns after so many calls, and at once when one is refused; then
    the query is tried again, each time after twice the wait.  A query that
    fails for good has no hits.
    """

    def __init__(self, options: dict[str, str], post: Callable[..., dict] = http_post, sleep: Callable[[float], None] = time.sleep):
        self.url, self.keys, self.domains = options.get("url", ""), json.loads(options.get("keys", "[]")), json.loads(options.get("domains", "[]"))
        if not self.keys:
            raise ValueError("a search service needs a key")
        self.delay, self.calls_per_key, self.retries = float(options.get("delay", "1")), int(options.get("calls_per_key", "100")), int(options.get("retries", "2"))
        self.extra = json.loads(options.get("payload", "{}"))
        self.post, self.sleep, self.at, self.calls = post, sleep, 0, 0

    def rotate(self) -> None:
        self.at, self.calls = (self.at + 1) % len(self.keys), 0

    def headers(self) -> dict[str, str]:
        if self.calls >= self.calls_per_key:
            self.rotate()
        self.calls += 1
        return {"X-API-KEY": self.keys[self.at]}

    def search(self, query: str, limit: int) -> list[dict]:
        payload = {**self.extra, "q": domain_locked(query, self.domains), "num": limit}
        for k in range(self.retries + 1):
            self.sleep(self.delay)
            try:
                return [hit for hit in self.post(self.url, self.headers(), payload).get("organic", []) if hit.get("link")]
            except Refused:
                if k < self.retries:
                    self.rotate()
                    self.sleep(self.delay * 2**k)
            except Exception:
                return []
        return []


class _Task(InputPartition):
    def __init__(self, ord: int, query: str):
        self.ord, self.query = ord, query


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Task(i, q) for i, q in enumerate(json.loads(self.options.get("queries", "[]")))] or [_Task(0, "")]

    def read(self, task: InputPartition) -> Iterator[tuple]:
        name = self.options.get("engine") or "recorded"
        if name not in ENGINES:
            raise ValueError(f"no search engine {name!r}; there are {sorted(ENGINES)}")
        limit = int(self.options.get("limit", "10"))
        for i, hit in enumerate(ENGINES[name](self.options).search(task.query, limit) if task.query else []):
            if hit.get("link"):
                yield task.ord, i, task.query, hit["link"], hit.get("title") or "No Title", hit.get("snippet") or ""


class SearchSource(DataSource):
    """``spark.read.format("websearch").option("queries", json_list)``: a partition for each query."""

    @classmethod
    def name(cls) -> str:
        return "websearch"

    def schema(self) -> str:
        return "task int, ord int, query string, link string, title string, snippet string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(SearchSource)


def domain_locked(query: str, domains: list[str]) -> str:
    """A query that only the given sites answer."""
    return f"{query} ({' OR '.join(f'site:{d}' for d in domains)})" if domains else query


def results(spark, tasks: DataFrame, engine: str, options: dict[str, str], limit: int = 10) -> DataFrame:
    """Hits of all search tasks (``task``, ``query``, ``priority``): ``task``, ``priority``, ``ord``, ``query``, ``link``, ``title``, ``snippet``.

    Tasks are configuration, of which there are few; each is a partition of the
    source.
    """
    register(spark)
    plan = tasks.select("task", "query", "priority").orderBy("task").collect()
    reader = spark.read.format("websearch").option("engine", engine).option("limit", str(limit)).option("queries", json.dumps([r.query for r in plan]))
    for key, value in options.items():
        reader = reader.option(key, value)
    places = spark.createDataFrame([(i, r.task, r.priority) for i, r in enumerate(plan)], "place int, number int, priority int")
    hits = reader.load().join(F.broadcast(places), F.col("task") == F.col("place"))
    return hits.select(F.col("number").alias("task"), "priority", (F.col("number") * 1000 + F.col("ord")).alias("ord"), "query", "link", "title", "snippet")
