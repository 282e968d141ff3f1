"""A paged REST collection as a Spark data source, for batches and streams.

    spark.dataSource.register(RestSource)
    spark.read.format("rest").schema("number long, title string").option("url", ...).option("client", "module:function").load()
    spark.readStream.format("rest")...   offsets are numbers of items, kept in the query's checkpoint

The client is a function (url, params) -> (status, headers, body) that executors can import, so tests and mirrors need no network. Items are
flat rows by their names. A page is asked for again by the rules of `get`; a page that does not come in the end is an error, never the end of
the collection: that is an answer with fewer items than a page holds, or one without a next link where links are followed.

Options: per_page, delay, `most` (items at all), `partitions` (readers that take every n-th page and share one limit of requests), `tokens`
(names of environment variables, comma-separated: one reader for each, sent as the parameter `token`, each under a limit of its own), `follow`
(links: one reader that goes along the next links).
"""

from __future__ import annotations

import importlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from mergelens.operators import ranks
from mergelens.storage import table

LINK = re.compile(r'<([^>]+)>;\s*rel="([^"]+)"')


def links(header: str | None) -> dict[str, str]:
    """Addresses by relation of a Link header."""
    return {m[2]: m[1] for part in (header or "").split(",") if (m := LINK.search(part))}


class Pace:
    """At least `delay` seconds between requests; where no more than `buffer` are left, a pause until the limit is reset."""

    def __init__(self, delay: float = 0.3, buffer: int = 10, clock: Callable = time.time, sleep: Callable = time.sleep):
        self.delay, self.buffer, self.clock, self.sleep = delay, buffer, clock, sleep
        self.last, self.left, self.reset = float("-inf"), None, 0.0

    def before(self) -> None:
        if self.left is not None and self.left <= self.buffer and self.reset > self.clock():
            self.sleep(self.reset - self.clock() + 1)
            self.left = None
        if (wait := self.last + self.delay - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()

    def after(self, headers: dict) -> None:
        if "X-RateLimit-Remaining" in headers:
            self.left, self.reset = int(headers["X-RateLimit-Remaining"]), float(headers.get("X-RateLimit-Reset", 0))


class Unavailable(Exception):
    """A page that did not come: what was read is not the whole collection."""


def get(client: Callable, url: str, params: dict | None, pace: Pace, tries: int = 5):
    """(body, headers), or (None, headers) for what is not there. 429 waits as long as it is told and a second, 403, 502, 503 and broken
    connections 2, 3, 5, 9, ... seconds; after `tries` that is Unavailable."""
    headers: dict = {}
    said: object = "no answer"
    for k in range(tries):
        pace.before()
        try:
            status, headers, body = client(url, params or {})
        except (ConnectionError, TimeoutError) as e:
            said = e
            pace.sleep(2**k + 1)
            continue
        pace.after(headers)
        if status == 200:
            return body, headers
        said = status
        if status == 429:
            pace.sleep(int(headers.get("Retry-After", 60)) + 1)
        elif status in (403, 502, 503):
            pace.sleep(2**k + 1)
        else:
            return None, headers
    raise Unavailable(f"{url} {params}: {said} after {tries} tries")


def page_of(client: Callable, url: str, params: dict | None, pace: Pace) -> tuple[list, dict]:
    """A page that must be there."""
    body, headers = get(client, url, params, pace)
    if body is None:
        raise Unavailable(f"{url} {params} is not there")
    return body, headers


def pages(client: Callable, url: str, pace: Pace, size: int = 100, most: int | None = None) -> Iterator[dict]:
    """Items of all pages: along the next links if there are any, else by page number until a page is short."""
    params: dict | None = {"per_page": size, "page": 1}
    given, where = 0, url
    while where:
        body, headers = page_of(client, where, params, pace)
        for item in body:
            if most is not None and given >= most:
                return
            given += 1
            yield item
        following = links(headers.get("Link")).get("next")
        if following:
            where, params = following, None
        elif params and len(body) == size:
            params = params | {"page": params["page"] + 1}
        else:
            return


def named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Pages(InputPartition):
    """Every step-th page from the first on, or the items from start to end; token: the environment variable that has it."""

    def __init__(self, first: int, step: int, token: str | None = None, start: int | None = None, end: int | None = None):
        self.first, self.step, self.token, self.start, self.end = first, step, token, start, end


class Asked:
    """What batch and stream readers share."""

    def __init__(self, schema, options):
        self.names, self.options = [f.name for f in schema.fields], dict(options)
        self.size, self.url = int(self.options.get("per_page", 100)), self.options["url"]
        self.most = int(self.options["most"]) if "most" in self.options else None
        self.tokens = [t for t in self.options.get("tokens", "").split(",") if t]

    def client(self) -> Callable:
        return named(self.options["client"])

    def pace(self, shared: int = 1) -> Pace:
        return Pace(float(self.options.get("delay", 0.3)) * shared)

    def params(self, page: int, token: str | None) -> dict:
        return {"per_page": self.size, "page": page} | ({"token": os.environ[token]} if token else {})

    def row(self, item: dict) -> tuple:
        return tuple(json.dumps(v) if isinstance(v := item.get(k), dict | list) else v for k in self.names)


class RestReader(DataSourceReader):
    def __init__(self, schema, options):
        self.asked = Asked(schema, options)

    def partitions(self):
        x = self.asked
        if x.options.get("follow") == "links":
            return [Pages(1, 1, *x.tokens[:1])]
        if x.tokens:
            return [Pages(k + 1, len(x.tokens), token) for k, token in enumerate(x.tokens)]
        n = int(x.options.get("partitions", 1))
        return [Pages(k + 1, n) for k in range(n)]

    def read(self, part):
        x = self.asked
        client, pace, page = x.client(), x.pace(1 if part.token else part.step), part.first
        if x.options.get("follow") == "links":
            for item in pages(client, x.url, pace, x.size, x.most):
                yield x.row(item)
            return
        while x.most is None or (page - 1) * x.size < x.most:
            body, _ = page_of(client, x.url, x.params(page, part.token), pace)
            left = len(body) if x.most is None else x.most - (page - 1) * x.size
            for item in body[:left]:
                yield x.row(item)
            if len(body) < x.size:
                return
            page += part.step


class RestStreamReader(DataSourceStreamReader):
    """A collection that only grows at its end. An offset is the number of items; a batch has up to `pages_per_batch` pages, dealt to a task each
    or to the tokens by turns. As the checkpoint keeps the offsets, a batch that failed is read again, from the same item to the same."""

    def __init__(self, schema, options):
        self.asked = Asked(schema, options)
        self.at = 0

    def initialOffset(self):
        return {"items": 0}

    def latestOffset(self):
        x = self.asked
        client, pace, n = x.client(), x.pace(), self.at
        for _ in range(int(x.options.get("pages_per_batch", 100))):
            page = n // x.size + 1
            body, _ = page_of(client, x.url, x.params(page, x.tokens[0] if x.tokens else None), pace)
            n = max(n, (page - 1) * x.size + len(body))
            if len(body) < x.size:
                break
        if x.most is not None:
            n = min(n, x.most)
        self.at = n
        return {"items": n}

    def partitions(self, start, end):
        x, first, last = self.asked, start["items"], end["items"]
        self.at = max(self.at, last)
        cuts = [(p, max(first, (p - 1) * x.size), min(last, p * x.size)) for p in range(first // x.size + 1, (last - 1) // x.size + 2)] if last > first else []
        return [Pages(p, 1, x.tokens[i % len(x.tokens)] if x.tokens else None, a, b) for i, (p, a, b) in enumerate(cuts)]

    def read(self, part):
        x = self.asked
        body, _ = page_of(x.client(), x.url, x.params(part.first, part.token), x.pace())
        some = body[part.start - (part.first - 1) * x.size : part.end - (part.first - 1) * x.size]
        if len(some) < part.end - part.start:
            raise Unavailable(f"{x.url}: page {part.first} has lost items")
        for item in some:
            yield x.row(item)

    def commit(self, end):
        pass


class RestSource(DataSource):
    @classmethod
    def name(cls):
        return "rest"

    def schema(self):
        return "number long, title string"

    def reader(self, schema):
        return RestReader(schema, self.options)

    def streamReader(self, schema):
        return RestStreamReader(schema, self.options)


def collect(repositories: DataFrame, client: str, out: str, delay: float = 0.3, size: int = 100, most: int | None = None, batch: int = 100) -> None:
    """The items of many repositories (repo, url), one folder for each (repo=..., JSON text in `item`), some `batch` repositories to a job.

    What a finished job wrote stays, and only repositories without a folder are asked for, so a call after a failure goes on where the other stopped and
    doubles nothing; a repository without items has a row without one. Repositories with the same name are one, with the smallest address."""
    spark, item = repositories.sparkSession, "repo string, item string"

    def fetch(frames):
        pace = Pace(delay)
        for frame in frames:
            for repo, url in zip(frame["repo"], frame["url"], strict=True):
                found = [json.dumps(x) for x in pages(named(client), url, pace, size, most)] or [None]
                yield pd.DataFrame({"repo": repo, "item": found})

    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    every = repositories.where("repo is not null").groupBy("repo").agg(F.min("url").alias("url"))
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        every = every.join(spark.read.schema(item).parquet(out).select("repo").distinct(), "repo", "left_anti")
    todo = table(ranks.positions(every, ["repo"]).withColumn("job", F.floor(F.col("position") / batch)), "todo")
    for job in range(int((todo.agg(F.max("job")).first()[0] if not todo.isEmpty() else -1)) + 1):
        mine = todo.where(F.col("job") == job).select("repo", "url").repartition(batch, "repo")
        mine.mapInPandas(fetch, item).write.mode("append").partitionBy("repo").parquet(out)


def collected(spark: SparkSession, out: str) -> DataFrame:
    """All that `collect` wrote, in one frame: repo, item."""
    return spark.read.schema("repo string, item string").parquet(out).where("item is not null")
