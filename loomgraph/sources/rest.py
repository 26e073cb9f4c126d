"""A REST source of articles as a Python data source: one row per id, batches of ids as partitions.

    spark.dataSource.register(ArticleSource)
    spark.read.format("articles").option("ids", "PMC1,PMC2").option("urls", "https://host/a/{id};https://host/b/{id}").load()

Each url pattern is tried in turn.  Transient failures are repeated after a growing pause; an article that
the service says it lacks gives the status ``unavailable``; anything else that fails gives ``error``.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers of a server that are worth another try, and the body that says an article is absent.
AGAIN = {429, 500, 502, 503, 504}
ABSENT = "No result can be found"


def fetch(url: str, timeout: float) -> tuple[str, str]:
    """Content type and body."""
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.headers.get("Content-Type", ""), r.read().decode("utf-8", "replace")


def article(paper: str, urls: list[str], tries: int = 3, pause: float = 2.0, timeout: float = 45.0, get: Callable[[str, float], tuple[str, str]] = fetch, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str, str, str]:
    """(id, status, payload, error)."""
    error = "no url"
    for url in urls:
        for attempt in range(tries):
            try:
                kind, body = get(url.replace("{id}", paper), timeout)
            except urllib.error.HTTPError as e:
                error = f"HTTP {e.code}"
                if e.code not in AGAIN:
                    break
            except (urllib.error.URLError, TimeoutError, OSError) as e:
                error = str(e)
            else:
                if body.lstrip().startswith("[Error]") and ABSENT in body:
                    return paper, "unavailable", "", ""
                if "json" in kind.lower():
                    return paper, "ok", body, ""
                error = f"content type {kind}"
                break
            if attempt + 1 < tries:
                sleep(pause * 2**attempt)
    return paper, "error", "", error


class Ids(InputPartition):
    def __init__(self, ids: list[str]) -> None:
        self.ids = ids


class ArticleReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ids = [x.strip() for x in options.get("ids", "").split(",") if x.strip()]
        self.urls = [x for x in options.get("urls", "").split(";") if x]
        self.batch, self.tries, self.pause = int(options.get("batch", 50)), int(options.get("tries", 3)), float(options.get("pause", 2))

    def partitions(self) -> list[Ids]:
        return [Ids(self.ids[k : k + self.batch]) for k in range(0, len(self.ids), self.batch)] or [Ids([])]

    def read(self, partition: Ids) -> Iterator[tuple]:
        for paper in partition.ids:
            yield article(paper, self.urls, self.tries, self.pause)


class ArticleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return "id string, status string, payload string, error string"

    def reader(self, schema) -> ArticleReader:  # noqa: ANN001
        return ArticleReader(self.options)
