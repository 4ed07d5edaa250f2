"""Paged announcements as a Spark data source: one partition a company.

``fetch(code, page)`` gives {"total": n, "rows": [...] or None}; it is a plug-in, so tests and offline runs need no network.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Rows a page, pages at most, tries, and which statuses are tried again.
PAGE, MOST_PAGES, TRIES = 30, 40, 3
AGAIN = {408, 429, 500, 502, 503, 504}
SCHEMA = "code string, ord int, title string, ts_ms bigint, url string, size_kb int, ann_id string, error string"


class Refused(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def with_retries(call: Callable[[], dict], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: random.uniform(0, 0.6)) -> dict:
    """Tries again after 1, 2, 4... seconds (30 at most) plus jitter, where the status says that may help."""
    for n in range(tries):
        try:
            return call()
        except Refused as e:
            if n + 1 == tries or e.status not in AGAIN:
                raise
        except OSError:
            if n + 1 == tries:
                raise
        sleep(min(2.0**n + jitter(), 30.0))
    raise ValueError("tries must be 1 or more")


def pages_of(fetch: Callable[[str, int], dict], code: str, **retry) -> Iterator[tuple]:
    """Rows of SCHEMA. Pages end when one is empty or the total is reached; after an error, what was read stays, and the error is a row."""
    n = 0
    for page in range(1, MOST_PAGES + 1):
        try:
            got = with_retries(lambda page=page: fetch(code, page), **retry)
        except Exception as e:
            yield code, n, None, None, None, None, None, str(e)[:200]
            return
        rows = got.get("rows") or []
        for r in rows:
            yield code, n, r.get("title") or "", r.get("ts_ms"), r.get("url"), r.get("size_kb"), str(r.get("ann_id")), None
            n += 1
        if not rows or page * PAGE >= (got.get("total") or 0):
            return


def source(fetch: Callable[[str, int], dict], codes: list[str], name: str = "announcements") -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(source(fetch, codes))``."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(c) for c in codes]

        def read(self, partition):
            yield from pages_of(fetch, partition.value)

    class Announcements(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader()

    return Announcements
