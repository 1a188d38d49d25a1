"""Weekly downloads from a tracker as a batch data source: a partition a week.

Each week is fetched by its own task, with pauses that grow by equal steps between the
tries; a week that fails gives a row with the reason, and never fails the others. Rows
are what :func:`corvidex.sources.store.manifest` reads; ``content`` is the feed as it came.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "week_start date, week_end date, ok boolean, rows long, error string, content string"


def get(url: str, timeout: float) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read().decode("utf-8", "replace")


def fetched(url: str, tries: int = 1, pause: float = 1.0, timeout: float = 30.0, fetch: Callable[[str, float], str] = get, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer of an address; after the n-th failed try it waits n pauses."""
    for n in range(1, tries + 1):
        try:
            return fetch(url, timeout)
        except OSError:
            if n == tries:
                raise
            sleep(n * pause)
    raise ValueError("tries must be 1 or more")


class Week(InputPartition):
    def __init__(self, start: date, end: date, url: str):
        self.start, self.end, self.url = start, end, url


class WeeklyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.weeks = [x.split("|", 2) for x in options["weeks"].split("\n")]
        self.tries, self.pause, self.timeout = int(options.get("tries", 1)), float(options.get("pause", 1)), float(options.get("timeout", 30))

    def partitions(self) -> list[InputPartition]:
        return [Week(date.fromisoformat(a), date.fromisoformat(b), url) for a, b, url in self.weeks]

    def read(self, partition: Week) -> Iterator[tuple]:
        try:
            text = fetched(partition.url, self.tries, self.pause, self.timeout)
            yield partition.start, partition.end, True, text.count("<item>"), None, text
        except OSError as e:
            yield partition.start, partition.end, False, 0, str(e)[:200], None


class WeeklySource(DataSource):
    """Options: weeks (lines of start|end|address), tries, pause and timeout in seconds."""

    @classmethod
    def name(cls) -> str:
        return "weekly"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WeeklyReader(self.options)


def download(spark: SparkSession, requests: DataFrame, **options: object) -> DataFrame:
    """Rows of :data:`SCHEMA` for (week_start, week_end, url): some hundred weeks at most, so the list is the driver's."""
    spark.dataSource.register(WeeklySource)
    weeks = "\n".join(f"{r.week_start}|{r.week_end}|{r.url}" for r in requests.select("week_start", "week_end", "url").collect())
    return spark.read.format("weekly").options(weeks=weeks, **options).load()
