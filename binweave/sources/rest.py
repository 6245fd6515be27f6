"""A paginated REST day feed as a Spark data source: one partition a day, retries with back-off, and clear outcomes.

A page is JSON {"code": 0, "data": {...}, "paginationToken": "..."}; the token leads to the next page. No first page (404)
means a day without data; a later one missing, a token that repeats or a code other than 0 fails the day.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "day string, page int, state string, body string"
RETRIED = (429, 500, 502, 503, 504)


class Missing(Exception):
    """404, or a file that isn't there."""


class Failed(Exception):
    """A status that may pass, with what the server says of when to try again."""

    def __init__(self, status: int, retry_after: str | None = None):
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after


def retry_after(text: str | None, now: datetime | None = None) -> float | None:
    """Seconds to wait by a Retry-After header, which has seconds or an HTTP date; None if it has neither."""
    if text is None:
        return None
    if text.strip().isdigit():
        return float(text)
    try:
        at = parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None
    return max(0.0, (at - (now or datetime.now(timezone.utc))).total_seconds())


def with_retries(get: Callable[[], str], tries: int = 5, first_s: float = 1.0, most_s: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """get(), again after a doubling wait where it fails for a while; a server's own wait comes first. Missing and other failures pass through."""
    for n in range(tries):
        try:
            return get()
        except Failed as e:
            if n == tries - 1 or e.status not in RETRIED:
                raise
            own = retry_after(e.retry_after) if e.status == 429 else None
            sleep(min(most_s, first_s * 2**n) if own is None else own)
    raise AssertionError


def http_get(url: str) -> str:
    """The body at a URL (http, https or file)."""
    from urllib.error import HTTPError, URLError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=60) as r:
            return r.read().decode()
    except HTTPError as e:
        if e.code == 404:
            raise Missing(url) from e
        raise Failed(e.code, e.headers.get("Retry-After")) from e
    except URLError as e:
        if isinstance(e.reason, FileNotFoundError):
            raise Missing(url) from e
        raise Failed(503) from e


def day_pages(day: str, page_url: Callable[[str, str | None], str], get: Callable[[str], str] = http_get, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[str, int, str, str | None]]:
    """Rows of SCHEMA of one day: its pages with state ok, or one row no_data; a page that can't be had makes the day failed at that page."""
    token, seen, number = None, set(), 0
    while True:
        number += 1
        try:
            body = with_retries(lambda: get(page_url(day, token)), sleep=sleep)
            page = json.loads(body)
        except Missing:
            yield day, number, "no_data" if number == 1 else "failed", None
            return
        except (Failed, ValueError):
            yield day, number, "failed", None
            return
        if page.get("code", 0) != 0:
            yield day, number, "failed", body
            return
        yield day, number, "ok", body
        token = (page.get("data") or {}).get("paginationToken")
        if not token:
            return
        if token in seen:
            yield day, number + 1, "failed", None
            return
        seen.add(token)


class _Day(InputPartition):
    def __init__(self, day: str):
        self.day = day


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        a, b = date.fromisoformat(self.options["first"]), date.fromisoformat(self.options["last"])
        return [_Day((a + timedelta(days=k)).isoformat()) for k in range((b - a).days + 1)]

    def read(self, partition: _Day) -> Iterator[tuple]:
        template = self.options["url"]
        yield from day_pages(partition.day, lambda day, token: template.format(day=day, token=token or "first"))


class _Poll(DataSourceStreamReader):
    """Whole days as they become complete: an offset is the first day not read yet, a batch the days between two offsets, one task each.

    `last` is the newest complete day (yesterday, if not given), asked anew by every poll. The checkpoint keeps the offsets, so that a query
    that stops goes on with the next day; a batch that is tried again reads the same days.
    """

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"day": self.options["first"]}

    def latestOffset(self) -> dict:
        last = self.options.get("last") or (datetime.now(timezone.utc).date() - timedelta(days=1)).isoformat()
        return {"day": max(self.options["first"], (date.fromisoformat(last) + timedelta(days=1)).isoformat())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = date.fromisoformat(start["day"]), date.fromisoformat(end["day"])
        return [_Day((a + timedelta(days=k)).isoformat()) for k in range((b - a).days)]

    def read(self, partition: _Day) -> Iterator[tuple]:
        return _Reader(self.options).read(partition)


class DayPages(DataSource):
    """format("day_pages"): options url (with {day} and {token}), first and last (dates); as a stream last may be left out."""

    @classmethod
    def name(cls) -> str:
        return "day_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Poll(dict(self.options))


def days(spark: SparkSession, url: str, first: str, last: str):
    """The pages of a span of days, one task a day."""
    spark.dataSource.register(DayPages)
    return spark.read.format("day_pages").option("url", url).option("first", first).option("last", last).load()


def polled_days(spark: SparkSession, url: str, first: str, last: str | None = None):
    """The pages of complete days as a stream that can stop and go on."""
    spark.dataSource.register(DayPages)
    stream = spark.readStream.format("day_pages").option("url", url).option("first", first)
    return (stream.option("last", last) if last else stream).load()
