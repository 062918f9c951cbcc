"""A paged HTTP source as a Python data source: ranges of time, keyset pages until a short one, retries with backoff.

A page begins behind the last record of the page before, by (time, key), not at an offset. So records that arrive while a range
is read shift nothing: each record that was there is read once, and new ones are read if they come behind the place reached.
The same places are the offsets of the stream, which Spark keeps in its checkpoint; a stream over a column that only grows (a
time of change, a running number) so reads every record once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import datetime
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE, RETRIES, BACKOFF = 50_000, 5, 2.0
RETRY_STATUS = {429, 500, 502, 503, 504}


def fetch(url: str, open_url=urlopen, wait=time.sleep) -> bytes:
    """The body of a URL; passing faults are tried again ``RETRIES`` times, each after twice the wait."""
    for attempt in range(RETRIES + 1):
        try:
            with open_url(url) as answer:
                return answer.read()
        except HTTPError as e:
            if e.code not in RETRY_STATUS or attempt == RETRIES:
                raise
        except URLError:
            if attempt == RETRIES:
                raise
        wait(BACKOFF * 2**attempt)
    raise AssertionError


class KeyRange(InputPartition):
    """Records from ``start`` (a bound of the field) or behind ``after`` (a place), below ``end`` or up to the place ``upto``."""

    def __init__(self, start: str = "", end: str = "", after: tuple[str, str] | None = None, upto: tuple[str, str] | None = None):
        super().__init__((start, end, after, upto))
        self.start, self.end, self.after, self.upto = start, end, after, upto


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _place(field: str, key: str, sign: str, place: tuple[str, str]) -> str:
    at, own = map(quoted, place)
    strict = sign.removesuffix("=")
    return f"({field} {strict} {at} OR ({field} = {at} AND {key} {sign} {own}))"


def pages(base: str, field: str, key: str, part: KeyRange, page: int = PAGE, get=fetch) -> Iterator[list[dict]]:
    """Pages of the records of a range, by (field, key), until one is short."""
    after = part.after
    while True:
        where = [_place(field, key, ">", after)] if after else [f"{field} >= {quoted(part.start)}"] if part.start else []
        where += [f"{field} < {quoted(part.end)}"] if part.end else []
        where += [_place(field, key, "<=", part.upto)] if part.upto else []
        query = {"$where": " AND ".join(where), "$order": f"{field},{key}", "$limit": page}
        rows = json.loads(get(f"{base}?{urlencode({k: v for k, v in query.items() if v != ''})}"))
        if not isinstance(rows, list):
            raise ValueError("a page isn't a list of records")
        yield rows
        if len(rows) < page:
            return
        last = rows[-1].get(field), rows[-1].get(key)
        if None in last:
            raise ValueError(f"a record lacks {field} or {key}, by which pages are read")
        if tuple(map(str, last)) == after:
            raise ValueError(f"{field} and {key} don't tell records apart")
        after = tuple(map(str, last))


def ranges(bounds: list[str], splits: int = 1) -> list[KeyRange]:
    """Half-open ranges between neighbouring bounds (ISO times), each cut into ``splits`` equally long ones."""
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        cuts = [a]
        if splits > 1:
            start, end = datetime.fromisoformat(a), datetime.fromisoformat(b)
            cuts += [(start + (end - start) * k / splits).isoformat(timespec="milliseconds") for k in range(1, splits)]
        cuts.append(b)
        out += [KeyRange(x, y) for x, y in zip(cuts, cuts[1:], strict=False)]
    return out


class _Pages:
    def __init__(self, schema, options):
        self.columns, self.options = [f.name for f in schema], dict(options)

    def _settings(self) -> tuple:
        o = self.options
        return o["url"], o.get("field", "created_date"), o.get("key", "unique_key")

    def read(self, partition):
        for rows in pages(*self._settings(), partition, int(self.options.get("page", PAGE))):
            for r in rows:
                yield tuple(None if r.get(c) is None else str(r[c]) for c in self.columns)


class PagedReader(_Pages, DataSourceReader):
    def partitions(self):
        return ranges(self.options["months"].split(","), int(self.options.get("splits", 1)))


class PagedStreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": "", "key": ""}

    def latestOffset(self) -> dict:
        base, field, key = self._settings()
        query = {"$select": f"{field},{key}", "$order": f"{field} DESC,{key} DESC", "$limit": 1}
        last = json.loads(fetch(f"{base}?{urlencode(query)}"))
        return {"at": str(last[0][field]), "key": str(last[0][key])} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        places = [(o["at"], o["key"]) if o["at"] else None for o in (start, end)]
        return [KeyRange(after=places[0], upto=places[1])] if places[1] and places[0] != places[1] else []

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """``spark.read.format("paged_rest")`` with url, months (comma-joined bounds), splits of a month, field, key and page; ``spark.readStream`` the same without months."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "unique_key string, created_date string, closed_date string, complaint_type string, agency string, borough string, latitude string, longitude string, incident_address string, status string, resolution_description string"

    def reader(self, schema):
        return PagedReader(schema, self.options)

    def streamReader(self, schema):
        return PagedStreamReader(schema, self.options)
