"""Spark data sources for map services that answer in pages.

`pages` has a row a page, with the page's text as `payload`, as a table or as a stream that polls the service; `layer`
has a row a feature and turns filters on the time of features into the service's own predicate.
"""

from __future__ import annotations

import json
import math
import time
import warnings
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from signalloom.tables import materialise


def feature_query(offset: int, size: int, where: str = "1=1", order: str | None = None) -> dict:
    """Parameters of a page of a feature layer as GeoJSON."""
    more = {"orderByFields": order} if order else {}
    return {"where": where, "outFields": "*", "outSR": 4326, "returnGeometry": "true", "resultOffset": offset, "resultRecordCount": size, "f": "geojson", **more}


def wfs_query(layer: str | None, version: str = "2.0.0", most: int | None = None) -> dict:
    """Parameters of a WFS request, whose names depend on the version; without a layer there is nothing to ask for."""
    if not layer:
        raise ValueError("a WFS source needs its layer")
    second = version.startswith("2")
    found = {"service": "WFS", "version": version, "request": "GetFeature", "typeNames" if second else "typeName": layer, "outputFormat": "application/json", "srsName": "EPSG:4326"}
    return found | ({"count" if second else "maxFeatures": most} if most else {})


def more_pages(page: dict, size: int) -> bool:
    """Whether a page says, by its mark or by being full, that others follow."""
    rows = len(page.get("features") or [])
    marks = [page.get("exceededTransferLimit"), (page.get("properties") or {}).get("exceededTransferLimit") if isinstance(page.get("properties"), dict) else None]
    return rows > 0 and (True in marks or rows >= size)


def fetched(url: str, tries: int = 3, wait: float = 1.0) -> str:
    """The answer of a URL (http, https, file). Timeouts, overload and server errors are tried again, other errors are not."""
    for k in range(tries):
        try:
            with urlopen(url, timeout=45) as answer:
                return answer.read().decode("utf-8")
        except HTTPError as e:
            if e.code not in (408, 429) and e.code < 500 or k == tries - 1:
                raise
        except (URLError, TimeoutError):
            if k == tries - 1:
                raise
        time.sleep(wait * 2**k)
    raise ValueError("no tries")


class Run(InputPartition):
    """Rows from an offset on, up to `end`; without an end, all that the service has. Up to `sure` a short page is not the last one."""

    def __init__(self, offset: int, end: int | None = None, sure: int = 0):
        self.offset, self.end, self.sure = offset, end, sure


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.kind = options["url"], options.get("kind", "features")
        self.size, self.most = int(options.get("page_rows", 1000)), int(options.get("most_pages", 50))
        self.total = int(options["total"]) if "total" in options else None
        self.where = options.get("where", "1=1")
        self.options = dict(options)
        if self.kind == "wfs":
            wfs_query(options.get("layer"))

    def partitions(self) -> list[Run]:
        """Where the rows are counted before, ranges of page_rows are tasks, and the last one takes what has come since; else one task follows the pages."""
        if self.kind != "features" or self.total is None:
            return [Run(0)]
        starts = range(0, max(1, self.total), self.size)
        return [Run(at, at + self.size, at + self.size) for at in starts[:-1]] + [Run(starts[-1], None, self.total)]

    def page_url(self, offset: int, rows: int | None = None) -> str:
        if "{offset}" in self.url:
            return self.url.replace("{offset}", str(offset))
        o = self.options
        query = wfs_query(o.get("layer"), o.get("version", "2.0.0"), int(o["most"]) if "most" in o else None) if self.kind == "wfs" else feature_query(offset, rows or self.size, self.where, o.get("order"))
        return f"{self.url}?{urlencode(query)}"

    def answers(self, run: Run) -> Iterator[tuple[int, str, dict]]:
        """(offset, text, page) of a run, by what the pages say: a service that gives fewer rows than asked for is asked for the rest."""
        offset = run.offset
        for k in range(10**9):
            # A range of known length may take as many pages as it needs; a walk without an end is bounded.
            if self.kind != "wfs" and offset >= run.sure and k >= self.most:
                raise RuntimeError(f"{self.url} has more than {self.most} pages: raise most_pages, or give total")
            ask = self.size if run.end is None else min(self.size, run.end - offset)
            text = fetched(self.page_url(offset, ask))
            page = json.loads(text)
            rows = len(page.get("features") or []) if isinstance(page, dict) else 0
            if run.end is not None and offset + rows > run.end:
                raise RuntimeError(f"{self.url} gave {rows} rows at {offset} where {ask} were asked for: leave out total")
            yield offset, text, page
            offset += rows
            if self.kind == "wfs" or not rows or offset == run.end or offset >= run.sure and not more_pages(page, ask):
                return

    def read(self, partition: Run) -> Iterator[tuple]:
        for offset, text, _ in self.answers(partition):
            yield offset, text


def moment(value) -> datetime | None:
    """A feature's time, in milliseconds since 1970 or as an ISO text (of UTC unless it says otherwise); None where it is neither."""
    try:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return datetime.fromtimestamp(value / 1000, timezone.utc)
        found = datetime.fromisoformat(str(value).strip())
        return found if found.tzinfo else found.replace(tzinfo=timezone.utc)
    except (ValueError, OverflowError, OSError):
        return None


class LayerReader(PageReader):
    """Features by row; comparisons of their time become a predicate of the request."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.time, self.clauses = options["time_field"], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes bounds of the time, rounded outwards to whole seconds as services know them; Spark applies all filters once more."""
        down, up = (GreaterThan, GreaterThanOrEqual), (LessThan, LessThanOrEqual)
        for f in filters:
            if isinstance(f, (*down, *up)) and f.attribute == (self.time,) and isinstance(f.value, datetime):
                at = (f.value if f.value.tzinfo else f.value.astimezone()).timestamp()
                at = datetime.fromtimestamp(math.floor(at) if isinstance(f, down) else math.ceil(at), timezone.utc)
                self.clauses.append(f"{self.time} {'>=' if isinstance(f, down) else '<='} timestamp '{at:%Y-%m-%d %H:%M:%S}'")
            yield f

    def partitions(self) -> list[Run]:
        # A count taken without the predicate says nothing about the rows that meet it.
        return [Run(0)] if self.clauses else super().partitions()

    def read(self, partition: Run) -> Iterator[tuple]:
        own = [] if self.where == "1=1" else [f"({self.where})"]
        wanted, refused = " AND ".join(own + self.clauses) or "1=1", None
        self.where = wanted
        pages = self.answers(partition)
        first, error = None, None
        try:
            first = next(pages)
            error = None if isinstance(first[2], dict) and "features" in first[2] else first[1][:200]
        except HTTPError as e:
            error = str(e)
        if error is not None:
            if wanted == "1=1":
                raise RuntimeError(f"{self.url} gave no features: {error}")
            warnings.warn(f"{self.url} refused {wanted} ({error}): asked without a predicate", stacklevel=2)
            refused, self.where = wanted, "1=1"
            pages = self.answers(Run(0))
            first = next(pages)
        page = first
        while page is not None:
            offset, _, body = page
            for feature in body["features"]:
                known = (feature or {}).get("properties") or {}
                yield offset, moment(known.get(self.time)), json.dumps(feature, ensure_ascii=False), refused
            page = next(pages, None)


class PageStream(DataSourceStreamReader):
    """Polls a service whose rows only grow in number, in a fixed order; the offset is the number of rows taken.

    Spark keeps the offsets in the checkpoint before it reads: a query that is started again reads the ranges that it
    had begun, and goes on after them.
    """

    def __init__(self, options: dict):
        self.reader = PageReader(options)
        self.count_url = options.get("count_url")

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        url = self.count_url or f"{self.reader.url}?{urlencode({'where': self.reader.where, 'returnCountOnly': 'true', 'f': 'json'})}"
        return {"rows": int(json.loads(fetched(url))["count"])}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        size = self.reader.size
        return [Run(at, min(at + size, end["rows"]), end["rows"]) for at in range(start["rows"], end["rows"], size)]

    def read(self, partition: Run) -> Iterator[tuple]:
        at = partition.offset
        for offset, text, page in self.reader.answers(partition):
            yield offset, text
            at = offset + len(page.get("features") or [])
        if at < partition.end:
            raise RuntimeError(f"{self.reader.url} counts {partition.end} rows and gives {at}")


class Pages(DataSource):
    """Options: url (a base, or a template with {offset}), kind (features or wfs), page_rows, most_pages, total, where, order; layer, version, most for wfs; count_url for streams."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page_offset long, payload string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:
        return PageStream(self.options)


class Layer(DataSource):
    """Options: those of pages for features, and time_field, the name of the features' time, which is a column too.

    `refused` has the predicate that the service did not take; the rows are then all that it has, filtered by Spark.
    """

    @classmethod
    def name(cls) -> str:
        return "layer"

    def schema(self) -> str:
        return f"page_offset long, `{self.options['time_field']}` timestamp, feature string, refused string"

    def reader(self, schema) -> LayerReader:
        return LayerReader(self.options)


def _options(url: str, options: dict) -> dict[str, str]:
    return {"url": url, **{k: str(v) for k, v in options.items()}}


def pages(spark: SparkSession, url: str, **options) -> DataFrame:
    """The pages of a service as rows of payload."""
    spark.dataSource.register(Pages)
    return spark.read.format("pages").options(**_options(url, options)).load()


def polled(spark: SparkSession, url: str, **options) -> DataFrame:
    """A stream of a service's pages of rows that it did not have before."""
    spark.dataSource.register(Pages)
    return spark.readStream.format("pages").options(**_options(url, options)).load()


def layer(spark: SparkSession, url: str, time_field: str, condition: Column | None = None, **options) -> DataFrame:
    """The features of a layer by row that meet the condition; its bounds of the time_field column reach the service.

    The answer is written as a table: Spark keeps the filters of a source's first query for the frame's later ones, so
    a frame that asks the service itself may be asked once only.
    """
    spark.dataSource.register(Layer)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("layer").options(**_options(url, options | {"time_field": time_field})).load()
    return materialise(rows if condition is None else rows.where(condition), "layer")


def as_payload(feature: Column) -> Column:
    """A feature as the collection of one that the normalisers read."""
    return F.concat(F.lit('{"type": "FeatureCollection", "features": ['), feature, F.lit("]}"))
