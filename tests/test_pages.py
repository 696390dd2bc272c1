import json
import threading
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from signalloom.sources import feeds, pages

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


class Service:
    """A feature layer of `rows` features, a day apart, that answers in pages of at most `cap`; `requests` has what was asked."""

    def __init__(self, rows, cap=1000, refuses=False, marks=True, field="F_INICIO"):
        self.rows, self.cap, self.refuses, self.marks, self.field, self.requests = rows, cap, refuses, marks, field, []
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                service.requests.append(asked)
                body = json.dumps(service.answer(asked)).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/query"

    def answer(self, asked):
        found = range(self.rows)
        if asked["where"] != "1=1":
            if self.refuses:
                return {"error": {"code": 400, "message": "Invalid field"}}
            for clause in asked["where"].split(" AND "):
                field, sign, _, day, hour = clause.split(" ")
                assert field == self.field
                at = datetime.fromisoformat(f"{day} {hour}".strip("'")).replace(tzinfo=timezone.utc)
                found = [i for i in found if (self.at(i) >= at if sign == ">=" else self.at(i) <= at)]
        if "returnCountOnly" in asked:
            return {"count": len(found)}
        offset, size = int(asked["resultOffset"]), min(self.cap, int(asked["resultRecordCount"]))
        part = list(found)[offset : offset + size]
        features = [{"id": str(i), "geometry": {"type": "Point", "coordinates": [-71.5, -33]}, "properties": {self.field: int(self.at(i).timestamp() * 1000), "n": i}} for i in part]
        return {"features": features} | ({"exceededTransferLimit": True} if self.marks and offset + len(part) < len(found) else {})

    @staticmethod
    def at(i):
        return START + timedelta(days=i, milliseconds=500)

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.server.shutdown()


def ids(df):
    return sorted(int(r["feature_id"]) for r in feeds.features(df).collect())


@pytest.mark.parametrize("marks", [True, False])
@pytest.mark.parametrize("total", [1, 37, 40, 60])
def test_a_service_that_caps_its_pages_loses_no_row(spark, marks, total):
    """The counted read goes on within each range; a count that has grown old costs nothing where pages are marked."""
    with Service(40, cap=3, marks=marks) as s:
        want = range(40) if marks or total >= 40 else None
        got = ids(pages.pages(spark, s.url, page_rows=10, total=total))
        assert got == list(want) if want is not None else got == list(range(len(got))) and len(got) >= total
        if marks:
            assert ids(pages.pages(spark, s.url, page_rows=10)) == list(range(40))


def test_short_files_and_greedy_services(spark, tmp_path):
    for at, mark in ((0, True), (2, False)):
        features = [{"id": str(at + i), "geometry": None, "properties": {}} for i in range(2)]
        (tmp_path / f"p{at}.json").write_text(json.dumps({"features": features, "exceededTransferLimit": mark}))
    url = f"file://{tmp_path}/p{{offset}}.json"
    assert pages.pages(spark, url, page_rows=4, total=4).count() == pages.pages(spark, url, page_rows=4).count() == 2
    assert ids(pages.pages(spark, url, page_rows=4, total=4)) == [0, 1, 2, 3]
    with pytest.raises(Exception, match="leave out total"):  # more rows than asked for would be read twice
        pages.pages(spark, url, page_rows=1, total=4).collect()


def test_time_filters_reach_the_service(spark):
    with Service(30) as s:
        at = lambda i: F.lit(Service.at(i).replace(tzinfo=None).isoformat(" ")).cast("timestamp")
        rows = pages.layer(spark, s.url, "F_INICIO", (F.col("F_INICIO") > at(3)) & (F.col("F_INICIO") <= at(20)) & F.col("feature").contains("properties"), page_rows=8)
        assert {r["where"] for r in s.requests} == {"F_INICIO >= timestamp '2024-01-04 00:00:00' AND F_INICIO <= timestamp '2024-01-21 00:00:01'"}
        assert sorted(int(r["resultOffset"]) for r in s.requests) == [0, 8, 16]
        got = rows.select("feature", "refused").collect()
        assert sorted(json.loads(r["feature"])["properties"]["n"] for r in got) == list(range(4, 21)) and {r["refused"] for r in got} == {None}
        # Queries over one answer do not disturb each other, nor ask again.
        assert (rows.where(F.col("F_INICIO") > at(15)).count(), rows.count(), rows.where(F.col("F_INICIO") < at(6)).count()) == (5, 17, 2)
        assert len(s.requests) == 3
        assert pages.layer(spark, s.url, "F_INICIO").count() == 30 and s.requests[-1]["where"] == "1=1"
        assert ids(rows.where(F.col("F_INICIO") >= at(19)).select(pages.as_payload(F.col("feature")).alias("payload"))) == [19, 20]


def test_a_refused_predicate_is_asked_without(spark):
    with Service(12, refuses=True) as s:
        got = pages.layer(spark, s.url, "F_INICIO", F.col("F_INICIO") >= F.lit("2024-01-11 00:00:00").cast("timestamp"), page_rows=5).collect()
        assert sorted(json.loads(r["feature"])["properties"]["n"] for r in got) == [10, 11]
        assert {r["refused"] for r in got} == {"F_INICIO >= timestamp '2024-01-11 00:00:00'"}
        assert [r["where"] for r in s.requests] == ["F_INICIO >= timestamp '2024-01-11 00:00:00'", "1=1", "1=1", "1=1"]
    with Service(1, field="OTHER") as s:
        assert [r["F_INICIO"] for r in pages.layer(spark, s.url, "F_INICIO").collect()] == [None]


def test_moments():
    assert pages.moment(1706700000000) == pages.moment("2024-01-31T11:20:00Z") == pages.moment("2024-01-31 08:20:00-03:00") == datetime(2024, 1, 31, 11, 20, tzinfo=timezone.utc)
    assert [pages.moment(x) for x in (None, "soon", True, 1e30, "")] == [None] * 5


def test_a_polled_service_survives_restarts(spark, tmp_path):
    def run(s):
        stream = pages.polled(spark, s.url, page_rows=4)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        return ids(spark.read.parquet(str(tmp_path / "out")))

    with Service(10, cap=3, marks=False) as s:
        assert run(s) == list(range(10))
        s.rows = 17
        s.requests.clear()
        assert run(s) == list(range(17))
        assert min(int(r["resultOffset"]) for r in s.requests if "resultOffset" in r) == 10
        assert run(s) == list(range(17))
