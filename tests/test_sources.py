import json
from datetime import datetime
from io import BytesIO
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from cityflux.sources import readers, rest, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_json_pages_in_both_shapes(spark, tmp_path):
    write(tmp_path / "p/a.json", json.dumps([{"unique_key": "1"}, {"unique_key": "2", "extra": 1}]))
    write(tmp_path / "p/b.json", json.dumps({"data": [{"unique_key": "3"}]}, indent=1))
    out = readers.json_pages(spark, str(tmp_path / "p"), readers.COMPLAINTS)
    assert sorted(r["unique_key"] for r in out.collect()) == ["1", "2", "3"]
    write(tmp_path / "p/c.json", '"text"')
    with pytest.raises(Exception, match="neither a list"):
        readers.json_pages(spark, str(tmp_path / "p"), readers.COMPLAINTS).collect()
    assert readers.json_array(spark, str(tmp_path / "p/a.json"), readers.COMPLAINTS).count() == 2


def payload(**changes):
    hourly = {k: ["2025-01-01T00:00", "2025-01-01T01:00"] if k == "time" else [0.0, 1.0] for k in readers.HOURLY_KEYS}
    return {"latitude": 1.0, "longitude": 2.0, "elevation": 3.0, "timezone": "America/New_York", "hourly": hourly} | changes


def test_weather_payload(spark, tmp_path):
    good = readers.weather(spark, write(tmp_path / "w.json", json.dumps(payload())))
    assert [(r["time"], r["rain"], r["weather_code"]) for r in good.orderBy("time").collect()] == [(datetime(2025, 1, 1, 0), 0.0, 0), (datetime(2025, 1, 1, 1), 1.0, 1)]
    with pytest.raises(Exception, match="payload"):
        readers.weather(spark, write(tmp_path / "z.json", json.dumps(payload(timezone="UTC")))).collect()
    short = payload()
    short["hourly"] = {**short["hourly"], "rain": [0.0]}
    with pytest.raises(Exception, match="payload"):
        readers.weather(spark, write(tmp_path / "s.json", json.dumps(short))).collect()


def test_zone_lookup_keeps_na(spark, tmp_path):
    rows = readers.zone_lookup(spark, write(tmp_path / "z.csv", "LocationID,Borough,Zone,service_zone\n264,Unknown,N/A,N/A\n1,EWR,,EWR\n")).orderBy("LocationID").collect()
    assert [(r["LocationID"], r["Zone"]) for r in rows] == [(1, None), (264, "N/A")]


def test_lineage(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t"))
    out = readers.with_lineage(readers.parquet(spark, str(tmp_path / "t")), "yellow_taxi", "r", "2025-01-01 00:00:00", 2025, 1)
    assert out.columns == ["id", *readers.LINEAGE]
    assert out.first()["_source_file"].startswith("file:")


def test_paging_stops_on_a_short_page():
    asked = []

    def get(url):
        asked.append(url)
        return json.dumps([{"d": "2025-01-01", "k": 2 * len(asked) + i} for i in range(2 if len(asked) < 3 else 1)]).encode()

    assert [len(p) for p in rest.pages("http://x", "d", "k", rest.KeyRange("2025-01-01", "2025-02-01"), 2, get)] == [2, 2, 1]
    assert "offset" not in asked[2]
    part = rest.KeyRange("a", "b")
    with pytest.raises(ValueError, match="list"):
        list(rest.pages("http://x", "d", "k", part, 2, lambda url: b"{}"))
    with pytest.raises(ValueError, match="lacks"):
        list(rest.pages("http://x", "d", "k", part, 1, lambda url: b'[{"d": "a"}]'))
    with pytest.raises(ValueError, match="apart"):
        list(rest.pages("http://x", "d", "k", part, 1, lambda url: b'[{"d": "a", "k": 1}]'))
    halves = rest.ranges(["2025-01-01T00:00:00", "2025-02-01T00:00:00", "2025-03-01T00:00:00"], 2)
    assert [(x.start, x.end) for x in halves[:2]] == [("2025-01-01T00:00:00", "2025-01-16T12:00:00.000"), ("2025-01-16T12:00:00.000", "2025-02-01T00:00:00")]
    assert len(halves) == 4


class Portal:
    """A local server over SQLite, into which ``between`` may put records before each answer."""

    def __init__(self, rows, between=lambda portal, n: None):
        import sqlite3
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
        from urllib.parse import parse_qs, urlparse

        self.db, self.lock, self.answers = sqlite3.connect(":memory:", check_same_thread=False), threading.Lock(), 0
        self.db.execute("CREATE TABLE t (unique_key TEXT, created_date TEXT)")
        self.put(rows)
        portal = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                with portal.lock:
                    portal.answers += 1
                    between(portal, portal.answers)
                    sql = f"SELECT {q.get('$select', '*')} FROM t WHERE {q.get('$where', '1')} ORDER BY {q['$order']} LIMIT {q['$limit']}"
                    found = portal.db.execute(sql)
                    body = json.dumps([dict(zip([c[0] for c in found.description], r, strict=True)) for r in found]).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def put(self, rows):
        self.db.executemany("INSERT INTO t VALUES (?, ?)", rows)


def records(first, n, month=1):
    return [(f"k'{k:05d}", f"2025-{month:02d}-{1 + k % 28:02d}T{k % 5:02d}:00:00.000") for k in range(first, first + n)]


def test_records_that_arrive_between_pages(spark):
    spark.dataSource.register(rest.PagedSource)
    old = records(0, 300) + records(1000, 50, 2)
    portal = Portal(old, lambda p, n: p.put(records(5000 + 20 * n, 20)))
    read = spark.read.format("paged_rest").option("url", portal.url).option("months", "2025-01-01T00:00:00.000,2025-02-01T00:00:00.000,2025-03-01T00:00:00.000").option("page", 7)
    for splits in (1, 4):
        df = read.option("splits", splits).load()
        assert df.rdd.getNumPartitions() == 2 * splits
        keys = [r["unique_key"] for r in df.select("unique_key").collect()]
        assert len(keys) == len(set(keys))  # none twice
        assert set(keys) >= {k for k, _ in old}  # none lost
    portal.server.shutdown()


def test_a_stream_of_records_keeps_its_place(spark, tmp_path):
    spark.dataSource.register(rest.PagedSource)
    portal = Portal(records(0, 90))
    events = lambda: spark.readStream.format("paged_rest").option("url", portal.url).option("page", 8).load().select("unique_key")
    run = lambda: events().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    for n, month in ((0, 1), (40, 2), (0, 2), (25, 3)):
        portal.put(records(1000 * month, n, month))
        assert run().awaitTermination(120)
    keys = [r["unique_key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(keys) == sorted(k for k, _ in records(0, 90) + records(2000, 40, 2) + records(3000, 25, 3))
    portal.server.shutdown()


def test_retries():
    waits, tries = [], []

    def failing(url):
        tries.append(url)
        if len(tries) < 3:
            raise HTTPError(url, 503, "busy", {}, None)
        return BytesIO(b"ok")

    assert rest.fetch("http://x", failing, waits.append) == b"ok"
    assert waits == [2.0, 4.0]

    def missing(url):
        raise HTTPError(url, 404, "none", {}, None)

    with pytest.raises(HTTPError):
        rest.fetch("http://x", missing, waits.append)


def test_publish_swaps_or_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.publish(spark.range(3), path, 3) == 3
    with pytest.raises(ValueError, match="expected"):
        sinks.publish(spark.range(5), path, 4)

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        sinks.publish(spark.range(5), path, check=refuse)
    assert spark.read.parquet(path).count() == 3
    assert sinks.publish(spark.range(5), path, 5) == 5
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_replaced_partitions_leave_others(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda y, n: spark.range(n).withColumn("y", F.lit(y))
    rows(2024, 3).unionAll(rows(2025, 3)).write.partitionBy("y").parquet(path)
    sinks.replace_partitions(rows(2025, 1), path, ["y"])
    assert {r["y"]: r["count"] for r in spark.read.parquet(path).groupBy("y").count().collect()} == {2024: 3, 2025: 1}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    once = sinks.upserted(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, sinks.upserted(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    assert sinks.upsert_counts(old, new, ["k"]) == (1, 1)
    assert sinks.upsert_counts(once, new, ["k"]) == (2, 0)
    assert sorted(map(tuple, sinks.inserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]
    with pytest.raises(ValueError, match="twice"):
        sinks.upserted(old, new.unionAll(new), ["k"])


def test_months_of_a_report_are_replaced(spark):
    old = spark.createDataFrame([("2025-01", 1), ("2025-02", 2)], "month string, n int")
    assert [tuple(r) for r in sinks.replace_months(old, spark.createDataFrame([("2025-02", 5)], "month string, n int")).collect()] == [("2025-01", 1), ("2025-02", 5)]


def test_manifest_and_its_verification(spark, tmp_path):
    for n, t in (("a", "1"), ("b", "22"), ("c", "3")):
        write(tmp_path / f"raw/{n}", t)
    sinks.manifest(spark, str(tmp_path / "raw")).write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    write(tmp_path / "raw/a", "2")
    write(tmp_path / "raw/b", "222")
    write(tmp_path / "raw/d", "4")
    (tmp_path / "raw/c").unlink()
    got = {r["file"].rsplit("/", 1)[1]: r["status"] for r in sinks.verified(base, sinks.manifest(spark, str(tmp_path / "raw"))).collect()}
    assert got == {"a": "SHA256_CHANGED", "b": "FILE_SIZE_CHANGED", "c": "MISSING", "d": "UNEXPECTED"}


def test_registry_watermark_and_runs(spark):
    files = spark.createDataFrame([("f1", "h1"), ("f2", "h2"), ("f1", "h9")], "file string, sha256 string")
    log = spark.createDataFrame([("p", "f1", "h1", "SUCCESS"), ("p", "f2", "h2", "FAILED"), ("q", "f1", "h9", "SUCCESS")], "pipeline string, file string, sha256 string, status string")
    assert sorted(map(tuple, sinks.pending(files, log, "p").collect())) == [("f1", "h9"), ("f2", "h2")]
    marks = spark.createDataFrame([("p", 3), ("p", 2)], "pipeline string, watermark int")
    assert sinks.watermark(marks, "p") == 3
    run = sinks.Run("r", "p", "silver")
    with pytest.raises(ValueError, match="reconcile"):
        run.succeed(10, 8, 1, 1, 1)
    for quarantined in (1, 3):  # records, not events: as many as were rejected
        with pytest.raises(ValueError, match="reconcile"):
            run.succeed(10, 8, 2, quarantined, 3)
    with pytest.raises(ValueError, match="reconcile"):
        run.succeed(10, 8, 2, 2, 1)
    done = run.succeed(10, 8, 2, 2, 3)
    assert (done.status, done.quarantined, done.events) == ("SUCCESS", 2, 3)
    with pytest.raises(ValueError, match="SUCCESS"):
        done.fail("late")
    assert run.fail("x").error == "x"
    assert sinks.batch_key("p", "2025-01", "h") == "p|2025-01|sha256=h"


def test_log_lines(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "run_id string, rows_read bigint"
    sinks.append_log(spark, path, [{"run_id": "a", "rows_read": 1}], schema)
    sinks.append_log(spark, path, [{"run_id": "b"}], schema)
    assert sorted((r["run_id"], r["rows_read"]) for r in spark.read.schema(schema).json(path).collect()) == [("a", 1), ("b", None)]


def test_database_tables(spark):
    url, driver = "jdbc:derby:memory:cityflux;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(1, 101).select(F.col("id").alias("K"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("NAME"))
    assert sinks.to_jdbc(rows, url, "STAGE", driver=driver) == 100
    assert sinks.to_jdbc(rows.where("K > 40"), url, "STAGE", driver=driver) == 60  # replaced, not added to
    back = readers.jdbc(spark, url, "STAGE", "K", (1, 100), 4, driver=driver)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in rows.where("K > 40").collect())
