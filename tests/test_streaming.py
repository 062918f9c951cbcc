from pyspark.sql import functions as F

from cityflux.streaming import hourly as H


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    zone = (F.col("user_id") % 25).cast("int")
    cells = H.hourly(H.source(spark, str(tmp_path / "in"), events.schema, 1), "ts", zone, "40 days")
    for _ in range(2):  # a second run finds nothing new
        q = H.start(cells, str(tmp_path / "out"), str(tmp_path / "state"))
        assert q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = events.groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), zone.alias("zone_id")).agg(F.count_if(F.col("event_type") == "purchase").alias("trips"), F.count_if(F.col("event_type") == "error").alias("complaints"))
    assert got.select(want.columns).exceptAll(want).count() == 0
    assert got.count() == want.count()


ROWS = "ts timestamp_ntz, user_id long, event_type string, value double"


def feed(spark, path, batches, first=0):
    """Files in the order of their batches."""
    import os

    for k, batch in enumerate(batches, first):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.parquet(str(path / f"b{k}"))
        for p in (path / f"b{k}").glob("*.parquet"):
            os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
            p.rename(path / f"{k}.parquet")


def some(r, n, low, high):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    return [(start + timedelta(hours=r.uniform(low, high)), r.randrange(40), r.choice(["purchase", "error", "view"]), round(r.random() * 50, 2)) for _ in range(n)]


def test_late_rows_are_counted_and_merged(spark, tmp_path, monkeypatch):
    import random
    from datetime import timedelta

    import pytest

    from cityflux.plans import loading
    from cityflux.sources import sinks
    from cityflux.streaming import late as L

    r = random.Random(6)
    batches = [some(r, 200, 700, 740), some(r, 200, 735, 800), some(r, 150, 790, 850) + some(r, 60, 600, 780) + [(None, 1, "purchase", 1.0)], some(r, 40, 0, 5) + some(r, 100, 840, 870)]
    (tmp_path / "in").mkdir()
    feed(spark, tmp_path / "in", batches)
    root, zone = str(tmp_path / "out"), F.col("user_id") % 25
    stream = lambda: L.start(H.source(spark, str(tmp_path / "in/*.parquet"), ROWS, 1), root, str(tmp_path / "state"), "ts", zone, "10 hours")
    for fault in ("after_parts", "before_mark"):  # the batch that broke off runs again
        with monkeypatch.context() as m, pytest.raises(Exception, match=fault):
            m.setenv(sinks.FAILPOINTS, fault)
            stream().awaitTermination(180)
    assert L.parts(spark, root).count() == 0
    assert stream().awaitTermination(180)
    assert stream().awaitTermination(180)

    late, high = {}, None
    for batch in batches:
        for at, *_ in batch:
            if at is None or (high is not None and at < high - timedelta(hours=10)):
                month = at and at.strftime("%Y-%m")
                late[month] = late.get(month, 0) + 1
        high = max(x[0] for x in batch if x[0] is not None and (high is None or x[0] > high)) if any(x[0] and (high is None or x[0] > high) for x in batch) else high
    assert {x["month"]: x["late_rows"] for x in L.late_counts(spark, root).collect()} == late
    assert late[None] == 1
    assert late["2024-01"] > 60

    fact, ledger = str(tmp_path / "fact"), str(tmp_path / "ledger")
    done = L.settle(spark, root, fact, ledger, "r", "2024-02-10")
    assert {m: x.status for m, x in done.items()} == {"2024-01": "SUCCESS", "2024-02": "SUCCESS"}
    assert {x.status for x in L.settle(spark, root, fact, ledger, "r", "2024-02-10").values()} == {"SKIPPED"}
    rows = spark.createDataFrame([x for b in batches for x in b if x[0] is not None], ROWS)
    want = lambda df: df.groupBy(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), (F.col("user_id") % 25).cast("int").alias("zone_id")).agg(F.count_if(F.col("event_type") == "purchase").alias("trips"), F.count_if(F.col("event_type") == "error").alias("complaints"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)"))).cast("decimal(28,2)").alias("revenue"))
    got = lambda: spark.read.parquet(fact).select("date", "hour", "zone_id", "trips", "complaints", "revenue")
    assert got().exceptAll(want(rows)).count() == want(rows).exceptAll(got()).count() == 0

    feed(spark, tmp_path / "in", [some(r, 30, 10, 12)], 4)  # January only, and late
    assert stream().awaitTermination(180)
    assert {m: x.status for m, x in L.settle(spark, root, fact, ledger, "r", "2024-02-11").items()} == {"2024-01": "SUCCESS", "2024-02": "SKIPPED"}
    again = spark.read.schema(ROWS).parquet(*[str(p) for p in (tmp_path / "in").glob("*.parquet")]).where("ts is not null")
    assert got().exceptAll(want(again)).count() == want(again).exceptAll(got()).count() == 0
    assert loading.Ledger(spark, ledger).events().where("status = 'SUCCESS'").count() == 3
