import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cityflux.functions import geo
from cityflux.operators import dims, quality
from cityflux.plans import loading
from cityflux.plans import medallion as M
from cityflux.sources import readers, sinks

P = M.Period("2025-01-01", "2025-01-03", "run-1", "2025-02-01 00:00:00")
TRIP = {"tpep_pickup_datetime": datetime(2025, 1, 1, 5), "tpep_dropoff_datetime": datetime(2025, 1, 1, 6), "PULocationID": 1, "DOLocationID": 264, "payment_type": 1, "fare_amount": 4.0, "total_amount": -3.5, "trip_distance": 2.0}


@pytest.fixture(scope="module")
def zone_dim(spark):
    return dims.zones(spark.createDataFrame([(1, "A", "X"), (2, "B", "X"), (264, "N/A", "Unknown")], "zone_id int, zone_name string, borough string"))


def test_raw_to_fact(spark, tmp_path, zone_dim, monkeypatch):
    names = readers.TRIPS.names
    rows = [TRIP, {**TRIP, "VendorID": 2}, {**TRIP, "VendorID": 2}, {**TRIP, "VendorID": 3, "PULocationID": 264}, {**TRIP, "VendorID": 4, "trip_distance": -1.0}, {**TRIP, "VendorID": 5, "tpep_pickup_datetime": datetime(2024, 12, 31)}]
    raw = str(tmp_path / "raw")
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], readers.TRIPS).write.parquet(raw)
    assert M.bronze(spark, raw, str(tmp_path / "bronze"), P, 2025, 1) == 6
    with monkeypatch.context() as m, pytest.raises(ValueError, match="5 rows were written, 6 were read"):
        m.setattr(sinks, "write_partitions", lambda df, out, by: df.limit(5).write.partitionBy(*by).parquet(out))
        M.bronze(spark, raw, str(tmp_path / "bronze"), P, 2025, 1)
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 6  # a bad write leaves the month as it was
    assert M.bronze(spark, raw, str(tmp_path / "bronze"), P, 2025, 1) == 6
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("bronze")] == ["bronze"]
    bronze = spark.read.parquet(str(tmp_path / "bronze"))
    assert set(M.bronze_checks(bronze).values()) == {0}
    trips = M.silver_trips(bronze, zone_dim, P)
    assert (trips.counts.read, trips.counts.valid, trips.counts.rejected) == (6, 3, 3)
    assert sorted(r["reason_code"] for r in trips.events.collect()) == ["DUPLICATE_TAXI_RECORD", "INVALID_PICKUP_DATE", "NEGATIVE_TRIP_DISTANCE"]
    one = trips.valid.where("VendorID is null").first()
    assert (one["payment_method"], one["trip_duration_minutes"], one["dropoff_zone"], one["dropoff_matched"], one["negative_total_amount"]) == ("Credit Card", 60.0, "N/A", True, True)

    calls = [("1", "2025-01-01T05:10:00", "1.0", "1.0"), ("2", "2025-01-02T23:59:59", "1.0", "9.0"), ("3", "2025-01-02T01:00:00", None, "1.0")]
    raw_calls = spark.createDataFrame([(k, t, None, "noise", "a", "QUEENS", y, x, None, "open", None) for k, t, y, x in calls], readers.COMPLAINTS)
    complaints = M.silver_complaints(raw_calls, P)
    assert (complaints.counts.valid, complaints.counts.rejected) == (2, 1)
    square = [(1, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])]
    polygons = readers.polygons(spark.createDataFrame(square, "zone_id int, ring int, seq int, x double, y double"))
    mapped = M.mapped_complaints(complaints.valid.drop("status"), polygons)
    assert {r["unique_key"]: r["status"] for r in mapped.collect()} == {"1": geo.MAPPED, "2": geo.OUTSIDE}

    stamps = [f"2025-01-0{d}T{h:02d}:00" for d in (1, 2) for h in range(24)]
    hourly = {k: stamps if k == "time" else [45.0 if k == "weather_code" else 1.0] * 48 for k in readers.HOURLY_KEYS}
    (tmp_path / "w.json").write_text(json.dumps({"latitude": 1.0, "longitude": 1.0, "elevation": 1.0, "timezone": "America/New_York", "hourly": hourly}))
    observed = readers.weather(spark, str(tmp_path / "w.json"))
    weather = M.silver_weather(observed, P)
    assert {r["weather_condition"] for r in weather.valid.collect()} == {"Fog"}
    with pytest.raises(ValueError, match="WEATHER_GAP"):
        M.silver_weather(observed.where("time <> timestamp_ntz'2025-01-01 07:00:00'"), P, str(tmp_path / "gaps"))
    assert [(r["date"], r["hour"]) for r in spark.read.option("header", "true").csv(str(tmp_path / "gaps")).collect()] == [("2025-01-01", "7")]
    with pytest.raises(ValueError, match="DUPLICATE_WEATHER"):
        M.silver_weather(observed.unionAll(observed.limit(1)), P)

    cube = M.gold(trips.valid, mapped, weather.valid, zone_dim, P)
    assert cube.count() == 2 * 48
    cell = cube.where("trips > 0").first()
    assert (cell["zone_id"], cell["hour"], cell["trips"], cell["revenue"], cell["average_fare"], cell["complaints"]) == (1, 5, 2, -7.0, 4.0, 1)

    fact, registry = str(tmp_path / "fact"), str(tmp_path / "registry")
    go = lambda sha, stage=cube: M.load(fact, registry, "p", "gold/2025-01", sha, stage, zone_dim, P.at)
    months = ("2025-01",)
    assert go("a") == M.Loaded("SUCCESS", 0, 96, months)
    assert go("a") == M.Loaded("SKIPPED")
    assert go("b", cube.withColumn("trips", F.col("trips") + 1)) == M.Loaded("SUCCESS", 96, 0, months)
    with pytest.raises(ValueError, match="unresolved_zone"):
        go("c", cube.withColumn("zone_id", F.col("zone_id") + 70))
    assert spark.read.parquet(fact).agg(F.sum("trips")).first()[0] == 2 + 96
    states = {(r["sha256"], r["status"]) for r in loading.Ledger(spark, registry).states().collect()}
    assert states == {("a", "SUCCESS"), ("b", "SUCCESS"), ("c", "FAILED")}
    assert go("d") == M.Loaded("SUCCESS", 96, 0, months)


def test_gate_and_checks(spark):
    good = [(f"2025-{m:02d}", "SUCCESS", 5, 4, 1) for m in range(1, 13)]
    schema = "month string, status string, rows_read int, rows_valid int, rows_rejected int"
    M.year_gate(spark.createDataFrame(good, schema))
    for bad in (good[1:], [*good[1:], ("2025-01", "FAILED", 5, 4, 1)], [*good[1:], ("2025-01", "SUCCESS", 5, 3, 1)], [*good, good[0]]):
        with pytest.raises(ValueError, match="months"):
            M.year_gate(spark.createDataFrame(bad, schema))
    with pytest.raises(ValueError, match="failed: b"):
        M.checked({"a": lambda: True, "b": lambda: False})


def test_schema_gate(spark):
    with pytest.raises(ValueError, match="TAXI_SCHEMA_MISMATCH"):
        quality.require_columns(spark.range(1), readers.TRIPS.names, "TAXI_SCHEMA_MISMATCH")
