from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cityflux.operators import cube, dims, forecast, profile, quality
from cityflux.sources import readers


def test_cube_is_dense_and_empty_cells_have_no_average(spark):
    zones = spark.createDataFrame([(1,), (2,)], "zone_id int")
    facts = spark.createDataFrame([(1, datetime(2024, 1, 1, 5), 3.0), (1, datetime(2024, 1, 1, 5), -5.0)], "z int, t timestamp_ntz, v double")
    cells = cube.cells(facts, "t", F.col("z"), {"trips": F.count(F.lit(1)), "revenue": F.sum("v"), "fare": F.avg("v")})
    out = cube.dense_cube(cube.grid(spark, "2024-01-01", "2024-01-03", zones), [cells], zero=("trips", "revenue"))
    assert out.count() == 2 * 48
    full = out.where("trips > 0").collect()
    assert [(r["hour"], r["zone_id"], r["trips"], r["revenue"], r["fare"]) for r in full] == [(5, 1, 2, -2.0, -1.0)]
    assert out.where("trips = 0 and fare is null and revenue = 0").count() == 95
    forecast.require_dense(out, 48)
    with pytest.raises(ValueError, match="48 hours"):
        forecast.require_dense(out.where("not (zone_id = 2 and hour = 3)"), 48)


def test_unique_raises(spark):
    with pytest.raises(ValueError, match="unique"):
        cube.unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")


def test_catalog_and_its_checks():
    rules = quality.catalog()
    assert len(rules) == 32
    assert {r.severity for r in rules} <= set(quality.SEVERITIES)
    with pytest.raises(ValueError, match="twice"):
        quality.check_catalog([rules[0], rules[0]])
    with pytest.raises(ValueError, match="incomplete"):
        quality.check_catalog([quality.Rule("A", "s", "n", "Awful", "Quarantine", "C")])


TRIP = {"VendorID": 1, "tpep_pickup_datetime": datetime(2025, 5, 1, 10), "tpep_dropoff_datetime": datetime(2025, 5, 1, 11), "passenger_count": 1, "trip_distance": 1.0, "PULocationID": 1, "DOLocationID": 2, "payment_type": 1, "fare_amount": 5.0, "total_amount": 6.0}


def trips(spark, *changes):
    names = [f.name for f in readers.TRIPS]
    return spark.createDataFrame([tuple({**TRIP, **c}.get(n) for n in names) + (c.get("file", "a"),) for c in changes], readers.TRIPS.add("file", "string") if "file" not in names else readers.TRIPS)


def test_trip_rules(spark):
    names = [f.name for f in readers.TRIPS if f.name != "file"]
    raw = trips(
        spark, {}, {"file": "b"}, {"VendorID": 2, "tpep_pickup_datetime": None}, {"VendorID": 3, "tpep_dropoff_datetime": datetime(2025, 5, 1, 9)}, {"VendorID": 4, "tpep_dropoff_datetime": datetime(2025, 5, 1, 10)},
        {"VendorID": 5, "tpep_pickup_datetime": datetime(2026, 1, 1), "tpep_dropoff_datetime": datetime(2025, 12, 31)}, {"VendorID": 6, "PULocationID": None}, {"VendorID": 7, "trip_distance": -0.1}, {"VendorID": 8, "fare_amount": -1.0},
        {"VendorID": 9, "fare_amount": 900.0, "trip_distance": 150.0, "tpep_dropoff_datetime": datetime(2025, 5, 1, 20), "passenger_count": 7}, {"VendorID": 10, "passenger_count": None},
    )
    rules = quality.of_source(quality.catalog(), "yellow_taxi")
    tagged = quality.tagged(quality.numbered(raw, names, ["file"]), rules, names)
    counts = quality.reconciled(tagged)
    assert (counts.read, counts.valid, counts.rejected, counts.events) == (11, 5, 6, 7)
    events = quality.events(tagged, "yellow_taxi", "r", "now")
    assert events.columns == list(quality.EVENT_COLUMNS)
    assert {t for _, t in events.dtypes} == {"string"}
    codes = sorted(r["reason_code"] for r in events.collect())
    assert codes == ["DUPLICATE_TAXI_RECORD", "INVALID_PICKUP_DATE", "INVALID_TRIP_DURATION", "INVALID_TRIP_DURATION", "MISSING_PICKUP_TIMESTAMP", "MISSING_TAXI_LOCATION", "NEGATIVE_TRIP_DISTANCE"]
    good = {r["VendorID"]: r for r in quality.valid(tagged, rules).collect()}
    assert sorted(good) == [1, 4, 8, 9, 10]
    assert good[8]["negative_fare_amount"]
    assert all(good[9][c] for c in ("extreme_fare", "extreme_trip_distance", "extreme_trip_duration", "unusual_passenger_count"))
    assert not good[10]["unusual_passenger_count"]


def test_complaint_rules(spark):
    names = [f.name for f in readers.COMPLAINTS]
    base = {"unique_key": "1", "created_date": "2025-03-01T00:00:00", "closed_date": "2025-03-02T00:00:00", "latitude": "40.7", "longitude": "-73.9", "complaint_type": " plumbing ", "borough": "STATEN  ISLAND"}
    rows = [base, base, {**base, "unique_key": "2", "created_date": "01/02/2025"}, {**base, "unique_key": "3", "latitude": "abc"}, {**base, "unique_key": "4", "latitude": None, "closed_date": "2025-02-01T00:00:00"}, {**base, "unique_key": "5", "closed_date": "2026-03-01T00:00:00"}, {**base, "unique_key": "6", "closed_date": "2026-03-01T03:00:00"}, {**base, "unique_key": "7", "latitude": "90"}, {**base, "unique_key": "8", "latitude": "90.1"}]
    raw = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], readers.COMPLAINTS)
    parsed = quality.numbered(readers.parsed_complaints(raw), ["unique_key"], ["created_at", "closed_at"])
    rules = quality.of_source(quality.catalog(), "nyc_311")
    tagged = quality.tagged(parsed, rules, ["unique_key"])
    got = sorted((r["original_record"], r["rule_id"]) for r in quality.events(tagged, "nyc_311", "r", "now").collect())
    key = lambda k: f'{{"unique_key":"{k}"}}'
    assert got == [(key(1), "DQ_311_004"), (key(2), "DQ_311_001"), (key(3), "DQ_311_006"), (key(4), "DQ_311_003"), (key(4), "DQ_311_005"), (key(8), "DQ_311_006")]
    good = {r["unique_key"]: r for r in quality.valid(tagged, rules).collect()}
    assert sorted(good) == ["1", "5", "6", "7"]
    assert (good["5"]["very_long_resolution_duration"], good["6"]["very_long_resolution_duration"]) == (False, True)
    assert (good["1"]["complaint_type"], good["1"]["borough"]) == ("Plumbing", "Staten Island")


def test_no_events_keep_their_schema(spark, tmp_path):
    rules = [quality.Rule("A", "s", "Never", "High", "Quarantine", "NEVER", "", F.lit(False))]
    quality.events(quality.tagged(spark.range(3), rules, ["id"]), "s", "r", "now").write.parquet(str(tmp_path / "q"))
    back = spark.read.parquet(str(tmp_path / "q"))
    assert (back.count(), back.columns) == (0, list(quality.EVENT_COLUMNS))


def test_zone_dimension(spark):
    lookup = spark.createDataFrame([(1, "A", "X"), (56, "Corona", "Q"), (57, "Corona", "Q"), (264, "N/A", "Unknown")], "zone_id int, zone_name string, borough string")
    out = dims.zones(lookup).orderBy("zone_key").collect()
    assert [r["zone_id"] for r in out] == [-1, 0, 1, 56, 57, 264]
    assert [r["is_special"] for r in out] == [False] * 5 + [True]
    with pytest.raises(ValueError, match="twice"):
        dims.zones(lookup.unionAll(lookup))


def test_dates_and_times(spark):
    d = {r["date_key"]: r for r in dims.dates(spark, "2024-12-30", "2025-01-01").collect()}
    assert (d[20241230]["iso_week"], d[0]["full_date"], len(d)) == (1, date(1900, 1, 1), 4)
    t = {r["time_key"]: r for r in dims.times(spark).collect()}
    assert (len(t), t[0]["daypart"], t[1]["hour_label"], t[19]["daypart"]) == (25, "Unknown", "00:00", "Evening")


def test_unknown_weather_code_fails(spark):
    df = spark.createDataFrame([(45,)], "weather_code int")
    assert dims.labelled_or_fail(df, "weather_code", dims.WEATHER_CODES, "label").first()["label"] == "Fog"
    with pytest.raises(Exception, match="unknown weather_code: 7"):
        dims.labelled_or_fail(spark.createDataFrame([(7,)], "weather_code int"), "weather_code", dims.WEATHER_CODES, "label").collect()


def test_role_playing_and_resolution(spark):
    zones = spark.createDataFrame([(1, "A", None)], "zone_id int, zone_name string, borough string")
    facts = spark.createDataFrame([(1, 2)], "pu int, do int")
    r = dims.role_playing(facts, zones, {"pu": "pickup", "do": "dropoff"}).first()
    assert (r["pickup_matched"], r["dropoff_matched"], r["pickup_zone"]) == (True, False, "A")
    keyed = dims.keyed(spark.createDataFrame([("b",), ("a",)], "code string"), "code", "key")
    assert {r["code"]: r["key"] for r in keyed.collect()} == {"a": 1, "b": 2}
    out = dims.resolved(spark.createDataFrame([("a",), ("z",)], "code string"), keyed, "code", "key").collect()
    assert {r["code"]: r["key"] for r in out} == {"a": 1, "z": 0}
    assert dims.unresolved(spark.createDataFrame([("a",), ("z",)], "code string"), keyed, "code").count() == 1


def test_lags_need_history(spark):
    zones = spark.createDataFrame([(1,), (2,)], "zone_id int")
    base = cube.grid(spark, "2024-01-01", "2024-01-09", zones).withColumns({"trips": (F.dayofmonth("date") * 100 + F.col("hour")).cast("long"), "complaints": F.col("zone_id").cast("long")})
    f = forecast.features(base)
    assert f.count() == 2 * 24
    r = f.where("zone_id = 1 and hour = 0").first()
    assert (r["trips"], r["trips_lag_1h"], r["trips_lag_24h"], r["trips_lag_168h"]) == (800, 723, 700, 100)
    assert {(r["compared"], r["unmatched"], r["largest_difference"]) for r in forecast.lag_differences(f, base).collect()} == {(48, 0, 0.0)}
    assert forecast.require_aligned(f, base) is f
    gapped = base.where("not (zone_id = 1 and hour = 7 and dayofmonth(date) = 8)")
    with pytest.raises(ValueError, match="trips_lag_1h"):
        forecast.require_aligned(forecast.features(gapped), gapped)
    with pytest.raises(ValueError, match="revenue"):
        forecast.forbid_leaks(["hour", "revenue"])


def test_metrics_edges(spark):
    df = spark.createDataFrame([("c", 0.0, 1.0), ("c", 0.0, 1.0), ("z", 0.0, 0.0), ("n", 1.0, 2.0), ("n", 3.0, 3.0)], "g string, a double, p double")
    m = {r["g"]: r for r in forecast.metrics(df, "a", "p", ["g"]).collect()}
    assert (m["c"]["r2"], m["c"]["mape"], m["c"]["smape"]) == (0.0, None, 200.0)
    assert (m["z"]["r2"], m["z"]["smape"], m["z"]["mae"]) == (1.0, None, 0.0)
    assert (m["n"]["mae"], m["n"]["bias"], m["n"]["r2"], m["n"]["mape"]) == (0.5, 0.5, 0.5, 50.0)


def test_shuffled_columns_keep_their_values(spark):
    df = spark.range(500).withColumns({"a": F.col("id") * 2, "b": F.col("id") * 3})
    out = forecast.permuted(df, ["a", "b"], 5)
    rows = out.collect()
    assert len(rows) == 500
    assert sorted(r["a"] for r in rows) == [2 * i for i in range(500)]
    assert all(r["b"] * 2 == r["a"] * 3 for r in rows)
    assert sum(r["a"] != 2 * r["id"] for r in rows) > 400


def test_models_and_importance(spark):
    df = spark.range(400).select((F.col("id") % 24).alias("hour"), (F.col("id") % 7).alias("noise"), ((F.col("id") % 24) * 2.0).alias("trips"))
    model = forecast.pipeline(forecast.random_forest(trees=5, depth=6), ["hour", "noise"]).fit(df)
    ranked = forecast.permutation_importance(model, df, "trips", {"hour": ["hour"], "noise": ["noise"]}, repeats=1)
    assert ranked[0][0] == "hour"
    assert ranked[0][1] > 1
    compared = forecast.compared(model.transform(df).withColumn("flat", F.lit(23.0)), "trips", {"forest": "prediction", "flat": "flat"})
    assert forecast.chosen(compared, "none") == "forest"


def test_unknown_categories_are_minus_one(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    model = forecast.encoder(["k"]).fit(df.where("k <> 'c' or k is null"))
    assert {r["k"]: r["k_code"] for r in model.transform(df).collect()} == {"a": 0.0, "b": 1.0, "c": -1.0, None: -1.0}
    many = spark.range(300).select((F.col("id") % 100).cast("string").alias("k"), (F.col("id") % 100).cast("double").alias("trips"))
    assert forecast.pipeline(forecast.random_forest(trees=2, depth=4), [], ["k"]).fit(many).transform(many).count() == 300
    assert forecast.encoder(["k"]).fit(df.limit(0)).transform(df).where("k_code = -1").count() == 4


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (1, " "), (2, None), (None, "a")], "n int, t string")
    n = {r["column_name"]: (r["row_count"], r["missing"]) for r in profile.nulls(df).collect()}
    assert n == {"n": (4, 1), "t": (4, 2)}
    assert [tuple(r) for r in profile.top_values(df, "t", 2).collect()] == [("a", 2), (None, 1)]
    q = {r["quantile"]: r["value"] for r in profile.exact_quantiles(df, ["n"], (0.0, 0.5, 1.0)).collect()}
    assert q == {0.0: 1.0, 0.5: 1.0, 1.0: 2.0}
    assert profile.schema_drift({"jan": {"a": "int", "b": "int"}, "feb": {"a": "long", "c": "int"}}) == [("feb", "b", "missing"), ("feb", "c", "added"), ("feb", "a", "type int -> long")]
    j = spark.createDataFrame([("01", '{"a":1,"b":2}'), ("02", '{"a":1,"c":2}')], "m string, j string")
    assert {r["m"]: (r["added"], r["missing"]) for r in profile.json_fields(j, "j", "m").collect()} == {"01": ([], []), "02": (["c"], ["b"])}
    t = spark.createDataFrame([(datetime(2024, 1, 1, 22),), (datetime(2024, 1, 1, 23),), (datetime(2024, 1, 2, 1),), (datetime(2024, 1, 2, 2),), (datetime(2024, 1, 2, 5),)], "t timestamp_ntz")
    assert profile.gaps(t, "t").first()[0] == 2
