from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cityflux.functions import geo
from cityflux.functions import scalar as S
from cityflux.sources import readers


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("  a  b ", "a b"), ("", None), (" \t\n ", None), ("a  b", "a b"), (None, None), ("A", "A")])
def test_clean(spark, text, want):
    assert one(spark, S.clean(F.lit(text).cast("string"))) == want


def test_canonical_passes_unknown_through(spark):
    names = readers.BOROUGHS
    assert [one(spark, S.canonical(F.lit(x), names)) for x in ("staten  island", "QUEENS", "Elsewhere")] == ["Staten Island", "Queens", "Elsewhere"]


def test_safe_casts(spark):
    assert one(spark, S.number(F.lit("abc"))) is None
    assert one(spark, S.number(F.lit("1.5"))) == 1.5
    assert one(spark, S.moment(F.lit("01/02/2025"))) is None
    assert one(spark, S.moment(F.lit("2025-02-01T10:00:00"))) == datetime(2025, 2, 1, 10)


def test_half_open_period(spark):
    at = lambda t: one(spark, S.outside(F.lit(t).cast("timestamp_ntz"), "2025-01-01", "2026-01-01"))
    assert [at("2025-01-01 00:00:00"), at("2025-12-31 23:59:59"), at("2026-01-01 00:00:00"), at("2024-12-31 23:59:59")] == [False, False, True, True]


def test_levels_are_right_closed(spark):
    got = [one(spark, S.demand_level(F.lit(x))) for x in (0, 1, 5, 6, 20, 21, 50, 51, 100, 101)]
    assert [g.rsplit(" ", 1)[0] for g in got] == ["Zero", *["Very Low"] * 2, *["Low"] * 2, *["Moderate"] * 2, *["High"] * 2, "Very High"]
    assert one(spark, S.demand_level(F.lit(None).cast("int"))) is None


def test_bands(spark):
    assert [one(spark, S.snow_band(F.lit(float(x)))) for x in (0, 0.5, 1, 5)] == ["No Snow", "Light Snow", "Moderate Snow", "Heavy Snow"]
    assert [one(spark, S.temperature_band(F.lit(float(x))))[0:4] for x in (-0.1, 0, 10, 20, 30)] == ["Free", "Cold", "Cool", "Warm", "Hot "]
    assert one(spark, S.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, S.percent_error(F.lit(2), F.lit(0))) is None
    assert one(spark, S.any_of([F.lit(None).cast("boolean"), F.lit(False)])) is False


def test_week_and_zone(spark):
    assert one(spark, S.weekend(F.lit("2024-01-06").cast("date"))) is True
    assert one(spark, S.hour_label(F.lit(7))) == "07:00"
    assert [one(spark, S.zone_or_unknown(F.lit(x).cast("int"))) for x in (1, 265, 266, None)] == [1, 265, 0, 0]


SQUARE = ([0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0])
HOLE = ([0.5, 1.5, 1.5, 0.5], [0.5, 0.5, 1.5, 1.5])
CONCAVE = ([0.0, 4.0, 4.0, 2.0, 0.0], [0.0, 0.0, 4.0, 1.0, 4.0])


@pytest.mark.parametrize(
    ("rings", "point", "want"),
    [([SQUARE], (1, 1), True), ([SQUARE], (3, 1), False), ([SQUARE], (0, 1), False), ([SQUARE], (2, 1), False), ([SQUARE], (1, 2), False), ([SQUARE], (0, 0), False), ([SQUARE, HOLE], (1, 1), False), ([SQUARE, HOLE], (0.25, 1), True), ([CONCAVE], (2, 3), False), ([CONCAVE], (0.5, 2), True)],
)
def test_point_in_polygon(spark, rings, point, want):
    df = spark.createDataFrame([([{"xs": x, "ys": y} for x, y in rings], float(point[0]), float(point[1]))], "rings array<struct<xs: array<double>, ys: array<double>>>, x double, y double")
    assert df.select(geo.inside(F.col("x"), F.col("y"), F.col("rings"))).first()[0] is want


def test_zone_assignment_and_overlap(spark):
    square = lambda z, a: [(z, 0, i, a + x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])]
    schema = "zone_id int, ring int, seq int, x double, y double"
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 9.0, 9.0), (4, None, 1.0), (5, 2.0, 1.0)], "id int, x double, y double")
    zones = readers.polygons(spark.createDataFrame(square(1, 0.0) + square(2, 2.0), schema))
    got = {r["id"]: (r["zone_id"], r["status"]) for r in geo.assign_zones(points, zones, "x", "y").collect()}
    assert got == {1: (1, geo.MAPPED), 2: (2, geo.MAPPED), 3: (None, geo.OUTSIDE), 4: (None, geo.OUTSIDE), 5: (None, geo.OUTSIDE)}
    overlapping = readers.polygons(spark.createDataFrame(square(1, 0.0) + square(2, 1.0), schema))
    with pytest.raises(Exception, match="several zones"):
        geo.assign_zones(points.where("id = 1").withColumn("x", F.lit(1.5)), overlapping, "x", "y").collect()
