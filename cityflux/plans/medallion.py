"""The trip, complaint and weather pipeline from raw files to the loaded fact, month by month.

``bronze`` keeps source rows with lineage, ``silver_*`` split tagged rows into valid ones and quarantine events, ``gold``
builds the cube of a period, ``load`` validates and upserts it into the fact once per file content. Months are those of
the event's date, whatever partition a row is stored in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import scalar as S
from ..operators import cube, dims, duplicates, quality
from ..sources import readers, sinks
from .loading import Loaded, load_months

TRIP_COLUMNS = [f.name for f in readers.TRIPS]
FACT_KEYS = ["date", "hour", "zone_id"]
MEASURES = ["trips", "revenue", "average_fare", "average_distance", "complaints", "temperature_c", "rain_mm", "snowfall_cm", "weather_condition"]


@dataclass(frozen=True)
class Period:
    """A half-open period of dates and the run that works on it."""

    start: str
    end: str
    run_id: str
    at: str


@dataclass(frozen=True)
class Layer:
    """Valid rows, quarantine events and their counts."""

    valid: DataFrame
    events: DataFrame
    counts: quality.Counts


def bronze(spark: SparkSession, files: str | Sequence[str], out: str, p: Period, year: int, month: int) -> int:
    """Raw trip files as a month's Bronze partition; raises, and leaves the old one, unless what is read back has the columns, types and number of rows that went in."""
    raw = quality.require_columns(readers.parquet(spark, files), TRIP_COLUMNS, "TAXI_SCHEMA_MISMATCH")
    rows = readers.with_lineage(raw, "yellow_taxi", p.run_id, p.at, year, month)
    want = raw.count()

    def check(back: DataFrame) -> None:
        if not readers.same_schema([raw, back.select(*raw.columns)]):
            raise ValueError("the written partition has other columns or types than its source")
        if (got := back.count()) != want:
            raise ValueError(f"{got} rows were written, {want} were read")

    sinks.replace_verified(rows, out, ["_processing_year", "_processing_month"], check)
    return want


def bronze_checks(df: DataFrame) -> dict[str, int]:
    """Nulls of each lineage column, in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in readers.LINEAGE]).first()
    return row.asDict()


def _layer(rows: DataFrame, rules: list[quality.Rule], originals: Sequence[str], source: str, p: Period) -> Layer:
    tagged = quality.tagged(rows, rules, originals)
    return Layer(quality.valid(tagged, rules), quality.events(tagged, source, p.run_id, p.at), quality.reconciled(tagged))


def silver_trips(rows: DataFrame, zone_dim: DataFrame, p: Period) -> Layer:
    """Valid trips with duration, payment method, revenue and both zones; duplicates are those of the source columns, the first by file stays."""
    quality.require_columns(rows, [*TRIP_COLUMNS, *readers.LINEAGE], "TAXI_SCHEMA_MISMATCH")
    numbered = duplicates.numbered(rows, TRIP_COLUMNS, ["_source_file"])
    layer = _layer(numbered, quality.of_source(quality.catalog(p.start, p.end), "yellow_taxi"), TRIP_COLUMNS, "yellow_taxi", p)
    made = layer.valid.drop("occurrence").withColumns({
        "pickup_date": F.to_date("tpep_pickup_datetime"), "pickup_hour": F.hour("tpep_pickup_datetime"), "trip_duration_minutes": S.minutes_between("tpep_pickup_datetime", "tpep_dropoff_datetime"),
        "payment_method": S.label("payment_type", {k: v for k, v in dims.PAYMENT_TYPES.items() if k >= 0}, dims.PAYMENT_TYPES[-1]), "revenue": F.col("total_amount").cast("double"),
    })
    return Layer(dims.role_playing(made, zone_dim, {"PULocationID": "pickup", "DOLocationID": "dropoff"}), layer.events, layer.counts)


def silver_complaints(raw: DataFrame, p: Period) -> Layer:
    quality.require_columns(raw, readers.COMPLAINTS.names, "311_SCHEMA_MISMATCH")
    numbered = quality.numbered(readers.parsed_complaints(raw), ["unique_key"], [F.col("created_at").asc_nulls_last(), F.col("closed_at").asc_nulls_last()])
    layer = _layer(numbered, quality.of_source(quality.catalog(p.start, p.end), "nyc_311"), ["unique_key", "created_at", "closed_at", "latitude_text", "longitude_text"], "nyc_311", p)
    return Layer(layer.valid.drop("occurrence", "latitude_text", "longitude_text").withColumns({"created_date": F.to_date("created_at"), "created_time": F.date_format("created_at", "HH:mm:ss")}), layer.events, layer.counts)


def mapped_complaints(complaints: DataFrame, polygons: DataFrame) -> DataFrame:
    """Complaints with the zone that their coordinates lie in."""
    return geo.assign_zones(complaints, polygons, "longitude", "latitude")


def silver_weather(hours: DataFrame, p: Period, gap_report: str | None = None) -> Layer:
    """Valid hours with their condition; an unknown code fails, and so do missing or double hours (the missing ones are written first)."""
    rules = quality.of_source(quality.catalog(p.start, p.end), "open_meteo_weather")
    layer = _layer(quality.numbered(hours, ["time"], ["temperature_2m"]), rules, list(readers.HOURLY_KEYS), "open_meteo_weather", p)
    rows = dims.labelled_or_fail(layer.valid, "weather_code", dims.WEATHER_CODES, "weather_condition").select(
        F.to_date("time").alias("date"), F.hour("time").alias("hour"), F.col("temperature_2m").alias("temperature_c"), F.col("rain").alias("rain_mm"), F.col("snowfall").alias("snowfall_cm"), "weather_condition"
    )
    missing = quality.missing_hours(cube.hours(hours.sparkSession, p.start, p.end), rows)
    if gap_report:
        missing.coalesce(1).write.mode("overwrite").option("header", "true").csv(gap_report)
    if missing.limit(1).count():
        raise ValueError("WEATHER_GAP: hours are missing")
    if layer.events.where("reason_code = 'DUPLICATE_WEATHER_TIMESTAMP'").limit(1).count():
        raise ValueError("DUPLICATE_WEATHER_TIMESTAMP")
    return Layer(rows, layer.events, layer.counts)


def gold(trips: DataFrame, complaints: DataFrame, weather: DataFrame, zone_dim: DataFrame, p: Period) -> DataFrame:
    """The dense cube of the period over the authoritative zones; raises if trips or complaints in it aren't those that went in."""
    spark = trips.sparkSession
    zones = zone_dim.where("is_authoritative").select("zone_id", "zone_name", "borough")
    inside = lambda df, c: df.where(~S.outside(c, p.start, p.end))
    t = inside(trips, "tpep_pickup_datetime").join(zones.select(F.col("zone_id").alias("PULocationID")), "PULocationID", "left_semi")
    c = inside(complaints, "created_at").where(F.col("status") == geo.MAPPED).join(zones.select("zone_id"), "zone_id", "left_semi")
    trip_cells = cube.cells(t, "tpep_pickup_datetime", F.col("PULocationID"), {"trips": F.count(F.lit(1)), "revenue": F.sum("revenue"), "average_fare": F.avg("fare_amount"), "average_distance": F.avg("trip_distance")})
    call_cells = cube.cells(c, "created_at", F.col("zone_id"), {"complaints": F.count(F.lit(1))})
    out = cube.dense_cube(cube.grid(spark, p.start, p.end, zones), [trip_cells, call_cells], weather, ("trips", "revenue", "complaints"))
    got = out.agg(F.sum("trips"), F.sum("complaints"), F.count(F.lit(1)), F.count_if(F.col("temperature_c").isNull())).first()
    want = (t.count(), c.count(), zones.count() * cube.hours(spark, p.start, p.end).count(), 0)
    if tuple(x or 0 for x in got) != want:
        raise ValueError(f"the cube has {tuple(got)}, {want} went in")
    return out.select(*FACT_KEYS, "zone_name", "borough", *MEASURES).orderBy("date", "hour", "zone_id")  # one stable order in the written table


def staged_checks(stage: DataFrame, zones: DataFrame, weather_labels: Sequence[str]) -> dict[str, int]:
    """Rows of a staged cube that break each load rule; all must be 0."""
    tests = {
        "null_key": F.col("date").isNull() | F.col("hour").isNull() | F.col("zone_id").isNull(), "hour_domain": ~F.col("hour").between(0, 23), "negative_count": (F.col("trips") < 0) | (F.col("complaints") < 0),
        "null_measure": F.col("trips").isNull() | F.col("revenue").isNull() | F.col("complaints").isNull() | F.col("temperature_c").isNull(), "unknown_weather": ~F.col("weather_condition").isin(*weather_labels),
    }
    found = stage.agg(*[F.count_if(S.truth(p)).alias(n) for n, p in tests.items()]).first().asDict()
    found["double_grain"] = stage.groupBy(*FACT_KEYS).count().where("count > 1").count()
    found["unresolved_zone"] = dims.unresolved(stage, zones, "zone_id").count()
    return found


def load(fact: str, ledger: str, pipeline: str, file: str, sha256: str, stage: DataFrame, zones: DataFrame, at: str, run_id: str = "load") -> Loaded:
    """Upserts a staged cube into the months of the fact at a path, unless this content has been loaded; see ``loading``."""

    def check(rows: DataFrame) -> None:
        broken = {k: v for k, v in staged_checks(rows, zones, sorted(dims.WEATHER_CODES.values())).items() if v}
        if broken:
            raise ValueError(f"the staged cube breaks {broken}")

    return load_months(fact, ledger, pipeline, file, sha256, stage, "date", FACT_KEYS, run_id, at, check)


def year_gate(reports: DataFrame, months: int = 12) -> None:
    """Raises unless each month is there once, succeeded, and has input = valid + rejected."""
    row = reports.agg(F.count_distinct("month"), F.count(F.lit(1)), F.count_if((F.col("status") != "SUCCESS") | (F.col("rows_read") != F.col("rows_valid") + F.col("rows_rejected")))).first()
    if tuple(row) != (months, months, 0):
        raise ValueError(f"{row[0]} of {months} months in {row[1]} rows, {row[2]} of them not reconciled")


def checked(checks: dict[str, Callable[[], bool]]) -> None:
    """Runs all named checks and raises with those that fail."""
    failed = [name for name, check in checks.items() if not check()]
    if failed:
        raise ValueError(f"failed: {', '.join(failed)}")
