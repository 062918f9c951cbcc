"""Data quality: a rule catalog, tagging of rows with all the rules they break, quarantine events, and first-of-duplicates.

Rows are tagged once; rows without a rejecting rule are the valid ones, the others become one event per broken rule, and
flags stay on the valid rows. So valid and rejected rows always add up to the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

SEVERITIES = ("Critical", "High", "Medium", "Warning", "Info")
ACTIONS = ("Quarantine", "Flag and Retain", "Fail Run", "Quarantine and Fail Run", "Retain as Source Reference")
EVENT_COLUMNS = ("source", "reason_code", "reason_description", "run_id", "rejected_at", "original_record", "rule_id", "severity")


@dataclass(frozen=True)
class Rule:
    """``test`` is true for rows that break the rule; rules about whole runs have none."""

    rule_id: str
    source: str
    name: str
    severity: str
    action: str
    reason_code: str = ""
    description: str = ""
    test: Column | None = None

    @property
    def rejects(self) -> bool:
        return self.action.startswith("Quarantine")

    @property
    def flags(self) -> bool:
        return self.action == "Flag and Retain"

    @property
    def flag(self) -> str:
        return self.name.lower().replace(" ", "_").replace("-", "_").replace("311_", "")


def check_catalog(rules: Iterable[Rule]) -> list[Rule]:
    """The rules; raises on double ids or codes, empty fields, unknown severities or actions, rejecting rules without a code."""
    rules = list(rules)
    ids, codes = [r.rule_id for r in rules], [r.reason_code for r in rules if r.reason_code]
    for r in rules:
        if not (r.rule_id and r.source and r.name) or r.severity not in SEVERITIES or r.action not in ACTIONS or (r.rejects and not r.reason_code):
            raise ValueError(f"incomplete rule {r.rule_id}")
    if len(set(ids)) < len(ids) or len(set(codes)) < len(codes):
        raise ValueError("rule ids or reason codes occur twice")
    return rules


def catalog(start: str = "2025-01-01", end: str = "2026-01-01") -> list[Rule]:
    """All 32 rules for trips, complaints, weather and zones of a period [start, end).

    Trips, complaints and weather are in the forms that ``sources.readers`` gives: parsed columns beside raw ones.
    Rules marked by a column of its own (duplicates) refer to ``occurrence``.
    """
    c, q, fail = F.col, "Quarantine", "Fail Run"
    year = start[:4]
    taxi, calls, hours, zones = "yellow_taxi", "nyc_311", "open_meteo_weather", "tlc_taxi_zones"
    minutes = S.minutes_between("tpep_pickup_datetime", "tpep_dropoff_datetime")
    # Ids, severities, actions, codes, thresholds.
    return check_catalog([
        Rule("DQ_TAXI_001", taxi, "Missing Pickup Timestamp", "Critical", q, "MISSING_PICKUP_TIMESTAMP", "Pickup timestamp is missing.", c("tpep_pickup_datetime").isNull()),
        Rule("DQ_TAXI_002", taxi, "Missing Drop-off Timestamp", "Critical", q, "MISSING_DROPOFF_TIMESTAMP", "Drop-off timestamp is missing.", c("tpep_dropoff_datetime").isNull()),
        Rule("DQ_TAXI_003", taxi, "Drop-off Before Pickup", "Critical", q, "INVALID_TRIP_DURATION", "Drop-off timestamp occurs before pickup timestamp.", c("tpep_dropoff_datetime") < c("tpep_pickup_datetime")),
        Rule("DQ_TAXI_004", taxi, f"Pickup Outside {year}", "Critical", q, "INVALID_PICKUP_DATE", f"Pickup timestamp is outside calendar year {year}.", S.outside("tpep_pickup_datetime", start, end)),
        Rule("DQ_TAXI_005", taxi, "Missing Taxi Location", "High", q, "MISSING_TAXI_LOCATION", "Pickup or drop-off Taxi Zone LocationID is missing.", c("PULocationID").isNull() | c("DOLocationID").isNull()),
        Rule("DQ_TAXI_006", taxi, "Exact Duplicate Trip Record", "High", q, "DUPLICATE_TAXI_RECORD", "Exact duplicate Taxi source record beyond the first occurrence.", c("occurrence") > 1),
        Rule("DQ_TAXI_007", taxi, "Negative Trip Distance", "Critical", q, "NEGATIVE_TRIP_DISTANCE", "Trip distance is negative.", c("trip_distance") < 0),
        Rule("DQ_TAXI_008", taxi, "Negative Fare Amount", "Medium", "Flag and Retain", test=c("fare_amount") < 0),
        Rule("DQ_TAXI_009", taxi, "Negative Total Amount", "Medium", "Flag and Retain", test=c("total_amount") < 0),
        Rule("DQ_TAXI_010", taxi, "Extreme Fare", "Warning", "Flag and Retain", test=c("fare_amount") >= 900),
        Rule("DQ_TAXI_011", taxi, "Extreme Trip Distance", "Warning", "Flag and Retain", test=c("trip_distance") >= 150),
        Rule("DQ_TAXI_012", taxi, "Extreme Trip Duration", "Warning", "Flag and Retain", test=minutes >= 600),
        Rule("DQ_TAXI_013", taxi, "Unusual Passenger Count", "Warning", "Flag and Retain", test=(c("passenger_count") <= 0) | (c("passenger_count") > 6)),
        Rule("DQ_TAXI_014", taxi, "Taxi Schema Mismatch", "Critical", fail, "TAXI_SCHEMA_MISMATCH", "Required Taxi schema is missing or incompatible."),
        Rule("DQ_311_001", calls, "Missing or Invalid Created Date", "Critical", q, "MISSING_OR_INVALID_311_CREATED_DATE", "311 created_date is missing or unparseable.", c("created_at").isNull()),
        Rule("DQ_311_002", calls, f"Created Date Outside {year}", "Critical", q, "INVALID_311_CREATED_DATE", f"311 created_date is outside calendar year {year}.", S.outside("created_at", start, end)),
        Rule("DQ_311_003", calls, "Closed Before Created", "Critical", q, "INVALID_311_DURATION", "311 closed_date occurs before created_date.", c("closed_at") < c("created_at")),
        Rule("DQ_311_004", calls, "Duplicate Complaint ID", "High", q, "DUPLICATE_311_RECORD", "Duplicate 311 unique_key occurrence beyond the first.", c("occurrence") > 1),
        Rule("DQ_311_005", calls, "Missing 311 Coordinates", "High", q, "MISSING_311_COORDINATES", "Latitude or longitude is missing for spatial enrichment.", S.blank("latitude_text") | S.blank("longitude_text")),
        Rule("DQ_311_006", calls, "Invalid Coordinate Range", "Critical", q, "INVALID_311_COORDINATES", "Latitude or longitude is outside global structural ranges.", S.any_of([~S.blank("latitude_text") & c("latitude").isNull(), ~S.blank("longitude_text") & c("longitude").isNull(), F.abs("latitude") > 90, F.abs("longitude") > 180])),
        Rule("DQ_311_007", calls, "Very Long Resolution Duration", "Warning", "Flag and Retain", test=S.minutes_between("created_at", "closed_at") > 365 * 24 * 60),
        Rule("DQ_311_008", calls, "311 Schema Mismatch", "Critical", fail, "311_SCHEMA_MISMATCH", "Required 311 schema is missing or incompatible."),
        Rule("DQ_WEATHER_001", hours, "Missing Expected Hour", "Critical", fail, "WEATHER_GAP", "One or more expected hourly timestamps are missing."),
        Rule("DQ_WEATHER_002", hours, "Duplicate Weather Timestamp", "Critical", "Quarantine and Fail Run", "DUPLICATE_WEATHER_TIMESTAMP", "Weather timestamp occurs more than once.", c("occurrence") > 1),
        Rule("DQ_WEATHER_003", hours, "Invalid Weather Measurement", "High", q, "INVALID_WEATHER_MEASUREMENT", "Weather measurement violates a physical range rule.", S.any_of([c("temperature_2m").isNull(), ~c("relative_humidity_2m").between(0, 100), *[c(x) < 0 for x in ("precipitation", "rain", "snowfall", "wind_speed_10m", "wind_gusts_10m")]])),
        Rule("DQ_WEATHER_004", hours, f"Weather Timestamp Outside {year}", "Critical", q, "INVALID_WEATHER_DATE", "Weather timestamp is outside the expected hourly grid.", S.outside("time", start, end)),
        Rule("DQ_WEATHER_005", hours, "Weather Schema Mismatch", "Critical", fail, "WEATHER_SCHEMA_MISMATCH", "Required Weather hourly schema is missing or arrays are inconsistent."),
        Rule("DQ_ZONE_001", zones, "Missing Zone Identifier", "Critical", fail, "MISSING_ZONE_ID", "Taxi Zone LocationID is missing.", c("LocationID").isNull()),
        Rule("DQ_ZONE_002", zones, "Duplicate Zone Identifier", "Critical", fail, "DUPLICATE_ZONE_ID", "Taxi Zone LocationID is duplicated.", c("occurrence") > 1),
        Rule("DQ_ZONE_003", zones, "Missing Zone Name", "High", fail, "MISSING_ZONE_NAME", "Taxi Zone name is truly empty after preserving literal N/A values.", S.blank("Zone")),
        Rule("DQ_ZONE_004", zones, "Special Taxi Zone Reference Values", "Info", "Retain as Source Reference", test=c("LocationID").isin(264, 265)),
        Rule("DQ_ZONE_005", zones, "Taxi Zone Schema Mismatch", "Critical", fail, "ZONE_SCHEMA_MISMATCH", "Taxi Zone lookup schema differs from the expected four columns."),
    ])


def of_source(rules: Iterable[Rule], source: str) -> list[Rule]:
    return [r for r in rules if r.source == source]


def require_columns(df: DataFrame, columns: Iterable[str], code: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{code}: {', '.join(missing)}")
    return df


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "occurrence") -> DataFrame:
    """``df`` with each row's place among the rows of its key; null keys are alike. One shuffle, no list of keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return numbered(df, keys, order, "_n").where("_n = 1").drop("_n")


def tagged(df: DataFrame, rules: Iterable[Rule], originals: Sequence[str]) -> DataFrame:
    """``df`` with ``_reasons`` (one struct per broken rejecting rule) and ``_record`` (the originals as JSON)."""
    hits = [F.when(S.truth(r.test), F.struct(F.lit(r.reason_code).alias("reason_code"), F.lit(r.description).alias("reason_description"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules if r.rejects and r.test is not None]
    return df.withColumns({"_reasons": F.array_compact(F.array(*hits)), "_record": S.row_json(*originals)})


def valid(tagged_rows: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The rows without a reason, with a flag column for each flag-and-retain rule."""
    flags = {r.flag: S.truth(r.test) for r in rules if r.flags}
    return tagged_rows.where(F.size("_reasons") == 0).drop("_reasons", "_record").withColumns(flags)


def events(tagged_rows: DataFrame, source: str, run_id: str, rejected_at: str) -> DataFrame:
    """One row of texts per row and broken rule."""
    rows = tagged_rows.where(F.size("_reasons") > 0).select(F.explode("_reasons").alias("r"), "_record")
    made = {"source": F.lit(source), "run_id": F.lit(run_id), "rejected_at": F.lit(rejected_at), "original_record": F.col("_record")}
    return rows.select(*[(made[c] if c in made else F.col(f"r.{c}")).cast("string").alias(c) for c in EVENT_COLUMNS])


@dataclass(frozen=True)
class Counts:
    read: int
    valid: int
    rejected: int
    events: int


def reconciled(tagged_rows: DataFrame) -> Counts:
    """Row counts in one pass; raises unless valid and rejected rows add up and every rejected row has an event."""
    n = F.size("_reasons")
    r = tagged_rows.agg(F.count(F.lit(1)), F.count_if(n == 0), F.count_if(n > 0), F.sum(n)).first()
    counts = Counts(r[0], r[1], r[2], r[3] or 0)
    return assert_reconciled(counts)


def assert_reconciled(c: Counts) -> Counts:
    if c.read != c.valid + c.rejected or c.events < c.rejected:
        raise ValueError(f"rows don't reconcile: {c}")
    return c


def rule_counts(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """rule_id and number of rows for which its test is true, of all rules with a test, in one pass."""
    tests = {r.rule_id: r.test for r in rules if r.test is not None}
    return df.agg(*[F.count_if(S.truth(t)).alias(name) for name, t in tests.items()]).unpivot([], list(tests), "rule_id", "n")


def missing_hours(spark_hours: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected (date, hour) without an observation."""
    return spark_hours.join(observed.select("date", "hour").distinct(), ["date", "hour"], "left_anti")


def domains(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row per named check with the number of rows for which it isn't true."""
    n = df.agg(*[F.count_if(~S.truth(p)).alias(name) for name, p in checks.items()])
    return n.unpivot([], list(checks), "check_name", "failures")
