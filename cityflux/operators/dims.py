"""Dimensions with deterministic keys, unknown members and key resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

UNKNOWN_DATE = "1900-01-01"

#: Payment codes and weather codes with their labels (fixed values of the sources).
PAYMENT_TYPES = {-1: "Unmapped", 0: "Flex Fare", 1: "Credit Card", 2: "Cash", 3: "No Charge", 4: "Dispute", 5: "Unknown", 6: "Voided Trip"}
WEATHER_CODES = {
    0: "Clear sky", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Depositing rime fog",
    51: "Light drizzle", 53: "Moderate drizzle", 55: "Dense drizzle", 56: "Light freezing drizzle", 57: "Dense freezing drizzle",
    61: "Slight rain", 63: "Moderate rain", 65: "Heavy rain", 66: "Light freezing rain", 67: "Heavy freezing rain",
    71: "Slight snowfall", 73: "Moderate snowfall", 75: "Heavy snowfall", 77: "Snow grains",
    80: "Slight rain showers", 81: "Moderate rain showers", 82: "Violent rain showers", 85: "Slight snow showers", 86: "Heavy snow showers",
    95: "Thunderstorm", 96: "Thunderstorm with slight hail", 99: "Thunderstorm with heavy hail",
}


def dates(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day of [start, end] plus the unknown day with key 0."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date"))
    days = days.withColumn("date_key", F.date_format("full_date", "yyyyMMdd").cast("int"))
    days = days.unionByName(spark.range(1).select(F.lit(UNKNOWN_DATE).cast("date").alias("full_date"), F.lit(0).alias("date_key")))
    return days.select(
        "date_key", "full_date", F.year("full_date").alias("year"), F.quarter("full_date").alias("quarter"), F.month("full_date").alias("month_number"), F.date_format("full_date", "MMMM").alias("month_name"),
        F.dayofmonth("full_date").alias("day_of_month"), F.weekofyear("full_date").alias("iso_week"), F.date_format("full_date", "EEEE").alias("day_name"), S.weekend("full_date").alias("is_weekend"),
    )


def times(spark: SparkSession) -> DataFrame:
    """24 hours with key hour + 1, plus the unknown hour with key 0."""
    rows = spark.range(-1, 24).select((F.col("id") + 1).cast("int").alias("time_key"), F.when(F.col("id") >= 0, F.col("id").cast("int")).alias("hour_of_day"))
    known = F.col("hour_of_day").isNotNull()
    return rows.select("time_key", "hour_of_day", F.when(known, S.hour_label("hour_of_day")).otherwise("Unknown").alias("hour_label"), F.when(known, S.daypart("hour_of_day")).otherwise("Unknown").alias("daypart"))


def keyed(members: DataFrame, natural: str, key: str, first: int = 1) -> DataFrame:
    """Members of a small dimension with keys in the order of their natural key."""
    return members.select((F.row_number().over(Window.orderBy(natural)) + F.lit(first - 1)).alias(key), *members.columns)


def zones(lookup: DataFrame, special: tuple[int, ...] = (264, 265)) -> DataFrame:
    """A zone dimension from (zone_id, zone_name, borough) with the technical members -1 and 0; the run fails on duplicates."""
    spark = lookup.sparkSession
    technical = spark.createDataFrame([(-1, "Not applicable", "Not applicable"), (0, "Unknown", "Unknown")], "zone_id int, zone_name string, borough string")
    every = lookup.select(F.col("zone_id").cast("int").alias("zone_id"), "zone_name", "borough").unionByName(technical)
    bad = every.groupBy("zone_id").count().where("count > 1 or zone_id is null").limit(1).count()
    if bad:
        raise ValueError("zone ids are null or occur twice")
    is_special, is_technical = F.col("zone_id").isin(*special), F.col("zone_id") < 1
    return keyed(every.withColumns({"is_special": is_special, "is_technical": is_technical, "is_authoritative": ~(is_special | is_technical)}), "zone_id", "zone_key")


def labels(spark: SparkSession, values: dict[int, str], code: str, name: str) -> DataFrame:
    return spark.createDataFrame(sorted(values.items()), f"{code} int, {name} string")


def labelled_or_fail(df: DataFrame, code: str, values: dict[int, str], out: str) -> DataFrame:
    """``df`` with a code's label; an unknown code fails the task that meets it."""
    missing = F.raise_error(F.concat(F.lit(f"unknown {code}: "), F.coalesce(F.col(code).cast("string"), F.lit("null"))))
    found = S.label(code, values)
    return df.withColumn(out, F.when(found.isNotNull(), found).otherwise(missing))


def unresolved(facts: DataFrame, dim: DataFrame, *on: str) -> DataFrame:
    """Facts without a member of the dimension."""
    return facts.join(dim.select(*on).distinct(), list(on), "left_anti")


def resolved(facts: DataFrame, dim: DataFrame, on: str, key: str, role: str | None = None, unknown: int = 0) -> DataFrame:
    """``facts`` with the dimension's surrogate key (as ``role``), unknown members by ``unknown``."""
    return facts.join(dim.select(F.col(on).alias("_on"), F.col(key).alias("_key")), F.col(on) == F.col("_on"), "left").withColumn(role or key, F.coalesce("_key", F.lit(unknown))).drop("_on", "_key")


def role_playing(facts: DataFrame, zone_dim: DataFrame, roles: dict[str, str]) -> DataFrame:
    """``facts`` with names and boroughs of several zone columns (column: prefix) and whether each was found."""
    for column, prefix in roles.items():
        dim = zone_dim.select(F.col("zone_id").alias("_z"), F.col("zone_name").alias(f"{prefix}_zone"), F.col("borough").alias(f"{prefix}_borough"), F.lit(True).alias(f"{prefix}_matched"))
        facts = facts.join(dim, F.col(column) == F.col("_z"), "left").drop("_z").withColumn(f"{prefix}_matched", F.coalesce(f"{prefix}_matched", F.lit(False)))
    return facts
