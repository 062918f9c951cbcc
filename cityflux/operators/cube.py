"""The dense date x hour x zone cube.

The grid has every hour of a period for every zone; counts and revenue of empty cells are 0, averages stay null. Facts
are aggregated once per cell (partial sums before the shuffle) and joined to the grid, whose size is hours x zones and
doesn't depend on the number of facts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAIN = ["date", "hour", "zone_id"]


def hours(spark: SparkSession, start: str, end: str) -> DataFrame:
    """date, hour for every hour of [start, end)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("date"))
    return days.select("date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))


def grid(spark: SparkSession, start: str, end: str, zones: DataFrame) -> DataFrame:
    return hours(spark, start, end).crossJoin(F.broadcast(zones))  # zones: a reference table of a few hundred rows


def cells(facts: DataFrame, moment: str, zone: Column, measures: Mapping[str, Column]) -> DataFrame:
    """Measures by date, hour and zone."""
    at = facts.withColumns({"date": F.to_date(moment), "hour": F.hour(moment), "zone_id": zone})
    return at.groupBy(*GRAIN).agg(*[m.alias(name) for name, m in measures.items()])


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``; the run fails if a key occurs twice."""
    n = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if n:
        raise ValueError(f"{', '.join(keys)} isn't unique")
    return df


def dense_cube(base: DataFrame, facts: list[DataFrame], weather: DataFrame | None = None, zero: tuple[str, ...] = ()) -> DataFrame:
    """The grid with each facts table joined by cell and weather by hour; ``zero`` names the measures that are 0 in empty cells."""
    for f in facts:
        base = base.join(f, GRAIN, "left")
    if weather is not None:
        base = base.join(weather, ["date", "hour"], "left")
    return base.na.fill(0, list(zero))


def daily(cube: DataFrame) -> DataFrame:
    """Trips and complaints by date and zone."""
    return cube.groupBy("date", "zone_id").agg(F.sum("trips").alias("daily_trips"), F.sum("complaints").alias("daily_complaints"))


def routing_audit(facts: DataFrame, moment: str, stored_month: str) -> DataFrame:
    """Rows by event month and storage month; those more than a month apart are ``late``."""
    event = F.trunc(F.col(moment).cast("date"), "MM")
    stored = F.trunc(F.col(stored_month).cast("date"), "MM")
    rows = facts.groupBy(event.alias("event_month"), stored.alias("stored_month")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("late", F.abs(F.months_between("event_month", "stored_month")) > 1)
