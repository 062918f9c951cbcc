"""Queries over the driver's tables by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import analytics as A
from . import analytics_sql, driver, pipeline


def _plain(df: DataFrame) -> DataFrame:
    """Dates as texts, so that engines agree on them."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else c for c, t in df.dtypes])


def _on_star(f, **how):
    return lambda spark, d: _plain(f(driver.star(spark, d), **how))


def _on_months(f, **how):
    return lambda spark, d: _plain(f(driver.month_star(spark, d), **how))


def _months_daily(spark, d):
    s = driver.month_star(spark, d)
    return _plain(A.month_growth_daily(s, s.fact.select("zone_id", "date", F.col("trips").alias("daily_trips"))))


def _with_days(f, **how):
    def run(spark, d):
        return _plain(f(driver.star(spark, d), days=driver.days(spark, d), **how))

    return run


def _dominant(spark, d):
    events = driver.read(spark, d, "events").where((F.col("ts") >= F.lit(driver.START).cast("timestamp_ntz")) & (F.col("ts") < F.lit(driver.END).cast("timestamp_ntz")))
    return A.dominant_zone(events.select(F.col("event_type").alias("complaint_type"), (F.col("user_id") % driver.ZONES).cast("int").alias("zone_id")), driver.zones(spark, d))


QUERIES = {
    "q01_top_zones": _on_star(A.top_zones),
    "q02_busiest_hours": _on_star(A.busiest_hours),
    "q03_top_revenue_zones": _on_star(A.top_revenue_zones),
    "q04_weighted_fare": _on_star(A.weighted_fare),
    "q05_month_growth": _on_months(A.month_growth),
    "q05o_month_growth_daily": _months_daily,
    "q06_rain_or_dry": _on_star(A.rain_or_dry),
    "q07_snow_bands": _on_star(A.snow_bands),
    "q08_top_quartile_complaints": _on_star(A.top_quartile_complaints),
    "q09_complaints_without_demand": _on_star(A.complaints_without_demand),
    "q10_hourly_revenue": _on_star(A.hourly_revenue),
    "q11_week_parts": _on_star(A.week_parts),
    "q12_revenue_volatility": _on_star(A.revenue_volatility),
    "q13_rising_complaints": _on_months(A.rising_complaints),
    "q14_spikes": _on_star(A.spikes, least=1.0),
    "q14o_spikes_joined": _with_days(A.spikes_joined, least=1.0),
    "q15_rolling_mean": _on_star(A.rolling_mean),
    "q15o_rolling_mean_daily": _with_days(A.rolling_mean),
    "q16_borough_revenue_rank": _on_star(A.borough_revenue_rank),
    "q17_by_weather": _on_star(A.by_weather),
    "f01_city_share": _on_star(A.city_share),
    "f02_demand_by_hour": _on_star(A.demand_by_hour),
    "f03_revenue_and_yield": _on_star(A.revenue_and_yield),
    "f04_by_month": _on_months(A.by_month),
    "f05_weather_city_hours": _on_star(A.weather_city_hours),
    "f06_temperature_city_hours": _on_star(A.temperature_city_hours),
    "f07_dominant_zone": _dominant,
    "f08_pearson": _on_star(A.pearson),
    "f08b_complaints_per_trips": _on_star(A.complaints_per_trips),
    "f12_rank_gaps": _on_star(A.rank_gaps),
    "f13_control_totals": _on_star(A.control_totals),
    "b00_measures": _on_star(A.measures),
    **pipeline.Q,
}
ORACLES = {**analytics_sql.ORACLES, **pipeline.ORACLES}
