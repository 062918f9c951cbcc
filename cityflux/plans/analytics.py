"""Rankings, growth, rolling means, spikes, correlation, weather and forecast quality over the zone-hour fact.

The fact has date, hour, zone_id, trips, revenue (decimal), average_fare, complaints, temperature_c, rain_mm, snowfall_cm
and weather_condition; zones have zone_id, zone_name and borough. Facts are summed by zone, hour or day before a dimension
is joined, so joins and windows see at most one row per zone and day. Ties are broken by zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


@dataclass(frozen=True)
class Star:
    fact: DataFrame
    zones: DataFrame


def total(name: str) -> Column:
    return F.sum(name).cast("double" if name == "revenue" else "long")


def mean(name: str) -> Column:
    """Of a count or an amount, from exact sums."""
    return F.round(F.sum(name).cast("double") / F.count(name), 6)


def r6(x: Column) -> Column:
    return F.round(x, 6)


def by_zone(s: Star, *names: str) -> DataFrame:
    sums = s.fact.groupBy("zone_id").agg(*[total(n).alias(f"total_{n}") for n in names])
    return sums.join(F.broadcast(s.zones), "zone_id")


# Questions 1 to 17


def top_zones(s: Star, n: int = 20) -> DataFrame:
    return by_zone(s, "trips").select("zone_id", "zone_name", "borough", "total_trips").orderBy(F.desc("total_trips"), "zone_id").limit(n)


def _by_hour(s: Star, *measures: Column) -> DataFrame:
    out = s.fact.groupBy(F.col("hour").alias("hour_of_day")).agg(*measures)
    return out.select("hour_of_day", S.hour_label("hour_of_day").alias("hour_label"), S.daypart("hour_of_day").alias("daypart"), *out.columns[1:])


def busiest_hours(s: Star) -> DataFrame:
    return _by_hour(s, total("trips").alias("total_trips"), mean("trips").alias("avg_trips_per_zone_hour"))


def top_revenue_zones(s: Star, n: int = 20) -> DataFrame:
    return by_zone(s, "revenue", "trips").select("zone_id", "zone_name", "borough", "total_revenue", "total_trips").orderBy(F.desc("total_revenue"), "zone_id").limit(n)


def weighted_fare(s: Star) -> DataFrame:
    """Fares weighted by trips, by borough, over cells with trips."""
    sums = s.fact.where("trips > 0").groupBy("zone_id").agg(F.sum("trips").alias("t"), F.sum("revenue").alias("r"), F.sum(F.round(F.col("average_fare").cast("decimal(24,6)") * F.col("trips"), 6)).alias("w"))
    out = sums.join(F.broadcast(s.zones), "zone_id").groupBy("borough").agg(F.sum("t").alias("t"), F.sum("r").alias("r"), F.sum("w").alias("w"))
    return out.select("borough", F.col("t").cast("long").alias("total_trips"), F.col("r").cast("double").alias("total_revenue"), r6(S.ratio(F.col("w"), F.col("t"))).alias("weighted_average_fare"))


def monthly(s: Star, name: str) -> DataFrame:
    return s.fact.groupBy("zone_id", S.month_start("date").alias("month_start")).agg(total(name).alias("now")).withColumn("before", F.lag("now").over(Window.partitionBy("zone_id").orderBy("month_start")))


def month_growth(s: Star, ranks: int = 10, source: DataFrame | None = None) -> DataFrame:
    grown = (source or monthly(s, "trips")).where("before is not null").withColumn("growth_pct", r6(100.0 * S.ratio(F.col("now") - F.col("before"), F.col("before"))))
    ranked = grown.withColumn("growth_rank", F.dense_rank().over(Window.partitionBy("month_start").orderBy(F.desc_nulls_last("growth_pct")))).where(F.col("growth_rank") <= ranks)
    return ranked.join(F.broadcast(s.zones), "zone_id").select("month_start", "zone_name", "borough", F.col("before").alias("previous_month_trips"), F.col("now").alias("monthly_trips"), "growth_pct", F.col("growth_rank").cast("long").alias("growth_rank"))


def month_growth_daily(s: Star, days: DataFrame, ranks: int = 10) -> DataFrame:
    """``month_growth`` from the daily aggregate."""
    months = days.groupBy("zone_id", S.month_start("date").alias("month_start")).agg(F.sum("daily_trips").cast("long").alias("now"))
    return month_growth(s, ranks, months.withColumn("before", F.lag("now").over(Window.partitionBy("zone_id").orderBy("month_start"))))


def rain_or_dry(s: Star) -> DataFrame:
    return s.fact.groupBy(S.rain_group("rain_mm").alias("weather_group")).agg(total("trips").alias("total_trips"), mean("trips").alias("avg_trips_per_zone_hour"), mean("revenue").alias("avg_revenue_per_zone_hour"))


def snow_bands(s: Star) -> DataFrame:
    return s.fact.groupBy(S.snow_band("snowfall_cm").alias("snowfall_band")).agg(F.count(F.lit(1)).alias("zone_hours"), total("trips").alias("total_trips"), mean("trips").alias("avg_trips_per_zone_hour"), total("revenue").alias("total_revenue"))


def _quartiles(s: Star) -> DataFrame:
    totals = s.fact.groupBy("zone_id").agg(total("trips").alias("total_trips"), total("complaints").alias("total_complaints"))  # a row per zone
    quarter = lambda c: F.ntile(4).over(Window.orderBy(F.desc(c), "zone_id"))
    return totals.withColumns({"demand_quartile": quarter("total_trips"), "complaint_quartile": quarter("total_complaints")}).join(F.broadcast(s.zones), "zone_id")


def top_quartile_complaints(s: Star) -> DataFrame:
    return _quartiles(s).where("demand_quartile = 1").select("zone_name", "borough", "total_trips", "total_complaints", F.col("demand_quartile").cast("long").alias("demand_quartile"))


def complaints_without_demand(s: Star) -> DataFrame:
    """Zones of the first complaint quartile and the lower half of demand."""
    return _quartiles(s).where("complaint_quartile = 1 and demand_quartile >= 3").select("zone_name", "borough", "total_trips", "total_complaints", F.lit("High Complaints / Low Taxi Demand").alias("zone_profile"))


def hourly_revenue(s: Star) -> DataFrame:
    return _by_hour(s, total("revenue").alias("total_revenue"), total("trips").alias("total_trips"), r6(S.ratio(F.sum("revenue"), F.sum("trips"))).alias("revenue_per_trip"))


def week_parts(s: Star) -> DataFrame:
    kind = F.when(S.weekend("date"), "Weekend").otherwise("Weekday")
    return s.fact.groupBy(kind.alias("day_type")).agg(total("trips").alias("total_trips"), total("revenue").alias("total_revenue"), mean("trips").alias("avg_trips_per_zone_hour"))


def revenue_volatility(s: Star, n: int = 20) -> DataFrame:
    named = s.fact.join(F.broadcast(s.zones), "zone_id")  # zones: a reference table
    out = named.groupBy("zone_name", "borough").agg(mean("revenue").alias("avg_hourly_revenue"), r6(F.stddev_samp(F.col("revenue").cast("double"))).alias("revenue_stddev"), F.max("revenue").cast("double").alias("max_hourly_revenue"), F.sum("trips").alias("_t"))
    return out.where("_t > 0").drop("_t").orderBy(F.desc("revenue_stddev"), "zone_name").limit(n)


def rising_complaints(s: Star, n: int = 20) -> DataFrame:
    months = monthly(s, "complaints").groupBy("zone_id").agg(F.count_if(F.col("now") > F.col("before")).alias("increasing_months"), F.count("before").alias("comparable_months"))
    out = months.where("comparable_months > 0").withColumn("increasing_month_pct", r6(100.0 * S.ratio(F.col("increasing_months"), F.col("comparable_months"))))
    return out.join(F.broadcast(s.zones), "zone_id").orderBy(F.desc("increasing_month_pct"), F.desc("increasing_months"), "zone_id").limit(n).select("zone_name", "borough", "increasing_months", "comparable_months", "increasing_month_pct")


def daily_zone(s: Star) -> DataFrame:
    return s.fact.groupBy("zone_id", "date").agg(total("trips").alias("daily_trips"), total("complaints").alias("daily_complaints"))


def _spikes(scored: DataFrame, s: Star, least: float) -> DataFrame:
    z = lambda x: S.ratio(F.col(f"daily_{x}") - F.col(f"avg_{x}"), F.round(f"sd_{x}", 9))
    out = scored.withColumns({"taxi_z_score": r6(z("trips")), "complaint_z_score": r6(z("complaints"))})
    return out.where((F.col("taxi_z_score") >= least) & (F.col("complaint_z_score") >= least)).join(F.broadcast(s.zones), "zone_id").select("zone_name", "borough", F.col("date").alias("full_date"), "daily_trips", "daily_complaints", "taxi_z_score", "complaint_z_score")


def spikes(s: Star, least: float = 2.0) -> DataFrame:
    """Days on which trips and complaints are both ``least`` deviations above their zone's mean; one window serves all four statistics."""
    w = Window.partitionBy("zone_id")
    stats = {f"{f}_{x}": g(F.col(f"daily_{x}").cast("double")).over(w) for x in ("trips", "complaints") for f, g in (("avg", F.avg), ("sd", F.stddev_samp))}
    return _spikes(daily_zone(s).withColumns(stats), s, least)


def spikes_joined(s: Star, days: DataFrame, least: float = 2.0) -> DataFrame:
    """``spikes`` from the daily aggregate, with statistics by group and join."""
    stats = days.groupBy("zone_id").agg(*[g(F.col(f"daily_{x}").cast("double")).alias(f"{f}_{x}") for x in ("trips", "complaints") for f, g in (("avg", F.avg), ("sd", F.stddev_samp))])
    return _spikes(days.join(stats, "zone_id"), s, least)


def rolling_mean(s: Star, days: DataFrame | None = None) -> DataFrame:
    """Trips by day and their mean over seven rows, by zone."""
    w = Window.partitionBy("zone_id").orderBy("date").rowsBetween(-6, 0)
    rolled = (days if days is not None else daily_zone(s)).withColumn("rolling_7_day_avg_trips", r6(F.sum("daily_trips").over(w).cast("double") / F.count("daily_trips").over(w)))
    return rolled.join(F.broadcast(s.zones), "zone_id").select("zone_name", "borough", F.col("date").alias("full_date"), F.col("daily_trips").cast("long").alias("daily_trips"), "rolling_7_day_avg_trips")


def borough_revenue_rank(s: Star, ranks: int = 10) -> DataFrame:
    ranked = by_zone(s, "revenue", "trips").withColumn("revenue_rank_in_borough", F.dense_rank().over(Window.partitionBy("borough").orderBy(F.desc("total_revenue"))).cast("long"))
    return ranked.where(F.col("revenue_rank_in_borough") <= ranks).select("borough", "zone_name", "total_revenue", "total_trips", "revenue_rank_in_borough")


def by_weather(s: Star) -> DataFrame:
    return s.fact.groupBy("weather_condition").agg(
        F.count(F.lit(1)).alias("zone_hours"), total("trips").alias("total_trips"), total("revenue").alias("total_revenue"), mean("trips").alias("avg_trips_per_zone_hour"),
        mean("temperature_c").alias("avg_temperature_c"), mean("rain_mm").alias("avg_rain_mm"), mean("snowfall_cm").alias("avg_snowfall_cm"),
    )


# Findings


def city_share(s: Star, n: int = 15) -> DataFrame:
    share = 100.0 * S.ratio(F.col("total_trips"), F.sum("total_trips").over(Window.partitionBy()))
    return by_zone(s, "trips").withColumn("pct_of_city_trips", r6(share)).orderBy(F.desc("total_trips"), "zone_id").limit(n).select("zone_id", "zone_name", "borough", "total_trips", "pct_of_city_trips")


def demand_by_hour(s: Star) -> DataFrame:
    return busiest_hours(s).drop("hour_label").withColumnRenamed("avg_trips_per_zone_hour", "avg_zone_hour_trips")


def revenue_and_yield(s: Star, n: int = 15) -> DataFrame:
    out = by_zone(s, "trips", "revenue").withColumn("revenue_per_trip", r6(S.ratio(F.col("total_revenue"), F.col("total_trips"))))
    return out.orderBy(F.desc("total_revenue"), "zone_id").limit(n).select("zone_id", "zone_name", "borough", "total_trips", "total_revenue", "revenue_per_trip")


def by_month(s: Star) -> DataFrame:
    return s.fact.groupBy(F.month("date").cast("long").alias("month_number"), F.date_format("date", "MMMM").alias("month_name")).agg(total("trips").alias("total_trips"), total("revenue").alias("total_revenue"), total("complaints").alias("complaints"))


def _city_hours(s: Star) -> DataFrame:
    """One row per hour: weather is the same for all zones of an hour."""
    return s.fact.groupBy("date", "hour").agg(F.first("weather_condition").alias("weather_condition"), F.avg("temperature_c").alias("temperature_c"), F.sum("trips").alias("trips"), F.sum("revenue").alias("revenue"), F.sum("complaints").alias("complaints"))


def weather_city_hours(s: Star) -> DataFrame:
    return _city_hours(s).groupBy("weather_condition").agg(F.count(F.lit(1)).alias("observed_city_hours"), mean("trips").alias("avg_city_trips_per_hour"), mean("revenue").alias("avg_city_revenue_per_hour"), mean("complaints").alias("avg_city_complaints_per_hour"))


def temperature_city_hours(s: Star) -> DataFrame:
    return _city_hours(s).groupBy(S.temperature_band("temperature_c").alias("temperature_band")).agg(F.count(F.lit(1)).alias("observed_city_hours"), mean("trips").alias("avg_city_trips_per_hour"), mean("complaints").alias("avg_city_complaints_per_hour"))


def dominant_zone(complaints: DataFrame, zones: DataFrame, least: int = 1000, n: int = 20) -> DataFrame:
    """The zone with most complaints of each type with ``least`` complaints; ``complaints`` has complaint_type and zone_id."""
    counts = complaints.groupBy("complaint_type", "zone_id").agg(F.count(F.lit(1)).alias("dominant_zone_complaints")).join(F.broadcast(zones), "zone_id")
    ranked = counts.withColumns({
        "category_total": F.sum("dominant_zone_complaints").over(Window.partitionBy("complaint_type")),
        "_rank": F.row_number().over(Window.partitionBy("complaint_type").orderBy(F.desc("dominant_zone_complaints"), "zone_id")),
    }).where((F.col("_rank") == 1) & (F.col("category_total") >= least))
    out = ranked.withColumn("dominant_zone_share_pct", r6(100.0 * S.ratio(F.col("dominant_zone_complaints"), F.col("category_total"))))
    return out.orderBy(F.desc("dominant_zone_share_pct"), F.desc("category_total"), "complaint_type").limit(n).select("complaint_type", F.col("zone_name").alias("dominant_zone"), "borough", "dominant_zone_complaints", "category_total", "dominant_zone_share_pct")


def pearson(s: Star) -> DataFrame:
    """Correlation of zone totals from their sums."""
    x, y = F.col("trips"), F.col("complaints")
    totals = s.fact.groupBy("zone_id").agg(F.sum("trips").cast("double").alias("trips"), F.sum("complaints").cast("double").alias("complaints"))
    m = totals.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sx2"), F.sum(y * y).alias("sy2"))
    c = F.col
    spread = F.sqrt((c("n") * c("sx2") - c("sx") * c("sx")) * (c("n") * c("sy2") - c("sy") * c("sy")))
    return m.select(r6(S.ratio(c("n") * c("sxy") - c("sx") * c("sy"), spread)).alias("pearson_zone_trips_vs_complaints"))


def complaints_per_trips(s: Star, n: int = 25) -> DataFrame:
    out = by_zone(s, "trips", "complaints").where("total_trips > 0").withColumn("complaints_per_1000_trips", r6(1000.0 * S.ratio(F.col("total_complaints"), F.col("total_trips"))))
    return out.orderBy(F.desc("total_complaints"), "zone_name").limit(n).select("zone_name", "borough", "total_trips", "total_complaints", "complaints_per_1000_trips")


def rank_gaps(s: Star, n: int = 25) -> DataFrame:
    """Zones whose complaint and revenue ranks are far from their demand rank."""
    totals = by_zone(s, "trips", "revenue", "complaints")  # a row per zone
    rank = lambda c: F.rank().over(Window.orderBy(F.desc(c))).cast("long")
    out = totals.withColumns({"demand_rank": rank("total_trips"), "revenue_rank": rank("total_revenue"), "complaint_rank": rank("total_complaints")}).where("total_trips > 0")
    out = out.withColumns({
        "complaint_demand_rank_gap": F.abs(F.col("complaint_rank") - F.col("demand_rank")), "revenue_demand_rank_gap": F.abs(F.col("revenue_rank") - F.col("demand_rank")),
        "revenue_per_trip": r6(S.ratio(F.col("total_revenue"), F.col("total_trips"))), "complaints_per_1000_trips": r6(1000.0 * S.ratio(F.col("total_complaints"), F.col("total_trips"))),
    })
    return out.orderBy(F.desc(F.col("complaint_demand_rank_gap") + F.col("revenue_demand_rank_gap")), "zone_id").limit(n).select(
        "zone_name", "borough", F.col("total_trips").alias("trips"), F.col("total_revenue").alias("revenue"), F.col("total_complaints").alias("complaints"), "demand_rank", "revenue_rank", "complaint_rank",
        "complaint_demand_rank_gap", "revenue_demand_rank_gap", "revenue_per_trip", "complaints_per_1000_trips",
    )


def control_totals(s: Star) -> DataFrame:
    return s.fact.agg(total("trips").alias("total_trips"), total("revenue").alias("total_revenue"), total("complaints").alias("total_complaints"), F.count(F.lit(1)).alias("gold_rows"))


# Business measures: one row of the numbers that a dashboard shows


def measures(s: Star) -> DataFrame:
    """Peak hours are 7-9 and 16-18 on weekdays; weather impact compares rainy with dry zone-hours; weekend share is of trips (definitions of this library)."""
    trips, rain = F.col("trips"), F.col("rain_mm") > 0
    peak = ~S.weekend("date") & (F.col("hour").between(7, 9) | F.col("hour").between(16, 18))
    of = lambda p: F.sum(F.when(p, trips).otherwise(0)).cast("long")
    per = lambda p: S.ratio(F.sum(F.when(p, trips)), F.count_if(p))
    return s.fact.agg(
        total("trips").alias("total_trips"), total("revenue").alias("total_revenue"), total("complaints").alias("total_complaints"), r6(S.ratio(F.sum("revenue"), F.sum("trips"))).alias("average_fare"), mean("temperature_c").alias("average_temperature"),
        of(peak).alias("peak_trips"), of(~peak).alias("off_peak_trips"), r6(100.0 * S.ratio(of(S.weekend("date")), F.sum("trips"))).alias("weekend_share_pct"), of(rain).alias("rain_trips"), of(F.col("snowfall_cm") > 0).alias("snow_trips"),
        r6(100.0 * S.ratio(per(rain) - per(~rain), per(~rain))).alias("weather_impact_pct"),
    )
