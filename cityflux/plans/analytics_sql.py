"""The named analyses in SQL over the driver's tables, for checking."""

from __future__ import annotations

from .driver import SQL

B = "CAST(sum({}) AS BIGINT)"
_DAYPART = "CASE WHEN hour < 6 THEN 'Night' WHEN hour < 12 THEN 'Morning' WHEN hour < 18 THEN 'Afternoon' ELSE 'Evening' END"
_LABEL = "lpad(CAST(hour AS VARCHAR), 2, '0') || ':00'"


def trips(name: str = "trips") -> str:
    return f"CAST(sum({name}) AS BIGINT)"


def revenue(name: str = "revenue") -> str:
    return f"CAST(sum({name}) AS DOUBLE)"


def mean(name: str) -> str:
    return f"round(CAST(sum({name}) AS DOUBLE) / count({name}), 6)"


def ratio(a: str, b: str, factor: str = "") -> str:
    return f"round({factor}CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 6)"


_ZT = f"zt AS (SELECT zone_id, {trips()} AS t, {revenue()} AS r, {trips('complaints')} AS c FROM g GROUP BY zone_id)"
_GROWTH = f"""
, mm AS ({{months}}), lg AS (SELECT *, lag(now) OVER (PARTITION BY zone_id ORDER BY month_start) AS before FROM mm),
gr AS (SELECT *, {ratio('now - before', 'before', '100.0 * ')} AS growth_pct FROM lg WHERE before IS NOT NULL),
rk AS (SELECT *, dense_rank() OVER (PARTITION BY month_start ORDER BY growth_pct DESC NULLS LAST) AS growth_rank FROM gr)
SELECT CAST(month_start AS VARCHAR) AS month_start, zone_name, borough, before AS previous_month_trips, now AS monthly_trips, growth_pct, growth_rank FROM rk JOIN z USING (zone_id) WHERE growth_rank <= 10
"""
_MONTHS = f"SELECT zone_id, CAST(date_trunc('month', date) AS DATE) AS month_start, {trips()} AS now FROM mf GROUP BY ALL"
_SPIKES = """
, st AS (SELECT *, avg(daily_trips) OVER p AS mt, stddev_samp(daily_trips) OVER p AS dt, avg(daily_complaints) OVER p AS mc, stddev_samp(daily_complaints) OVER p AS dc FROM dz WINDOW p AS (PARTITION BY zone_id)),
sc AS (SELECT *, round((daily_trips - mt) / nullif(round(dt, 9), 0), 6) AS taxi_z_score, round((daily_complaints - mc) / nullif(round(dc, 9), 0), 6) AS complaint_z_score FROM st)
SELECT zone_name, borough, CAST(date AS VARCHAR) AS full_date, daily_trips, daily_complaints, taxi_z_score, complaint_z_score FROM sc JOIN z USING (zone_id) WHERE taxi_z_score >= {least} AND complaint_z_score >= {least}
"""
_ROLLING = """
SELECT zone_name, borough, CAST(date AS VARCHAR) AS full_date, daily_trips, round(CAST(sum(daily_trips) OVER p AS DOUBLE) / count(*) OVER p, 6) AS rolling_7_day_avg_trips
FROM dz JOIN z USING (zone_id) WINDOW p AS (PARTITION BY zone_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
"""
_HOURS = f"SELECT hour AS hour_of_day, {_LABEL} AS hour_label, {_DAYPART} AS daypart, "
_CITY = ", ch AS (SELECT date, hour, any_value(weather_condition) AS weather_condition, avg(temperature_c) AS temperature_c, sum(trips) AS trips, sum(revenue) AS revenue, sum(complaints) AS complaints FROM g GROUP BY date, hour)"
_QUART = f", {_ZT}, q AS (SELECT *, ntile(4) OVER (ORDER BY t DESC, zone_id) AS dq, ntile(4) OVER (ORDER BY c DESC, zone_id) AS cq FROM zt)"
_SNOW = "CASE WHEN snowfall_cm = 0 THEN 'No Snow' WHEN snowfall_cm > 0 AND snowfall_cm < 1 THEN 'Light Snow' WHEN snowfall_cm >= 1 AND snowfall_cm < 5 THEN 'Moderate Snow' ELSE 'Heavy Snow' END"
_TEMPERATURE = "CASE WHEN temperature_c < 0 THEN 'Freezing (<0C)' WHEN temperature_c < 10 THEN 'Cold (0-10C)' WHEN temperature_c < 20 THEN 'Cool (10-20C)' WHEN temperature_c < 30 THEN 'Warm (20-30C)' ELSE 'Hot (30C+)' END"
_PEAK = "(isodow(date) < 6 AND (hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 18))"

BODY = {
    "q01_top_zones": f", {_ZT} SELECT zone_id, zone_name, borough, t AS total_trips FROM zt JOIN z USING (zone_id) ORDER BY t DESC, zone_id LIMIT 20",
    "q02_busiest_hours": f"{_HOURS} {trips()} AS total_trips, {mean('trips')} AS avg_trips_per_zone_hour FROM g GROUP BY hour",
    "q03_top_revenue_zones": f", {_ZT} SELECT zone_id, zone_name, borough, r AS total_revenue, t AS total_trips FROM zt JOIN z USING (zone_id) ORDER BY r DESC, zone_id LIMIT 20",
    "q04_weighted_fare": f"SELECT borough, {trips()} AS total_trips, {revenue()} AS total_revenue, {ratio('sum(CAST(average_fare AS DECIMAL(24,6)) * trips)', 'sum(trips)')} AS weighted_average_fare FROM g JOIN z USING (zone_id) WHERE trips > 0 GROUP BY borough",
    "q05_month_growth": _GROWTH.format(months=_MONTHS),
    "q05o_month_growth_daily": _GROWTH.format(months=_MONTHS),
    "q06_rain_or_dry": f"SELECT CASE WHEN rain_mm > 0 THEN 'Rain' ELSE 'Dry' END AS weather_group, {trips()} AS total_trips, {mean('trips')} AS avg_trips_per_zone_hour, {mean('revenue')} AS avg_revenue_per_zone_hour FROM g GROUP BY 1",
    "q07_snow_bands": f"SELECT {_SNOW} AS snowfall_band, count(*) AS zone_hours, {trips()} AS total_trips, {mean('trips')} AS avg_trips_per_zone_hour, {revenue()} AS total_revenue FROM g GROUP BY 1",
    "q08_top_quartile_complaints": f"{_QUART} SELECT zone_name, borough, t AS total_trips, c AS total_complaints, dq AS demand_quartile FROM q JOIN z USING (zone_id) WHERE dq = 1",
    "q09_complaints_without_demand": f"{_QUART} SELECT zone_name, borough, t AS total_trips, c AS total_complaints, 'High Complaints / Low Taxi Demand' AS zone_profile FROM q JOIN z USING (zone_id) WHERE cq = 1 AND dq >= 3",
    "q10_hourly_revenue": f"{_HOURS} {revenue()} AS total_revenue, {trips()} AS total_trips, {ratio('sum(revenue)', 'sum(trips)')} AS revenue_per_trip FROM g GROUP BY hour",
    "q11_week_parts": f"SELECT CASE WHEN isodow(date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, {trips()} AS total_trips, {revenue()} AS total_revenue, {mean('trips')} AS avg_trips_per_zone_hour FROM g GROUP BY 1",
    "q12_revenue_volatility": f"SELECT zone_name, borough, {mean('revenue')} AS avg_hourly_revenue, round(stddev_samp(CAST(revenue AS DOUBLE)), 6) AS revenue_stddev, CAST(max(revenue) AS DOUBLE) AS max_hourly_revenue FROM g JOIN z USING (zone_id) GROUP BY zone_name, borough HAVING sum(trips) > 0 ORDER BY revenue_stddev DESC, zone_name LIMIT 20",
    "q13_rising_complaints": f", mm AS (SELECT zone_id, date_trunc('month', date) AS m, {trips('complaints')} AS now FROM mf GROUP BY ALL), lg AS (SELECT *, lag(now) OVER (PARTITION BY zone_id ORDER BY m) AS before FROM mm), s AS (SELECT zone_id, count(*) FILTER (now > before) AS increasing_months, count(before) AS comparable_months FROM lg GROUP BY zone_id) SELECT zone_name, borough, increasing_months, comparable_months, {ratio('increasing_months', 'comparable_months', '100.0 * ')} AS increasing_month_pct FROM s JOIN z USING (zone_id) WHERE comparable_months > 0 ORDER BY increasing_month_pct DESC, increasing_months DESC, zone_id LIMIT 20",
    "q14_spikes": _SPIKES.format(least=1.0),
    "q14o_spikes_joined": _SPIKES.format(least=1.0),
    "q15_rolling_mean": _ROLLING,
    "q15o_rolling_mean_daily": _ROLLING,
    "q16_borough_revenue_rank": f", {_ZT}, rk AS (SELECT *, dense_rank() OVER (PARTITION BY borough ORDER BY r DESC) AS k FROM zt JOIN z USING (zone_id)) SELECT borough, zone_name, r AS total_revenue, t AS total_trips, k AS revenue_rank_in_borough FROM rk WHERE k <= 10",
    "q17_by_weather": f"SELECT weather_condition, count(*) AS zone_hours, {trips()} AS total_trips, {revenue()} AS total_revenue, {mean('trips')} AS avg_trips_per_zone_hour, {mean('temperature_c')} AS avg_temperature_c, {mean('rain_mm')} AS avg_rain_mm, {mean('snowfall_cm')} AS avg_snowfall_cm FROM g GROUP BY 1",
    "f01_city_share": f", {_ZT} SELECT zone_id, zone_name, borough, t AS total_trips, {ratio('t', 'sum(t) OVER ()', '100.0 * ')} AS pct_of_city_trips FROM zt JOIN z USING (zone_id) ORDER BY t DESC, zone_id LIMIT 15",
    "f02_demand_by_hour": f"SELECT hour AS hour_of_day, {_DAYPART} AS daypart, {trips()} AS total_trips, {mean('trips')} AS avg_zone_hour_trips FROM g GROUP BY hour",
    "f03_revenue_and_yield": f", {_ZT} SELECT zone_id, zone_name, borough, t AS total_trips, r AS total_revenue, {ratio('r', 't')} AS revenue_per_trip FROM zt JOIN z USING (zone_id) ORDER BY r DESC, zone_id LIMIT 15",
    "f04_by_month": f"SELECT CAST(month(date) AS BIGINT) AS month_number, monthname(date) AS month_name, {trips()} AS total_trips, {revenue()} AS total_revenue, {trips('complaints')} AS complaints FROM mf GROUP BY 1, 2",
    "f05_weather_city_hours": f"{_CITY} SELECT weather_condition, count(*) AS observed_city_hours, {mean('trips')} AS avg_city_trips_per_hour, {mean('revenue')} AS avg_city_revenue_per_hour, {mean('complaints')} AS avg_city_complaints_per_hour FROM ch GROUP BY 1",
    "f06_temperature_city_hours": f"{_CITY} SELECT {_TEMPERATURE} AS temperature_band, count(*) AS observed_city_hours, {mean('trips')} AS avg_city_trips_per_hour, {mean('complaints')} AS avg_city_complaints_per_hour FROM ch GROUP BY 1",
    "f07_dominant_zone": f", c AS (SELECT event_type, zone_id, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY event_type) AS BIGINT) AS total, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, zone_id) AS k FROM c) SELECT event_type AS complaint_type, zone_name AS dominant_zone, borough, n AS dominant_zone_complaints, total AS category_total, {ratio('n', 'total', '100.0 * ')} AS dominant_zone_share_pct FROM r JOIN z USING (zone_id) WHERE k = 1 AND total >= 1000 ORDER BY dominant_zone_share_pct DESC, total DESC, event_type LIMIT 20",
    "f08_pearson": ", t AS (SELECT zone_id, CAST(sum(trips) AS DOUBLE) AS x, CAST(sum(complaints) AS DOUBLE) AS y FROM g GROUP BY zone_id) SELECT round(corr(x, y), 6) AS pearson_zone_trips_vs_complaints FROM t",
    "f08b_complaints_per_trips": f", {_ZT} SELECT zone_name, borough, t AS total_trips, c AS total_complaints, {ratio('c', 't', '1000.0 * ')} AS complaints_per_1000_trips FROM zt JOIN z USING (zone_id) WHERE t > 0 ORDER BY c DESC, zone_name LIMIT 25",
    "f12_rank_gaps": f", {_ZT}, rk AS (SELECT *, rank() OVER (ORDER BY t DESC) AS a, rank() OVER (ORDER BY r DESC) AS b, rank() OVER (ORDER BY c DESC) AS d FROM zt) SELECT zone_name, borough, t AS trips, r AS revenue, c AS complaints, a AS demand_rank, b AS revenue_rank, d AS complaint_rank, abs(d - a) AS complaint_demand_rank_gap, abs(b - a) AS revenue_demand_rank_gap, {ratio('r', 't')} AS revenue_per_trip, {ratio('c', 't', '1000.0 * ')} AS complaints_per_1000_trips FROM rk JOIN z USING (zone_id) WHERE t > 0 ORDER BY abs(d - a) + abs(b - a) DESC, zone_id LIMIT 25",
    "f13_control_totals": f"SELECT {trips()} AS total_trips, {revenue()} AS total_revenue, {trips('complaints')} AS total_complaints, count(*) AS gold_rows FROM g",
    "b00_measures": f"SELECT {trips()} AS total_trips, {revenue()} AS total_revenue, {trips('complaints')} AS total_complaints, {ratio('sum(revenue)', 'sum(trips)')} AS average_fare, {mean('temperature_c')} AS average_temperature, CAST(coalesce(sum(trips) FILTER ({_PEAK}), 0) AS BIGINT) AS peak_trips, CAST(coalesce(sum(trips) FILTER (NOT {_PEAK}), 0) AS BIGINT) AS off_peak_trips, round(100.0 * CAST(coalesce(sum(trips) FILTER (isodow(date) >= 6), 0) AS DOUBLE) / nullif(CAST(sum(trips) AS DOUBLE), 0), 6) AS weekend_share_pct, CAST(coalesce(sum(trips) FILTER (rain_mm > 0), 0) AS BIGINT) AS rain_trips, CAST(coalesce(sum(trips) FILTER (snowfall_cm > 0), 0) AS BIGINT) AS snow_trips, round(100.0 * (CAST(sum(trips) FILTER (rain_mm > 0) AS DOUBLE) / count(*) FILTER (rain_mm > 0) - CAST(sum(trips) FILTER (NOT rain_mm > 0) AS DOUBLE) / count(*) FILTER (NOT rain_mm > 0)) / (CAST(sum(trips) FILTER (NOT rain_mm > 0) AS DOUBLE) / count(*) FILTER (NOT rain_mm > 0)), 6) AS weather_impact_pct FROM g",
}

ORACLES = {name: SQL + body for name, body in BODY.items()}
