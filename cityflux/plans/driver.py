"""The star schema over the driver's tables, and the same tables as SQL.

Zones are nations (users and customers by id modulo their number), boroughs are regions; trips are purchases, complaints are
errors, weather is an expression of day and hour. Months come from orders: an order is a trip, an urgent one a complaint too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.cube import GRAIN, cells, daily, dense_cube, grid, hours
from .analytics import Star
from .stored import stored

START, END, ZONES = "2024-01-01", "2024-01-31", 25


#: Schemas of the tables, so that reading one asks for no footers first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def zones(spark: SparkSession, d: str) -> DataFrame:
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").cast("int").alias("zone_id"), F.col("n_name").alias("zone_name"), F.col("r_name").alias("borough"))


def stored_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zones with their boroughs, a reference table of a few hundred rows, stored like the cube."""
    return stored(spark, "zones", _sources(d, "nation", "region"), lambda: zones(spark, d).coalesce(1))


def weather(spark: SparkSession) -> DataFrame:
    """Temperature, rain, snow and condition of each hour, by a rule."""
    day, hour = F.dayofmonth("date"), F.col("hour")
    n = day * 24 + hour
    names = F.array(*map(F.lit, ("Clear sky", "Mainly clear", "Partly cloudy", "Overcast", "Light drizzle", "Slight rain", "Slight snow fall")))
    return hours(spark, START, END).select(
        "date", "hour", ((day * 7 + hour * 3) % 45 - 8).cast("double").alias("temperature_c"),
        F.when(n % 7 == 0, (day + hour) % 5).otherwise(0).cast("double").alias("rain_mm"), (F.when(n % 11 == 0, (day * hour) % 7).otherwise(0) / F.lit(2.0)).cast("double").alias("snowfall_cm"),
        F.element_at(names, (F.floor(n / 6) % 7 + 1).cast("int")).alias("weather_condition"),
    )


def star(spark: SparkSession, d: str) -> Star:
    """The cube, which is Gold: built once for a data folder, then read."""
    return Star(stored(spark, "cube", _sources(d, "events", "nation", "region"), lambda: _cube(spark, d)), stored_zones(spark, d))


def days(spark: SparkSession, d: str) -> DataFrame:
    """The daily aggregate of the cube, stored like it."""
    return stored(spark, "days", _sources(d, "events", "nation", "region"), lambda: daily(star(spark, d).fact).coalesce(1))  # a row per zone and day


def _sources(d: str, *names: str) -> list[str]:
    return [f"{d}/{n}.parquet" for n in names]


def _cube(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.col("event_type").isin("purchase", "error")
    events = read(spark, d, "events").where((F.col("ts") >= F.lit(START).cast("timestamp_ntz")) & (F.col("ts") < F.lit(END).cast("timestamp_ntz")) & kinds)
    bought = F.col("event_type") == "purchase"
    value, trips = F.when(bought, S.money("value")), F.count_if(bought)
    measures = {
        "trips": trips, "revenue": F.sum(value), "average_fare": F.round(S.ratio(F.sum(value), F.count(value)), 6), "average_distance": F.round(S.ratio(F.sum(F.when(bought, F.col("event_id") % 100)), trips * 10), 6),
        "complaints": F.count_if(F.col("event_type") == "error"),
    }
    facts = cells(events, "ts", (F.col("user_id") % ZONES).cast("int"), measures)  # one scan for both kinds of facts
    fact = dense_cube(grid(spark, START, END, zones(spark, d).select("zone_id")), [facts], weather(spark), zero=("trips", "complaints"))
    return fact.withColumn("revenue", F.coalesce("revenue", F.lit(0).cast("decimal(28,2)"))).orderBy(*GRAIN)


def month_star(spark: SparkSession, d: str) -> Star:
    """Orders by zone and day, stored like the cube."""
    return Star(stored(spark, "month-days", _sources(d, "orders"), lambda: _month_days(spark, d)), stored_zones(spark, d))


def _month_days(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    fact = orders.groupBy((F.col("o_custkey") % ZONES).cast("int").alias("zone_id"), F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("trips"), F.sum(S.money("o_totalprice")).alias("revenue"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("complaints"))
    return fact.orderBy("zone_id", "date")


#: The tables above in SQL: z, ev, g (the cube), mf (orders by zone and day), dz (the cube by zone and day).
SQL = f"""
WITH z AS (
  SELECT CAST(n_nationkey AS INTEGER) AS zone_id, n_name AS zone_name, r_name AS borough FROM nation JOIN region ON n_regionkey = r_regionkey
), ev AS (
  SELECT *, CAST(user_id % {ZONES} AS INTEGER) AS zone_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'
), hrs AS (
  SELECT CAST(t AS DATE) AS date, CAST(hour(t) AS INTEGER) AS hour, day(t) AS dd, day(t) * 24 + hour(t) AS n FROM (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS t)
), w AS (
  SELECT date, hour, CAST((dd * 7 + hour * 3) % 45 - 8 AS DOUBLE) AS temperature_c, CAST(CASE WHEN n % 7 = 0 THEN (dd + hour) % 5 ELSE 0 END AS DOUBLE) AS rain_mm,
    CASE WHEN n % 11 = 0 THEN (dd * hour) % 7 ELSE 0 END / CAST(2 AS DOUBLE) AS snowfall_cm,
    (['Clear sky', 'Mainly clear', 'Partly cloudy', 'Overcast', 'Light drizzle', 'Slight rain', 'Slight snow fall'])[CAST((n // 6) % 7 + 1 AS INTEGER)] AS weather_condition FROM hrs
), tx AS (
  SELECT zone_id, date, hour, count(*) AS trips, sum(CAST(value AS DECIMAL(18,2))) AS revenue, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 6) AS average_fare FROM ev WHERE event_type = 'purchase' GROUP BY ALL
), cp AS (
  SELECT zone_id, date, hour, count(*) AS complaints FROM ev WHERE event_type = 'error' GROUP BY ALL
), g AS (
  SELECT w.*, z.zone_id, coalesce(trips, 0) AS trips, coalesce(revenue, 0) AS revenue, average_fare, coalesce(complaints, 0) AS complaints
  FROM w CROSS JOIN z LEFT JOIN tx ON tx.zone_id = z.zone_id AND tx.date = w.date AND tx.hour = w.hour LEFT JOIN cp ON cp.zone_id = z.zone_id AND cp.date = w.date AND cp.hour = w.hour
), mf AS (
  SELECT CAST(o_custkey % {ZONES} AS INTEGER) AS zone_id, CAST(o_orderdate AS DATE) AS date, count(*) AS trips, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue, count(*) FILTER (o_orderpriority = '1-URGENT') AS complaints FROM orders GROUP BY ALL
), dz AS (
  SELECT zone_id, date, CAST(sum(trips) AS BIGINT) AS daily_trips, CAST(sum(complaints) AS BIGINT) AS daily_complaints FROM g GROUP BY ALL
)
"""
