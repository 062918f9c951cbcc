"""Sources: Parquet, JSON pages and envelopes, columnar JSON payloads, CSV with literal N/A, polygon tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions import scalar as S


def _fields(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


TEXT, DOUBLE, LONG, INT, NTZ = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()
TRIPS = T.StructType([
    T.StructField("VendorID", INT), *_fields("tpep_pickup_datetime tpep_dropoff_datetime", NTZ), T.StructField("passenger_count", LONG), T.StructField("trip_distance", DOUBLE), T.StructField("RatecodeID", LONG),
    T.StructField("store_and_fwd_flag", TEXT), *_fields("PULocationID DOLocationID", INT), T.StructField("payment_type", LONG),
    *_fields("fare_amount extra mta_tax tip_amount tolls_amount improvement_surcharge total_amount congestion_surcharge Airport_fee cbd_congestion_fee", DOUBLE),
])
COMPLAINTS = T.StructType(_fields("unique_key created_date closed_date complaint_type agency borough latitude longitude incident_address status resolution_description", TEXT))
ZONE_LOOKUP = T.StructType([T.StructField("LocationID", INT), *_fields("Borough Zone service_zone", TEXT)])
HOURLY_KEYS = ("time", "temperature_2m", "relative_humidity_2m", "apparent_temperature", "precipitation", "rain", "snowfall", "weather_code", "wind_speed_10m", "wind_gusts_10m")
PAYLOAD = T.StructType([*_fields("latitude longitude elevation", DOUBLE), T.StructField("timezone", TEXT), T.StructField("hourly", T.StructType([T.StructField(k, T.ArrayType(TEXT if k == "time" else DOUBLE)) for k in HOURLY_KEYS]))])
LINEAGE = ("_source", "_source_file", "_ingested_at", "_run_id", "_processing_year", "_processing_month")

#: Labels of boroughs and of three complaint types (fixed values).
BOROUGHS = {"BRONX": "Bronx", "BROOKLYN": "Brooklyn", "MANHATTAN": "Manhattan", "QUEENS": "Queens", "STATEN ISLAND": "Staten Island", "UNSPECIFIED": "Unspecified"}
COMPLAINT_TYPES = {"PLUMBING": "Plumbing", "ELEVATOR": "Elevator", "ASBESTOS": "Asbestos"}


def parquet(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None, merge: bool = False) -> DataFrame:
    """A directory or a list of files; with a schema there is no inference, with ``merge`` differing schemas are united."""
    reader = spark.read.option("mergeSchema", str(merge).lower())
    return (reader.schema(schema) if schema else reader).parquet(*([paths] if isinstance(paths, str) else paths))


def with_lineage(df: DataFrame, source: str, run_id: str, ingested_at: str, year: int, month: int) -> DataFrame:
    """Source-aligned rows with where they come from."""
    return df.withColumns({
        "_source": F.lit(source), "_source_file": F.col("_metadata.file_path"), "_ingested_at": F.lit(ingested_at).cast("timestamp_ntz"), "_run_id": F.lit(run_id),
        "_processing_year": F.lit(year).cast("int"), "_processing_month": F.lit(month).cast("int"),
    })


def json_array(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Pages that are JSON arrays of records."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def json_pages(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Pages that are an array of records or an object with the array in ``data``; anything else fails the task that reads it."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_source_file"))
    listed = F.from_json("value", T.ArrayType(schema))
    wrapped = F.from_json("value", T.StructType([T.StructField("data", T.ArrayType(schema))]))["data"]
    start = F.substring(F.ltrim("value"), 1, 1)
    bad = F.raise_error(F.concat(F.lit("neither a list nor an object with data: "), F.col("_source_file"))).cast(T.ArrayType(schema))
    checked = F.when(start == "[", listed).when((start == "{") & F.get_json_object("value", "$.data").isNotNull(), wrapped).otherwise(bad)
    return text.select(F.explode(checked).alias("r"), "_source_file").select("r.*", "_source_file")


def weather(spark: SparkSession, path: str | Sequence[str], timezone: str = "America/New_York") -> DataFrame:
    """Hourly rows from payloads of parallel arrays; unequal arrays or another time zone fail the task that reads them."""
    raw = spark.read.schema(PAYLOAD).option("multiLine", "true").json(path)
    sizes = [F.coalesce(F.size(f"hourly.{k}"), F.lit(-1)) for k in HOURLY_KEYS]
    bad = S.any_of([n != sizes[0] for n in sizes[1:]]) | (sizes[0] <= 0) | (F.coalesce("timezone", F.lit("")) != timezone)
    zipped = F.arrays_zip(*[F.col(f"hourly.{k}").alias(k) for k in HOURLY_KEYS])
    rows = F.when(~bad, zipped).otherwise(F.raise_error(F.lit("a weather payload has unequal arrays or another time zone")).cast(T.ArrayType(T.StructType([T.StructField(k, TEXT if k == "time" else DOUBLE) for k in HOURLY_KEYS]))))
    out = raw.select("timezone", F.inline(rows))
    return out.withColumns({"time": S.moment("time"), "weather_code": F.col("weather_code").cast("int")})


def zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    """The zone table; the text N/A is a label, only an empty field is null."""
    return spark.read.schema(ZONE_LOOKUP).option("header", "true").option("nullValue", "").csv(path)


def polygons(rows: DataFrame) -> DataFrame:
    """Zone polygons from vertex rows (zone_id, ring, seq, x, y) as arrays of rings; ids must be unique by grouping."""
    rings = rows.groupBy("zone_id", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    shaped = rings.select("zone_id", F.struct(F.transform("v", lambda p: p["x"].cast("double")).alias("xs"), F.transform("v", lambda p: p["y"].cast("double")).alias("ys")).alias("r"))
    return shaped.groupBy("zone_id").agg(F.collect_list("r").alias("rings"))


def parsed_complaints(raw: DataFrame) -> DataFrame:
    """Complaints with parsed times and coordinates beside the raw texts, and standard labels."""
    return raw.select(
        "unique_key", S.moment("created_date").alias("created_at"), S.moment("closed_date").alias("closed_at"), S.canonical("complaint_type", COMPLAINT_TYPES).alias("complaint_type"), F.upper(S.clean("agency")).alias("agency"), S.canonical("borough", BOROUGHS).alias("borough"),
        S.number("latitude").alias("latitude"), S.number("longitude").alias("longitude"), F.col("latitude").alias("latitude_text"), F.col("longitude").alias("longitude_text"),
        *[S.clean(c).alias(c) for c in ("incident_address", "status", "resolution_description")],
    )


def same_schema(parts: Iterable[DataFrame]) -> bool:
    parts = list(parts)
    return all([(f.name, f.dataType) for f in p.schema] == [(f.name, f.dataType) for f in parts[0].schema] for p in parts)


def file_counts(df: DataFrame) -> DataFrame:
    """Rows of each file that a scan reads; no data columns are read."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("row_count"))


def checked_polygons(shapes: DataFrame, expected: int | None = None, special: Sequence[int] = (264, 265)) -> DataFrame:
    """Polygons as ``polygons`` gives them; raises on null, special or double ids, another number of zones, rings of under three vertices, and on rings or zones that ``geo.zone_faults`` finds fault with."""
    broken = F.exists("rings", lambda r: (F.size(r["xs"]) < 3) | (F.size(r["xs"]) != F.size(r["ys"])) | F.exists(F.concat(r["xs"], r["ys"]), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    row = shapes.agg(F.count(F.lit(1)), F.count_distinct("zone_id"), F.count_if(S.truth(broken) | F.col("zone_id").isNull() | F.col("zone_id").isin(*special) | (F.size("rings") < 1))).first()
    if row[0] != row[1] or row[2] or (expected is not None and row[0] != expected):
        raise ValueError(f"{row[0]} polygons of {row[1]} zones, {row[2]} of them invalid")
    found = geo.zone_faults(shapes).orderBy("zone", "fault", "other", "x", "y").limit(20).collect()
    if found:
        raise ValueError("invalid polygons: " + "; ".join(f"zone {r['zone']} {r['fault']}{'' if r['other'] is None else f' {r["other"]}'} at {r['x']} {r['y']}" for r in found))
    return shapes


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric column and its bounds, read in parts."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()
