"""Hourly counts by zone from a stream of events, upserted batch by batch like a batch load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import Store, replace_partitions, upserted


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly(events: DataFrame, moment: str, zone: Column, lateness: str = "1 hour") -> DataFrame:
    """Counts and amounts by hour and zone; later events than the lateness are left out."""
    at = F.col(moment).cast("timestamp")
    rows = events.select(at.alias("at"), zone.alias("zone_id"), F.col("event_type"), F.col("value"))
    kind = lambda k: F.count_if(F.col("event_type") == k)
    cells = rows.withWatermark("at", lateness).groupBy(F.window("at", "1 hour").alias("w"), "zone_id")
    out = cells.agg(kind("purchase").alias("trips"), kind("error").alias("complaints"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)"))).alias("revenue"))
    return out.select(F.to_date("w.start").alias("date"), F.hour("w.start").alias("hour"), "zone_id", "trips", "complaints", "revenue")


def upsert_into(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that upserts cells into the table at ``path``, partitioned by date; a repeated batch changes nothing.

    Only the dates that a batch touches, a few within the lateness, are read and replaced.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark, store = batch.sparkSession, Store(batch.sparkSession)
        stage = f"{path}.stage-{epoch}"
        store.remove(stage)  # of a run that was lost in this batch
        kept = batch.persist()
        try:
            dates = [r["date"] for r in kept.select("date").distinct().collect()]
            if not dates:
                return
            current = spark.createDataFrame([], batch.schema)
            if store.exists(path):
                current = spark.read.schema(batch.schema).parquet(path).where(F.col("date").isin(dates))
            upserted(current, kept, ["date", "hour", "zone_id"]).write.parquet(stage)
            replace_partitions(spark.read.schema(batch.schema).parquet(stage), path, ["date"])
        finally:
            kept.unpersist()
            store.remove(stage)

    return write


def start(cells: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return cells.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert_into(path)).start()
