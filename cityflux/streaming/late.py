"""Hourly cells from a stream that loses no late row: late ones go to the correction of their month.

Each micro-batch becomes partial cells in a folder of its own epoch, so a batch that is run again replaces what it wrote and
nothing is added twice; the stream itself keeps no state but the highest time that it has seen. A row is late if it comes more
than ``lateness`` behind that time. Late rows are kept as they are, counted by month, and their partial cells are marked.
``settle`` loads the months into the fact: those that have got new partial cells since, late or not, and no others.

Rows without a time have no month: they are kept and counted with the late ones, and no cell counts them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.loading import Loaded, load_months
from ..sources.sinks import Store, failpoint

KEYS = ["date", "hour", "zone_id"]
PARTS = "date date, hour int, zone_id int, late boolean, trips long, complaints long, revenue decimal(28,2), epoch long"


def _marks(spark: SparkSession, root: str) -> dict[int, str]:
    store = Store(spark)
    found = [json.loads(store.text(p)) for p in store.matching(f"{root}/marks/*.json")]
    return {m["epoch"]: m["high"] for m in found if m["high"] is not None}


def routed(root: str, moment: str, zone: Column, lateness: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes a batch's partial cells and its late rows."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark, store = batch.sparkSession, Store(batch.sparkSession)
        before = [high for e, high in _marks(spark, root).items() if e < epoch]  # of this batch's own earlier runs nothing counts
        at = F.col(moment).cast("timestamp_ntz")
        late = at.isNull() | (at < F.lit(max(before)).cast("timestamp_ntz") - F.expr(f"interval {lateness}") if before else F.lit(False))
        kept = batch.withColumns({"_at": at, "_zone": zone.cast("int"), "_late": late}).persist()
        try:
            kind = lambda k: F.count_if(F.col("event_type") == k)
            cells = kept.where("_at is not null").groupBy(F.to_date("_at").alias("date"), F.hour("_at").alias("hour"), F.col("_zone").alias("zone_id"), F.col("_late").alias("late"))
            parts = cells.agg(kind("purchase").alias("trips"), kind("error").alias("complaints"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)"))).alias("revenue"))
            parts.write.mode("overwrite").parquet(f"{root}/parts/epoch={epoch}")
            failpoint("after_parts")
            kept.where("_late").withColumn("month", F.date_format("_at", "yyyy-MM")).drop("_at", "_zone", "_late").write.mode("overwrite").parquet(f"{root}/late/epoch={epoch}")
            failpoint("before_mark")
            high = kept.agg(F.max("_at").cast("string")).first()[0]
            store.create(f"{root}/marks/{epoch:012d}.json", json.dumps({"epoch": epoch, "high": high}))
        finally:
            kept.unpersist()

    return write


def start(events: DataFrame, root: str, checkpoint: str, moment: str, zone: Column, lateness: str = "1 hour") -> StreamingQuery:
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(routed(root, moment, zone, lateness)).start()


def parts(spark: SparkSession, root: str) -> DataFrame:
    """The partial cells of all finished batches; those of a batch that broke off don't count until it has run again."""
    store = Store(spark)
    done = [json.loads(store.text(p))["epoch"] for p in store.matching(f"{root}/marks/*.json")]
    if not done:
        return spark.createDataFrame([], PARTS)
    return spark.read.schema(PARTS).option("basePath", f"{root}/parts").parquet(*[f"{root}/parts/epoch={e}" for e in done])


def cells(spark: SparkSession, root: str) -> DataFrame:
    """Hourly cells with all rows, late ones too."""
    return parts(spark, root).groupBy(*KEYS).agg(F.sum("trips").alias("trips"), F.sum("complaints").alias("complaints"), F.sum("revenue").cast("decimal(28,2)").alias("revenue"))


def late_counts(spark: SparkSession, root: str) -> DataFrame:
    """month (null for rows without a time) and number of late rows."""
    if not Store(spark).matching(f"{root}/late/epoch=*"):
        return spark.createDataFrame([], "month string, late_rows long")
    rows = spark.read.schema("month string").option("recursiveFileLookup", "true").parquet(f"{root}/late")
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("late_rows"))


def settle(spark: SparkSession, root: str, fact: str, ledger: str, run_id: str, at: str) -> dict[str, Loaded]:
    """Loads each month's cells into the fact; a month without new batches since its last load is skipped."""
    month = F.date_format("date", "yyyy-MM")
    touched: dict[str, list[int]] = {}
    for r in parts(spark, root).select(month.alias("m"), "epoch").distinct().collect():  # months x batches
        touched.setdefault(r["m"], []).append(r["epoch"])
    whole = cells(spark, root)
    out = {}
    for m, epochs in sorted(touched.items()):
        sha = hashlib.sha256(",".join(map(str, sorted(epochs))).encode()).hexdigest()
        out[m] = load_months(fact, ledger, "stream", f"month={m}", sha, whole.where(month == m), "date", KEYS, run_id, at, months=[m], replace=True)
    return out
