"""Reconciliation, dashboard parity, data-quality and run-health views, duplicate and log checks.

Audit tables have the columns of the ``*_of`` functions below; those make them from the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import analytics as A


def status(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


# Reconciliation


def source_reconciliation(summary: DataFrame) -> DataFrame:
    """Raw = valid + rejected by source; ``summary`` has source_name and record counts."""
    variance = F.col("input_records") - F.col("valid_records") - F.col("rejected_records")
    return summary.select("source_name", F.col("input_records").alias("raw_records"), "valid_records", "rejected_records", variance.alias("reconciliation_variance"), status(variance == 0).alias("reconciliation_status"))


def overall_reconciliation(summary: DataFrame) -> DataFrame:
    sums = summary.agg(*[F.sum(f"{c}_records").alias(f"total_{c}_records") for c in ("input", "valid", "rejected")])
    variance = F.col("total_input_records") - F.col("total_valid_records") - F.col("total_rejected_records")
    return sums.select("*", variance.alias("reconciliation_variance"), status(variance == 0).alias("reconciliation_status"))


def grain(fact: DataFrame, zones: int, hours: int) -> DataFrame:
    return fact.agg(F.count(F.lit(1)).alias("actual_rows")).select("actual_rows", F.lit(zones * hours).cast("long").alias("expected_rows"), (F.col("actual_rows") - zones * hours).alias("variance"), status(F.col("actual_rows") == zones * hours).alias("reconciliation_status"))


def represented(fact: DataFrame, facts: DataFrame, measure: str, excluded: Column) -> DataFrame:
    """Source rows less the excluded ones against the cube's sum of a measure."""
    source = facts.agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(S.truth(excluded)).alias("excluded_rows"))
    both = source.crossJoin(fact.agg(F.sum(measure).cast("long").alias("represented")))  # one row each
    expected = F.col("source_rows") - F.col("excluded_rows")
    return both.select("source_rows", "excluded_rows", expected.alias("expected"), "represented", (F.col("represented") - expected).alias("variance"), status(F.col("represented") == expected).alias("reconciliation_status"))


# Dashboard parity


def totals(s: A.Star) -> DataFrame:
    """Total trips, revenue and complaints as rows."""
    row = s.fact.agg(F.sum("trips").cast("double").alias("Total Taxi Trips"), F.sum("revenue").cast("double").alias("Total Revenue"), F.sum("complaints").cast("double").alias("Total Complaints"))
    return row.unpivot([], row.columns, "metric", "result")


def monthly_control(s: A.Star) -> DataFrame:
    """Monthly sums against the year's sum."""
    months = s.fact.groupBy(F.month("date").alias("m")).agg(F.sum("trips").alias("t"))
    both = months.agg(F.sum("t").cast("long").alias("monthly_sum")).crossJoin(s.fact.agg(F.sum("trips").cast("long").alias("full_sum")))  # one row each
    return both.select("*", (F.col("monthly_sum") - F.col("full_sum")).alias("variance"), status(F.col("monthly_sum") == F.col("full_sum")).alias("status"))


# Views


def quality_summary(summary: DataFrame) -> DataFrame:
    pct = lambda c: A.r6(100.0 * S.ratio(F.col(c), F.col("input_records")))
    return summary.select(
        "source_name", "input_records", "valid_records", "rejected_records", "quarantine_event_rows", (F.col("input_records") - F.col("valid_records") - F.col("rejected_records")).alias("reconciliation_variance"),
        pct("valid_records").alias("valid_percentage"), pct("rejected_records").alias("rejected_percentage"), F.greatest(F.col("quarantine_event_rows") - F.col("rejected_records"), F.lit(0)).alias("multi_rule_event_excess"),
    )


def issue_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("source", "reason_code", "rule_id", "severity").agg(F.count(F.lit(1)).alias("issue_count"))


def run_health(log: DataFrame, keys: list[str], started: str = "start_time", ended: str = "end_time") -> DataFrame:
    """The latest run of each key and when one last succeeded; ties go by run id."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(started), F.desc("run_id"))
    ranked = log.withColumns({"_n": F.row_number().over(latest), "last_successful_run": F.max(F.when(F.col("status") == "SUCCESS", F.col(ended))).over(Window.partitionBy(*keys))})
    return ranked.where("_n = 1").drop("_n").withColumnRenamed("status", "latest_status")


def marked_tests(log: DataFrame, start: str, end: str) -> DataFrame:
    """``log`` with is_test_run: test names, test sources, or months outside the period."""
    return log.withColumn("is_test_run", S.any_of([S.contains_folded("pipeline_name", "test"), F.lower("source").startswith("test/"), F.col("processing_month") < F.lit(start).cast("date"), F.col("processing_month") >= F.lit(end).cast("date")]))


def reconciliation_health(results: DataFrame) -> DataFrame:
    ok = F.col("status") == "PASS"
    return results.groupBy("metric_name").agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if(ok).alias("passed_checks"), F.count_if(~ok).alias("failed_checks"), A.r6(F.max(F.abs(F.coalesce("variance_value", F.lit(0.0))))).alias("max_absolute_variance"),
        F.when(F.count_if(~ok) == 0, "PASS").otherwise("ATTENTION").alias("reconciliation_status"),
    )


def prediction_analysis(predictions: DataFrame, zones: DataFrame) -> DataFrame:
    return predictions.join(zones, "zone_id").select(
        "date", "hour", S.hour_label("hour").alias("hour_label"), S.daypart("hour").alias("daypart"), "zone_id", "zone_name", "borough", "model_name", "actual", "predicted", F.col("error").alias("signed_error"),
        F.abs("error").alias("absolute_error"), A.r6(S.percent_error(F.col("error"), F.col("actual"))).alias("percentage_error"),
    )


def dropoff_daily(trips: DataFrame, moment: str, zone: str, start: str, end: str, high: int) -> DataFrame:
    """Trips by drop-off day and zone; ids out of range are zone 0, days by the drop-off's date."""
    inside = trips.where(~S.outside(moment, start, end))
    return inside.groupBy(F.to_date(moment).alias("date"), S.zone_or_unknown(zone, 1, high).alias("zone_id")).agg(F.count(F.lit(1)).alias("dropoff_trips"))


def double_keys(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Per table: rows, keys, and groups of several rows."""
    out = None
    for name, (df, keys) in tables.items():
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        row = groups.agg(F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("double_groups"))
        out = row if out is None else out.unionAll(row)
    return out


def incremental_summary(registry: DataFrame) -> DataFrame:
    return registry.groupBy("status").agg(F.count(F.lit(1)).alias("file_count"), F.sum("rows_read").alias("total_rows_read"), F.sum("rows_rejected").alias("total_rows_rejected"))


def log_violations(log: DataFrame) -> DataFrame:
    """Successful runs whose counts don't reconcile, ended runs without an end, runs still open."""
    numbers = ["rows_processed", "rows_valid", "rows_rejected", "quarantine_rows"]
    broken = S.any_of([*[F.col(c).isNull() for c in numbers], F.col("rows_processed") != F.col("rows_valid") + F.col("rows_rejected"), F.col("quarantine_rows") != F.col("rows_rejected")])
    kind = (
        F.when((F.col("status") == "SUCCESS") & broken, "NOT RECONCILED").when(F.col("status").isin("SUCCESS", "FAILED") & F.col("end_time").isNull(), "WITHOUT END").when(F.col("status") == "STARTED", "STILL OPEN")
    )
    return log.withColumn("violation", kind).where("violation is not null").groupBy("pipeline_name", "violation").agg(F.count(F.lit(1)).alias("runs"))
