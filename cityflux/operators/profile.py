"""Profiles in one pass each: nulls, ranges, quantiles, frequent values, duplicates, schema drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .ranks import order_statistics

QUANTILES = (0.0, 0.01, 0.5, 0.95, 0.99, 0.999, 1.0)


def _long(row: DataFrame, names: Sequence[str], per: Sequence[str]) -> DataFrame:
    """A row with columns ``name__stat`` as one row per name."""
    structs = [F.struct(F.lit(n).alias("column_name"), *[F.col(f"{n}__{p}").alias(p) for p in per]) for n in names]
    return row.select(F.inline(F.array(*structs)))


def nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, nulls and blanks, percentage."""
    columns = list(columns or df.columns)
    row = df.agg(*[x for c in columns for x in (F.count(F.lit(1)).alias(f"{c}__row_count"), F.count_if(S.blank(c)).alias(f"{c}__missing"))])
    return _long(row, columns, ("row_count", "missing")).withColumn("missing_pct", F.round(100.0 * S.ratio(F.col("missing"), F.col("row_count")), 6))


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: smallest, largest, distinct values. Each column is counted on its own, so no row is copied for each column."""
    row = df.agg(*[x for c in columns for x in (F.min(c).cast("double").alias(f"{c}__low"), F.max(c).cast("double").alias(f"{c}__high"))])
    return _long(row, columns, ("low", "high")).join(distinct_values(df, columns), "column_name")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: exact number of distinct values. A scan for each column, which reads nothing else."""
    each = [df.select(F.col(c)).where(F.col(c).isNotNull()).distinct().agg(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_distinct")) for c in columns]
    return reduce(DataFrame.unionByName, each)


#: Log2 of a sketch's size, and the relative error that all but a few of a thousand estimates keep (4 / sqrt(2 ** SKETCH)).
SKETCH, SKETCH_ERROR = 14, 4 / 2**7


def sketches(df: DataFrame, columns: Sequence[str], period: str) -> DataFrame:
    """period, column_name, row_count, missing and a sketch of the distinct values: one pass for all columns, rows of fixed size.

    Kept as a table (``sinks.replace_partitions`` by period), it answers for any periods together without their rows.
    """
    per = [x for c in columns for x in (F.count(F.lit(1)).alias(f"{c}__row_count"), F.count_if(F.col(c).isNull()).alias(f"{c}__missing"), F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH)).alias(f"{c}__sketch"))]
    wide = df.groupBy(period).agg(*per)
    structs = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{p}").alias(p) for p in ("row_count", "missing", "sketch")]) for c in columns]
    return wide.select(period, F.inline(F.array(*structs)))


def estimated(sketch_rows: DataFrame) -> DataFrame:
    """Per column over all given periods: rows, nulls, estimated distinct values."""
    return sketch_rows.groupBy("column_name").agg(F.sum("row_count").alias("row_count"), F.sum("missing").alias("missing"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_estimated"))


def battery(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """Per test: rows for which it is true."""
    return df.agg(*[F.count_if(S.truth(p)).alias(n) for n, p in tests.items()]).unpivot([], list(tests), "test_name", "row_count")


def exact_quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float] = QUANTILES) -> DataFrame:
    """Interpolated, by global ranks: memory and what a task reads don't grow with a column's distinct values."""
    return df.sparkSession.createDataFrame(order_statistics(df, columns, at), "column_name string, quantile double, value double")


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float] = QUANTILES, accuracy: int = 10000) -> DataFrame:
    """Approximate ones in bounded memory."""
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), list(at), accuracy).alias(c) for c in columns])
    return _spread(row, columns, at)


def _spread(row: DataFrame, columns: Sequence[str], at: Sequence[float]) -> DataFrame:
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(float(p)).alias("quantile"), F.get(F.col(c), i).alias("value")) for c in columns for i, p in enumerate(at)])))


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.desc("row_count"), F.col("value").asc_nulls_first()).limit(n)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, rows beyond the first of their key."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(F.struct(*keys)).alias("n_distinct")).withColumn("beyond_first", F.col("row_count") - F.col("n_distinct"))


def gaps(df: DataFrame, moment: str, hours: int = 1) -> DataFrame:
    """One row: how many neighbouring timestamps aren't ``hours`` apart. A day's hours are compared in their partition, and days by their ends."""
    day = df.select(F.col(moment).alias("t"), F.to_date(moment).alias("d")).distinct().groupBy("d").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    inner = F.size(F.filter(F.zip_with(F.slice("ts", F.lit(1), F.size("ts") - 1), F.slice("ts", F.lit(2), F.size("ts") - 1), lambda a, b: F.timestamp_diff("HOUR", a, b)), lambda x: x != hours))
    from pyspark.sql import Window

    ends = day.select(inner.alias("n"), F.element_at("ts", 1).alias("first"), F.lag(F.element_at("ts", -1)).over(Window.orderBy("d")).alias("before"))
    jump = F.when(F.col("before").isNotNull() & (F.timestamp_diff("HOUR", F.col("before"), F.col("first")) != hours), 1).otherwise(0)
    return ends.agg(F.coalesce(F.sum(F.col("n") + jump), F.lit(0)).alias("gaps"))


def schema_drift(schemas: Mapping[str, Mapping[str, str]]) -> list[tuple[str, str, str]]:
    """(part, column, "missing" | "added" | "type a -> b") against the first part, from schemas alone."""
    parts = list(schemas)
    base, out = schemas[parts[0]], []
    for part in parts[1:]:
        own = schemas[part]
        out += [(part, c, "missing") for c in base if c not in own] + [(part, c, "added") for c in own if c not in base]
        out += [(part, c, f"type {base[c]} -> {own[c]}") for c in base if c in own and own[c] != base[c]]
    return out


def json_fields(df: DataFrame, json_column: str, part: str) -> DataFrame:
    """Per part: the top-level fields of its JSON objects, and those added and missing against the first part."""
    keys = df.select(part, F.explode(F.json_object_keys(json_column)).alias("k")).groupBy(part).agg(F.array_sort(F.collect_set("k")).alias("fields"))
    first = keys.agg(F.min_by("fields", part).alias("base"))
    return keys.crossJoin(F.broadcast(first)).select(part, "fields", F.array_except("fields", "base").alias("added"), F.array_except("base", "fields").alias("missing"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], file: str) -> DataFrame:
    """Keys of several rows: how many, and the first file that has one (the keeper). For wide keys see ``duplicates``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.min(file).alias("keeper")).where("occurrences > 1")
