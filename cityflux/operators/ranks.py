"""Places in a global order without a single task: range partitions, their sizes, prefix sums.

A table is sorted by range over the tasks and written to the shared folder once, so that all that follows sees the same
partitions. What reaches the driver is one number per partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pinned

#: ``monotonically_increasing_id`` has the partition above this bit and the place in it below.
BIT = 33


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 1) in the order; equal rows get places of their own, and even a value of all rows is spread over the tasks."""
    by = [*order, F.col("_u")]
    rows = df.withColumn("_u", F.monotonically_increasing_id()).repartitionByRange(_parts(df), *by).sortWithinPartitions(*by)
    rows = pinned(rows.drop("_u").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", BIT)
    before, offsets = 0, []
    for p, n in sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect()):  # a row per partition
        offsets.append((p, before))
        before += n
    known = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _before long"))  # a row per partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << BIT) - 1)) + 1
    return rows.withColumn("_part", part).join(known, "_part").withColumn(name, place).drop("_part", "_at", "_before")


def order_statistics(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> list[tuple[str, float, float | None]]:
    """(column, quantile, value) with interpolation, exact; NaN is the largest number and nulls don't count.

    Values are counted first, so a value of many rows is one row of what is sorted. Prefix sums of the partitions' counts tell
    which partition holds a rank, and only those partitions are read for it.
    """
    each = [df.select(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")).where("v is not null") for k, c in enumerate(columns)]
    counts = reduce(DataFrame.unionAll, each).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = pinned(counts.repartitionByRange(_parts(df), "k", "v").sortWithinPartitions("k", "v").withColumn("part", F.spark_partition_id()))
    held: dict[int, list[tuple[int, int]]] = {}
    for k, part, n in rows.groupBy("k", "part").agg(F.sum("n")).orderBy("k", "part").collect():  # a row per partition and column at most
        held.setdefault(k, []).append((part, n))
    wanted: dict[tuple[int, int], tuple[int, int]] = {}
    for k, parts in held.items():
        total = sum(n for _, n in parts)
        for rank in {f(p * (total - 1)) for p in at for f in (math.floor, math.ceil)}:
            before = 0
            for part, n in parts:
                if before <= rank < before + n:
                    wanted[k, rank] = part, rank - before
                before += n
    if not wanted:
        return [(c, float(p), None) for c in columns for p in at]
    ask = F.broadcast(df.sparkSession.createDataFrame([(k, part, inside, rank) for (k, rank), (part, inside) in wanted.items()], "k int, part int, inside long, rank long"))  # two rows per quantile
    # the rows of one partition up to an asked rank, summed: a partition's own work
    near = rows.join(ask.select("k", "part").distinct(), ["k", "part"], "left_semi")
    from pyspark.sql import Window

    running = near.withColumn("upto", F.sum("n").over(Window.partitionBy("k", "part").orderBy("v")))
    hit = running.join(ask, ["k", "part"]).where((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
    value = {(r["k"], r["rank"]): r["v"] for r in hit.select("k", "rank", "v").collect()}  # two rows per quantile
    out = []
    for k, c in enumerate(columns):
        total = sum(n for _, n in held.get(k, []))
        for p in at:
            if not total:
                out.append((c, float(p), None))
                continue
            place = p * (total - 1)
            low, high = math.floor(place), math.ceil(place)
            a, b = value[k, low], value[k, high]
            out.append((c, float(p), a if a == b or low == high else (high - place) * a + (place - low) * b))
    return out
