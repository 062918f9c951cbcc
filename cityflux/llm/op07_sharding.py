"""Sharding by size.

Documents are laid out by id; a document's place is the sum of the sizes before it, and the shard is the equal share of
all bytes in which that place falls. So shards are contiguous and their sizes differ by less than one document. The sums
come from per-partition totals: range partitions of narrow rows are pinned, their totals are summed in order, and a
running sum inside each partition adds the rest. Only one row per partition meets in a window of its own.

Defined results: a null text has no bytes and size 1; a null id sorts first; repeated rows are separate rows (those alike
in id, size and checksum are interchangeable, and a random last key spreads them over partitions); an empty table gives
no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pinned, sql_crc, table

N_SHARDS = 8
ROWS_PER_PARTITION = 1_000_000


def shard(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, size, text_crc32, shard and slot (its place in the shard)."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, docs.count() // ROWS_PER_PARTITION + 1)
    order = [F.col(id_col).asc_nulls_first(), "text_crc32", "size", "_any"]
    rows = pinned(rows.withColumn("_any", F.rand(7)).repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    totals = rows.groupBy("_p").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_p", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_byte0"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_row0"), F.sum("_bytes").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"_byte": F.sum("size").over(inside) - F.col("size"), "_row": F.row_number().over(inside) - 1}).join(starts, "_p")
    placed = placed.select(id_col, "size", "text_crc32", F.floor((F.col("_byte0") + F.col("_byte")) * F.lit(n_shards) / F.col("_all")).cast("int").alias("shard"), (F.col("_row0") + F.col("_row")).alias("_row"))
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = f"""
WITH b AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), c AS (
  SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size, {sql_crc('text')} AS crc FROM b
), p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) AS n FROM c
), s AS (
  SELECT *, CAST(floor(CAST(before * {N_SHARDS} AS DOUBLE) / CAST(total AS DOUBLE)) AS INTEGER) AS shard FROM p
)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
