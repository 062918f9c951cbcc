"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents are laid out by that key; a document's place in words is
the sum of the sizes before it. The sums are distributed: keys fall into buckets (the key's leading bits), bucket totals
are summed per source, and a running sum inside each (source, bucket) adds the rest. A source whose target is ``full``
times its size plus a remainder is taken whole ``full`` times and then once more up to exactly its remainder.

A source with a third of all rows is spread over all its buckets; only one row per (source, bucket) and one row per source
meet in a window of their own. Nothing is broadcast by hand and no row reaches the driver.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in order;
a null id is a row like any other; repeated rows are separate rows (rows alike in id and text are interchangeable);
an empty table gives no rows; an input column that clashes with an output column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_RE, table, word_array

WEIGHT_CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Rows that a bucket holds about; the bucket count is a power of two.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1024, 64, 65536


def _key(doc_id: str, text: str) -> Column:
    """By id and text, so that rows with one id, null above all, spread over the buckets too."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From one row per source (``_s`` sortable key, ``_total`` words), each source's target.

    The weights share all words. A source stops at ``max_epochs`` times its size, and what it can't take is shared by
    weight among the rest until none is above: the water level, found in closed form by ordering sources by cap per weight.
    """
    by_name, everywhere = Window.orderBy("_s"), Window.partitionBy()
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.lit(max_epochs).cast("long") * F.col("_total"))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_s")
    # the words taken at a level are the least of these lines over it, so the level that takes all words is the greatest of theirs
    ranked = ranked.withColumns({
        "_capped": F.coalesce(F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_open": F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)),
        "_all": F.sum("_total").over(everywhere),
    })
    level = (F.col("_all") - F.col("_capped")).cast("double") / F.col("_open").cast("double")
    ranked = ranked.withColumn("_level", level).withColumn("_level", F.max("_level").over(everywhere))
    return ranked.select("_s", "_total", F.least(F.col("_w") * F.col("_level"), F.col("_cap").cast("double")).alias("_target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs`` with size, source_size, target, full (whole epochs), part (words of one more) and taken."""
    made = ["size", "source_size", "target", "full", "part", "taken"]
    rows = docs.drop(*made, "_s", "_key", "_b", "_text")
    buckets = 2 ** max(int(math.log2(LEAST_BUCKETS)), min(int(math.log2(MOST_BUCKETS)), math.ceil(math.log2(docs.count() / BUCKET_ROWS + 1))))
    rows = rows.withColumns({
        "size": F.size(word_array(text_col)).cast("long"),
        "_s": F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")),  # sorts nulls last
        "_key": _key(id_col, text_col),
        "_text": F.xxhash64(text_col),  # rows alike in id and size
    })
    rows = rows.withColumn("_b", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("int") * F.lit(buckets) / 65536).cast("int"))
    totals = rows.groupBy("_s", "_b").agg(F.sum("size").alias("_words"))
    targets = source_targets(totals.groupBy("_s").agg(F.sum("_words").alias("_total")), weights, max_epochs)
    earlier = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words").join(targets, "_s")
    within = Window.partitionBy("_s", "_b").orderBy("_key", "size", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_run", F.sum("size").over(within)).join(starts, ["_s", "_b"])
    budget, total = F.floor("_target"), F.col("_total")
    full = F.when(total > 0, F.floor(budget / F.greatest(total, F.lit(1)))).otherwise(0)
    placed = placed.withColumns({"source_size": total, "target": F.col("_target"), "full": full.cast("long")})
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("full") * total - (F.col("_start") + F.col("_run") - F.col("size")))).cast("long"))
    placed = placed.withColumn("taken", F.col("full") * F.col("size") + F.col("part"))
    return placed.select(*[c for c in docs.columns if c not in made], *made)


def first_words(text: Column, n: Column) -> Column:
    """A text's start up to the end of its n-th word, white space kept as it is."""
    pieces = F.split(text, rf"(?<=[{SPACE_CLASS}])(?=[^{SPACE_CLASS}])")
    lead = F.when(text.rlike(rf"^[{SPACE_CLASS}]"), 1).otherwise(0)
    return F.array_join(F.slice(pieces, F.lit(1), (n + lead).cast("int")), "")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: a document's row once per epoch that takes it; the last, partly taken one is cut to its words."""
    plan = mix(docs, id_col, text_col, source_col, **how)
    text, part, size = F.col(text_col), F.col("part"), F.col("size")
    whole = F.when(size > 0, F.array_repeat(text, (F.col("full") + F.when(part == size, 1).otherwise(0)).cast("int"))).otherwise(F.array().cast("array<string>"))
    rest = F.when((part > 0) & (part < size), F.array(first_words(text, part))).otherwise(F.array().cast("array<string>"))
    out = plan.withColumn("_copy", F.explode(F.concat(whole, rest)))
    return out.select(*[F.col("_copy").alias(c) if c == text_col else c for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, text, coalesce('0' || source, '1') AS s, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD_RE}')), 0) AS BIGINT) AS size FROM documents
), t AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS total, CAST((row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS BIGINT) AS w FROM d GROUP BY s
), u AS (
  SELECT *, CAST(3 * total AS BIGINT) AS cap, CAST(sum(total) OVER () AS BIGINT) AS al,
         CAST(coalesce(sum(3 * total) OVER (ORDER BY CAST(3 * total AS DOUBLE) / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
         CAST(sum(w) OVER (ORDER BY CAST(3 * total AS DOUBLE) / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS opened FROM t
), v AS (
  SELECT *, CAST(al - capped AS DOUBLE) / CAST(opened AS DOUBLE) AS lv FROM u
), x AS (
  SELECT s, total, cap, w, max(lv) OVER () AS lv FROM v
), y AS (
  SELECT s, total, least(w * lv, CAST(cap AS DOUBLE)) AS target, CAST(floor(least(w * lv, CAST(cap AS DOUBLE))) AS BIGINT) AS budget FROM x
), z AS (
  SELECT d.doc_id, d.size, y.total, y.target, y.budget,
         CASE WHEN y.total > 0 THEN y.budget // greatest(y.total, 1) ELSE 0 END AS f,
         sum(d.size) OVER (PARTITION BY d.s ORDER BY d.k, d.size, d.text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN y ON d.s = y.s
)
SELECT doc_id, size, total AS source_size, target,
       CAST(f * size + greatest(0, least(size, budget - f * total - before)) AS BIGINT) AS taken FROM z
"""
