"""Quality rules.

Word unigrams and bigrams are hashed into a fixed number of bins. Two multinomials are counted over them: the trusted
target (all documents labelled good) and the raw corpus (all documents, all words). A bin's weight is log(p_target / p_raw) with ``SMOOTHING`` added to the target's count and to
the count expected from the raw corpus, so bins with little evidence weigh little, whether a document is among the trusted
ones or not. A document's score is the mean weight of its n-grams, and it is kept when
the score reaches a fixed threshold and no base rule fails. Everything is built-in functions: one pass counts the bins
(summed before the shuffle, so at most one row per bin and task moves), a second one scores row by row without a shuffle.
The weights reach the tasks as a literal array of ``BINS`` whole numbers, whatever the corpus: log ratios in units of
1 / ``UNITS``, so a document's sum is exact in any order.

Defined results: a null or blank text has no words, fails the base rules and scores 0; repeated rows and null ids are
rows like any other; an empty table gives no rows; without trusted rows all scores are 0; input columns that clash with
output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_RE, sql_crc, table, word_array

BINS = 1 << 16
SMOOTHING = 20.0
UNITS = 10_000
THRESHOLD = -0.12
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where lambdas inside refer to it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in a 5-word window that the text has at least twice."""

    def count(hashes: Column) -> Column:
        def covered(found: Column) -> Column:
            reach = F.transform(found, lambda p, i: F.when(i == F.size(found) - 1, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get(found, i + 1) - p)))
            return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

        def several(order: Column) -> Column:
            same = lambda i, e: F.coalesce(F.get(order, i)["h"] == e["h"], F.lit(False))
            kept = F.filter(order, lambda e, i: same(i - 1, e) | same(i + 1, e))
            return let(F.array_sort(F.transform(kept, lambda e: e["i"])), covered)

        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ranked, several))

    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) > WINDOW, let(windows, count)).otherwise(0).cast("long")


def gram_bins(words: Column, bins: int = BINS) -> Column:
    """The bins of a text's unigrams, then of its bigrams."""
    of = lambda gram: F.pmod(F.crc32(gram), F.lit(bins)).cast("int")
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: of(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(words, lambda w: of(w)), pairs)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_t")).distinct()


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS) -> DataFrame:
    """One row: the array of log(p_target / p_raw) by bin, in units of 1 / UNITS."""
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_text"))
    # one plan at every size: texts move once, unsorted; rows without an id don't move
    known = rows.where("_i is not null").join(trusted_ids(labels, id_col).hint("shuffle_hash"), F.col("_i") == F.col("_t"), "left")
    grams = known.unionByName(rows.where("_i is null"), allowMissingColumns=True).select("_t", word_array("_text").alias("_words"))
    grams = grams.select(F.col("_t").isNotNull().cast("long").alias("_good"), F.explode(gram_bins(F.col("_words"), bins)).alias("_bin"))
    counts = grams.groupBy("_bin").agg(F.count(F.lit(1)).alias("_raw"), F.sum("_good").alias("_target"))
    every = docs.sparkSession.range(bins).select(F.col("id").cast("int").alias("_bin")).join(counts, "_bin", "left").na.fill(0, ["_raw", "_target"])
    row = every.agg(F.array_sort(F.collect_list(F.struct("_bin", "_target", "_raw"))).alias("c"), F.sum("_target").alias("t"), F.sum("_raw").alias("r"))  # BINS entries
    expected = lambda e: e["_raw"] * F.col("t") / F.col("r")
    ratio = F.transform("c", lambda e: F.round(F.log((e["_target"] + SMOOTHING) / (expected(e) + SMOOTHING)) * UNITS).cast("int"))
    return row.select(F.when(F.col("t") > 0, ratio).otherwise(F.transform("c", lambda e: F.lit(0))).alias("w"))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bins: int = BINS) -> DataFrame:
    """``docs`` with n_words, the four base counts, base_failed, score and kept."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    weight = F.split(F.lit(",".join(map(str, weights(docs, labels, id_col, text_col, bins).first()["w"]))), ",").cast("array<int>")  # folded into a constant
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE_CLASS}]"))

    def counted(words: Column) -> Column:
        total = F.aggregate(gram_bins(words, bins), F.lit(0).cast("long"), lambda a, g: a + F.element_at(weight, g + 1))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.when(F.size(words) > 0, total / (2 * F.size(words) - 1) / UNITS).otherwise(0.0).alias("score"),
        )

    def decided(m: Column) -> Column:
        failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in made[:5]], failed.alias("base_failed"), m["score"].alias("score"), (~failed & (m["score"] >= threshold)).alias("kept"))

    # one expression, so a filter on the verdict that moves below computes the words once too
    rows = docs.drop(*made).withColumn("_m", let(let(word_array(text_col), counted), decided))
    return rows.select(*[c for c in docs.columns if c not in made], *[F.col(f"_m.{c}").alias(c) for c in made])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, table(spark, sf_dir, "labels")).drop("text")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD_RE}') AS w FROM documents
), u AS (
  SELECT doc_id, unnest(w) AS x FROM d UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)
), h AS (
  SELECT x, {sql_crc('x')} % {BINS} AS bin FROM (SELECT DISTINCT x FROM u)
), ub AS (
  SELECT doc_id, bin FROM u JOIN h USING (x)
), trusted AS (
  SELECT DISTINCT doc_id AS good FROM labels WHERE quality = 1 AND doc_id IS NOT NULL
), c AS (
  SELECT bin, count(*) AS r, count(good) AS g FROM ub LEFT JOIN trusted ON doc_id = good GROUP BY bin
), v AS (
  SELECT bin, CASE WHEN sum(g) OVER () > 0 THEN CAST(round(ln((CAST(g AS DOUBLE) + {SMOOTHING}::DOUBLE) / (CAST(r * sum(g) OVER () AS DOUBLE) / CAST(sum(r) OVER () AS DOUBLE) + {SMOOTHING}::DOUBLE)) * {UNITS}) AS BIGINT) ELSE 0 END AS weight FROM c
), s AS (
  SELECT doc_id, CAST(sum(weight) AS BIGINT) AS total FROM ub JOIN v USING (bin) GROUP BY doc_id
), p AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {WINDOW - 1}], ' ')) > 1 AS again FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d)
), q AS (
  SELECT doc_id, count(*) AS repeated FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM p WHERE again) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{SPACE_CLASS}]')) AS l, coalesce(repeated, 0) AS n_repeat_words, total FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN q ON d.doc_id = q.doc_id
), f AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed, CASE WHEN n_words > 0 THEN CAST(total AS DOUBLE) / CAST(2 * n_words - 1 AS DOUBLE) / CAST({UNITS} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed, score, NOT base_failed AND score >= {THRESHOLD} AS kept FROM f
"""
