"""Global places, order statistics, duplicates of wide rows, sketches and permutations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cityflux.operators import duplicates, forecast, profile, ranks


def test_places_of_a_value_that_most_rows_have(spark):
    r = random.Random(1)
    rows = [(k, None if k % 17 == 0 else 5.0 if k % 3 else r.random() * 9) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(7)
    got = ranks.ranked(df, [F.col("v").asc_nulls_first(), "id"]).orderBy("rank").collect()
    assert [x["rank"] for x in got] == list(range(1, 3001))
    assert [x["id"] for x in got] == [k for k, _ in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0]))]
    alike = ranks.ranked(df.withColumn("one", F.lit(1)), ["one"])
    assert sorted(x["rank"] for x in alike.select("rank").collect()) == list(range(1, 3001))
    assert alike.groupBy(F.spark_partition_id()).count().count() > 1  # one value, several tasks
    assert ranks.ranked(df.limit(0), ["id"]).collect() == []


def test_order_statistics_against_numpy(spark):
    r = random.Random(3)
    rows = [(r.choice([None, float(r.randrange(20)), r.random() * 1e6]), r.randrange(5), None) for _ in range(4001)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(6)
    at = (0.0, 0.013, 0.5, 0.77, 1.0)
    got = {(c, q): v for c, q, v in ranks.order_statistics(df, ["a", "b", "c"], at)}
    for k, c in enumerate("ab"):
        want = np.quantile([x[k] for x in rows if x[k] is not None], at)
        assert [got[c, q] for q in at] == pytest.approx(list(want), rel=1e-12)
    assert {got["c", q] for q in at} == {None}
    assert ranks.order_statistics(df.limit(0), ["a"], (0.5,)) == [("a", 0.5, None)]
    odd = spark.createDataFrame([(math.nan,), (1.0,), (-0.0,), (0.0,)], "a double")
    assert [v for _, _, v in ranks.order_statistics(odd, ["a"], (0.0, 2 / 3))] == [0.0, 1.0]
    assert math.isnan(ranks.order_statistics(odd, ["a"], (1.0,))[0][2])
    same = profile.exact_quantiles(df, ["a"], at).select("value").exceptAll(df.select(F.explode(F.percentile("a", F.array(*map(F.lit, at)))).alias("value")))
    assert same.count() == 0


def wide(spark, seed=2, n=2500):
    r = random.Random(seed)
    rows = [(k, r.choice([None, "x", "y"]), r.randrange(10**9) if r.random() < 0.9 else r.randrange(40), "hot" if r.random() < 0.3 else f"t{r.randrange(10**9)}", r.randrange(5)) for k in range(n)]
    rows = [(k, "x", 7, "hot", f) if k % 4 == 0 else (k, a, b, c, f) for k, a, b, c, f in rows]
    return spark.createDataFrame(rows, "id int, a string, b long, c string, file int").repartition(9)


@pytest.mark.parametrize("most", [duplicates.MOST_HASHES, 0])
def test_numbers_as_a_window_gives_them(spark, monkeypatch, most):
    monkeypatch.setattr(duplicates, "MOST_HASHES", most)
    df, keys = wide(spark), ["a", "b", "c"]
    want = df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy("file", "id")))
    got = duplicates.numbered(df, keys, ["file", "id"])
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0
    assert got.count() == df.count()
    assert got.where("occurrence > 1").count() > 500
    found = duplicates.duplicate_keys(df, keys, "file")
    plain = profile.duplicate_keys(df, keys, "file")
    assert found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0
    assert plain.count() > 0


def test_rows_that_are_no_candidates_stay_where_they_are(spark, tmp_path):
    wide(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    candidates, single = duplicates.split(df, ["a", "b", "c"])
    assert single.count() + candidates.count() == df.count()
    assert candidates.groupBy("a", "b", "c").count().where("count < 2").count() == 0
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert "Exchange rangepartitioning" not in plan


def test_without_duplicates_nothing_is_a_candidate(spark):
    df = spark.range(100).withColumn("a", F.lit(None).cast("string"))
    candidates, single = duplicates.split(df, ["id", "a"])
    assert (candidates.count(), single.count()) == (0, 100)
    assert duplicates.numbered(df, ["id", "a"], ["id"]).where("occurrence = 1").count() == 100
    assert duplicates.numbered(df.limit(0), ["id"], ["id"]).count() == 0


def test_the_filter_forgets_no_hash(spark):
    hashes = spark.range(20000).select(F.xxhash64("id").alias("h"))
    test = duplicates.bloom(hashes, 20000)
    assert hashes.where(test(F.col("h"))).count() == 20000
    others = spark.range(50000, 100000).select(F.xxhash64("id").alias("h"))
    assert others.where(test(F.col("h"))).count() < 2500


def test_sketches_merge_over_months(spark):
    df = spark.range(60000).select((F.col("id") % 12).alias("month"), (F.col("id") % 25000).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("b"), F.lit(None).cast("string").alias("c"))
    kept = profile.sketches(df, ["a", "b", "c"], "month")
    assert kept.count() == 36
    got = {r["column_name"]: (r["row_count"], r["missing"], r["n_estimated"]) for r in profile.estimated(kept).collect()}
    assert got["b"] == (60000, 12000, 7)
    assert got["c"] == (60000, 60000, 0)
    assert got["a"][2] == pytest.approx(25000, rel=profile.SKETCH_ERROR)
    half = {r["column_name"]: r["n_estimated"] for r in profile.estimated(kept.where("month < 6")).collect()}
    assert half["a"] == pytest.approx(df.where("month < 6").select("a").distinct().count(), rel=profile.SKETCH_ERROR)
    exact = {r["column_name"]: r["n_distinct"] for r in profile.distinct_values(df, ["a", "b", "c"]).collect()}
    assert exact == {"a": 25000, "b": 7, "c": 0}
    assert "Expand" not in profile.ranges(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()


def test_permutations_use_each_value_once(spark):
    df = spark.range(3000).withColumns({"a": F.col("id") * 2, "b": F.col("id") * 3}).repartition(7)
    out = forecast.permuted(df, ["a", "b"], 5, ["id"]).collect()
    assert sorted(r["id"] for r in out) == list(range(3000))
    assert sorted(r["a"] for r in out) == [2 * k for k in range(3000)]
    assert all(r["b"] * 2 == r["a"] * 3 for r in out)
    moved = [abs(r["a"] / 2 - r["id"]) for r in out]
    assert sum(m == 0 for m in moved) < 10
    assert sum(moved) / 3000 == pytest.approx(1000, rel=0.1)  # two places of one another are a third of the range apart
    again = forecast.permuted(df.repartition(3), ["a", "b"], 5, ["id"]).collect()
    assert {r["id"]: r["a"] for r in again} == {r["id"]: r["a"] for r in out}
    same = spark.createDataFrame([(1, "x")] * 50 + [(2, None)] * 50, "a int, b string")
    assert forecast.permuted(same, ["a"], 1).groupBy("a").count().collect() in ([(1, 50), (2, 50)], [(2, 50), (1, 50)])


def test_group_means(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, "b", 7.0)], "k int, c string, trips double")
    model = forecast.GroupMeans(df, ["k"], "trips")
    assert sorted((r["k"], r["prediction"]) for r in model.transform(df).collect()) == [(1, 3.0), (1, 3.0), (2, 7.0)]
    assert model.transform(df.withColumn("k", F.lit(9))).where("prediction is null").count() == 3
