import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cityflux.operators import forecast
from cityflux.sources import landing, readers


def test_files_land_whole_and_once(tmp_path):
    calls = []

    def content():
        calls.append(1)
        return b"abc"

    path = tmp_path / "raw/x.bin"
    assert landing.land(path, content) == landing.land(path, content) == hashlib.sha256(b"abc").hexdigest()
    assert len(calls) == 1
    with pytest.raises(ValueError, match="complete"):
        landing.land(tmp_path / "raw/y.bin", lambda: b"")
    path.write_bytes(b"")
    landing.land(path, content)
    assert [p.name for p in (tmp_path / "raw").iterdir()] == ["x.bin"]


def test_month_of_pages(tmp_path, spark):
    asked = []

    def get(url):
        asked.append(url)
        return json.dumps([{"unique_key": f"{len(asked)}{n}", "created_date": "2025-01-05"} for n in range(2 if len(asked) == 1 else 1)]).encode()

    for _ in range(2):
        files = landing.land_month(tmp_path / "m", "http://x", "created_date", "2025-01-01", "2025-02-01", "unique_key", 2, get)
    assert len(asked) == 2
    out = readers.json_pages(spark, str(tmp_path / "m/page-*.json"), readers.COMPLAINTS)
    assert (len(files), sorted(r["unique_key"] for r in out.collect())) == (2, ["10", "11", "20"])


def test_weather_payloads():
    good = {"timezone": "America/New_York", "hourly": {k: [1, 2] for k in readers.HOURLY_KEYS}}
    ok = lambda p, n=None: landing.weather_complete(json.dumps(p).encode(), n)
    assert ok(good)
    assert ok(good, 2)
    assert not ok(good, 3)
    assert not ok({**good, "timezone": "UTC"})
    assert not ok({**good, "hourly": {**good["hourly"], "rain": [1]}})
    assert not ok({**good, "hourly": {}})
    assert not landing.weather_complete(b"{")


def test_polygon_checks_and_file_counts(spark, tmp_path):
    shape = lambda z, n: [(z, 0, i, float(i + 10 * z), float(i * i)) for i in range(n)]
    make = lambda rows: readers.polygons(spark.createDataFrame(rows, "zone_id int, ring int, seq int, x double, y double"))
    assert readers.checked_polygons(make(shape(1, 3) + shape(2, 4)), 2).count() == 2
    for bad in (make(shape(1, 2)), make(shape(264, 3)), make(shape(1, 3)).unionAll(make(shape(1, 3)))):
        with pytest.raises(ValueError, match="polygons"):
            readers.checked_polygons(bad)
    with pytest.raises(ValueError, match="polygons"):
        readers.checked_polygons(make(shape(1, 3)), 2)
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t"))
    counts = readers.file_counts(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert sum(r["row_count"] for r in counts) == 10


def test_merged_schemas(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t/m=1"))
    spark.range(1).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "t/m=2"))
    assert sorted(readers.parquet(spark, str(tmp_path / "t"), merge=True).columns) == ["id", "m", "x"]
    assert not readers.same_schema([spark.range(1), spark.range(1).withColumn("x", F.lit(1))])


def test_models_are_kept(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = spark.range(200).select((F.col("id") % 24).alias("hour"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), ((F.col("id") % 24) * 2.0).alias("trips"))
    model = forecast.pipeline(forecast.boosted_trees(rounds=3, depth=3), ["hour"], ["kind"]).fit(df)
    assert forecast.impurity_importance(model, ["hour", "kind"])[0][0] == "hour"
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    unseen = df.limit(1).withColumn("kind", F.lit("c"))
    assert again.transform(unseen).first()["prediction"] == model.transform(unseen).first()["prediction"]
