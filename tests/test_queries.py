from pathlib import Path

import duckdb
import pytest

from cityflux.operators import forecast
from cityflux.plans.registry import ORACLES, QUERIES

from .oracle import TABLES, connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() > 0


def test_variants_agree(spark, sf_dir):
    for a, b in (("q05_month_growth", "q05o_month_growth_daily"), ("q14_spikes", "q14o_spikes_joined"), ("q15_rolling_mean", "q15o_rolling_mean_daily")):
        x, y = QUERIES[a](spark, sf_dir), QUERIES[b](spark, sf_dir)
        assert x.exceptAll(y.select(*x.columns)).count() == 0
        assert x.count() == y.count()


def test_the_forest_has_the_surveys_size(spark, sf_dir, monkeypatch):
    made, forest = [], forecast.random_forest
    monkeypatch.setattr(forecast, "random_forest", lambda **k: made.append(forest(**k)) or made[-1])
    assert QUERIES["m08_forest_metrics"](spark, sf_dir).count() == 2
    assert [(m.getNumTrees(), m.getMaxDepth()) for m in made] == [(50, 18)]


@pytest.fixture(scope="module")
def busy_dir(sf_dir, tmp_path_factory):
    """The tables with 1 to 120 copies of each event, so that hours of zones have trips of every demand level."""
    out = tmp_path_factory.mktemp("busy")
    for t in TABLES:
        if t != "events":
            (out / f"{t}.parquet").symlink_to(Path(sf_dir) / f"{t}.parquet")
    duckdb.sql(f"COPY (SELECT event_id + k * 1000000 AS event_id, ts, user_id, event_type, value, props FROM '{sf_dir}/events.parquet' JOIN range(120) r(k) ON k <= event_id % 120) TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize(("name", "levels"), [("m10_baseline_by_level", 4), ("m10b_baseline_by_demand_level", 6)])
def test_levels_of_busy_hours(spark, busy_dir, name, levels):
    df = QUERIES[name](spark, busy_dir)
    same(df, connect(busy_dir), ORACLES[name])
    assert df.count() == levels
