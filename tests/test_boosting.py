"""Boosting by histograms against a plain numpy version that splits one leaf at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityflux.operators import boosting


def plain(values, y, edges, base, rounds, rate, leaves, least, l2):
    """Predictions after each round: every split is searched over the rows themselves."""
    bins = boosting.binned(values, edges).astype(int)
    p, out = np.full(len(y), base), []
    for _ in range(rounds):
        g = p - y
        held = {0: np.arange(len(y))}

        def search(rows, g=g):
            best = None
            score = lambda r: g[r].sum() ** 2 / (len(r) + l2)  # noqa: B023, E731
            for f in range(bins.shape[1]):
                for upto in np.unique(bins[rows, f])[:-1]:
                    a, b = rows[bins[rows, f] <= upto], rows[bins[rows, f] > upto]
                    if min(len(a), len(b)) >= least:
                        gain = score(a) + score(b) - score(rows)
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = gain, a, b
            return best

        found = {0: search(held[0])}
        while len(held) < leaves and any(found[k] for k in held):
            x = max((k for k in held if found[k]), key=lambda k: found[k][0])
            _, a, b = found[x]
            del held[x]
            for new in (a, b):
                name = len(found)
                held[name], found[name] = new, search(new)
        p = p.copy()
        for rows in held.values():
            p[rows] += -rate * g[rows].sum() / (len(rows) + l2)
        out.append(p)
    return out


def data(n=900, seed=4):
    r = np.random.default_rng(seed)
    x = np.stack((r.normal(size=n), r.integers(0, 12, n), r.random(n) * 100), 1)
    x[r.random(n) < 0.1, 0] = np.nan
    y = np.where(np.isnan(x[:, 0]), 3.0, x[:, 0] * 2) + (x[:, 1] > 6) * 5 + np.sin(x[:, 2] / 9) + r.normal(size=n) / 5
    return x, y


def frame(spark, x, y):
    rows = [(*[None if np.isnan(v) else float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(5)


@pytest.mark.parametrize(("leaves", "least"), [(31, 30), (8, 5), (2, 1)])
def test_boosting_equals_the_plain_version(spark, leaves, least, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    x, y = data()
    df = frame(spark, x, y)
    rounds = 3 if leaves > 2 else 5
    model = boosting.fitted(df, ["a", "b", "c"], "y", rounds=rounds, leaves=leaves, least=least)
    want = plain(x, y, model.edges, model.base, rounds, 0.08, leaves, least, 1.0)
    assert model.predict(x) == pytest.approx(want[-1], abs=1e-6)
    assert all(sum(f < 0 for f in t.feature) <= leaves for t in model.trees)
    assert np.abs(want[-1] - y).mean() < np.abs(model.base - y).mean()
    got = model.transform(df).select(F.abs(F.col("prediction") - F.col("y")).alias("e")).agg(F.avg("e")).first()[0]
    assert got == pytest.approx(np.abs(want[-1] - y).mean(), abs=1e-6)


def test_the_order_of_rows_changes_nothing(spark):
    x, y = data(400)
    one = boosting.fitted(frame(spark, x, y), ["a", "b", "c"], "y", rounds=2, least=10)
    two = boosting.fitted(frame(spark, x[::-1], y[::-1]).repartition(2), ["a", "b", "c"], "y", rounds=2, least=10)
    assert [(t.feature, t.upto, t.value) for t in one.trees] == [(t.feature, t.upto, t.value) for t in two.trees]


def test_odd_tables(spark):
    schema = "a double, y double"
    assert boosting.fitted(spark.createDataFrame([], schema), ["a"], "y", rounds=1).predict(np.zeros((2, 1))).tolist() == [0.0, 0.0]
    flat = spark.createDataFrame([(None, 2.0)] * 70 + [(1.0, None)], schema)
    assert boosting.fitted(flat, ["a"], "y", rounds=2).predict(np.array([[np.nan], [1.0]])).tolist() == pytest.approx([2.0, 2.0])
    with pytest.raises(ValueError, match="revenue"):
        boosting.fitted(flat.withColumn("revenue", F.lit(1.0)), ["revenue"], "y")
