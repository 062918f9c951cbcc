"""Demand forecasting: lag features on a dense grid, time split, models, metrics by slice, permutation importance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .ranks import ranked

LEAKING = {"revenue", "average_fare", "average_trip_distance", "average_distance"}
LAGS = {"trips": (1, 24, 168), "complaints": (1, 24)}


def require_dense(cube: DataFrame, hours: int, zone: str = "zone_id") -> DataFrame:
    """``cube``; raises unless every zone has exactly ``hours`` rows of different hours."""
    bad = cube.groupBy(zone).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date", "hour").alias("d")).where((F.col("n") != hours) | (F.col("d") != hours)).limit(1).count()
    if bad:
        raise ValueError(f"a zone doesn't have {hours} hours")
    return cube


def features(cube: DataFrame, lags: Mapping[str, Sequence[int]] = LAGS, complete: bool = True) -> DataFrame:
    """Calendar, weather and lag features; lags are row offsets, so the grid must be dense. ``complete`` leaves the warm-up out."""
    w = Window.partitionBy("zone_id").orderBy("date", "hour")
    named = {f"{m}_lag_{k}h": F.lag(m, k).over(w) for m, ks in lags.items() for k in ks}
    out = cube.withColumns(named).withColumns({"day_of_week": F.weekday("date"), "month": F.month("date"), "is_weekend": S.weekend("date")})
    return out.dropna(subset=list(named)) if complete else out


def lag_differences(featured: DataFrame, cube: DataFrame, lags: Mapping[str, Sequence[int]] = LAGS) -> DataFrame:
    """Per lag, against the cube's value that many hours before: rows compared, rows where only one side has a value, largest difference."""
    at = F.timestamp_add("HOUR", F.col("hour"), F.col("date").cast("timestamp_ntz"))
    named = {f"{m}_lag_{k}h": (m, k) for m, ks in lags.items() for k in ks}
    hours = sorted({k for _, k in named.values()})
    later = cube.select("zone_id", at.alias("_from"), *lags, F.explode(F.array(*map(F.lit, hours))).alias("_k"))
    # all lags of an hour in one row, so that one join serves them
    expected = later.groupBy("zone_id", F.timestamp_add("HOUR", F.col("_k"), F.col("_from")).alias("_at")).agg(*[F.max(F.when(F.col("_k") == k, F.col(m))).alias(f"_{n}") for n, (m, k) in named.items()])
    joined = featured.withColumn("_at", at).join(expected, ["zone_id", "_at"], "left")
    rows = joined.select(F.inline(F.array(*[F.struct(F.lit(n).alias("lag"), F.col(n).cast("double").alias("a"), F.col(f"_{n}").cast("double").alias("b")) for n in named])))
    a, b = F.col("a"), F.col("b")
    return rows.groupBy("lag").agg(F.count(a - b).alias("compared"), F.count_if(a.isNull() != b.isNull()).alias("unmatched"), F.max(F.abs(a - b)).alias("largest_difference"))


def require_aligned(featured: DataFrame, cube: DataFrame, lags: Mapping[str, Sequence[int]] = LAGS) -> DataFrame:
    """``featured``; raises if a lag isn't the value of its hour."""
    bad = [r["lag"] for r in lag_differences(featured, cube, lags).collect() if r["unmatched"] or r["largest_difference"]]
    if bad:
        raise ValueError(f"lags out of place: {', '.join(sorted(bad))}")
    return featured


def forbid_leaks(names: Sequence[str], leaking: set[str] = LEAKING) -> None:
    bad = sorted(set(names) & leaking)
    if bad:
        raise ValueError(f"features known only after the hour: {', '.join(bad)}")


def time_split(df: DataFrame, cut: str, moment: str = "date") -> tuple[DataFrame, DataFrame]:
    """Rows before ``cut`` and rows from it on."""
    return df.where(F.col(moment) < F.lit(cut).cast("date")), df.where(F.col(moment) >= F.lit(cut).cast("date"))


def metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str | Column] = ()) -> DataFrame:
    """n, means, MAE, RMSE, R2, MAPE over non-zero actuals, sMAPE over non-zero sums, bias; R2 is 0 for constant actuals, undefined ones are null."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = p - a
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("mean_actual"), F.avg(p).alias("mean_predicted"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_sse"), F.var_pop(a).alias("_var"), F.avg(F.when(a > 0, 100.0 * F.abs(e) / a)).alias("mape"), F.avg(F.when(F.abs(a) + F.abs(p) > 0, 200.0 * F.abs(e) / (F.abs(a) + F.abs(p)))).alias("smape"), F.avg(e).alias("bias"),
    )
    sst = F.col("_var") * F.col("n")
    r2 = F.when(F.round(sst, 9) == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("_sse") / F.when(sst == 0, None).otherwise(sst))
    out = sums.withColumn("r2", r2).drop("_sse", "_var")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def encoder(columns: Sequence[str]):
    """Ordinal codes of categories, -1 for unknown ones."""
    from .ordinal import OrdinalEncoder

    return OrdinalEncoder(columns, [f"{c}_code" for c in columns])


def pipeline(model, numeric: Sequence[str], categories: Sequence[str] = ()):
    """Ordinal codes, assembled features, model; refuses leaking features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    forbid_leaks([*numeric, *categories])
    stages = [encoder(categories)] if categories else []
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*numeric, *[f"{c}_code" for c in categories]], outputCol="features"), model])


def random_forest(label: str = "trips", trees: int = 50, depth: int = 18, seed: int = 42):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="0.75", subsamplingRate=0.7, seed=seed)


def boosted_trees(label: str = "trips", rounds: int = 200, depth: int = 5, seed: int = 42):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.08, minInstancesPerNode=30, seed=seed)


def compared(df: DataFrame, actual: str, models: Mapping[str, str]) -> DataFrame:
    """Metrics of several prediction columns with their rank by MAE (equal ones share the least), then RMSE."""
    long = df.select(F.col(actual).alias("_a"), F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("_p")) for m, c in models.items()])))
    out = metrics(long, "_a", "_p", ["model"])
    return out.withColumn("mae_rank", F.rank().over(Window.orderBy("mae")))


def chosen(comparison: DataFrame, baseline: str) -> str:
    return comparison.where(F.col("model") != baseline).orderBy("mae", "rmse", "model").first()["model"]


class GroupMeans:
    """Predicts the mean of its training rows with equal keys; rows of unknown keys get none."""

    def __init__(self, df: DataFrame, keys: Sequence[str], label: str):
        self.keys = list(keys)
        self.means = df.groupBy(*keys).agg(F.avg(label).alias("prediction"))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.means, self.keys, "left")


def permuted(df: DataFrame, columns: Sequence[str], seed: int, key: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns' values shuffled together over all rows: two random orders of the rows, and each row gets the values of the one at its place in the other order.

    The orders are those of MD5 sums of ``key`` (all columns, unless given) with the seed; places come from ranges and prefix
    sums, so no task holds more than its range.
    """
    at = lambda s: F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key or df.columns], F.lit(str(s))))
    placed = ranked(df, [at(0)], "_i")
    other = ranked(df.select(*key, *columns) if key else df, [at(seed + 1)], "_i").select("_i", *[F.col(c).alias(f"_{c}") for c in columns])
    return placed.join(other, "_i").select(*[F.col(f"_{c}").alias(c) if c in columns else c for c in df.columns])


def permutation_importance(model, df: DataFrame, label: str, groups: Mapping[str, Sequence[str]], repeats: int = 3, key: Sequence[str] = ()) -> list[tuple[str, float, float]]:
    """(group, mean rise of MAE, deviation) when a group's columns are shuffled together; ``model`` is anything with ``transform``."""
    error = lambda d: model.transform(d).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]
    base, out = error(df), []
    for name, columns in groups.items():
        rises = [error(permuted(df, columns, 1000 + k, key)) - base for k in range(repeats)]
        mean = sum(rises) / repeats
        out.append((name, mean, (sum((r - mean) ** 2 for r in rises) / repeats) ** 0.5))
    return sorted(out, key=lambda r: -r[1])


def prediction_rows(df: DataFrame, run: str, model: str, predicted: str, actual: str = "trips") -> DataFrame:
    """Predictions for loading: rounded to four places before the error is taken."""
    p = F.round(F.greatest(F.col(predicted).cast("double"), F.lit(0.0)), 4)
    out = df.select(F.lit(run).alias("run_id"), F.lit(model).alias("model_name"), "date", "hour", "zone_id", F.col(actual).cast("long").alias("actual"), p.alias("predicted"))
    return out.withColumn("error", F.round(F.col("predicted") - F.col("actual"), 4))


def impurity_importance(fitted, names: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted pipeline's trees, greatest first; ``names`` as given to ``pipeline``, categories last."""
    return sorted(zip(names, fitted.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda r: -r[1])
