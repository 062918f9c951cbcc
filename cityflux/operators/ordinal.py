"""Ordinal codes as a pipeline stage: the place of a value among the sorted ones, -1 for null and unknown values.

Codes are plain numbers, so trees split them by order and take any number of values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A column with more values than this is no category; fitting raises.
MOST_VALUES = 10_000


class OrdinalModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Puts the codes of ``inputCols`` into ``outputCols``."""

    labels = Param(Params._dummy(), "labels", "sorted values of each input column", TypeConverters.identity)

    def __init__(self, inputCols: Sequence[str] = (), outputCols: Sequence[str] = (), labels: Sequence[Sequence[str]] = ()):
        super().__init__()
        self._set(inputCols=list(inputCols), outputCols=list(outputCols), labels=[list(v) for v in labels])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.labels), strict=True)
        place = lambda c, values: F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), F.col(c).cast("string")) - 1
        return dataset.withColumns({o: F.coalesce(place(c, values), F.lit(-1)).cast("double") for c, o, values in names})


class OrdinalEncoder(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the values of each input column; null is none of them."""

    def __init__(self, inputCols: Sequence[str] = (), outputCols: Sequence[str] = ()):
        super().__init__()
        self._set(inputCols=list(inputCols), outputCols=list(outputCols))

    def _fit(self, dataset: DataFrame) -> OrdinalModel:
        labels = []
        for c in self.getInputCols():
            rows = dataset.select(F.col(c).cast("string").alias("v")).dropna().distinct().limit(MOST_VALUES + 1).collect()
            if len(rows) > MOST_VALUES:
                raise ValueError(f"{c} has more than {MOST_VALUES} values")
            labels.append(sorted(r["v"] for r in rows))
        return OrdinalModel(self.getInputCols(), self.getOutputCols(), labels)
