"""Derived tables that are built once for a session and a data folder, and read by every query after that."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder
from ..sources.sinks import Store, publish

_MADE: dict[tuple, tuple[str, object]] = {}


def _state(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Sizes and times of the sources, so that a changed one is a new one."""
    store = Store(spark)
    return tuple((p, *store.stamp(p)) for p in paths)


def stored(spark: SparkSession, name: str, sources: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build`` gives, published under ``name`` in the shared folder when it is first asked for."""
    key = (spark.sparkContext.applicationId, name, _state(spark, sources))
    if key not in _MADE:
        df = build()
        path = f"{shared_folder(spark)}/gold-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        publish(df, path)
        _MADE[key] = path, df.schema
    path, schema = _MADE[key]
    return spark.read.schema(schema).parquet(path)
