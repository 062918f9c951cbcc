"""Duplicates of wide rows without moving all of them.

Rows are counted by a 64-bit hash of their keys, which partial sums shrink before the shuffle. Only rows whose hash occurs
more than once are candidates: those hashes are few where duplicates are few. They go to all tasks, as they are up to
``MOST_HASHES``, else as a Bloom filter of fixed size, so the other rows never leave their place. Candidates are compared on
their values: neither a collision nor a false positive of the filter changes a result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pinned
from .ranks import ranked

#: Hashes that are broadcast as rows (8 MB); beyond, a filter of ``BITS`` bits a hash, 2 ** ``MOST_BITS`` (256 MB) at most.
MOST_HASHES, BITS, MOST_BITS, SEEDS = 1_000_000, 12, 31, (1, 2, 3)


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The hashes (h) of keys that occur more than once; nothing but hashes is shuffled."""
    return df.select(_hash(keys).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def _places(h: Column, bits: int) -> list[Column]:
    return [F.xxhash64(h, F.lit(s)).bitwiseAND(F.lit((1 << bits) - 1)) for s in SEEDS]


def bloom(hashes: DataFrame, n: int):
    """A test (on a hash) that is true for all of ``hashes`` and few others."""
    bits = min(MOST_BITS, max(10, int(np.ceil(np.log2(max(1, n) * BITS)))))
    place = hashes.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()  # 2 ** (bits - 6) rows at most
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    held = hashes.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def known(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        hit = np.ones(len(a), bool)
        for x in (a, b, c):
            p = x.to_numpy()
            hit &= (held.value[p >> 6] >> (p & 63)) & 1 == 1
        return pd.Series(hit)

    return lambda h: known(*_places(h, bits))


def split(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys may occur again, and those whose keys don't."""
    hashes = pinned(repeated(df, keys))
    n = hashes.count()
    if not n:
        return df.limit(0), df
    if n <= MOST_HASHES:
        known = F.broadcast(hashes)  # MOST_HASHES rows at most
        # joined on the expression: a column that holds it would stand for all keys in the optimizer's constraints
        return df.join(known, _hash(keys) == F.col("h"), "left_semi"), df.join(known, _hash(keys) == F.col("h"), "left_anti")
    again = bloom(hashes, n)(_hash(keys))
    return df.where(again), df.where(~again)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "occurrence") -> DataFrame:
    """``df`` with each row's place among the rows of its keys, as a window would give it; null keys are alike.

    Candidates are numbered by their place in the order of keys and ``order`` and the first place of their keys, so a key of
    most candidates is no single task's work.
    """
    candidates, single = split(df, keys)
    placed = ranked(candidates.withColumn("_key", F.struct(*keys)), ["_key", *order], "_place")  # null fields of structs are alike
    first = placed.groupBy("_key").agg(F.min("_place").alias("_first"))
    found = placed.join(first, "_key").withColumn(name, (F.col("_place") - F.col("_first") + 1).cast("int"))
    return found.select(*df.columns, name).unionByName(single.withColumn(name, F.lit(1)))


def duplicate_keys(df: DataFrame, keys: Sequence[str], file: str) -> DataFrame:
    """Keys of several rows: how many, and the first file that has one; only candidates are grouped by their values."""
    candidates, _ = split(df.select(*dict.fromkeys([*keys, file])), keys)
    return candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.min(file).alias("keeper")).where("occurrences > 1")
