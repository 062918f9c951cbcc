"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a text are maximal runs of characters outside these six.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_RE = rf"[^{SPACE_CLASS}]+"
SPACE_RE = rf"[{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in fewer pieces than there are cores is dealt out first."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def word_array(text: Column | str) -> Column:
    """The words of a text, in order; an empty array for a null or blank text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``; where it is unset, a new one, which only a local master can have."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='cityflux-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def pinned(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in reliable checkpoint files of the shared folder: lineage ends here, a lost executor costs nothing, and Spark removes the files when no plan needs them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key with this share of all rows or more counts as hot.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left-joined with ``facts``, which has one row per key and in ``weight`` how many of the rows have it.

    Keys with a ``HOT_SHARE``-th of all rows or more, of which there are ``HOT_SHARE`` at most, are broadcast, so their rows
    stay where they are; all others are joined by a shuffle. Both sides are read twice, so they should be stored.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(facts.where(F.col(weight) * HOT_SHARE >= total).drop(weight))  # HOT_SHARE rows at most
    cold = facts.where(F.col(weight) * HOT_SHARE < total).drop(weight)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key, "left"))


class Scratch:
    """Tables in the shared folder that live as long as the ``with`` block; for steps that are over when the operator returns."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.made: dict[str, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.made)}"
        self.made[path] = name
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        for path in [p for p, n in self.made.items() if n == name]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path if urlparse(path).scheme else f"file://{path}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def __exit__(self, *exc) -> None:
        self._delete(self.root)


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "binary": T.BinaryType()}


def struct_of(fields: str) -> T.StructType:
    """A schema from ``"name type, ..."``, without a running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


def crc_table() -> list[int]:
    """What CRC-32 does to each byte, by its polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


def sql_crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 in DuckDB."""
    codes = f"[CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode({text})), '..')]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, x: xor(({crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"
