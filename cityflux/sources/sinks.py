"""Publication: staged writes that are verified before they replace anything, upserts, registries, run logs, manifests.

File moves go through Hadoop's file system API, so any store that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Names of faults that ``failpoint`` raises, for tests of recovery, comma-joined.
FAILPOINTS = "CITYFLUX_FAILPOINTS"


def failpoint(name: str) -> None:
    if name in os.environ.get(FAILPOINTS, "").split(","):
        raise RuntimeError(f"failpoint {name}")


class Store:
    """Existence, removal and renaming of paths."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def stamp(self, path: str) -> tuple[int, int]:
        """Bytes below a path and the time of its last change."""
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()

    def matching(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return sorted(str(s.getPath()) for s in fs.globStatus(p) or [])

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def create(self, path: str, text: str) -> bool:
        """A small file, unless there is one: the store decides which of two writers made it."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                return False
            raise OSError(f"{path} can't be created") from e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def files(self, path: str) -> list[tuple[str, int]]:
        """(path, bytes) of every file below a path, empty ones too."""
        fs, p = self._at(path)
        found, out = fs.listFiles(p, True), []
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString(), s.getLen()))
        return sorted(out)

    def move(self, source: str, target: str) -> None:
        fs, p = self._at(source)
        q = self.jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"{source} can't become {target}")


def publish(df: DataFrame, path: str, expected: int | None = None, partition_by: Sequence[str] = (), check=None) -> int:
    """Replaces the table at ``path``: writes beside it, reads back and verifies the count (and ``check(df)``), then swaps; on a failure the old table stays. A table that a lost driver left as a backup alone is put back first."""
    spark, store = df.sparkSession, Store(df.sparkSession)
    if not store.exists(path) and (left := store.matching(f"{path}.backup-*")):
        store.move(left[-1], path)
    tag = uuid.uuid4().hex
    stage, backup = f"{path}.stage-{tag}", f"{path}.backup-{tag}"
    try:
        df.write.partitionBy(*partition_by).parquet(stage) if partition_by else df.write.parquet(stage)
        back = spark.read.schema(df.schema).parquet(stage)
        n = back.count()
        if expected is not None and n != expected:
            raise ValueError(f"{n} rows were written, {expected} expected")
        if check is not None:
            check(back)
        failpoint("before_publish")
        if store.exists(path):
            store.move(path, backup)
        try:
            store.move(stage, path)
        except Exception:
            if store.exists(backup):
                store.move(backup, path)
            raise
        store.remove(backup)
        return n
    finally:
        store.remove(stage)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replaces the partitions that ``df`` has rows of; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    df.write.partitionBy(*partition_by).parquet(path)


def replace_verified(df: DataFrame, path: str, partition_by: Sequence[str], check) -> None:
    """Replaces the partitions that ``df`` has rows of, after ``check`` has seen what was written; on a failure the old ones stay."""
    spark, store = df.sparkSession, Store(df.sparkSession)
    tag = uuid.uuid4().hex
    stage, backup = f"{path}.stage-{tag}", f"{path}.backup-{tag}"
    try:
        write_partitions(df, stage, partition_by)
        check(spark.read.parquet(stage))
        moved = []
        try:
            for new in store.matching(stage + "/*=*" * len(partition_by)):
                part = new[new.index(tag) + len(tag) :]
                if store.exists(path + part):
                    store.move(path + part, backup + part)
                moved.append(part)
                store.move(new, path + part)
        except Exception:
            for part in moved:
                if store.exists(backup + part):
                    store.remove(path + part)
                    store.move(backup + part, path + part)
            raise
    finally:
        store.remove(stage)
        store.remove(backup)


def upserted(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``current`` with rows of equal key replaced by ``incoming`` and the rest of it added; raises on double or null keys."""
    bad = incoming.groupBy(*keys).count().where(" or ".join(["count > 1", *[f"{k} is null" for k in keys]])).limit(1).count()
    if bad:
        raise ValueError("incoming keys are null or occur twice")
    return current.join(incoming.select(*keys), list(keys), "left_anti").select(*current.columns).unionByName(incoming.select(*current.columns))


def inserted(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``current`` plus the rows of ``incoming`` whose key it lacks."""
    return current.unionByName(incoming.select(*current.columns).join(current.select(*keys), list(keys), "left_anti").select(*current.columns))


def upsert_counts(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(updated, inserted)."""
    n = incoming.join(current.select(*keys).distinct().withColumn("_old", F.lit(True)), list(keys), "left").agg(F.count("_old"), F.count_if(F.col("_old").isNull())).first()
    return n[0], n[1]


def replace_months(report: DataFrame, incoming: DataFrame, month: str = "month") -> DataFrame:
    """A report with the incoming months in place of its own."""
    return upserted_groups(report, incoming, [month]).orderBy(month)


def upserted_groups(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(incoming.select(*keys).distinct(), list(keys), "left_anti").select(*current.columns).unionByName(incoming.select(*current.columns))


# Files


MANIFEST = "file string, size long, sha256 string"
#: Bytes of a file that are in memory at once.
CHUNK = 16 << 20


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, size and SHA-256 of every file below a path, empty ones too.

    Names and sizes come from the store's listing. Each file is hashed as a stream in blocks, in a task of its own, so its size
    doesn't matter; tasks open files by their full path, so the store has to be one that pyarrow reads (local, HDFS, S3 and others).
    """
    names = [(f, n) for f, n in Store(spark).files(path) if fnmatch(f.rsplit("/", 1)[1], pattern)]
    files = spark.createDataFrame(names, "file string, size long")
    if len(names) > 1:
        files = files.repartition(min(len(names), 10_000), "file")

    def hashed(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            out = []
            for f in batch.column(0).to_pylist():
                scheme, _, rest = f.partition(":")
                host, _, at = rest.removeprefix("//").partition("/") if rest.startswith("//") else ("", "", rest.removeprefix("/"))
                # names hold any characters, so they never pass through a URI
                system, root = (fs.LocalFileSystem(), "") if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}://{host}/")
                at = f"{root.rstrip('/')}/{at}"
                sha = hashlib.sha256()
                with system.open_input_stream(at, compression=None) as stream:
                    while block := stream.read(CHUNK):
                        sha.update(block)
                out.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["file", "size", "sha256"])

    return files.mapInArrow(hashed, MANIFEST)


def verified(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Per file of either side what has changed: MATCH, FILE_SIZE_CHANGED, SHA256_CHANGED, MISSING or UNEXPECTED."""
    a, b = baseline.alias("a"), current.alias("b")
    state = (
        F.when(F.col("b.file").isNull(), "MISSING").when(F.col("a.file").isNull(), "UNEXPECTED")
        .when(F.col("a.size") != F.col("b.size"), "FILE_SIZE_CHANGED").when(F.col("a.sha256") != F.col("b.sha256"), "SHA256_CHANGED").otherwise("MATCH")
    )
    return a.join(b, F.col("a.file") == F.col("b.file"), "full").select(F.coalesce("a.file", "b.file").alias("file"), state.alias("status"))


# Control tables: small append-only logs, of which the last state counts

REGISTRY = "pipeline string, file string, sha256 string, status string, batch string, at timestamp_ntz"


def latest(log: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The last row of each key; of rows of one time the one with the greatest values, column by column."""
    ties = [F.col(c).desc_nulls_last() for c in log.columns if c not in (at, *keys)]
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), *ties))).where("_n = 1").drop("_n")


def pending(files: DataFrame, registry: DataFrame, pipeline: str) -> DataFrame:
    """Files (file, sha256) whose content the pipeline hasn't loaded with success."""
    done = registry.where((F.col("pipeline") == pipeline) & (F.col("status") == "SUCCESS")).select("file", "sha256").distinct()
    return files.join(done, ["file", "sha256"], "left_anti")


def batch_key(pipeline: str, partition: str, sha256: str) -> str:
    return f"{pipeline}|{partition}|sha256={sha256}"


def watermark(log: DataFrame, pipeline: str):
    """The highest watermark that a pipeline has reached; later lower ones don't move it."""
    return log.where(F.col("pipeline") == pipeline).agg(F.max("watermark")).first()[0]


@dataclass(frozen=True)
class Run:
    """One run of a stage: STARTED, then SUCCESS or FAILED, once. Success needs processed = valid + rejected, as many quarantined records as rejected ones, and an event at least for each."""

    run_id: str
    pipeline: str
    stage: str
    status: str = "STARTED"
    processed: int | None = None
    valid: int | None = None
    rejected: int | None = None
    quarantined: int | None = None
    events: int | None = None
    error: str | None = None

    def _open(self) -> None:
        if self.status != "STARTED":
            raise ValueError(f"run {self.run_id} is {self.status}")

    def succeed(self, processed: int, valid: int, rejected: int, quarantined: int, events: int) -> Run:
        self._open()
        if processed != valid + rejected or quarantined != rejected or events < rejected or (rejected == 0) != (events == 0):
            raise ValueError(f"run {self.run_id} doesn't reconcile: {processed}, {valid}, {rejected}, {quarantined}, {events}")
        return replace(self, status="SUCCESS", processed=processed, valid=valid, rejected=rejected, quarantined=quarantined, events=events)

    def fail(self, error: str) -> Run:
        self._open()
        return replace(self, status="FAILED", error=error[:4000])


def append_log(spark: SparkSession, path: str, rows: Sequence[dict], schema: str) -> None:
    """Appends rows to a JSON-lines log."""
    spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema).coalesce(1).write.mode("append").json(path)


def to_jdbc(df: DataFrame, url: str, stage: str, batch_rows: int = 10_000, **options: str) -> int:
    """Replaces a staging table and counts it back."""
    expected = df.count()
    df.write.format("jdbc").option("url", url).option("dbtable", stage).option("batchsize", batch_rows).option("truncate", "true").options(**options).mode("overwrite").save()
    n = df.sparkSession.read.format("jdbc").option("url", url).option("dbtable", stage).options(**options).load().count()
    if n != expected:
        raise ValueError(f"{n} rows are staged, {expected} expected")
    return n
