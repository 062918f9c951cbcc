"""Loads that touch only the months they bring, and that a restart finishes or undoes.

A fact is a table with one folder per month. A load claims its months, writes their new rows beside the table, verifies what it
reads back, and then writes its intent: from that moment it counts as done, and whoever finds the intent carries it out. Each
step may be repeated: a month is moved in only while its staged folder is still there, and states are files of fixed names.

States are DISCOVERED, PROCESSING, then SUCCESS or FAILED, each a small file that is created or found, never written over. A claim
is such a file too, so two runs can't hold one month; a run that starts again under its own id takes its claims over, and
``repair`` settles what a dead run left: an intent is carried out, a load without one is undone.

Between two renames of a month readers don't find that month; other months stay readable all the time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import Store, batch_key, failpoint

STATES = {"DISCOVERED": 0, "PROCESSING": 1, "FAILED": 2, "SUCCESS": 3}
EVENTS = "pipeline string, file string, sha256 string, batch string, run_id string, attempt int, step int, status string, at string, updated long, inserted long, error string"
MONTH = "month"


class Claimed(RuntimeError):
    """Another run holds a month."""


@dataclass(frozen=True)
class Loaded:
    status: str
    updated: int = 0
    inserted: int = 0
    months: tuple[str, ...] = ()


class Ledger:
    """States, claims and intents of the loads into one fact, as small files below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark)

    # states

    def _events(self, batch: str) -> list[dict]:
        """What is noted of one batch, oldest first."""
        found = [json.loads(self.store.text(p)) for p in self.store.matching(f"{self.root}/events/{_name(batch)}-*.json")]
        return sorted(found, key=lambda e: (e["attempt"], e["step"]))

    def state(self, batch: str) -> dict | None:
        own = self._events(batch)
        return own[-1] if own else None

    def note(self, base: dict, attempt: int, status: str, **facts) -> None:
        event = {**base, "attempt": attempt, "step": STATES[status], "status": status, **facts}
        self.store.create(f"{self.root}/events/{_name(base['batch'])}-{attempt:06d}-{STATES[status]}.json", json.dumps(event))

    def events(self) -> DataFrame:
        if not self.store.matching(f"{self.root}/events/*.json"):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).json(f"{self.root}/events")

    def states(self) -> DataFrame:
        """The last state of each batch; later attempts and later steps win, times play no role."""
        w = Window.partitionBy("batch").orderBy(F.desc("attempt"), F.desc("step"))
        return self.events().withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    # claims

    def _claim(self, month: str) -> str:
        return f"{self.root}/claims/{_name(month)}.json"

    def claim(self, months: Sequence[str], batch: str, run_id: str) -> None:
        """All of the months or none; months that this run holds already, from before a restart, stay its own."""
        taken = []
        for m in sorted(months):
            if self.store.create(self._claim(m), json.dumps({"month": m, "batch": batch, "run_id": run_id})):
                taken.append(m)
                continue
            holder = json.loads(self.store.text(self._claim(m)))
            if (holder["run_id"], holder["batch"]) != (run_id, batch):
                for t in taken:
                    self.store.remove(self._claim(t))
                raise Claimed(f"month {m} is held by run {holder['run_id']} for {holder['batch']}")

    def claims(self) -> list[dict]:
        return [json.loads(self.store.text(p)) for p in self.store.matching(f"{self.root}/claims/*.json")]

    def release(self, batch: str, run_id: str) -> None:
        for c in self.claims():
            if (c["batch"], c["run_id"]) == (batch, run_id):
                self.store.remove(self._claim(c["month"]))

    # intents

    def _intent(self, batch: str) -> str:
        return f"{self.root}/intents/{_name(batch)}.json"

    def intend(self, intent: dict) -> None:
        self.store.create(self._intent(intent["base"]["batch"]), json.dumps(intent))

    def intent(self, batch: str) -> dict | None:
        return json.loads(self.store.text(self._intent(batch))) if self.store.exists(self._intent(batch)) else None

    def forget(self, batch: str) -> None:
        self.store.remove(self._intent(batch))


def _name(key: str) -> str:
    """A key as a file's name."""
    return hashlib.sha256(key.encode()).hexdigest()[:32]


def _folders(fact: str, batch: str) -> tuple[str, str]:
    return f"{fact}.stage-{_name(batch)}", f"{fact}.backup-{_name(batch)}"


def _carried_out(ledger: Ledger, intent: dict) -> Loaded:
    """Moves the staged months in, notes success, clears up; all of it may be repeated."""
    store, base, fact = ledger.store, intent["base"], intent["fact"]
    stage, backup = _folders(fact, base["batch"])
    for k, m in enumerate(intent["months"]):
        at = f"{MONTH}={m}"
        new, here, old = f"{stage}/{at}", f"{fact}/{at}", f"{backup}/{at}"
        if store.exists(new) or m in intent["emptied"]:
            if store.exists(here) and not store.exists(old):
                store.move(here, old)
            failpoint(f"between_moves_{k}")
            if store.exists(new):
                store.move(new, here)
        failpoint(f"after_month_{k}")
    ledger.note(base, intent["attempt"], "SUCCESS", updated=intent["updated"], inserted=intent["inserted"])
    failpoint("after_success")
    store.remove(stage)
    store.remove(backup)
    ledger.release(base["batch"], base["run_id"])
    ledger.forget(base["batch"])
    return Loaded("SUCCESS", intent["updated"], intent["inserted"], tuple(intent["months"]))


def _undone(ledger: Ledger, fact: str, base: dict, attempt: int, error: str) -> None:
    ledger.note(base, attempt, "FAILED", error=error[:4000])
    ledger.store.remove(_folders(fact, base["batch"])[0])
    ledger.release(base["batch"], base["run_id"])


def load_months(
    fact: str, ledger: str, pipeline: str, file: str, sha256: str, stage: DataFrame, date: str, keys: Sequence[str], run_id: str, at: str, check: Callable[[DataFrame], None] = lambda df: None, months: Sequence[str] | None = None, replace: bool = False,
) -> Loaded:
    """Upserts ``stage`` by ``keys`` into the months of its ``date``, once for each content.

    Only the touched months are read and written. With ``replace`` the ``months`` get the staged rows instead of their own, and
    those without staged rows become empty. ``check`` raises on staged rows that must not be loaded.
    """
    spark = stage.sparkSession
    book, batch = Ledger(spark, ledger), batch_key(pipeline, file, sha256)
    base = {"pipeline": pipeline, "file": file, "sha256": sha256, "batch": batch, "run_id": run_id, "at": at}
    left = book.intent(batch)
    if left:
        if left["base"]["run_id"] != run_id:
            raise Claimed(f"run {left['base']['run_id']} has begun to load {batch}; repair it if it is dead")
        return _carried_out(book, left)
    last = book.state(batch)
    if last and last["status"] == "SUCCESS":
        return Loaded("SKIPPED")
    attempt = 0 if last is None else last["attempt"] + (last["status"] == "FAILED" or last["run_id"] != run_id)
    book.note(base, attempt, "DISCOVERED")
    rows = stage.withColumn(MONTH, F.date_format(date, "yyyy-MM"))
    touched = sorted(r[0] for r in rows.select(MONTH).distinct().collect() if r[0] is not None)  # months of one load
    wanted = sorted(months) if months is not None else touched
    book.claim(wanted, batch, run_id)
    failpoint("after_claim")
    book.note(base, attempt, "PROCESSING")
    new, _ = _folders(fact, batch)
    try:
        check(stage)
        if set(touched) - set(wanted):
            raise ValueError(f"rows of {sorted(set(touched) - set(wanted))} aren't of the months to load")
        bad = rows.groupBy(*keys).count().where(" or ".join(["count > 1", *[f"{k} is null" for k in keys]])).limit(1).count() + rows.where(f"{MONTH} is null").limit(1).count()
        if bad:
            raise ValueError("staged keys or dates are null, or keys occur twice")
        current = _current(spark, fact, stage, wanted)
        keyed = rows.select(*keys).withColumn("_new", F.lit(True))
        marked = current.join(keyed, list(keys), "left")
        old, met = (x or 0 for x in marked.agg(F.count(F.lit(1)), F.count("_new")).first())
        staged = rows.count()
        kept = marked.where("_new is null").select(*rows.columns) if not replace else current.limit(0).select(*rows.columns)
        book.store.remove(new)  # what an earlier attempt left
        expected = staged + (0 if replace else old - met)
        split = max(1, expected // (FILE_ROWS * max(1, len(wanted))))
        kept.unionByName(rows).repartition(MONTH, F.pmod(F.xxhash64(*keys), F.lit(split))).write.partitionBy(MONTH).parquet(new)
        failpoint("after_stage")
        found = spark.read.schema(rows.schema).parquet(new).groupBy(MONTH).count().collect() if expected else []
        if sum(r[1] for r in found) != expected:
            raise ValueError(f"{sum(r[1] for r in found)} rows were written, {expected} expected")
    except Exception as e:
        _undone(book, fact, base, attempt, str(e))
        raise
    filled = {r[0] for r in found}
    intent = {"base": base, "attempt": attempt, "fact": fact, "months": wanted, "emptied": sorted(set(wanted) - filled) if replace else [], "updated": met, "inserted": staged - met}
    book.intend(intent)
    failpoint("after_intent")
    return _carried_out(book, intent)


#: Rows of a month that one task writes, in the mean.
FILE_ROWS = 1_000_000


def _current(spark: SparkSession, fact: str, like: DataFrame, months: Sequence[str]) -> DataFrame:
    """The fact's rows of some months; other months' files aren't opened."""
    store = Store(spark)
    paths = [p for m in months if store.exists(p := f"{fact}/{MONTH}={m}")]
    schema = like.withColumn(MONTH, F.lit("")).schema
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", fact).parquet(*paths)


def repair(spark: SparkSession, fact: str, ledger: str, run_id: str) -> list[Loaded]:
    """Settles what a dead run left in a fact: intents are carried out, other loads are undone and noted as failed."""
    book, out = Ledger(spark, ledger), []
    for path in book.store.matching(f"{book.root}/intents/*.json"):
        intent = json.loads(book.store.text(path))
        if intent["base"]["run_id"] == run_id:
            out.append(_carried_out(book, intent))
    for batch in sorted({c["batch"] for c in book.claims() if c["run_id"] == run_id}):
        last = book.state(batch)
        if last is not None:
            base = {k: last[k] for k in ("pipeline", "file", "sha256", "batch", "at")} | {"run_id": run_id}
            _undone(book, fact, base, last["attempt"], f"run {run_id} was dead")
            out.append(Loaded("FAILED"))
        else:
            book.release(batch, run_id)
    return out


def unsettled(spark: SparkSession, ledger: str) -> DataFrame:
    """Batches that are PROCESSING by their last state: at work, or what ``repair`` is for."""
    return Ledger(spark, ledger).states().where("status = 'PROCESSING'")
