"""Loads by months: states, claims, and a failure at every step."""

import json

import pytest
from pyspark.sql import functions as F

from cityflux.plans import loading
from cityflux.sources import sinks

SCHEMA = "k int, d date, v int"


def rows(spark, data):
    return spark.createDataFrame(data, "k int, d string, v int").withColumn("d", F.to_date("d"))


@pytest.fixture
def place(spark, tmp_path):
    fact, ledger = str(tmp_path / "fact"), str(tmp_path / "ledger")

    def load(sha, data, run="r1", **how):
        return loading.load_months(fact, ledger, "p", "f", sha, rows(spark, data), "d", ["k"], run, "2025-01-01", **how)

    def held():
        return sorted(tuple(r) for r in spark.read.parquet(fact).select("k", F.col("d").cast("string"), "v").collect())

    load.held, load.fact, load.ledger, load.tmp = held, fact, ledger, tmp_path
    return load


OLD = [(1, "2025-01-05", 1), (2, "2025-01-09", 1), (3, "2025-02-05", 1), (4, "2025-03-05", 1)]
NEW = [(2, "2025-01-09", 2), (3, "2025-02-05", 2), (5, "2025-02-07", 2)]
BOTH = [(1, "2025-01-05", 1), (2, "2025-01-09", 2), (3, "2025-02-05", 2), (4, "2025-03-05", 1), (5, "2025-02-07", 2)]


def test_only_touched_months_are_written(spark, place):
    assert place("a", OLD) == loading.Loaded("SUCCESS", 0, 4, ("2025-01", "2025-02", "2025-03"))
    before = {p.name: p.stat().st_mtime_ns for p in place.tmp.glob("fact/month=2025-03/*.parquet")}
    assert place("b", NEW) == loading.Loaded("SUCCESS", 2, 1, ("2025-01", "2025-02"))
    assert {p.name: p.stat().st_mtime_ns for p in place.tmp.glob("fact/month=2025-03/*.parquet")} == before
    assert place.held() == BOTH
    assert place("b", NEW) == loading.Loaded("SKIPPED")
    assert sorted(p.name for p in place.tmp.iterdir()) == ["fact", "ledger"]
    assert loading.Ledger(spark, place.ledger).claims() == []


STEPS = ["after_claim", "after_stage", "after_intent", "between_moves_0", "after_month_0", "between_moves_1", "after_month_1", "after_success"]


@pytest.mark.parametrize("again", ["same run", "repair"])
@pytest.mark.parametrize("step", STEPS)
def test_a_failure_at_any_step_ends_in_one_result(spark, place, monkeypatch, step, again):
    place("a", OLD)
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match=step):
        m.setenv(sinks.FAILPOINTS, step)
        if step == "after_stage":  # a dead driver, not an error that the load could note
            m.setattr(loading, "_undone", lambda *a: None)
        place("b", NEW)
    if again == "repair":
        with pytest.raises(loading.Claimed):  # another run can't go on before the dead one is settled
            place("c", [(2, "2025-01-09", 9)], "r2")
        done = loading.repair(spark, place.fact, place.ledger, "r1")
        committed = STEPS.index(step) >= STEPS.index("after_intent")
        assert [x.status for x in done] == ["SUCCESS" if committed else "FAILED"]
        assert place.held() == (BOTH if committed else OLD)
        assert place("b", NEW, "r2").status == ("SKIPPED" if committed else "SUCCESS")
    else:
        assert place("b", NEW).status == "SUCCESS"
        assert place("b", NEW).status == "SKIPPED"
    assert place.held() == BOTH
    book = loading.Ledger(spark, place.ledger)
    assert {(r["sha256"], r["status"]) for r in book.states().where("sha256 <> 'c'").collect()} == {("a", "SUCCESS"), ("b", "SUCCESS")}
    assert book.events().where("status = 'SUCCESS'").count() == 2
    assert book.claims() == []
    assert loading.unsettled(spark, place.ledger).count() == 0
    assert sorted(p.name for p in place.tmp.iterdir()) == ["fact", "ledger"]


def test_an_error_is_noted_and_undone(spark, place):
    place("a", OLD)
    for bad in ([(7, "2025-01-01", 1)] * 2, [(None, "2025-01-01", 1)], [(7, None, 1)]):
        with pytest.raises(ValueError, match="staged keys"):
            place("x", bad)

    def no(df):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        place("x", NEW, check=no)
    assert place.held() == OLD
    state = loading.Ledger(spark, place.ledger).states().where("sha256 = 'x'").first()
    assert (state["status"], state["error"], state["attempt"]) == ("FAILED", "no", 3)
    assert place("x", NEW).status == "SUCCESS"


def test_months_are_replaced_even_by_nothing(spark, place):
    place("a", OLD)
    assert place("b", [(9, "2025-02-01", 3)], months=["2025-01", "2025-02"], replace=True).months == ("2025-01", "2025-02")
    assert place.held() == [(4, "2025-03-05", 1), (9, "2025-02-01", 3)]
    with pytest.raises(ValueError, match="2025-03"):
        place("c", [(9, "2025-03-01", 3)], months=["2025-01"], replace=True)
    assert place("d", [], months=["2025-02"], replace=True).status == "SUCCESS"
    assert place.held() == [(4, "2025-03-05", 1)]
    assert place("e", []) == loading.Loaded("SUCCESS", 0, 0, ())


def test_a_claim_is_of_one_run(spark, place):
    book = loading.Ledger(spark, place.ledger)
    book.claim(["2025-02"], "other", "r9")
    with pytest.raises(loading.Claimed, match="r9"):
        place("b", NEW)
    assert [c["month"] for c in book.claims()] == ["2025-02"]  # January was let go again
    book.release("other", "r9")
    assert place("b", NEW).status == "SUCCESS"
    assert sinks.Store(spark).create(str(place.tmp / "one"), "a")
    assert not sinks.Store(spark).create(str(place.tmp / "one"), "b")
    assert json.loads(json.dumps(sinks.Store(spark).text(str(place.tmp / "one")))) == "a"


def test_large_and_empty_files_in_manifests(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "in").mkdir(parents=True)
    with (raw / "huge").open("wb") as f:
        f.truncate(3 << 30)  # no bytes on the disk
    (raw / "in/cut").write_bytes(b"x" * 70)
    (raw / "in/none").write_bytes(b"")
    (raw / "in/ö b#%20").write_bytes(b"y")
    base = spark.createDataFrame(sinks.manifest(spark, str(raw)).collect(), sinks.MANIFEST)
    assert {r["file"].rsplit("/", 1)[1]: r["size"] for r in base.collect()} == {"huge": 3 << 30, "cut": 70, "none": 0, "ö b#%20": 1}
    (raw / "in/cut").write_bytes(b"")
    with (raw / "huge").open("r+b") as f:
        f.seek((3 << 30) - 1)
        f.write(b"z")
    got = {r["file"].rsplit("/", 1)[1]: r["status"] for r in sinks.verified(base, sinks.manifest(spark, str(raw))).collect()}
    assert got == {"huge": "SHA256_CHANGED", "cut": "FILE_SIZE_CHANGED", "none": "MATCH", "ö b#%20": "MATCH"}
    assert sinks.manifest(spark, str(raw), "c*").count() == 1
    assert sinks.manifest(spark, str(raw), "q*").count() == 0
