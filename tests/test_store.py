"""The keyed delta log: merge on read, buckets, conflicts, compaction, old readers, leases."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from lumenloft import schemas
from lumenloft.operators import maintenance
from lumenloft.store import Conflict, Store

NAMES = schemas.SETTINGS.names


def rows(spark, *values):
    return spark.createDataFrame([(k, v, None) for k, v in values], schemas.SETTINGS)


def held(df):
    return {r["key"]: r["value_json"] for r in df.collect()}


def parts(tmp_path, path):
    return [p for p in (tmp_path / "settings" / "data" / path).rglob("*.parquet")]


def test_rows_follow_the_log(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert held(s.read("settings")) == {}
    s.append("settings", rows(spark, ("a", "1"), ("b", "2"), ("c", "3")))
    s.merge("settings", rows(spark, ("b", "20"), ("d", "4")))
    s.merge("settings", rows(spark, ("a", None)).withColumn("_deleted", F.lit(True)))
    want = {"b": "20", "c": "3", "d": "4"}
    assert held(s.read("settings")) == want and held(s.read("settings", 1)) == {"a": "1", "b": "2", "c": "3"}
    before = s.read("settings")
    assert s.compact("settings") == 4 and s.compact("settings") is None
    assert held(s.read("settings")) == want == held(before)
    s.append("settings", rows(spark, ("a", "again")))
    s.merge("settings", rows(spark, ("c", "30")))
    s.update("settings", lambda t: maintenance.changed(t, F.col("key") == "d", {"value_json": F.concat("value_json", F.lit("!"))}))
    s.update("settings", lambda t: maintenance.removed(t, t.filter("key = 'b'"), ["key"]))
    want = {"a": "again", "c": "30", "d": "4!"}
    assert held(s.read("settings")) == want
    assert held(s.get("settings", "d")) == {"d": "4!"} and s.get("settings", "b").isEmpty() and held(s.get("settings", "a")) == {"a": "again"}
    s.compact("settings")
    assert held(s.read("settings")) == want and held(s.get("settings", "d")) == {"d": "4!"}
    assert [s.vacuum("settings", keep=1, older_than_s=1e9), s.vacuum("settings", keep=1, older_than_s=-60) > 0] == [0, True]
    assert held(Store(spark, str(tmp_path)).read("settings")) == want
    s.replace("settings", rows(spark, ("z", "1")))
    assert held(s.read("settings")) == {"z": "1"}


def test_a_change_writes_one_small_file(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.replace("settings", spark.range(20_000).select(F.col("id").cast("string").alias("key"), F.repeat(F.lit("v"), 50).alias("value_json"), F.lit(None).cast("string").alias("updated_at")))
    base = s.state("settings").base
    assert len(base) == 16
    s.update("settings", lambda t: maintenance.changed(t, F.col("key") == "77", {"value_json": F.lit("new")}))
    path = s.state("settings").deltas[0][2]
    found = parts(tmp_path, path)
    assert len(found) == 1 and found[0].stat().st_size < 5000
    # compaction writes the bucket of that row and no other
    s.compact("settings")
    after = s.state("settings").base
    assert sum(after[b] != base[b] for b in base) == 1 and s.read("settings").count() == 20_000
    # a lookup reads one bucket's files
    assert len(s.get("settings", "77").inputFiles()) == 1
    # and the base isn't shuffled to read it with its deltas
    s.merge("settings", rows(spark, ("78", "x")))
    plan = s.read("settings")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_two_writers_lose_nothing(spark, tmp_path):
    Store(spark, str(tmp_path)).append("settings", rows(spark, ("n", "0"), ("m", "0")))
    failed = []

    def count(key, times):
        own = Store(spark, str(tmp_path), compact_after=5)
        try:
            for _ in range(times):
                own.update("settings", lambda t: maintenance.changed(t, F.col("key") == key, {"value_json": (F.col("value_json").cast("int") + 1).cast("string")}))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=count, args=a) for a in (("n", 5), ("n", 5), ("m", 5))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    s = Store(spark, str(tmp_path))
    assert held(s.read("settings")) == {"n": "10", "m": "5"}
    assert s.versions("settings") == list(range(1, max(s.versions("settings")) + 1))


def test_conflicts(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.append("settings", rows(spark, ("k", "1"), ("l", "1")))
    at = a.state("settings").version
    b.merge("settings", rows(spark, ("k", "2")))
    with pytest.raises(Conflict):
        a.merge("settings", rows(spark, ("k", "3")), parent=at)
    a.merge("settings", rows(spark, ("l", "3")), parent=at)  # other rows: no conflict
    assert held(a.read("settings")) == {"k": "2", "l": "3"}
    # a commit between reading and writing is seen, whatever the clock says
    seen = []

    def make(t):
        if not seen:
            b.merge("settings", rows(spark, ("k", "10")))
        seen.append(1)
        return maintenance.changed(t, F.col("key") == "k", {"value_json": F.concat("value_json", F.lit("+"))})

    a.update("settings", make)
    assert len(seen) == 2 and held(a.read("settings"))["k"] == "10+"
    # a writer that died before its commit leaves nothing to be seen
    a._write("settings", a._fit("settings", rows(spark, ("k", "dead")), F.lit(False).alias("_deleted")))
    assert held(b.read("settings"))["k"] == "10+"
    # compaction while others commit keeps their rows
    real = a._write_base

    def slow(*x):
        out = real(*x)
        b.merge("settings", rows(spark, ("late", "1")))
        return out

    a._write_base = slow
    assert a.compact("settings") and held(a.read("settings")) == {"k": "10+", "l": "3", "late": "1"} and len(a.state("settings").deltas) == 1


def test_leases(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one = a.acquire("session-1", "driver-a", 1000, now_ms=0)
    assert one == 1 and b.acquire("session-1", "driver-b", 1000, now_ms=500) is None
    two = b.acquire("session-1", "driver-b", 1000, now_ms=1500)  # a is dead
    assert two == 2 and a.acquire("session-1", "driver-a", 1000, now_ms=1600) is None
    b.merge("settings", rows(spark, ("k", "b")), fences={"session-1": two})
    with pytest.raises(Conflict, match="newer holder"):
        a.update("settings", lambda t: rows(spark, ("k", "a")), fences={"session-1": one})
    assert held(a.read("settings")) == {"k": "b"}
    a.release("session-1", "driver-a")
    assert a.acquire("session-1", "driver-a", 1, now_ms=1700) is None
    b.release("session-1", "driver-b")
    three = a.acquire("session-1", "driver-a", 1, now_ms=1700)
    assert three == 4
    a.merge("settings", rows(spark, ("k", "a")), fences={"session-1": three})
    a.compact("settings")
    with pytest.raises(Conflict):
        b.append("settings", rows(spark, ("x", "b")), fences={"session-1": two})
    assert json.loads((tmp_path / "_leases" / "session-1" / "_log" / "000000000003.json").read_text())["holder"] is None
