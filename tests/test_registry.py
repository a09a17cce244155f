"""The registry as a stream equals its batch fold, through restarts and late changes; arrivals are ingested once."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lumenloft.engine import Engine
from lumenloft.streaming import feeds
from lumenloft.streaming.registry import AutoIngest, present, stream_registry

CHANGES = "host string, poll long, change string, strong_id string, path string, label string, known_source_id string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, old)


def feed(rng, n):
    for poll in range(n):
        card = rng.randrange(12)
        strong = f" v{card} " if card % 3 else rng.choice(["", " ", None])
        yield rng.choice("ab"), poll, rng.choice(["arrived", "arrived", "removed"]), strong, f"/m/{card}" if strong and strong.strip() else f"/p/{card}", f"l{poll}", rng.choice([None, None, f"s{poll}"])


def run(spark, folder, checkpoint, into, batches=100):
    """Until nothing is left, a file in each micro-batch; the query ends and starts again from its checkpoint for each."""
    changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).json(folder)

    def write(df, epoch):
        df.withColumn("at", F.lit(epoch)).write.mode("append").parquet(into)

    q = stream_registry(changes).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.mark.parametrize("late", [False, True])
def test_stream_equals_batch(rocks, tmp_path, late):
    rows = list(feed(random.Random(3), 120))
    order = random.Random(1).sample(rows, len(rows)) if late else rows
    folder = tmp_path / "in"
    parts = [order[:30], order[30:70], order[70:]]
    for part in parts:
        rocks.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").json(str(folder))
        run(rocks, str(folder), str(tmp_path / "checkpoint"), str(tmp_path / "out"))  # a new query, from the old state
    got = present(rocks.read.parquet(str(tmp_path / "out"))).collect()
    want = []
    for host in "ab":
        changes = rocks.createDataFrame([r for r in rows if r[0] == host], CHANGES)
        want += [(host, r.key, r.path, r.label, r.known_source_id) for r in feeds.detected_registry(changes).collect()]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 5


def test_absent_cards_leave(rocks, tmp_path):
    folder = tmp_path / "in"
    rocks.createDataFrame([("a", 1, "arrived", "v1", "/m/1", "card", None)], CHANGES).coalesce(1).write.json(str(folder))
    changes = rocks.readStream.schema(CHANGES).json(str(folder))
    seen = []
    q = stream_registry(changes, absent_ms=1500).writeStream.outputMode("update").foreachBatch(lambda df, e: seen.extend((r.key, r.online) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            if ("v1", False) in seen:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert seen[0] == ("v1", True) and seen[-1] == ("v1", False)


def test_arrivals_are_ingested_once(spark, tmp_path):
    card = tmp_path / "CARD" / "DCIM"
    card.mkdir(parents=True)
    (card / "a.jpg").write_bytes(b"a")
    e = Engine(spark, str(tmp_path / "catalog"))
    auto = AutoIngest(e, "cards", str(tmp_path / "archive"), "driver-1")
    rows = spark.createDataFrame([("h", "v1", str(card.parent), "card", None, True, 1), ("h", "v2", "/gone", "left", None, False, 1)], "host string, key string, path string, label string, known_source_id string, online boolean, poll long")
    # another driver holds the lease and dies; until it expires nothing is ingested
    assert e.store.acquire("ingest-cards", "driver-0", 3000)
    with pytest.raises(RuntimeError, match="another driver"):
        auto(rows, 7)
    assert e.table("ingest_sessions").isEmpty()
    time.sleep(3.1)
    auto(rows, 7)
    auto(rows, 7)  # the epoch is replayed
    sessions = e.table("ingest_sessions").collect()
    assert [(s.id, s.status) for s in sessions] == [(auto.session_id(7, "h", "v1"), "completed")]
    # a session that its driver left open is recovered by the replay, not begun anew
    e.store.update("ingest_sessions", lambda t: t.withColumn("status", F.lit("copying")).withColumn("completed_at", F.lit(None).cast("string")))
    auto(rows, 7)
    assert [(s.id, s.status) for s in e.table("ingest_sessions").collect()] == [(auto.session_id(7, "h", "v1"), "completed")]
    auto.enabled = lambda: False
    auto(rows, 8)
    assert e.table("ingest_sessions").count() == 1


def test_one_host_is_spread(rocks, tmp_path):
    """The cards of one host don't meet in one task, and the registry is still that of the batch fold."""
    rows = [("a", poll, "removed" if poll % 7 == 3 else "arrived", f"v{poll % 40}", f"/m/{poll}", "l", f"s{poll}" if poll % 4 == 0 else None) for poll in range(400)]
    rocks.createDataFrame(rows, CHANGES).coalesce(1).write.json(str(tmp_path / "in"))
    changes = rocks.readStream.schema(CHANGES).json(str(tmp_path / "in"))
    seen = []

    def take(df, epoch):
        seen.extend(df.withColumn("at", F.lit(epoch)).withColumn("task", F.spark_partition_id()).collect())

    stream_registry(changes).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len({r.task for r in seen}) > 1
    want = feeds.detected_registry(rocks.createDataFrame(rows, CHANGES)).collect()
    assert sorted((r.key, r.path, r.label, r.known_source_id) for r in seen if r.online) == sorted(map(tuple, want)) and want
