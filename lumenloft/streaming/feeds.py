"""Change feeds and stateful folds, as batch functions and as streams.

The batch forms work on any window of events; the stream forms keep one small state for each key. None of them reads
event time out of order: samples count in the order of their sequence, as they were taken."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenloft import schemas
from lumenloft.operators.maintenance import latest_state
from lumenloft.sinks.writers import fan_out

WINDOW_MS, POLL_MS = 15_000, 2_000


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """change, and the columns of the snapshots: `removed` rows of before, `arrived` rows of after."""
    gone = before.join(after.select(*keys), keys, "left_anti").select(F.lit("removed").alias("change"), *before.columns)
    new = after.join(before.select(*keys), keys, "left_anti").select(F.lit("arrived").alias("change"), *before.columns)
    return gone.unionByName(new)


def polls_to_changes(polls: DataFrame, keys: list[str], poll: str = "poll", failed: str = "failed") -> DataFrame:
    """Changes between successive polls of a table of snapshots: the first poll is silent, failed polls are passed over.
    Everything is one pass with lag and lead over the key, so a feed of any length needs no loop."""
    good = polls.filter(~F.col(failed)).drop(failed)
    turns = good.select(poll).distinct().withColumn("turn", F.dense_rank().over(W.orderBy(poll)))
    last = turns.agg(F.max("turn").alias("last"))
    rows = good.select(poll, *keys).filter(" and ".join(f"`{k}` is not null" for k in keys)).distinct().join(turns, poll)
    by = W.partitionBy(*keys).orderBy("turn")
    rows = rows.select(*keys, "turn", F.lag("turn").over(by).alias("p"), F.lead("turn").over(by).alias("n"))
    arrived = rows.filter("turn > 1 and (p is null or p < turn - 1)").select(*keys, "turn", F.lit("arrived").alias("change"))
    removed = rows.filter(((F.col("n").isNull()) | (F.col("n") > F.col("turn") + 1)) & (F.col("turn") < last.scalar())).select(*keys, (F.col("turn") + 1).alias("turn"), F.lit("removed").alias("change"))
    return arrived.unionByName(removed).join(turns, "turn").select(poll, "change", *keys)


def detected_registry(changes: DataFrame, order: str = "poll") -> DataFrame:
    """Cards that are present after a feed of changes(order, change, strong_id, path, label, known_source_id): keyed by
    strong id, else by path; what is known of a card's identity is carried forward over later upserts until it leaves."""
    key = F.coalesce(F.nullif(F.trim("strong_id"), F.lit("")), "path")
    rows = changes.withColumn("key", key)
    stays = W.partitionBy("key").orderBy(F.desc(order))
    last_gone = F.max(F.when(F.col("change") == "removed", F.col(order))).over(W.partitionBy("key"))
    rows = rows.withColumn("gone", last_gone).filter((F.col("change") != "removed") & (F.col("gone").isNull() | (F.col(order) > F.col("gone"))))
    rows = rows.withColumn("known", F.first("known_source_id", ignorenulls=True).over(stays.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return latest_state(rows, ["key"], [order]).select("key", "path", "label", F.col("known").alias("known_source_id"))


def rolling_throughput(samples: DataFrame, by: str = "session", at_ms: str = "at_ms", done: str = "completed_bytes", seq: str = "seq", window_ms: int = WINDOW_MS) -> DataFrame:
    """Bytes a second over the trailing window of each sample. Rows of one time are told apart by `seq`."""
    good = samples.filter(F.col(done) >= 0)
    frame = W.partitionBy(by).orderBy(F.col(at_ms)).rangeBetween(-window_ms, 0)
    first = F.min(F.struct(F.col(at_ms).alias("t"), F.col(seq).alias("s"), F.col(done).alias("b"))).over(frame)
    rows = good.select("*", first.alias("f"))
    took = F.col(at_ms) - F.col("f.t")
    rate = F.when(took <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (F.col(done) - F.col("f.b")) / (took / 1000)))
    return rows.withColumn("bytes_per_second", rate).drop("f")


def session_fold(events: DataFrame, by: str = "session", order: str = "seq") -> DataFrame:
    """Progress events (kind: discovered, skipped, progress, completed, failed, status) as one snapshot a session."""
    n = lambda k: F.count_if(F.col("kind") == k)
    latest = events.filter("kind = 'progress'").groupBy(by, "file").agg(F.max_by("bytes", order).alias("b")).groupBy(by).agg(F.sum("b").alias("completed_bytes"))
    out = events.groupBy(by).agg(
        n("discovered").alias("total_files"), n("skipped").alias("skipped_files"), n("completed").alias("completed_files"), n("failed").alias("failed_files"), F.coalesce(F.sum(F.when(F.col("kind") == "discovered", F.col("bytes"))), F.lit(0)).alias("total_bytes"),
        F.max_by("status", F.when(F.col("kind") == "status", F.col(order))).alias("status"), F.max(order).alias("last_seq"),
    )
    return out.join(latest, by, "left").withColumn("completed_bytes", F.coalesce("completed_bytes", F.lit(0)))


def copy_states(events: DataFrame, by: str = "copy", order: str = "seq") -> DataFrame:
    """Each copy's latest status, and whether every step on its way was allowed."""
    from lumenloft.operators.constraints import bad_moves

    bad = bad_moves(events, [by], [order], schemas.COPY_MOVES).select(by).distinct().withColumn("bad", F.lit(True))
    return latest_state(events, [by], [order]).select(by, "status").join(bad, by, "left").select(by, "status", F.col("bad").isNull().alias("valid"))


def throttle_progress(events: DataFrame, by: str = "copy", done: str = "copied_bytes", order: str = "seq", step: int = 4 << 20) -> DataFrame:
    """Progress rows worth writing: the first of each step of bytes, and the last."""
    mark = F.floor(F.col(done) / step)
    w = W.partitionBy(by).orderBy(order)
    rows = events.withColumn("_m", mark).withColumn("_p", F.lag("_m").over(w)).withColumn("_n", F.lead(order).over(w))
    return rows.filter("_p is null or _m > _p or _n is null").drop("_m", "_p", "_n")


def single_flight(requests: DataFrame, key: str = "cache_key") -> DataFrame:
    """One request for each piece of content; the results are joined back by key."""
    return requests.dropDuplicates([key])


# streams


def stream_rolling_throughput(samples: DataFrame, by: str = "session", window_ms: int = WINDOW_MS) -> DataFrame:
    """The same as a stream over (session, at_ms, completed_bytes, seq). A session's state is its samples of the window."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.completed_bytes < 0:
                continue
            held.append((int(r.at_ms), int(r.completed_bytes)))
            while len(held) > 1 and held[0][0] < r.at_ms - window_ms:
                held.pop(0)
            took = held[-1][0] - held[0][0]
            out.append((key[0], int(r.seq), int(r.at_ms), max(0.0, (held[-1][1] - held[0][1]) / (took / 1000)) if took > 0 else 0.0))
        if held:
            state.update(tuple(list(c) for c in zip(*held, strict=True)))
        yield pd.DataFrame(out, columns=["session", "seq", "at_ms", "bytes_per_second"])

    return samples.groupBy(by).applyInPandasWithState(fold, "session string, seq long, at_ms long, bytes_per_second double", "t array<long>, b array<long>", "append", GroupStateTimeout.NoTimeout)


def stream_session_fold(events: DataFrame, by: str = "session") -> DataFrame:
    """Progress events (session, seq, kind, file, bytes, status) to a snapshot for each session that a batch touches.
    The state is the counters and the bytes of files under way."""
    kinds = ("discovered", "skipped", "completed", "failed")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = list(state.get) if state.exists else [0, 0, 0, 0, 0, 0, "", [], []]
        active = dict(zip(c[7], c[8], strict=True))
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.kind in kinds:
                c[kinds.index(r.kind)] += 1
                if r.kind == "discovered":
                    c[4] += int(r.bytes)
            if r.kind == "status":
                c[6] = r.status
            if r.kind == "progress":
                active[r.file] = int(r.bytes)
            if r.kind == "completed":
                c[5] += active.pop(r.file, 0)
        c[7], c[8] = list(active), list(active.values())
        state.update(tuple(c))
        yield pd.DataFrame([(key[0], *c[:5], c[5] + sum(active.values()), c[6])], columns=["session", "total_files", "skipped_files", "completed_files", "failed_files", "total_bytes", "completed_bytes", "status"])

    out = "session string, total_files long, skipped_files long, completed_files long, failed_files long, total_bytes long, completed_bytes long, status string"
    return events.groupBy(by).applyInPandasWithState(fold, out, "a long, b long, c long, d long, e long, f long, g string, h array<string>, i array<long>", "update", GroupStateTimeout.NoTimeout)


class VolumeFeed:
    """Polls of mounted volumes as a stream: each micro-batch is one poll; changes go to `on_change`, arrivals to
    `on_arrival` while nothing else is active. The last good snapshot stays through failed polls."""

    def __init__(self, keys: list[str], on_change: Callable[[DataFrame], None], on_arrival: Callable[[DataFrame], None] | None = None, active: Callable[[], bool] = lambda: False):
        self.keys, self.on_change, self.on_arrival, self.active, self.rows, self.schema = keys, on_change, on_arrival, active, None, None

    def __call__(self, batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        try:
            rows = batch.collect()  # the volumes of one host
        except Exception:  # noqa: BLE001
            return
        if self.rows is not None:
            before, after = (spark.createDataFrame(r, batch.schema) for r in (self.rows, rows))
            changes = snapshot_diff(before, after, self.keys)
            found = changes.collect()
            if found:
                told = spark.createDataFrame(found, changes.schema)
                self.on_change(told)
                arrived = told.filter("change = 'arrived'")
                if self.on_arrival and not self.active() and any(r["change"] == "arrived" for r in found):
                    self.on_arrival(arrived)
        self.rows = rows

    def start(self, polls: DataFrame, checkpoint: str, poll_ms: int = POLL_MS):
        return polls.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(processingTime=f"{poll_ms} milliseconds").start()


def write_all(stream: DataFrame, sinks: list[Callable[[DataFrame], None]], checkpoint: str):
    """A stream into several sinks; a batch fails only where all of them do."""
    return stream.writeStream.foreachBatch(lambda df, _epoch: fan_out(df, sinks)).option("checkpointLocation", checkpoint)


class SessionLock:
    """One resume or clean-up at a time for each session, on the driver. Who asks for an action that runs already gets its
    result; other actions of the session wait for their turn."""

    def __init__(self):
        import threading

        self._guard, self._locks, self._running = threading.Lock(), {}, {}

    def __call__(self, session: str):
        import threading

        with self._guard:
            return self._locks.setdefault(session, threading.Lock())

    def run(self, session: str, action: str, operation: Callable[[], object]):
        from concurrent.futures import Future

        with self._guard:
            mine = (session, action) not in self._running
            future = self._running.setdefault((session, action), Future())
        if not mine:
            return future.result()
        try:
            with self(session):
                future.set_result(operation())
        except BaseException as e:
            future.set_exception(e)
        finally:
            with self._guard:
                del self._running[session, action]
        return future.result()
