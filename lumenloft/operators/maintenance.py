"""Writes as DataFrames: Parquet tables are rewritten or appended to, so an upsert is a new state, not a change in place."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloft.operators.core import top1


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows replace those of the same key; columns in `keep` hold on to their old values. Keys are unique in both, nulls
    equal nulls."""
    old, new = table.withColumn("_old", F.lit(True)).alias("old"), rows.withColumn("_new", F.lit(True)).alias("new")
    on = None
    for k in keys:
        c = F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
        on = c if on is None else on & c
    def pick(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"old.{c}").alias(c)
        first, second = ("old", "new") if c in keep else ("new", "old")
        return F.when(F.col(f"_{first}").isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}")).alias(c)

    return old.join(new, on, "full").select(*[pick(c) for c in table.columns])


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that aren't there yet."""
    return rows.join(table.select(*keys), list(keys), "left_anti")


def conflicts(table: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows whose key is there with other values."""
    old = table.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    differs = None
    for c in columns:
        d = ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        differs = d if differs is None else differs | d
    return rows.join(old, list(keys)).filter(differs).select(*rows.columns)


def update(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return table.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def changed(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """The rows that an update changes, as they are after it: what a keyed table has to merge."""
    return update(table.filter(condition), F.lit(True), values)


def upserted(table: DataFrame, rows: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The rows that an upsert writes, and no others."""
    same = None
    named = rows.select(*[F.col(k).alias(f"_u_{k}") for k in keys])
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_u_{k}"))
        same = c if same is None else same & c
    return upsert(table.join(named, same, "left_semi"), rows, keys, keep)


def removed(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows that a deletion takes away, marked for a keyed table."""
    return table.join(keys.select(*on).distinct(), list(on), "left_semi").select(*table.columns, F.lit(True).alias("_deleted"))


def delete_unreferenced(table: DataFrame, candidates: DataFrame, key: str, children: DataFrame, child_key: str) -> DataFrame:
    """The table without candidates that no child refers to."""
    gone = candidates.select(key).join(children.select(F.col(child_key).alias(key)), key, "left_anti")
    return table.join(gone, key, "left_anti")


def delete(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on), list(on), "left_anti")


def latest_state(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key of an append-only table."""
    return top1(events, keys, [F.desc(o) for o in order])


def clear_session(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Files of deleted sessions lose their session."""
    gone = deleted.select(F.col("id").alias("_gone")).distinct()
    out = files.join(gone, files["ingest_session_id"] == F.col("_gone"), "left")
    return out.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "ingest_session_id" else files[c] for c in files.columns])


def evict(artifacts: DataFrame, limit_bytes: int, in_use: DataFrame | None = None) -> DataFrame:
    """Artifacts to drop, oldest first, until the rest fits; those in use stay out of the list but count.

    The running sum is taken level by level, so that no task sees all artifacts, nor all of an hour: hours, their seconds,
    those' full times, and artifacts of one time by the first letters of their keys. Each level adds up the sums of few spans
    inside one span of the level above, and only the artifacts of the last level are added up one by one."""
    levels = ["_hour", "_second", "_time", "_keys", "_more"]
    time = F.coalesce("updated_at", F.lit(""))
    a = artifacts.select("cache_key", "size_bytes", "updated_at", F.substring(time, 1, 13).alias("_hour"), F.substring(time, 1, 19).alias("_second"), time.alias("_time"), F.substring("cache_key", 1, 3).alias("_keys"), F.substring("cache_key", 1, 6).alias("_more"))
    before = lambda column, by, *order: F.coalesce(F.sum(column).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = [a.groupBy(*levels).agg(F.sum("size_bytes").alias("_s"))]
    for n in range(len(levels) - 1, 0, -1):
        spans.insert(0, spans[0].groupBy(*levels[:n]).agg(F.sum("_s").alias("_s")))
    start = spans[0].select("_hour", before("_s", [], "_hour").alias("_e"), F.sum("_s").over(W.partitionBy()).alias("_t"))
    for n in range(1, len(levels)):
        inside = spans[n].select(*levels[: n + 1], before("_s", levels[:n], levels[n]).alias("_i"))
        start = inside.join(start, levels[:n]).select(*levels[: n + 1], (F.col("_e") + F.col("_i")).alias("_e"), "_t")
    out = a.withColumn("_b", before("size_bytes", levels, "updated_at", "cache_key")).join(start, levels).filter(F.col("_t") - F.col("_e") - F.col("_b") > limit_bytes)
    out = out.select("cache_key", "size_bytes", "updated_at")
    return out if in_use is None else out.join(in_use, "cache_key", "left_anti")


def evict_other_sessions(artifacts: DataFrame, thumbnails: DataFrame, copies: DataFrame, copy: str) -> DataFrame:
    """Artifacts that no thumbnail of the session of `copy` shows; none where the copy isn't known."""
    session = copies.filter(F.col("id") == copy).select(F.col("ingest_session_id").alias("_session"))
    mine = copies.join(session, copies["ingest_session_id"] == F.col("_session")).select(F.col("id").alias("copied_file_id"))
    shown = thumbnails.join(mine, "copied_file_id").select(F.col("artifact_cache_key").alias("cache_key")).distinct()
    known = session.agg(F.count(F.lit(1)).alias("n"))
    return artifacts.join(shown, "cache_key", "left_anti").filter(known.scalar() > 0).select("cache_key", "size_bytes", "updated_at")


def running_stats(samples: DataFrame, by: str = "source_id", value: str = "bytes_per_second", order: str = "at") -> DataFrame:
    """Count, mean and last value of each source's samples."""
    return samples.groupBy(by).agg(F.count(F.lit(1)).alias("sample_count"), F.avg(value).alias("average_bytes_per_second"), F.max_by(value, order).alias("last_bytes_per_second"))


def add_samples(stats: DataFrame, samples: DataFrame, by: str = "source_id", value: str = "bytes_per_second", order: str = "at") -> DataFrame:
    """Stats brought forward by new samples, without the old ones."""
    s = running_stats(samples, by, value, order)
    s = s.select(by, F.col("sample_count").alias("n"), F.col("average_bytes_per_second").alias("m"), F.col("last_bytes_per_second").alias("l"))
    out = stats.join(s, by, "full")
    old, new = F.coalesce("sample_count", F.lit(0)), F.coalesce("n", F.lit(0))
    mean = (F.coalesce("average_bytes_per_second", F.lit(0.0)) * old + F.coalesce("m", F.lit(0.0)) * new) / (old + new)
    return out.select(by, (old + new).alias("sample_count"), mean.alias("average_bytes_per_second"), F.coalesce("l", "last_bytes_per_second").alias("last_bytes_per_second"))


def fold_ordered(rows: DataFrame, by: str, order: list[str], value: str, start: Callable[[], object], step: Callable[[object, object], object], out: str, show: Callable[[object], tuple]) -> DataFrame:
    """A fold of each key's values in order, without holding them: rows are sorted inside partitions and streamed through,
    and a key's state is carried from batch to batch. A key's rows pass one task, as each step needs the one before."""

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in out.split(", ")]
        key, state, open_ = None, None, False
        for b in batches:
            done = []
            for k, v in zip(b["k"].to_pylist(), b["v"].to_pylist(), strict=True):
                if not open_ or k != key:
                    if open_:
                        done.append((key, *show(state)))
                    key, state, open_ = k, start(), True
                state = step(state, v)
            yield batch_of(pa, done, names)
        yield batch_of(pa, [(key, *show(state))] if open_ else [], names)

    def batch_of(pa, done, names):
        cols = list(zip(*done, strict=True)) if done else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    import pyarrow as pa

    types = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in out.split(", ")]
    ordered = rows.select(F.col(by).alias("k"), F.col(value).alias("v"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    ordered = ordered.repartition("k").sortWithinPartitions("k", *[f"o{i}" for i in range(len(order))], "v")
    return ordered.select("k", "v").mapInArrow(run, out)


def replay_mean(samples: DataFrame, by: str = "source_id", value: str = "bytes_per_second", order: str = "at") -> DataFrame:
    """The running mean in exactly the order of the samples, for a bit-for-bit replay."""
    rows = samples.select(F.col(by).cast("string").alias(by), F.col(value).cast("double").alias(value), order)

    def step(state, v):
        n, m = state
        if v is None:  # no sample
            return state
        return n + 1, m + (v - m) / (n + 1)

    out = fold_ordered(rows, by, [order], value, lambda: (0, 0.0), step, f"{by} string, sample_count long, average_bytes_per_second double", lambda s: s)
    return out.withColumn(by, F.col(by).cast(samples.schema[by].dataType))


def may_adopt(sessions: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions that may take over a source: still discovering, the source exists, and no file of theirs was recorded."""
    s = sessions.filter("status = 'discovering'").join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return s.join(files.select(F.col("ingest_session_id").alias("id")), "id", "left_anti")
