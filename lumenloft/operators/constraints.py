"""The catalog's rules as violation queries: each gives the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloft import schemas
from lumenloft.functions import paths


def lifecycle_ok() -> Column:
    """The four shapes that a copy may have."""
    null = lambda *c: reduce(lambda a, b: a & b, [F.col(x).isNull() for x in c])
    full = lambda *c: reduce(lambda a, b: a & b, [F.coalesce(F.col(x) != "", F.lit(False)) for x in c])
    s = F.col("status")
    planned = (s == "planned") & (F.col("copied_bytes") == 0) & null("checksum", "started_at", "last_progress_at", "failed_at", "recovery_started_at", "verified_at", "error_code", "error_message")
    started = (s == "started") & F.col("started_at").isNotNull() & null("checksum", "failed_at", "verified_at", "error_code", "error_message")
    failed = (s == "failed") & F.col("started_at").isNotNull() & F.col("failed_at").isNotNull() & null("checksum", "verified_at") & full("error_code", "error_message")
    verified = (s == "verified") & F.col("started_at").isNotNull() & (F.col("copied_bytes") == F.col("expected_bytes")) & full("checksum") & F.col("verified_at").isNotNull() & null("failed_at", "error_code", "error_message")
    return F.coalesce(planned | started | failed | verified, F.lit(False))


def lifecycle(copies: DataFrame) -> DataFrame:
    return copies.filter(~lifecycle_ok())


def unsafe_paths(files: DataFrame, column: str = "relative_path") -> DataFrame:
    return files.filter(~F.coalesce(paths.is_safe_relative(column), F.lit(False)))


def not_in(df: DataFrame, column: str, allowed) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Children whose (non-null) key has no parent; composite keys too."""
    p = parent.select(*[F.col(k).alias(c) for k, c in zip(parent_keys, keys, strict=True)])
    return child.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).join(p, keys, "left_anti")


def thumbnails_without_copy(thumbnails: DataFrame, copies: DataFrame) -> DataFrame:
    ok = copies.filter("status = 'verified'").select(F.col("id").alias("copied_file_id"), "source_file_id")
    return thumbnails.join(ok, ["copied_file_id", "source_file_id"], "left_anti")


def bad_moves(events: DataFrame, by: list[str], order: list[str], moves: dict[str, tuple[str, ...]], status: str = "status") -> DataFrame:
    """Steps of a state machine that its table doesn't allow."""
    before = F.lag(status).over(W.partitionBy(*by).orderBy(*order))
    allowed = [F.lit(f"{a}>{b}") for a, bs in moves.items() for b in bs]
    rows = events.withColumn("before", before)
    return rows.filter(F.col("before").isNotNull() & ~F.concat_ws(">", "before", status).isin(*allowed))


def terminal_fields(sessions: DataFrame) -> DataFrame:
    """A session has an end exactly if it is over, and an error exactly if it failed or was cancelled."""
    over = F.col("status").isin(*schemas.TERMINAL)
    wrong = F.col("status").isin("failed", "cancelled")
    has = F.coalesce((F.col("error_code") != "") & (F.col("error_message") != ""), F.lit(False))
    none = F.col("error_code").isNull() & F.col("error_message").isNull()
    return sessions.filter((over != F.col("completed_at").isNotNull()) | (wrong & ~has) | (~wrong & ~none))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """rule, violations."""
    rows = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(k).alias("rule"), "violations") for k, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def migration_history(expected: list[tuple[int, str, str]], applied: list[tuple[int, str, str]]) -> list[str]:
    """Problems of a history of (version, name, checksum): gaps, unknown versions, changed contents. A few rows, on the driver."""
    out, known = [], {v: (n, c) for v, n, c in expected}
    for i, (v, n, c) in enumerate(sorted(applied), 1):
        if v != i:
            out.append(f"version {i} is missing")
            break
        if v not in known:
            out.append(f"version {v} is unknown")
        elif known[v] != (n, c):
            out.append(f"version {v} was changed")
    return out
