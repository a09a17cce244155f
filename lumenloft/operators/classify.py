"""New, known, ambiguous or recoverable: files of a card against everything seen before.

The three lookups (path, size, checksum) are joins to candidates that are already reduced to their best row by a fixed
rank, so no file sees a list and nothing runs row by row. Two compat modes: `documented` uses full checksums where given;
`composed-app` ignores them, as the shipped wiring does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloft.operators import catalog
from lumenloft.operators.core import locale_order


def prior_files(files: DataFrame, states: DataFrame) -> DataFrame:
    """Prior versions with their copy status and rank: verified, then any other copy, then none; then id in locale order."""
    p = files.join(states.withColumnRenamed("source_file_id", "_file"), files["id"] == F.col("_file"), "left").drop("_file")
    p = p.withColumn("copy_status", F.coalesce("copy_status", F.lit("none")))
    return p.withColumn("rank", F.when(F.col("copy_status") == "verified", 0).when(F.col("copy_status") != "none", 1).otherwise(2))


def _best(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    pick = F.min(F.struct(F.col("rank"), locale_order("id").alias("o"), F.col("id"), F.col("copy_status"), F.col("source_id")))
    return rows.groupBy(*keys).agg(pick.alias(name))


def classify(current: DataFrame, prior: DataFrame, compat: str = "documented") -> DataFrame:
    """current(file, source_id, relative_path, canonical_path_key, size_bytes, modified_at, quick_fingerprint, full_checksum)
    -> file, decision, reason, needs_full_checksum, matched_file_id, cross_source_duplicate."""
    if compat not in ("documented", "composed-app"):
        raise ValueError("compat is documented or composed-app")
    c = current if compat == "documented" else current.withColumn("full_checksum", F.lit(None).cast("string"))
    p = prior.select("id", "source_id", "relative_path", "canonical_path_key", "size_bytes", "modified_at", "quick_fingerprint", "full_checksum", "copy_status", "rank")
    path = _best(p, ["source_id", "relative_path"], "by_path")
    exact = _best(p, ["source_id", "canonical_path_key", "relative_path", "size_bytes", "modified_at", "quick_fingerprint"], "by_exact")
    # same size under another path: the best of all paths, and the best of the paths other than that one's. Paths are
    # compared as they are written: two spellings of one canonical key are two paths.
    size = p.groupBy("source_id", "size_bytes").agg(F.min(F.struct("rank", locale_order("id").alias("o"), "id", "relative_path")).alias("first"))
    other = p.join(size.select("source_id", "size_bytes", F.col("first.relative_path").alias("fp")), ["source_id", "size_bytes"]).filter("relative_path <> fp")
    other = _best(other, ["source_id", "size_bytes"], "next")
    sums = p.filter("full_checksum is not null")
    own = _best(sums, ["source_id", "full_checksum"], "by_sum")
    # another source with the checksum: the best row overall, or the best of the sources other than that one's
    every = sums.groupBy("full_checksum").agg(F.min(F.struct("rank", locale_order("id").alias("o"), "id", "source_id")).alias("top"))
    rest = sums.join(every.select("full_checksum", F.col("top.source_id").alias("ts")), "full_checksum").filter("source_id <> ts")
    rest = _best(rest, ["full_checksum"], "second")
    # only files with a checksum take part in its joins: the others, most of a real batch, would all have the null key
    summed = c.filter("full_checksum is not null").select("file", "source_id", "full_checksum")
    summed = summed.join(own, ["source_id", "full_checksum"], "left").join(every, "full_checksum", "left").join(rest, "full_checksum", "left").select("file", "by_sum", "top", "second")
    r = c.join(path, ["source_id", "relative_path"], "left").join(exact, ["source_id", "canonical_path_key", "relative_path", "size_bytes", "modified_at", "quick_fingerprint"], "left")
    r = r.join(size.select("source_id", "size_bytes", "first"), ["source_id", "size_bytes"], "left").join(other, ["source_id", "size_bytes"], "left")
    r = r.join(summed, "file", "left")
    same_size = F.when(F.col("first.relative_path") != F.col("relative_path"), F.col("first.id")).otherwise(F.col("next.id"))
    cross = F.when(F.col("top.source_id") != F.col("source_id"), F.col("top.id")).otherwise(F.col("second.id"))
    known_sum = F.col("full_checksum").isNotNull()

    def row(decision, reason, full, match, duplicate=None):
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), F.lit(full).alias("needs_full_checksum"), (match if match is not None else F.lit(None)).cast("string").alias("matched_file_id"), (duplicate if duplicate is not None else F.lit(None)).cast("string").alias("cross_source_duplicate"))

    def by_status(when, name, hit, reason):
        status = F.col(f"{name}.copy_status")
        return (
            when.when(hit & (status == "verified"), row("known", reason, False, F.col(f"{name}.id"))).when(hit & (status == "none"), row("new", "unverified-prior-record", False, F.col(f"{name}.id"))).when(hit, row("recoverable", "incomplete-prior-copy", False, F.col(f"{name}.id")))
        )

    verdict = by_status(F, "by_sum", known_sum & F.col("by_sum").isNotNull(), "verified-full-checksum-match")
    verdict = verdict.when(known_sum & (F.col("by_path").isNotNull() | same_size.isNotNull()), row("new", "checksum-disproved-candidates", False, None, cross))
    verdict = verdict.when(known_sum & cross.isNotNull(), row("new", "no-same-source-match", False, None, cross)).when(known_sum, row("new", "no-prior-match", False, None))
    verdict = by_status(verdict, "by_exact", F.col("by_exact").isNotNull(), "verified-exact-match")
    verdict = verdict.when(F.col("by_path").isNotNull(), row("ambiguous", "same-path-changed-facts", True, F.col("by_path.id"))).when(same_size.isNotNull(), row("ambiguous", "same-size-different-path", True, same_size)).otherwise(row("new", "no-prior-match", False, None))
    return r.select("file", verdict.alias("v")).select("file", "v.*")


def review(classified: DataFrame, files: DataFrame, scan_errors: DataFrame) -> DataFrame:
    """One row of counts by decision. Recoverable includes the scan's errors; the estimate leaves out known files only."""
    rows = classified.join(files.select("file", "size_bytes"), "file")
    n = lambda d: F.count_if(F.col("decision") == d)
    counts = rows.agg(F.count(F.lit(1)).alias("total"), n("new").alias("new"), n("known").alias("known"), n("ambiguous").alias("ambiguous"), n("recoverable").alias("r"), F.coalesce(F.sum(F.when(F.col("decision") != "known", F.col("size_bytes"))), F.lit(0)).cast("long").alias("estimated_bytes"))
    errors = scan_errors.agg(F.count(F.lit(1)).alias("e"))
    return counts.select("total", "new", "known", "ambiguous", (F.col("r") + errors.scalar()).alias("recoverable"), "estimated_bytes")


def review_days(files: DataFrame) -> DataFrame:
    """Photos, videos, other files and bytes of what was scanned, by day of modification and in order of it."""
    return catalog.card_media(files).filter("is_total = 0").select("day", "photos", "videos", "other", "bytes")


def run_counters(outcomes: DataFrame) -> DataFrame:
    """Completed, failed, skipped and collided files of a run; a collision counts as failed too."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return outcomes.agg(n("completed").alias("completed"), n("failed", "collision").alias("failed"), n("skipped").alias("skipped"), n("collision").alias("collisions"))
