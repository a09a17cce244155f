"""What to do with the copies of an interrupted session, from the records and a listing of the disk."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloft.functions import paths
from lumenloft.functions.core import col
from lumenloft.sinks.writers import quarantine


def recovery_actions(copies: DataFrame, disk: DataFrame) -> DataFrame:
    """copies(copy, status, final_path, provisional_path, expected_bytes, expected_checksum, stored_checksum) and
    disk(path, size_bytes, checksum) -> copy, action, quarantine_path, recopy.

    keep, mark-verified, promote, recopy; a file that doesn't match is quarantined before its copy is made anew. Where disk
    has a column `refused`, copies whose path it marks have the action refused and nothing is done to them."""
    d = disk.select("path", F.col("size_bytes").alias("size"), F.col("checksum").alias("sum"), F.col("refused") if "refused" in disk.columns else F.lit(False).alias("refused"))
    f = d.select(F.col("path").alias("final_path"), F.col("size").alias("f_size"), F.col("sum").alias("f_sum"), "refused", F.lit(True).alias("f"))
    p = d.select(F.col("path").alias("provisional_path"), F.col("size").alias("p_size"), F.col("sum").alias("p_sum"), F.lit(True).alias("p"))
    r = copies.join(f, "final_path", "left").join(p, "provisional_path", "left")
    no = F.lit(False)
    verified = col("status") == "verified"
    final, provisional = F.coalesce("f", no), F.coalesce("p", no)
    f_size, f_hash = F.coalesce(col("f_size") == col("expected_bytes"), no), F.coalesce(col("f_sum") == col("expected_checksum"), no)
    stored = F.coalesce(col("stored_checksum") == col("expected_checksum"), no)
    p_good = F.coalesce((col("p_size") == col("expected_bytes")) & (col("p_sum") == col("expected_checksum")), no)
    action = (
        F.when(F.coalesce("refused", no), "refused").when(verified & final & f_size & stored, "keep").when(verified & final & f_size & f_hash, "mark-verified").when(verified & final, "quarantine-final").when(provisional & p_good, "promote").when(provisional, "quarantine-provisional").otherwise("recopy")
    )
    r = r.select("copy", action.alias("action"), "final_path", "provisional_path")
    where = F.when(col("action") == "quarantine-final", col("final_path")).when(col("action") == "quarantine-provisional", col("provisional_path"))
    return r.select("copy", "action", where.alias("quarantine_path"), col("action").isin("quarantine-final", "quarantine-provisional", "recopy").alias("recopy"))


def quarantine_files(actions: DataFrame, root: str, session: str) -> DataFrame:
    """copy, moved_to: files that don't match are moved aside in the tasks. A task that runs again finds the file gone and
    reports nothing moved, which is what a file that vanished gives as well."""

    def run(batches):
        for b in batches:
            moved = []
            for path in b["quarantine_path"].to_pylist():
                try:
                    moved.append(quarantine(root, path, session))
                except FileNotFoundError:
                    moved.append(None)
            yield pa.RecordBatch.from_arrays([b["copy"], pa.array(moved, pa.string())], ["copy", "moved_to"])

    return actions.filter("quarantine_path is not null").select("copy", "quarantine_path").mapInArrow(run, "copy string, moved_to string")


def session_outcome(actions: DataFrame, source_present: bool) -> DataFrame:
    """paused where something must be copied again and the source is absent, else scheduled or clean."""
    n = F.count_if("recopy")
    return actions.agg(n.alias("to_copy"), F.when((n > 0) & ~F.lit(source_present), "paused").when(n > 0, "scheduled").otherwise("clean").alias("outcome"))


def owned_temps(listing: DataFrame, copies: DataFrame) -> DataFrame:
    """Temporary files on disk that belong to a copy of the session, by their exact name."""
    mine = copies.select(paths.temp_path("destination_path", "session", "copy").alias("path"), "copy")
    return listing.join(mine, "path")


def recovery_inputs(copies: DataFrame, files: DataFrame) -> DataFrame:
    """Copies joined with their files: the expected checksum is the copy's, else the file's; a copy that isn't verified is
    looked for at its own destination."""
    f = files.select(F.col("id").alias("source_file_id"), "full_checksum")
    return copies.join(f, "source_file_id").select(
        F.col("id").alias("copy"), "status", F.col("destination_path").alias("final_path"), F.when(F.col("status") != "verified", F.col("destination_path")).alias("provisional_path"), "expected_bytes",
        F.coalesce("checksum", "full_checksum").alias("expected_checksum"), F.col("checksum").alias("stored_checksum"),
    )
