"""Reads of the catalog: summaries, pages, rollups, snapshots, manifests.

Inputs are DataFrames with the columns of lumenloft.schemas; operators read only the columns that they name, so pruning
reaches the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloft import schemas
from lumenloft.functions import dates, hashing, media
from lumenloft.operators.core import all_of, top1

PAGE, MOST_PAGE = 60, 200


def summary_filter(source_id=None, session_id=None, media_type=None) -> Column:
    """Verified copies, narrowed by what is given."""
    wanted = [F.col("copy.status") == "verified"]
    if source_id is not None:
        wanted.append(F.col("copy.source_id") == source_id)
    if session_id is not None:
        wanted.append(F.col("copy.ingest_session_id") == session_id)
    if media_type is not None:
        wanted.append(F.coalesce("file.media_type", F.lit("unknown")) == media_type)
    return all_of(wanted)


def copies_with_files(copies: DataFrame, files: DataFrame) -> DataFrame:
    return copies.alias("copy").join(files.alias("file"), F.col("copy.source_file_id") == F.col("file.id"))


def day_of() -> Column:
    return dates.derived_day("file.capture_day", "file.capture_at", "file.modified_at", "copy.verified_at")


def day_summary(copies: DataFrame, files: DataFrame, **filters) -> DataFrame:
    """Photos, videos, others and bytes of each day, latest first."""
    kind = F.coalesce("file.media_type", F.lit("unknown"))
    rows = copies_with_files(copies, files).filter(summary_filter(**filters)).select(day_of().alias("capture_day"), kind.alias("kind"), F.col("file.size_bytes").alias("size"))
    out = rows.groupBy("capture_day").agg(
        F.count(F.lit(1)).alias("item_count"), F.count_if(F.col("kind") == "photo").alias("photo_count"), F.count_if(F.col("kind") == "video").alias("video_count"), F.count_if(~F.col("kind").isin("photo", "video")).alias("unknown_count"), F.sum("size").alias("total_bytes")
    )
    return out.orderBy(F.desc("capture_day"))


def latest_thumbnails(thumbnails: DataFrame, variant: str = "grid") -> DataFrame:
    return top1(thumbnails.filter(F.col("variant") == variant), ["copied_file_id"], [F.desc("updated_at"), F.desc("id")])


def media_page(copies: DataFrame, files: DataFrame, thumbnails: DataFrame, artifacts: DataFrame, day: str, limit: int = PAGE, cursor: str | None = None, **filters) -> DataFrame:
    """A page of one day's media in order of path and id: limit + 1 rows, the last of which only tells that there's more.

    The day, filters and keyset reach the scan side; the order ends in a top-k, not in a full sort."""
    if not 1 <= limit <= MOST_PAGE:
        raise ValueError(f"a page has 1 to {MOST_PAGE} rows")
    rows = copies_with_files(copies, files).filter(summary_filter(**filters) & (day_of() == day))
    if cursor is not None:
        path, id = hashing.decode_cursor(cursor)
        rows = rows.filter((F.col("file.relative_path") > path) | ((F.col("file.relative_path") == path) & (F.col("file.id") > id)))
    rows = rows.select(
        F.col("file.id").alias("id"), F.col("copy.id").alias("copy_id"), F.col("copy.checksum").alias("checksum"), day_of().alias("capture_day"), F.col("file.capture_at").alias("captured_at"), F.col("file.name").alias("original_filename"),
        F.coalesce("file.media_type", F.lit("unknown")).alias("media_type"), F.col("file.size_bytes").alias("size_bytes"), F.col("file.camera_make").alias("camera_make"), F.col("file.camera_model").alias("camera_model"), F.col("file.width").alias("width"),
        F.col("file.height").alias("height"), F.col("file.duration_seconds").alias("duration_seconds"), F.col("file.relative_path").alias("relative_path"),
    )
    page = rows.orderBy("relative_path", "id").limit(limit + 1)
    small = artifacts.select(F.col("cache_key").alias("_key"), F.col("mime_type").alias("_mime"), F.col("width").alias("_width"), F.col("height").alias("_height"))
    shown = latest_thumbnails(thumbnails.join(page.select(F.col("copy_id").alias("copied_file_id")), "copied_file_id", "left_semi"))
    shown = shown.join(small, F.col("artifact_cache_key") == F.col("_key"), "left").select(F.col("copied_file_id").alias("copy_id"), media.thumbnail_union("id", "state", "artifact_cache_key", "_mime", "_width", "_height", "error_code", "safe_message", "attempt_count", "next_retry_at", "max_attempts").alias("thumbnail"))
    return page.join(shown, "copy_id", "left").withColumn("thumbnail", F.coalesce("thumbnail", F.struct(F.lit("none").alias("kind"), F.lit(None).cast(shown.schema["thumbnail"].dataType["ready"].dataType).alias("ready"), F.lit(None).cast(shown.schema["thumbnail"].dataType["failed"].dataType).alias("failed")))).orderBy("relative_path", "id")


def thumbnails_wanted(copies: DataFrame, thumbnails: DataFrame, now_ms: int, n: int = 8) -> DataFrame:
    """The first copies whose grid thumbnail is missing or due for another try."""
    t = latest_thumbnails(thumbnails).select("copied_file_id", "state", "attempt_count", "max_attempts", F.unix_millis(F.try_to_timestamp("next_retry_at")).alias("next_ms"))
    rows = copies.filter("status = 'verified'").join(t, copies["id"] == t["copied_file_id"], "left")
    return rows.filter(media.retry_due("state", "attempt_count", "max_attempts", "next_ms", F.lit(now_ms))).select(copies["id"], "state", "attempt_count").orderBy("id").limit(n)


def latest_copies(copies: DataFrame, per_session: bool = False) -> DataFrame:
    """Each file's newest copy, or its newest copy in each session."""
    return top1(copies, ["source_file_id"] + ["ingest_session_id"] * per_session, [F.desc("created_at"), F.desc("id")])


def copy_states(copies: DataFrame) -> DataFrame:
    """Each file's copy status: verified if any copy is, else that of the newest."""
    newest = F.max_by("status", F.struct("created_at", "id"))
    return copies.groupBy("source_file_id").agg(F.when(F.max(F.col("status") == "verified"), "verified").otherwise(newest).alias("copy_status"))


def manifest_rows(files: DataFrame, copies: DataFrame, session_id=None) -> DataFrame:
    """A session's files with the newest copy that the session made of each."""
    f = files if session_id is None else files.filter(F.col("ingest_session_id") == session_id)
    c = latest_copies(copies if session_id is None else copies.filter(F.col("ingest_session_id") == session_id), True)
    c = c.select(F.col("source_file_id").alias("_file"), F.col("ingest_session_id").alias("_session"), "destination_path", F.col("status").alias("copy_status"), "checksum", "verified_at")
    out = f.join(c, (f["id"] == c["_file"]) & (f["ingest_session_id"] == c["_session"]), "left")
    return out.select(f["ingest_session_id"], "id", "relative_path", "size_bytes", "modified_at", F.col("status").alias("file_status"), "destination_path", "copy_status", "checksum", "verified_at").orderBy("relative_path", "id")


def known_sources(sources: DataFrame, sessions: DataFrame, copies: DataFrame, observations: DataFrame, throughput: DataFrame, online_ids: DataFrame | None = None) -> DataFrame:
    """Each source with its sessions, verified media, identity and throughput. Every child table is aggregated once by
    source and joined, in place of a subquery for each figure."""
    newest = F.struct("started_at", "id")
    s = sessions.groupBy("source_id").agg(F.count(F.lit(1)).alias("session_count"), F.max_by("status", newest).alias("last_session_status"))
    c = copies.filter("status = 'verified'").groupBy("source_id").agg(F.count(F.lit(1)).alias("verified_media_count"), F.sum("expected_bytes").alias("verified_bytes"))
    seen = F.struct("observed_at", "id")
    o = observations.groupBy("source_id").agg(
        F.max_by("confidence", seen).alias("identity_confidence"), F.max_by("fingerprint", seen).alias("fingerprint"), F.max_by("algorithm_version", seen).alias("algorithm_version"),
        F.max_by("strong_platform_id", F.when(F.col("strong_platform_id").isNotNull(), seen)).alias("strong_platform_id"),
    )
    t = throughput.select("source_id", "sample_count", "average_bytes_per_second", "last_bytes_per_second", media.evaluate_throughput("last_bytes_per_second", "average_bytes_per_second", "sample_count")["is_slow"].alias("is_slow"))
    out = sources.filter("display_name <> 'Pending source'").withColumnRenamed("id", "source_id")
    for child in (s, c, o, t):
        out = out.join(child, "source_id", "left")
    if online_ids is None:
        out = out.withColumn("online", F.lit(False))
    else:
        on = online_ids.select(F.col(online_ids.columns[0]).alias("strong_platform_id"), F.lit(True).alias("_on")).distinct()
        out = out.join(on, "strong_platform_id", "left").withColumn("online", F.coalesce("_on", F.lit(False))).drop("_on")
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    return out.select(
        F.col("source_id").alias("id"), "display_name", "nickname", "kind", "online", "first_seen_at", "last_seen_at", zero("session_count"), "last_session_status", zero("verified_media_count"), zero("verified_bytes"),
        F.coalesce("identity_confidence", F.lit("none")).alias("identity_confidence"), "fingerprint", "algorithm_version", "strong_platform_id", "sample_count", "average_bytes_per_second", "last_bytes_per_second", "is_slow",
    ).orderBy(F.desc("last_seen_at"), "id")


def sources_without_strong_id(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """Sources that were observed, but never with a strong id."""
    o = observations.select(F.col("source_id").alias("id"), "strong_platform_id")
    return sources.join(o.select("id"), "id", "left_semi").join(o.filter("strong_platform_id is not null").select("id"), "id", "left_anti")


def session_snapshot(sessions: DataFrame, files: DataFrame, copies: DataFrame) -> DataFrame:
    """Counters, bytes and errors (code, message, filename) of each session; the session's own error comes first, then those
    of its files in order of path and id. Errors without a code or message get the usual ones."""
    c = latest_copies(copies, True).select(F.col("source_file_id").alias("file"), F.col("ingest_session_id").alias("session"), "copied_bytes")
    f = files.select(F.col("id").alias("file"), F.col("ingest_session_id").alias("session"), "relative_path", "size_bytes", F.col("status").alias("s"), F.col("error_code").alias("code"), F.col("error_message").alias("message"))
    f = f.join(c, ["file", "session"], "left")
    error = F.when(F.col("s") == "failed", F.struct("relative_path", "file", F.coalesce("code", F.lit("FILE_FAILED")).alias("code"), F.coalesce("message", F.lit("The file could not be copied.")).alias("message")))
    by = f.groupBy("session").agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("s") == "completed").alias("completed_files"), F.count_if(F.col("s") == "skipped").alias("skipped_files"), F.count_if(F.col("s") == "failed").alias("failed_files"),
        F.count_if(F.col("s") != "skipped").alias("new_files"), F.sum("size_bytes").alias("total_bytes"), F.sum(F.coalesce("copied_bytes", F.lit(0))).alias("completed_bytes"), F.array_sort(F.collect_list(error)).alias("errors"),
    )
    out = sessions.join(by, sessions["id"] == by["session"], "left")
    own = F.when(F.col("error_code").isNotNull(), F.array(F.struct(F.col("error_code").alias("code"), F.coalesce("error_message", F.lit(media.OTHER_MESSAGE)).alias("message"), F.lit(None).cast("string").alias("filename")))).otherwise(F.array().cast("array<struct<code:string,message:string,filename:string>>"))
    theirs = F.transform(F.coalesce("errors", F.array().cast(by.schema["errors"].dataType)), lambda e: F.struct(e["code"].alias("code"), e["message"].alias("message"), F.element_at(F.split(e["relative_path"], "/"), -1).alias("filename")))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long")).alias(n)
    return out.select(
        sessions["id"], "status", media.phase_label("status").alias("phase"), *[zero(n) for n in ("total_files", "completed_files", "skipped_files", "failed_files", "new_files", "total_bytes", "completed_bytes")],
        F.lit(0.0).alias("throughput"), F.concat(own, theirs).alias("errors"), F.coalesce("completed_at", "started_at").alias("updated_at"),
    )


def recoverable_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter(~F.col("status").isin(*schemas.TERMINAL)).orderBy(F.desc("started_at"), "id")


def card_media(files: DataFrame) -> DataFrame:
    """Media of a card by modification day and in total (a row with a null day), in one pass. Kinds are those of the
    catalog's media types, so every extension that makes a photo or video there is counted as one."""
    kind = media.media_type("extension")
    rows = files.select(dates.mtime_day("modified_at").alias("day"), kind.alias("kind"), "size_bytes")
    out = rows.rollup("day").agg(F.grouping("day").alias("is_total"), F.count_if(F.col("kind") == "photo").alias("photos"), F.count_if(F.col("kind") == "video").alias("videos"), F.count_if(~F.col("kind").isin("photo", "video")).alias("other"), F.sum("size_bytes").alias("bytes"))
    return out.orderBy("is_total", "day")


def capacity_segments(by_day: DataFrame, capacity: int | None, colours: int = 12) -> DataFrame:
    """Each day's share of a capacity bar in percent, with a colour number. A card has few thousand days at most."""
    from pyspark.sql import Window as W

    used = F.sum("bytes").over(W.partitionBy())
    scale = F.when(F.lit(capacity).cast("long") > used, F.lit(capacity).cast("long")).when(used > 0, used).otherwise(1)
    return by_day.select("day", "bytes", (F.col("bytes") / scale * 100).alias("percent"), F.pmod(F.row_number().over(W.orderBy("day")) - 1, F.lit(colours)).alias("colour"))


def selected_totals(by_day: DataFrame, days: list[str]) -> DataFrame:
    """Totals of chosen days; no choice means all."""
    rows = by_day.filter(F.col("day").isin(days)) if days else by_day
    return rows.agg(F.coalesce(F.sum(F.col("photos") + F.col("videos") + F.col("other")), F.lit(0)).alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def on_days(files: DataFrame, days: list[str]) -> DataFrame:
    """Files of chosen modification days; no choice means all."""
    return files.filter(dates.mtime_day("modified_at").isin(days)) if days else files


def contract_summaries(copies: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Counts and bytes by media kind, status, source and session."""
    rows = copies_with_files(copies, files).select(F.coalesce("file.media_type", F.lit("unknown")).alias("media_type"), F.col("copy.status").alias("status"), F.col("copy.source_id").alias("source_id"), F.col("copy.ingest_session_id").alias("session_id"), F.col("file.size_bytes").alias("size"))
    return {k: rows.groupBy(k).agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("bytes")) for k in ("media_type", "status", "source_id", "session_id")}
