"""The catalog's tables as Spark schemas, its enumerations and transition tables."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "map<string;string>": T.MapType(T.StringType(), T.StringType())}


def _parse(text: str) -> T.StructType:
    """'name kind, name kind': plain columns, without a session (Spark's own DDL parser needs one)."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in text.split(", "))])


#: Enumerations and state machines of the catalog.
SOURCE_KINDS = ("removable-volume", "folder")
SESSION_STATUSES = ("discovering", "analyzing", "ready", "copying", "verifying", "completed", "cancelled", "failed")
TERMINAL = ("completed", "cancelled", "failed")
COPY_STATUSES = ("planned", "started", "failed", "verified")
FILE_STATUSES = ("discovered", "analyzing", "new", "known", "ambiguous", "recoverable", "copying", "verifying", "completed", "skipped", "failed")
CONFIDENCES = ("exact", "medium", "low", "none")
SESSION_MOVES = {"discovering": ("analyzing", "cancelled", "failed"), "analyzing": ("ready", "cancelled", "failed"), "ready": ("copying", "cancelled", "failed"), "copying": ("verifying", "cancelled", "failed"), "verifying": ("completed", "cancelled", "failed")}
COPY_MOVES = {"planned": ("started",), "started": ("verified", "failed"), "failed": ("started",)}

SOURCES = _parse("id string, kind string, display_name string, nickname string, first_seen_at string, last_seen_at string, created_at string, updated_at string")
OBSERVATIONS = _parse("id string, source_id string, algorithm_version long, fingerprint string, raw_facts_json string, confidence string, strong_platform_id string, observed_at string")
SESSIONS = _parse("id string, source_id string, status string, started_at string, completed_at string, error_code string, error_message string, created_at string, updated_at string")
FILES = _parse(
    "id string, source_id string, ingest_session_id string, relative_path string, canonical_path_key string, version_key string, name string, extension string, size_bytes long, modified_at string, media_kind string, status string, "
    "quick_fingerprint string, full_checksum string, error_code string, error_message string, media_type string, mime_type string, capture_at string, capture_at_source string, capture_at_raw string, capture_timezone_kind string, "
    "capture_offset_minutes long, capture_offset_source string, capture_offset_raw string, capture_day string, camera_make string, camera_model string, lens_model string, width long, height long, duration_seconds double, gps_present boolean, created_at string, updated_at string"
)
COPIES = _parse(
    "id string, source_file_id string, source_id string, ingest_session_id string, destination_path string, status string, expected_bytes long, copied_bytes long, checksum string, started_at string, last_progress_at string, failed_at string, "
    "recovery_started_at string, verified_at string, error_code string, error_message string, created_at string, updated_at string"
)
ARTIFACTS = _parse("cache_key string, relative_path string, mime_type string, width long, height long, size_bytes long, created_at string, updated_at string")
THUMBNAILS = _parse("id string, copied_file_id string, source_file_id string, variant string, state string, artifact_cache_key string, error_code string, safe_message string, attempt_count long, max_attempts long, next_retry_at string, created_at string, updated_at string")
ALIASES = _parse("source_id string, algorithm_version long, fingerprint string, first_observed_at string, last_observed_at string")
AUDIT = _parse("id string, source_id string, ingest_session_id string, identity_key string, decision_kind string, reasons_json string, decided_at string")
RECOVERY = _parse("session_id string, destination_root string, strong_id string, fingerprint string, algorithm_version string, updated_at string")
THROUGHPUT = _parse("source_id string, sample_count long, average_bytes_per_second double, last_bytes_per_second double, updated_at string")
SETTINGS = _parse("key string, value_json string, updated_at string")
MIGRATIONS = _parse("version long, name string, checksum string, applied_at string")
TABLES = {
    "sources": SOURCES, "source_identity_observations": OBSERVATIONS, "ingest_sessions": SESSIONS, "source_files": FILES, "copied_files": COPIES, "thumbnail_artifacts": ARTIFACTS, "thumbnails": THUMBNAILS,
    "source_identity_aliases": ALIASES, "source_reconciliation_audit": AUDIT, "session_recovery_context": RECOVERY, "source_throughput_stats": THROUGHPUT, "settings": SETTINGS, "schema_migrations": MIGRATIONS,
}
#: What tells a table's rows apart.
KEYS = {t: ["id"] for t in TABLES} | {
    "thumbnail_artifacts": ["cache_key"], "source_identity_aliases": ["source_id", "algorithm_version", "fingerprint"], "session_recovery_context": ["session_id"], "source_throughput_stats": ["source_id"], "settings": ["key"], "schema_migrations": ["version"],
}

SCAN_FILE = _parse("relative_path string, canonical_path_key string, name string, extension string, size_bytes long, modified_at string, file_id string")
SCAN_ERROR = _parse("code string, relative_path string, message string")
SCAN = T.StructType([T.StructField("type", T.StringType()), T.StructField("file", SCAN_FILE), T.StructField("error", SCAN_ERROR)])
VOLUME = _parse("source_type string, mount_path string, display_name string, volume_label string, platform_volume_id string, fs_type string, capacity_bytes long, device_vendor string, device_model string, removable boolean, raw_facts map<string;string>")
