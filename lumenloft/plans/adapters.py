"""Catalog tables as views over generic sales, event and document tables.

One text serves both engines: {orders} becomes a DataFrame in Spark and a table name in the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenloft.plans.scratch import sound_unions

DAY = "replace(cast({0} as string), ' ', 'T') || 'Z'"
_SHIP, _ORDER = DAY.format("l_shipdate"), DAY.format("o_orderdate")

VIEWS = {
    "sources": """SELECT cast(c_custkey as string) AS id, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'BUILDING') THEN 'folder' ELSE 'removable-volume' END AS kind,
        CASE WHEN c_custkey % 97 = 5 THEN 'Pending source' ELSE c_name END AS display_name, CASE WHEN c_custkey % 4 = 0 THEN lower(c_mktsegment) END AS nickname, '2020-01-01T00:00:00Z' AS first_seen_at,
        '2024-01-' || lpad(cast(c_custkey % 28 + 1 as string), 2, '0') || 'T00:00:00Z' AS last_seen_at FROM {customer}""",
    "sessions": f"""SELECT cast(o_orderkey as string) AS id, cast(o_custkey as string) AS source_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'copying' ELSE 'failed' END AS status, {_ORDER} AS started_at,
        CASE WHEN o_orderstatus <> 'O' THEN {_ORDER} END AS completed_at, CASE WHEN o_orderstatus = 'P' THEN 'COPY_FAILED' END AS error_code, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS error_message FROM {{orders}}""",
    "files": """SELECT cast(p_partkey as string) AS id, cast(p_partkey % 150 as string) AS source_id, cast(p_partkey % 500 as string) AS ingest_session_id, p_brand || '/' || replace(p_name, ' ', '_') || '_' || cast(p_partkey as string) AS relative_path,
        p_brand || '/' || replace(p_name, ' ', '_') AS canonical_path_key, replace(p_name, ' ', '_') AS name, CASE p_size % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.mov' WHEN 2 THEN '.nef' WHEN 3 THEN '.txt' WHEN 4 THEN '.webp' ELSE '.insv' END AS extension, cast(floor(p_retailprice) as bigint) AS size_bytes,
        CASE WHEN p_size % 5 > 0 THEN '2021-03-' || lpad(cast(p_size % 28 + 1 as string), 2, '0') || 'T10:00:00.000Z' END AS modified_at, CASE p_size % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'new' END AS status,
        CASE WHEN p_size % 4 = 1 AND p_size % 3 = 0 THEN 'READ_FAILED' END AS error_code, CASE WHEN p_size % 4 = 1 THEN p_type END AS error_message,
        CASE p_size % 4 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' WHEN 2 THEN 'photo' END AS media_type, CASE WHEN p_size % 3 = 0 THEN '2021-02-' || lpad(cast(p_size % 28 + 1 as string), 2, '0') END AS capture_day,
        CASE WHEN p_size % 3 = 1 THEN '2021-01-' || lpad(cast(p_size % 28 + 1 as string), 2, '0') || 'T08:00:00+02:00' END AS capture_at, p_brand AS camera_make, p_type AS camera_model, cast(p_size * 100 as bigint) AS width, cast(p_size * 75 as bigint) AS height,
        CASE WHEN p_size % 4 = 1 THEN p_retailprice END AS duration_seconds FROM {part}""",
    "copies": f"""SELECT cast(l_orderkey as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || cast(l_linenumber as string) AS id, cast(l_partkey as string) AS source_file_id, cast(l_suppkey as string) AS source_id,
        cast(l_orderkey as string) AS ingest_session_id, cast(l_suppkey as string) || '/' || cast(l_partkey as string) || '/' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) AS destination_path,
        CASE WHEN l_linestatus = 'F' THEN 'verified' WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'N' THEN 'planned' ELSE 'started' END AS status, cast(floor(l_extendedprice) as bigint) AS expected_bytes,
        CASE WHEN l_linestatus = 'F' THEN cast(floor(l_extendedprice) as bigint) WHEN l_returnflag = 'N' THEN cast(0 as bigint) ELSE cast(floor(l_quantity) as bigint) END AS copied_bytes, CASE WHEN l_linestatus = 'F' THEN 'sum-' || cast(l_partkey % 50 as string) END AS checksum,
        CASE WHEN l_linestatus = 'F' OR l_returnflag <> 'N' THEN {_SHIP} END AS started_at, cast(null as string) AS last_progress_at, CASE WHEN l_linestatus <> 'F' AND l_returnflag = 'R' THEN {_SHIP} END AS failed_at, cast(null as string) AS recovery_started_at,
        CASE WHEN l_linestatus = 'F' THEN {_SHIP} END AS verified_at, CASE WHEN l_linestatus <> 'F' AND l_returnflag = 'R' THEN 'WRITE_FAILED' END AS error_code, CASE WHEN l_linestatus <> 'F' AND l_returnflag = 'R' AND l_tax > 0 THEN 'disk' END AS error_message,
        {_SHIP} AS created_at FROM {{lineitem}}""",
    "observations": f"""SELECT cast(o_orderkey as string) AS id, cast(o_custkey as string) AS source_id, cast(1 as bigint) AS algorithm_version, o_orderpriority || '-' || cast(o_custkey % 40 as string) AS fingerprint, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'medium' ELSE 'low' END AS confidence,
        CASE WHEN o_custkey % 3 = 0 AND o_orderstatus = 'F' THEN 'vol-' || cast(o_custkey % 200 as string) END AS strong_platform_id, {_ORDER} AS observed_at FROM {{orders}}""",
    "thumbnails": """SELECT cast(l_orderkey as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || cast(l_linenumber as string) || '-t' AS id,
        cast(l_orderkey as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || cast(l_linenumber as string) AS copied_file_id, cast(l_partkey as string) AS source_file_id, 'grid' AS variant, CASE WHEN l_linenumber % 2 = 0 THEN 'ready' ELSE 'failed' END AS state,
        CASE WHEN l_linenumber % 2 = 0 THEN 'art-' || cast(l_partkey % 100 as string) END AS artifact_cache_key, CASE WHEN l_linenumber % 2 = 1 THEN 'DECODE' END AS error_code, CASE WHEN l_linenumber % 2 = 1 THEN 'No preview.' END AS safe_message, cast(l_linenumber as bigint) AS attempt_count,
        cast(5 as bigint) AS max_attempts, CASE WHEN l_linenumber = 3 THEN '2024-01-01T00:00:00Z' WHEN l_linenumber = 1 THEN '2030-01-01T00:00:00Z' END AS next_retry_at, '2023-01-01T00:00:00Z' AS updated_at FROM {lineitem} WHERE l_linenumber < 6""",
    "artifacts": """SELECT 'art-' || cast(p_partkey as string) AS cache_key, 'image/webp' AS mime_type, cast(480 as bigint) AS width, cast(p_size + 100 as bigint) AS height, cast(p_size * 1000 as bigint) AS size_bytes,
        '2023-01-' || lpad(cast(p_size % 28 + 1 as string), 2, '0') AS updated_at FROM {part} WHERE p_partkey < 100""",
    "samples": """SELECT cast(user_id as string) AS session, cast(event_id as bigint) AS seq, cast(floor(value * 1000000) as bigint) AS bps, event_type, value, props FROM {events}""",
    "progress": """SELECT cast(user_id as string) AS session, cast(event_id as bigint) AS seq, cast(user_id as string) || ':' || cast(event_id % 7 as string) AS file, cast(floor(value * 100) as bigint) AS bytes,
        CASE event_id % 5 WHEN 0 THEN 'discovered' WHEN 1 THEN 'progress' WHEN 2 THEN 'completed' WHEN 3 THEN 'status' ELSE 'failed' END AS kind, CASE WHEN event_id % 5 = 3 THEN event_type END AS status FROM {events}""",
    "contents": """SELECT cast(doc_id as string) AS file, source AS source_id, source || CASE WHEN doc_id % 5 = 0 THEN '/cafe\u0301' ELSE '/caf\u00e9' END || cast(doc_id % 31 as string) || '.jpg' AS relative_path, source || '/caf\u00e9' || cast(doc_id % 31 as string) || '.jpg' AS canonical_path_key,
        cast(n_chars % 40 as bigint) AS size_bytes, '2022-01-0' || cast(doc_id % 3 + 1 as string) || 'T00:00:00Z' AS modified_at, lang, text, doc_id FROM {documents}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Views:
    """The catalog's tables over one folder: v.copies, v.table("orders")."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = sound_unions(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Text that names tables in braces."""
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if "{" + t + "}" in text})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)


def oracle(text: str) -> str:
    """Plain SQL with the views that it names in front."""
    used = [v for v in VIEWS if f" {v}" in text or f"({v}" in text]
    with_ = ", ".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in used)
    return (f"WITH {with_}{', ' + text.strip()[5:] if text.strip().upper().startswith('WITH ') else ' ' + text}") if used else text
