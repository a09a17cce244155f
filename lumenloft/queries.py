"""The queries over the driver's tables, each with the SQL that checks it (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloft import schemas
from lumenloft.functions import core, dates, hashing, media, paths
from lumenloft.operators import catalog, classify, constraints, identity, maintenance, plan, recover
from lumenloft.operators.core import any_of, by_key, last_n, range_of, same
from lumenloft.plans.adapters import Views, oracle
from lumenloft.plans.scratch import new_folder
from lumenloft.sinks import writers
from lumenloft.sources import listing, records, volumes
from lumenloft.store import Store
from lumenloft.streaming import feeds, registry

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.rstrip("_")
        _QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _SQL[name] = oracle(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# summaries

DAY_SQL = "coalesce(f.capture_day, substr(f.capture_at, 1, 10), substr(f.modified_at, 1, 10), substr(c.verified_at, 1, 10))"
SUMMARY_SQL = f"""SELECT {DAY_SQL} AS capture_day, count(*) AS item_count, count(*) FILTER (WHERE f.media_type = 'photo') AS photo_count, count(*) FILTER (WHERE f.media_type = 'video') AS video_count,
    count(*) FILTER (WHERE coalesce(f.media_type, 'unknown') NOT IN ('photo', 'video')) AS unknown_count, cast(sum(f.size_bytes) AS bigint) AS total_bytes FROM copies c JOIN files f ON c.source_file_id = f.id WHERE c.status = 'verified' %s GROUP BY 1"""


@query(SUMMARY_SQL % "")
def day_summary(v):
    return catalog.day_summary(v.copies, v.files)


@query(SUMMARY_SQL % "AND c.source_id = '7' AND coalesce(f.media_type, 'unknown') = 'photo'")
def day_summary_filtered(v):
    return catalog.day_summary(v.copies, v.files, source_id="7", media_type="photo")


@query(SUMMARY_SQL % "AND c.ingest_session_id = '17'")
def day_summary_session(v):
    return catalog.day_summary(v.copies, v.files, session_id="17")


PAGE_SQL = f"""SELECT f.id, c.id AS copy_id, c.checksum, {DAY_SQL} AS capture_day, coalesce(f.media_type, 'unknown') AS media_type, f.size_bytes, f.relative_path,
    CASE WHEN t.id IS NULL THEN 'none' WHEN t.state = 'ready' AND a.mime_type IS NOT NULL THEN 'ready' ELSE 'failed' END AS thumbnail_kind, CASE WHEN t.state = 'ready' THEN a.height END AS thumbnail_height
    FROM copies c JOIN files f ON c.source_file_id = f.id LEFT JOIN thumbnails t ON t.copied_file_id = c.id LEFT JOIN artifacts a ON a.cache_key = t.artifact_cache_key
    WHERE c.status = 'verified' AND c.source_id = '7' AND {DAY_SQL} = '2021-02-04' %s ORDER BY f.relative_path, f.id LIMIT 21"""


def _page(v, **more):
    # a page's rows of one file and path would tie, so the source's copies are reduced to the newest of each file first
    copies = catalog.latest_copies(v.copies.filter("status = 'verified' and source_id = '7'"))
    p = catalog.media_page(copies, v.files, v.thumbnails, v.artifacts, "2021-02-04", 20, source_id="7", **more)
    return p.select("id", "copy_id", "checksum", "capture_day", "media_type", "size_bytes", "relative_path", F.col("thumbnail.kind").alias("thumbnail_kind"), F.col("thumbnail.ready.height").alias("thumbnail_height"))


NEWEST_SQL = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY created_at DESC, id DESC) AS r FROM copies WHERE status = 'verified' AND source_id = '7') WHERE r = 1)"


@query(f"WITH {NEWEST_SQL} " + (PAGE_SQL % "").replace("FROM copies c", "FROM newest c"))
def media_page_first(v):
    return _page(v)


@query(f"WITH {NEWEST_SQL} " + (PAGE_SQL % "AND (f.relative_path > 'Brand#15' OR (f.relative_path = 'Brand#15' AND f.id > '3'))").replace("FROM copies c", "FROM newest c"))
def media_page_next(v):
    return _page(v, cursor=hashing.encode_cursor("Brand#15", "3"))


@query("SELECT id, source_file_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY created_at DESC, id DESC) AS r FROM copies) WHERE r = 1")
def latest_copy_per_file(v):
    return catalog.latest_copies(v.copies).select("id", "source_file_id", "status")


@query("SELECT source_file_id, CASE WHEN max(CASE WHEN status = 'verified' THEN 1 ELSE 0 END) = 1 THEN 'verified' ELSE max_by(status, created_at || '|' || id) END AS copy_status FROM copies GROUP BY 1")
def copy_status_per_file(v):
    return catalog.copy_states(v.copies)


MANIFEST_SQL = """SELECT f.ingest_session_id, f.id, f.relative_path, f.size_bytes, f.modified_at, f.status AS file_status, c.destination_path, c.status AS copy_status, c.checksum, c.verified_at FROM files f
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY source_file_id, ingest_session_id ORDER BY created_at DESC, id DESC) AS r FROM copies) c ON c.source_file_id = f.id AND c.ingest_session_id = f.ingest_session_id AND c.r = 1"""


@query(MANIFEST_SQL)
def manifest(v):
    return catalog.manifest_rows(v.files, v.copies)


@query("SELECT f.ingest_session_id AS session, count(*) AS n FROM files f GROUP BY 1")
def manifest_documents(v):
    doc = writers.manifest_json(catalog.manifest_rows(v.files, v.copies))
    return doc.select("session", F.get_json_object("manifest", "$.fileCount").cast("long").alias("n"))


KNOWN_SQL = """WITH s AS (SELECT source_id, count(*) AS n, max_by(status, started_at || '|' || id) AS st FROM sessions GROUP BY 1), c AS (SELECT source_id, count(*) AS n, cast(sum(expected_bytes) AS bigint) AS b FROM copies WHERE status = 'verified' GROUP BY 1),
    o AS (SELECT source_id, max_by(confidence, observed_at || '|' || id) AS conf, max_by(fingerprint, observed_at || '|' || id) AS fp, max_by(strong_platform_id, observed_at || '|' || id) FILTER (WHERE strong_platform_id IS NOT NULL) AS strong FROM observations GROUP BY 1),
    t AS (SELECT session AS source_id, count(*) AS n, cast(sum(bps) AS bigint) AS total, max_by(bps, seq) AS last FROM samples GROUP BY 1)
    SELECT x.id, x.display_name, x.nickname, x.kind, coalesce(x.id IN ('1', '3', '9') AND false, false) OR coalesce(o.strong IN ('vol-0', 'vol-3', 'vol-9'), false) AS online, coalesce(s.n, 0) AS session_count, s.st AS last_session_status, coalesce(c.n, 0) AS verified_media_count, coalesce(c.b, 0) AS verified_bytes,
    coalesce(o.conf, 'none') AS identity_confidence, o.fp AS fingerprint, o.strong AS strong_platform_id, t.n AS sample_count, t.last AS last_bps, CASE WHEN t.n >= 3 THEN t.last * t.n * 2 < t.total ELSE t.last < 5000000 END AS is_slow
    FROM sources x LEFT JOIN s ON s.source_id = x.id LEFT JOIN c ON c.source_id = x.id LEFT JOIN o ON o.source_id = x.id LEFT JOIN t ON t.source_id = x.id WHERE x.display_name <> 'Pending source'"""


def _stats(v):
    return maintenance.running_stats(v.samples.withColumnRenamed("session", "source_id"), "source_id", "bps", "seq")


@query(KNOWN_SQL)
def known_sources(v):
    online = v.spark.createDataFrame([("vol-0",), ("vol-3",), ("vol-9",)], "id string")
    out = catalog.known_sources(v.sources, v.sessions, v.copies, v.observations, _stats(v), online)
    return out.select("id", "display_name", "nickname", "kind", "online", "session_count", "last_session_status", "verified_media_count", "verified_bytes", "identity_confidence", "fingerprint", "strong_platform_id", "sample_count", F.col("last_bytes_per_second").alias("last_bps"), "is_slow")


@query("SELECT id, display_name FROM sources s WHERE EXISTS (SELECT 1 FROM observations o WHERE o.source_id = s.id) AND NOT EXISTS (SELECT 1 FROM observations o WHERE o.source_id = s.id AND o.strong_platform_id IS NOT NULL)")
def sources_without_strong_id(v):
    return catalog.sources_without_strong_id(v.sources, v.observations).select("id", "display_name")


SNAPSHOT_SQL = """WITH lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id, ingest_session_id ORDER BY created_at DESC, id DESC) AS r FROM copies) WHERE r = 1),
    ff AS (SELECT f.ingest_session_id AS session, count(*) AS total_files, count(*) FILTER (WHERE f.status = 'completed') AS completed_files, count(*) FILTER (WHERE f.status = 'skipped') AS skipped_files, count(*) FILTER (WHERE f.status = 'failed') AS failed_files,
    count(*) FILTER (WHERE f.status <> 'skipped') AS new_files, cast(sum(f.size_bytes) AS bigint) AS total_bytes, cast(sum(coalesce(lc.copied_bytes, 0)) AS bigint) AS completed_bytes,
    string_agg(coalesce(f.error_code, 'FILE_FAILED') || ':' || coalesce(f.error_message, 'The file could not be copied.') || ':' || regexp_extract(f.relative_path, '[^/]*$'), ',' ORDER BY f.relative_path, f.id) FILTER (WHERE f.status = 'failed') AS codes FROM files f LEFT JOIN lc ON lc.source_file_id = f.id AND lc.ingest_session_id = f.ingest_session_id GROUP BY 1)
    SELECT s.id, s.status, upper(substr(s.status, 1, 1)) || substr(s.status, 2) AS phase, coalesce(total_files, 0) AS total_files, coalesce(completed_files, 0) AS completed_files, coalesce(skipped_files, 0) AS skipped_files, coalesce(failed_files, 0) AS failed_files, coalesce(new_files, 0) AS new_files,
    coalesce(total_bytes, 0) AS total_bytes, coalesce(completed_bytes, 0) AS completed_bytes, concat_ws(',', s.error_code || ':' || coalesce(s.error_message, 'The ingest could not be completed.') || ':', ff.codes) AS error_codes, coalesce(s.completed_at, s.started_at) AS updated_at FROM sessions s LEFT JOIN ff ON ff.session = s.id"""


@query(SNAPSHOT_SQL)
def session_snapshot(v):
    out = catalog.session_snapshot(v.sessions, v.files, v.copies)
    return out.withColumn("error_codes", F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["code"], e["message"], F.coalesce(e["filename"], F.lit("")))), ",")).drop("errors", "throughput")


@query("SELECT id, status, started_at FROM sessions WHERE status NOT IN ('completed', 'cancelled', 'failed')")
def recoverable_sessions(v):
    return catalog.recoverable_sessions(v.sessions).select("id", "status", "started_at")


CARD_SQL = """SELECT {day} AS day, {total} AS is_total, count(*) FILTER (WHERE extension IN ('.jpg', '.nef', '.webp')) AS photos, count(*) FILTER (WHERE extension IN ('.mov', '.insv')) AS videos, count(*) FILTER (WHERE extension = '.txt') AS other, cast(sum(size_bytes) AS bigint) AS bytes FROM files"""


@query(CARD_SQL.format(day="substr(modified_at, 1, 10)", total="0") + " GROUP BY 1 UNION ALL " + CARD_SQL.format(day="null", total="1"))
def card_media_by_day(v):
    return catalog.card_media(v.files).withColumn("is_total", F.col("is_total").cast("int"))


@query("WITH d AS (SELECT substr(modified_at, 1, 10) AS day, cast(sum(size_bytes) AS bigint) AS bytes FROM files WHERE modified_at IS NOT NULL GROUP BY 1) SELECT day, bytes, floor(bytes * 10000 / 100000000) AS share, cast((row_number() OVER (ORDER BY day) - 1) % 12 AS int) AS colour FROM d".replace("floor(bytes * 10000 / 100000000)", "cast(floor(bytes / 100000000.0 * 100 * 1000) AS bigint)"))
def capacity_segments(v):
    by_day = catalog.card_media(v.files).filter("is_total = 0 and day is not null")
    out = catalog.capacity_segments(by_day, 100_000_000)
    return out.select("day", "bytes", F.floor(F.col("bytes") / 100000000.0 * 100 * 1000).cast("long").alias("share"), F.col("colour").cast("int").alias("colour"))


@query("SELECT count(*) AS items, cast(sum(size_bytes) AS bigint) AS bytes FROM files WHERE substr(modified_at, 1, 10) IN ('2021-03-02', '2021-03-03')")
def selected_days(v):
    out = catalog.selected_totals(catalog.card_media(v.files).filter("is_total = 0"), ["2021-03-02", "2021-03-03"])
    return out.select(F.col("items").cast("long").alias("items"), F.col("bytes").cast("long").alias("bytes"))


@query("SELECT id FROM files WHERE substr(modified_at, 1, 10) IN ('2021-03-02', '2021-03-05')")
def day_allowlist(v):
    return catalog.on_days(v.files, ["2021-03-02", "2021-03-05"]).select("id")


@query("SELECT 'media_type' AS what, coalesce(f.media_type, 'unknown') AS value, count(*) AS items, cast(sum(f.size_bytes) AS bigint) AS bytes FROM copies c JOIN files f ON c.source_file_id = f.id GROUP BY 2 UNION ALL SELECT 'status', c.status, count(*), cast(sum(f.size_bytes) AS bigint) FROM copies c JOIN files f ON c.source_file_id = f.id GROUP BY 2")
def contract_summaries(v):
    out = catalog.contract_summaries(v.copies, v.files)
    return out["media_type"].select(F.lit("media_type").alias("what"), F.col("media_type").alias("value"), "items", "bytes").unionByName(out["status"].select(F.lit("status").alias("what"), F.col("status").alias("value"), "items", "bytes"))


@query("""SELECT c.id, t.state, t.attempt_count FROM copies c LEFT JOIN thumbnails t ON t.copied_file_id = c.id WHERE c.status = 'verified'
    AND (t.id IS NULL OR (t.state = 'failed' AND t.attempt_count < t.max_attempts AND coalesce(t.next_retry_at, '') <= '2025-01-01T00:00:00Z')) ORDER BY c.id LIMIT 8""")
def thumbnails_wanted(v):
    return catalog.thumbnails_wanted(v.copies, v.thumbnails, 1735689600000)


# identity


@query("SELECT DISTINCT s.id FROM sources s JOIN observations o ON o.source_id = s.id WHERE o.strong_platform_id = 'vol-3' OR (o.fingerprint = '1-URGENT-7' AND o.algorithm_version = 1)")
def identity_candidates(v):
    return identity.identity_candidates(v.sources, v.observations, "vol-3", "1-URGENT-7", 1).select("id")


@query("SELECT source_id, algorithm_version, fingerprint, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at FROM observations GROUP BY 1, 2, 3")
def identity_aliases(v):
    return identity.aliases(v.observations)


FACTS_SQL = "facts AS (SELECT source_id, max_by(fingerprint, observed_at || '|' || id) AS fp, max_by(strong_platform_id, observed_at || '|' || id) FILTER (WHERE strong_platform_id IS NOT NULL) AS strong FROM observations GROUP BY 1)"


@query(f"WITH {FACTS_SQL} SELECT f.source_id, f.fp AS fingerprint, f.strong AS strong_id, a.n AS alias_count FROM facts f JOIN (SELECT source_id, count(DISTINCT fingerprint) AS n FROM observations GROUP BY 1) a USING (source_id)")
def candidate_facts(v):
    out = identity.candidate_facts(v.observations, identity.aliases(v.observations))
    return out.select("source_id", "fingerprint", "strong_id", F.size("aliases").cast("long").alias("alias_count"))


CARDS_SQL = "d AS (SELECT cast(s_suppkey AS string) AS card, CASE WHEN s_suppkey % 2 = 0 THEN 'vol-' || cast(s_suppkey AS string) END AS strong, '2-HIGH-' || cast(s_suppkey AS string) AS fp FROM supplier)"
MATCH_SQL = f"""WITH {CARDS_SQL}, {FACTS_SQL}, st AS (SELECT d.card, f.source_id, true AS strong FROM d JOIN facts f ON f.strong = d.strong), wk AS (SELECT DISTINCT d.card, o.source_id, false AS strong FROM d JOIN observations o ON o.fingerprint = d.fp),
    b AS (SELECT *, bool_or(strong) OVER (PARTITION BY card) AS any_strong FROM (SELECT * FROM st UNION ALL SELECT * FROM wk)), k AS (SELECT *, count(*) OVER (PARTITION BY card) AS n FROM b WHERE strong = any_strong)"""


def _matches(v):
    cards = v.sql("SELECT cast(s_suppkey AS string) AS card, CASE WHEN s_suppkey % 2 = 0 THEN 'vol-' || cast(s_suppkey AS string) END AS strong_id, '2-HIGH-' || cast(s_suppkey AS string) AS fingerprint FROM {supplier}")
    return cards, identity.identify(cards, identity.candidate_facts(v.observations, identity.aliases(v.observations)))


@query(MATCH_SQL + " SELECT card, source_id, CASE WHEN strong THEN 'exact' ELSE 'medium' END AS confidence, (NOT strong OR n > 1) AS requires_confirmation FROM k")
def identity_match(v):
    return _matches(v)[1].drop("reason")


@query(MATCH_SQL + ", m AS (SELECT card, count(*) AS n, bool_or(NOT strong OR n > 1) AS ask FROM k GROUP BY 1) SELECT d.card, CASE WHEN m.n IS NULL THEN 'new-source' WHEN m.n = 1 AND NOT m.ask THEN 'candidate-found' ELSE 'confirmation-required' END AS reconciliation FROM d LEFT JOIN m USING (card)")
def identity_reconcile(v):
    return identity.reconcile(*_matches(v))


@query("""SELECT DISTINCT source_id, relative_path, canonical_path_key, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY lower(canonical_path_key), canonical_path_key, relative_path, size_bytes) AS a,
    row_number() OVER (PARTITION BY source_id ORDER BY lower(canonical_path_key) DESC, canonical_path_key DESC, relative_path DESC, size_bytes DESC) AS b FROM (SELECT DISTINCT source_id, relative_path, canonical_path_key, size_bytes FROM contents)) WHERE a <= 8 OR b <= 8""")
def identity_edge_samples(v):
    return identity.edge_samples(v.contents)


@query("""WITH d AS (SELECT DISTINCT source_id, relative_path, canonical_path_key, size_bytes FROM contents),
    e AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY lower(canonical_path_key), canonical_path_key, relative_path, size_bytes) AS a, row_number() OVER (PARTITION BY source_id ORDER BY lower(canonical_path_key) DESC, canonical_path_key DESC, relative_path DESC, size_bytes DESC) AS b FROM d),
    s AS (SELECT source_id, string_agg('{"relativePath":"' || relative_path || '","canonicalPathKey":"' || canonical_path_key || '","sizeBytes":' || size_bytes || '}', ',' ORDER BY lower(canonical_path_key), canonical_path_key, relative_path, size_bytes) AS t FROM e WHERE a <= 8 OR b <= 8 GROUP BY 1),
    f AS (SELECT source_id, cast(sum(size_bytes) AS double) AS c FROM contents GROUP BY 1)
    SELECT source_id, 'source-fallback-v1:' || sha256('{"version":1,"label":"' || lower(source_id) || '","capacityBucketBytes":' || CASE WHEN c > 0 THEN cast(cast(pow(2, floor(log2(c) + 0.5)) AS bigint) AS string) ELSE 'null' END || ',"filesystem":"exfat","samples":[' || t || ']}') AS fingerprint FROM f JOIN s USING (source_id)""")
def identity_fallback_fingerprint(v):
    facts = v.contents.groupBy("source_id").agg(F.min("source_id").alias("label"), F.sum("size_bytes").alias("capacity_bytes"), F.lit("exfat").alias("filesystem"))
    return identity.fallback_identity(facts, v.contents)


@query("SELECT n_nationkey AS id, cast(coalesce(s.k, c.k) AS string) AS known FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, max(c_custkey) AS k FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def resolve_volume(v):
    vols = v.table("nation").select(F.concat(F.lit("/m/"), F.col("n_nationkey").cast("string")).alias("mount_path"), F.concat(F.lit("vol-"), F.col("n_nationkey").cast("string")).alias("platform_volume_id"), F.col("n_nationkey").alias("id"))
    marks = v.table("supplier").filter("s_suppkey % 2 = 0").groupBy("s_nationkey").agg(F.min("s_suppkey").cast("string").alias("source_id")).select(F.concat(F.lit("/m/"), F.col("s_nationkey").cast("string")).alias("mount_path"), "source_id")
    known = v.table("supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    seen = v.table("customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit("vol-"), F.col("c_nationkey").cast("string")).alias("strong_platform_id"), F.col("c_custkey").alias("observed_at"), F.col("c_custkey").alias("id"))
    return identity.resolve_volume(vols, marks, known, seen).select("id", F.col("known_source_id").alias("known"))


@query("SELECT p_name || '/' || cast(p_partkey AS string) AS path, CASE WHEN p_partkey % 3 = 0 THEN 'removable-volume' ELSE 'folder' END AS source_type, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE cast(p_partkey AS string) END AS display_name FROM part")
def source_of_path(v):
    chosen = v.sql("SELECT p_name || '/' || cast(p_partkey AS string) AS path FROM {part}")
    mounted = v.sql("SELECT p_name || '/' || cast(p_partkey AS string) AS mount_path, 'removable-volume' AS source_type, p_brand AS display_name, 'x' AS platform_volume_id, 'exfat' AS fs_type, cast(1 AS bigint) AS capacity_bytes FROM {part} WHERE p_partkey % 3 = 0")
    return identity.source_of_path(chosen, mounted).select("path", "source_type", "display_name")


MERGE_SQL = """WITH k AS (SELECT c_custkey AS id, c_name AS name, c_custkey % 5 = 0 AS online FROM customer), d AS (SELECT s_suppkey AS id, s_name AS label, s_suppkey % 2 = 0 AS online, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 40 END AS known_source_id FROM supplier),
    l AS (SELECT known_source_id, max_by(online, id) AS o, max(id) AS live_id FROM d WHERE known_source_id IS NOT NULL GROUP BY 1),
    cards AS (SELECT 'known' AS kind, k.id, k.name, (k.online OR coalesce(l.o, false)) AS online, l.live_id FROM k LEFT JOIN l ON l.known_source_id = k.id UNION ALL SELECT 'new', d.id, d.label, d.online, null FROM d WHERE d.known_source_id IS NULL OR d.known_source_id NOT IN (SELECT id FROM k))"""


def _cards(v):
    known = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 5 == 0).alias("online"))
    found = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), (F.col("s_suppkey") % 2 == 0).alias("online"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") * 40).alias("known_source_id"))
    return identity.merge_cards(known, found)


@query(MERGE_SQL + " SELECT * FROM cards")
def card_merge(v):
    return _cards(v)


@query(MERGE_SQL + " SELECT count(*) FILTER (WHERE online) AS online_count, count(*) FILTER (WHERE NOT online) AS offline_count FROM cards")
def card_counts(v):
    return identity.online_counts(_cards(v))


# classification and planning


def _classify_inputs(v, sums: bool):
    files = v.contents.withColumn("id", F.concat(F.lit("f"), F.lpad("file", 8, "0"))).withColumn("quick_fingerprint", F.concat_ws("|", "canonical_path_key", "size_bytes", "modified_at")).withColumn("full_checksum", F.sha2("text", 256))
    prior = files.filter("doc_id % 2 = 0")
    states = prior.filter("doc_id % 6 <> 0").select(F.col("id").alias("source_file_id"), F.when(F.col("doc_id") % 6 == 2, "verified").otherwise("started").alias("copy_status"))
    now = files.filter("doc_id % 2 = 1")
    if not sums:
        now = now.withColumn("full_checksum", F.lit(None).cast("string"))
    return now.select("file", "source_id", "relative_path", "canonical_path_key", "size_bytes", "modified_at", "quick_fingerprint", "full_checksum"), classify.prior_files(prior, states)


CLASS_SQL = """WITH p AS (SELECT 'f' || lpad(file, 8, '0') AS id, *, sha256(text) AS sum, CASE doc_id % 6 WHEN 2 THEN 'verified' WHEN 4 THEN 'started' ELSE 'none' END AS st, CASE doc_id % 6 WHEN 2 THEN 0 WHEN 4 THEN 1 ELSE 2 END AS rk FROM contents WHERE doc_id % 2 = 0),
    c AS (SELECT *, %s AS sum FROM contents WHERE doc_id %% 2 = 1),
    s1 AS (SELECT c.file, min(cast(p.rk AS string) || p.id || p.st) AS b FROM c JOIN p ON p.source_id = c.source_id AND p.sum = c.sum GROUP BY 1),
    e1 AS (SELECT c.file, min(cast(p.rk AS string) || p.id || p.st) AS b FROM c JOIN p ON p.source_id = c.source_id AND p.relative_path = c.relative_path AND p.canonical_path_key = c.canonical_path_key AND p.size_bytes = c.size_bytes AND p.modified_at = c.modified_at GROUP BY 1),
    p1 AS (SELECT c.file, min(cast(p.rk AS string) || p.id || p.st) AS b FROM c JOIN p ON p.source_id = c.source_id AND p.relative_path = c.relative_path GROUP BY 1),
    z1 AS (SELECT c.file, min(cast(p.rk AS string) || p.id || p.st) AS b FROM c JOIN p ON p.source_id = c.source_id AND p.size_bytes = c.size_bytes AND p.relative_path <> c.relative_path GROUP BY 1),
    x1 AS (SELECT c.file, min(cast(p.rk AS string) || p.id || p.st) AS b FROM c JOIN p ON p.source_id <> c.source_id AND p.sum = c.sum GROUP BY 1),
    r AS (SELECT c.file, c.sum, c.size_bytes, s1.b AS s, e1.b AS e, p1.b AS p, z1.b AS z, x1.b AS x FROM c LEFT JOIN s1 USING (file) LEFT JOIN e1 USING (file) LEFT JOIN p1 USING (file) LEFT JOIN z1 USING (file) LEFT JOIN x1 USING (file)),
    k AS (SELECT *, CASE WHEN sum IS NOT NULL AND s IS NOT NULL THEN CASE substr(s, 1, 1) WHEN '0' THEN 'verified-full-checksum-match' WHEN '2' THEN 'unverified-prior-record' ELSE 'incomplete-prior-copy' END
      WHEN sum IS NOT NULL AND (p IS NOT NULL OR z IS NOT NULL) THEN 'checksum-disproved-candidates' WHEN sum IS NOT NULL AND x IS NOT NULL THEN 'no-same-source-match' WHEN sum IS NOT NULL THEN 'no-prior-match'
      WHEN e IS NOT NULL THEN CASE substr(e, 1, 1) WHEN '0' THEN 'verified-exact-match' WHEN '2' THEN 'unverified-prior-record' ELSE 'incomplete-prior-copy' END WHEN p IS NOT NULL THEN 'same-path-changed-facts' WHEN z IS NOT NULL THEN 'same-size-different-path' ELSE 'no-prior-match' END AS reason FROM r),
    v AS (SELECT file, size_bytes, reason, CASE WHEN reason LIKE 'verified%%' THEN 'known' WHEN reason = 'incomplete-prior-copy' THEN 'recoverable' WHEN reason LIKE 'same-%%' THEN 'ambiguous' ELSE 'new' END AS decision, reason LIKE 'same-%%' AS needs_full_checksum,
      CASE WHEN reason IN ('verified-full-checksum-match', 'verified-exact-match', 'unverified-prior-record', 'incomplete-prior-copy') THEN substr(coalesce(CASE WHEN sum IS NOT NULL THEN s END, e), 2, 9) WHEN reason = 'same-path-changed-facts' THEN substr(p, 2, 9) WHEN reason = 'same-size-different-path' THEN substr(z, 2, 9) END AS matched_file_id,
      CASE WHEN reason IN ('checksum-disproved-candidates', 'no-same-source-match') THEN substr(x, 2, 9) END AS cross_source_duplicate FROM k)"""
CLASS_SUM, CLASS_QUICK = (CLASS_SQL.replace("doc_id % ", "doc_id %% ").replace("%%%%", "%%") % s for s in ("sha256(text)", "cast(null AS string)"))


@query(CLASS_SUM + " SELECT file, decision, reason, needs_full_checksum, matched_file_id, cross_source_duplicate FROM v")
def classify_with_checksums(v):
    return classify.classify(*_classify_inputs(v, True))


@query(CLASS_QUICK + " SELECT file, decision, reason, needs_full_checksum, matched_file_id, cross_source_duplicate FROM v")
def classify_files(v):
    return classify.classify(*_classify_inputs(v, True), compat="composed-app")


@query(CLASS_QUICK + " SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'new') AS new, count(*) FILTER (WHERE decision = 'known') AS known, count(*) FILTER (WHERE decision = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE decision = 'recoverable') + 25 AS recoverable, cast(coalesce(sum(size_bytes) FILTER (WHERE decision <> 'known'), 0) AS bigint) AS estimated_bytes FROM v")
def review_counts(v):
    now, prior = _classify_inputs(v, False)
    return classify.review(classify.classify(now, prior), now, v.table("nation"))


@query("SELECT substr(modified_at, 1, 10) AS day, count(*) FILTER (WHERE extension IN ('.jpg', '.nef', '.webp')) AS photos, count(*) FILTER (WHERE extension IN ('.mov', '.insv')) AS videos, count(*) FILTER (WHERE extension = '.txt') AS other, cast(sum(size_bytes) AS bigint) AS bytes FROM files GROUP BY 1")
def review_days(v):
    return classify.review_days(v.files)


@query("SELECT sha256(text) AS sha256, cast(strlen(text) AS bigint) AS size_bytes, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def checksum_duplicates(v):
    d = v.table("documents").select("doc_id", hashing.content_facts("text").alias("f"))
    return d.groupBy("f.sha256", "f.size_bytes").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("""SELECT file, 'quick-v1:' || sha256(unhex('00000014') || encode('quick-fingerprint.v1') || unhex(lpad(to_hex(strlen(canonical_path_key)), 8, '0')) || encode(canonical_path_key) || unhex(lpad(to_hex(length(cast(size_bytes AS string))), 8, '0')) || encode(cast(size_bytes AS string))
    || unhex('00000018') || encode(replace(modified_at, 'Z', '.000Z'))) AS fingerprint FROM contents""")
def quick_fingerprint(v):
    return v.contents.select("file", hashing.quick_fingerprint("canonical_path_key", "size_bytes", "modified_at", F.lit("2020-01-01T00:00:00Z")).alias("fingerprint"))


@query("""WITH f AS (SELECT p_partkey, substr(sha256(cast(p_partkey % 7 AS string)), 1, 8) AS short, '2021/2021-02-' || lpad(cast(p_size % 28 + 1 AS string), 2, '0') || '/' || p_brand || '/' || replace(p_name, ' ', '_') AS dest FROM part),
    g AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY lpad(cast(p_partkey AS string), 9, '0')) - 1 AS k FROM f)
    SELECT cast(p_partkey AS string) AS file, 'new' AS kind, replace(replace(dest, '#', '#'), '', '') || CASE WHEN k = 0 THEN '' WHEN k = 1 THEN '-' || short ELSE '-' || short || '-' || cast(k AS string) END || '.jpg' AS destination_path FROM g""".replace("replace(replace(dest, '#', '#'), '', '')", "dest"))
def plan_by_window(v):
    f = v.sql("SELECT cast(p_partkey AS string) AS file, lpad(cast(p_partkey AS string), 9, '0') AS relative_path, p_partkey, '2021-02-' || lpad(cast(p_size % 28 + 1 AS string), 2, '0') AS day, p_brand AS label, replace(p_name, ' ', '_') || '.jpg' AS name FROM {part}")
    f = f.withColumn("checksum", F.sha2((F.col("p_partkey") % 7).cast("string"), 256)).withColumn("dest", paths.compile_template(paths.DEFAULT_TEMPLATE, "day", "label", "name", unicode=False))
    return plan.plan_by_window(f.select("file", "relative_path", "checksum", "dest")).drop("checksum")


#: Destinations one after another, a directory's taken names in two lists: f(file, rel, k, checksum, dir, stem) and old(dir, name, v).
WALK_SQL = """WITH RECURSIVE %s, q AS (SELECT *, substr(checksum, 1, 8) AS short, row_number() OVER (PARTITION BY dir ORDER BY rel, file) AS r FROM f),
    held AS (SELECT dir, list(name) AS names, list(coalesce(v, '')) AS sums FROM old GROUP BY dir),
    walk AS (SELECT d.dir, cast(0 AS bigint) AS r, coalesce(h.names, cast([] AS varchar[])) AS names, coalesce(h.sums, cast([] AS varchar[])) AS sums, cast(NULL AS varchar) AS file, cast(NULL AS varchar) AS checksum, cast(NULL AS varchar) AS at_name, false AS again FROM (SELECT DISTINCT dir FROM q) d LEFT JOIN held h ON h.dir = d.dir
        UNION ALL SELECT dir, r, CASE WHEN again THEN names ELSE list_append(names, at_name) END, CASE WHEN again THEN sums ELSE list_append(sums, checksum) END, file, checksum, at_name, again FROM (SELECT *, list_contains(names, at_name) AS again FROM (
            SELECT w.dir, q.r, w.names, w.sums, q.file, q.checksum, list_filter(list_concat([q.stem || '.jpg', q.stem || '-' || q.short || '.jpg'], list_transform(range(2, len(w.names) + 3), lambda n: q.stem || '-' || q.short || '-' || n || '.jpg')), lambda c: NOT list_contains(w.names, c) OR w.sums[list_position(w.names, c)] = q.checksum)[1] AS at_name
            FROM walk w JOIN q ON q.dir = w.dir AND q.r = w.r + 1)))
    SELECT file, CASE WHEN again THEN 'reuse' ELSE 'new' END AS kind, dir || '/' || at_name AS destination_path, checksum FROM walk WHERE r > 0"""


@query(WALK_SQL.replace("%s", """f AS (SELECT cast(p_partkey AS string) AS file, lpad(cast(p_partkey AS string), 9, '0') AS rel, p_partkey AS k, sha256(cast(p_partkey %% 7 AS string)) AS checksum, '2021/2021-02-' || lpad(cast(p_size %% 28 + 1 AS string), 2, '0') || '/' || p_brand AS dir, replace(p_name, ' ', '_') AS stem FROM part),
    old AS (SELECT dir, stem || '.jpg' AS name, max(CASE WHEN k %% 20 = 0 THEN checksum END) AS v FROM f WHERE k %% 10 = 0 GROUP BY 1, 2)""".replace("%%", "%")))
def plan_destinations(v):
    f = v.sql("SELECT cast(p_partkey AS string) AS file, lpad(cast(p_partkey AS string), 9, '0') AS relative_path, p_partkey, '2021-02-' || lpad(cast(p_size % 28 + 1 AS string), 2, '0') AS capture_day, p_brand AS label, cast(null AS string) AS nickname, replace(p_name, ' ', '_') || '.jpg' AS original_filename FROM {part}")
    f = f.withColumn("checksum", F.sha2((F.col("p_partkey") % 7).cast("string"), 256))
    old = f.filter("p_partkey % 10 = 0").select(paths.compile_template(paths.DEFAULT_TEMPLATE, "capture_day", "label", "original_filename", unicode=False).alias("destination_path"), F.when(F.col("p_partkey") % 20 == 0, F.col("checksum")).alias("verified_checksum"))
    return plan.plan_destinations(f, old, unicode=False)


@query(WALK_SQL.replace("%s", """f AS (SELECT *, 'IMG' || CASE WHEN k %% 5 = 1 THEN '-' || substr(sha256(cast((k + 3) %% 23 AS string)), 1, 8) WHEN k %% 5 = 2 THEN '-' || substr(checksum, 1, 8) || '-2' WHEN k %% 5 = 3 THEN cast(k %% 11 AS string) ELSE '' END AS stem FROM (
        SELECT cast(p_partkey AS string) AS file, lpad(cast(p_partkey AS string), 9, '0') AS rel, p_partkey AS k, sha256(cast(p_partkey %% 23 AS string)) AS checksum, '2021/2021-02-' || lpad(cast(p_size %% 28 + 1 AS string), 2, '0') || '/card' AS dir FROM part)),
    old AS (SELECT dir, CASE WHEN k %% 4 = 0 THEN 'IMG-' || substr(checksum, 1, 8) ELSE stem END || '.jpg' AS name, max(CASE WHEN k %% 3 = 0 THEN checksum END) AS v FROM f WHERE k %% 10 = 0 GROUP BY 1, 2)""".replace("%%", "%")))
def plan_destinations_clashing(v):
    """Names that stand in other files' families, names that many files have, and records in the way."""
    f = v.sql("SELECT cast(p_partkey AS string) AS file, lpad(cast(p_partkey AS string), 9, '0') AS relative_path, p_partkey AS k, sha2(cast(p_partkey % 23 AS string), 256) AS checksum, sha2(cast((p_partkey + 3) % 23 AS string), 256) AS other, '2021-02-' || lpad(cast(p_size % 28 + 1 AS string), 2, '0') AS capture_day, 'card' AS label, cast(null AS string) AS nickname FROM {part}")
    more = F.when(F.col("k") % 5 == 1, F.concat(F.lit("-"), F.substring("other", 1, 8))).when(F.col("k") % 5 == 2, F.concat(F.lit("-"), F.substring("checksum", 1, 8), F.lit("-2"))).when(F.col("k") % 5 == 3, (F.col("k") % 11).cast("string")).otherwise("")
    f = f.withColumn("original_filename", F.concat(F.lit("IMG"), more, F.lit(".jpg")))
    name = F.when(F.col("k") % 4 == 0, F.concat(F.lit("IMG-"), F.substring("checksum", 1, 8), F.lit(".jpg"))).otherwise(F.col("original_filename"))
    old = f.filter("k % 10 = 0").select(F.concat(F.lit("2021/"), "capture_day", F.lit("/card/"), name).alias("destination_path"), F.when(F.col("k") % 3 == 0, F.col("checksum")).alias("verified_checksum"))
    return plan.plan_destinations(f, old, unicode=False)


@query("SELECT count(*) FILTER (WHERE event_type = 'click') AS completed, count(*) FILTER (WHERE event_type IN ('error', 'view')) AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS skipped, count(*) FILTER (WHERE event_type = 'view') AS collisions FROM events")
def run_counters(v):
    kind = F.when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "skipped").when(F.col("event_type") == "view", "collision")
    return classify.run_counters(v.table("events").select(kind.alias("outcome")))


# recovery

RECOVER_SQL = """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'F' THEN 'verified' ELSE 'started' END AS status, cast(l_orderkey % 900 AS string) AS fp, CASE WHEN l_linestatus <> 'F' THEN cast(l_orderkey % 900 AS string) END AS pp, l_partkey % 7 AS eb, cast(l_suppkey % 4 AS string) AS es, CASE WHEN l_linestatus = 'F' THEN cast(l_partkey % 3 AS string) END AS ss FROM lineitem),
    d AS (SELECT cast(doc_id % 900 AS string) AS path, max(doc_id) % 7 AS size, cast(max(doc_id) % 4 AS string) AS sum FROM documents WHERE doc_id % 900 % 3 <> 0 GROUP BY doc_id % 900),
    r AS (SELECT c.*, f.path AS f, f.size AS fz, f.sum AS fs, p.path AS p, p.size AS pz, p.sum AS ps FROM c LEFT JOIN d f ON f.path = c.fp LEFT JOIN d p ON p.path = c.pp),
    a AS (SELECT *, CASE WHEN status = 'verified' AND f IS NOT NULL THEN CASE WHEN fz = eb AND coalesce(ss = es, false) THEN 'keep' WHEN fz = eb AND fs = es THEN 'mark-verified' ELSE 'quarantine-final' END WHEN p IS NOT NULL THEN CASE WHEN pz = eb AND ps = es THEN 'promote' ELSE 'quarantine-provisional' END ELSE 'recopy' END AS action FROM r)"""


def _recovery(v):
    c = v.sql("""SELECT cast(l_orderkey AS string) || '-' || cast(l_partkey AS string) || '-' || cast(l_suppkey AS string) || '-' || cast(l_linenumber AS string) AS copy, CASE WHEN l_linestatus = 'F' THEN 'verified' ELSE 'started' END AS status, cast(l_orderkey % 900 AS string) AS final_path,
        CASE WHEN l_linestatus <> 'F' THEN cast(l_orderkey % 900 AS string) END AS provisional_path, l_partkey % 7 AS expected_bytes, cast(l_suppkey % 4 AS string) AS expected_checksum, CASE WHEN l_linestatus = 'F' THEN cast(l_partkey % 3 AS string) END AS stored_checksum FROM {lineitem}""")
    d = v.sql("SELECT cast(doc_id % 900 AS string) AS path, max(doc_id) % 7 AS size_bytes, cast(max(doc_id) % 4 AS string) AS checksum FROM {documents} WHERE doc_id % 900 % 3 <> 0 GROUP BY doc_id % 900")
    return recover.recovery_actions(c, d)


@query(RECOVER_SQL + " SELECT cast(l_orderkey AS string) || '-' || cast(l_partkey AS string) || '-' || cast(l_suppkey AS string) || '-' || cast(l_linenumber AS string) AS copy, action, CASE action WHEN 'quarantine-final' THEN fp WHEN 'quarantine-provisional' THEN pp END AS quarantine_path, action IN ('quarantine-final', 'quarantine-provisional', 'recopy') AS recopy FROM a")
def recovery_actions(v):
    return _recovery(v)


@query(RECOVER_SQL + " SELECT count(*) FILTER (WHERE action IN ('quarantine-final', 'quarantine-provisional', 'recopy')) AS to_copy, 'paused' AS outcome FROM a")
def recovery_outcome(v):
    return recover.session_outcome(_recovery(v), source_present=False)


@query("SELECT c.id AS copy, c.status, c.destination_path AS final_path, CASE WHEN c.status <> 'verified' THEN c.destination_path END AS provisional_path, c.expected_bytes, coalesce(c.checksum, 'full-' || f.id) AS expected_checksum, c.checksum AS stored_checksum FROM copies c JOIN files f ON f.id = c.source_file_id")
def recovery_inputs(v):
    return recover.recovery_inputs(v.copies, v.files.withColumn("full_checksum", F.concat(F.lit("full-"), F.col("id"))))


@query("SELECT id AS copy, CASE WHEN regexp_matches(destination_path, '/') THEN regexp_replace(destination_path, '/[^/]*$', '') || '/' ELSE '' END || '.' || regexp_extract(destination_path, '[^/]*$') || '.' || ingest_session_id || '.' || id || '.tmp' AS temp_path FROM copies")
def temp_paths(v):
    return v.copies.select(F.col("id").alias("copy"), paths.temp_path("destination_path", "ingest_session_id", "id").alias("temp_path"))


# maintenance

EVICT_SQL = "WITH a AS (SELECT doc_id, n_chars AS size_bytes, cast(doc_id % 50 AS string) AS u, lpad(cast(doc_id AS string), 9, '0') AS k FROM documents) SELECT k AS cache_key, size_bytes, u AS updated_at FROM (SELECT *, sum(size_bytes) OVER () AS t, coalesce(sum(size_bytes) OVER (ORDER BY u, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM a) WHERE t - b > 100000"


def _artifacts(v):
    return v.sql("SELECT n_chars AS size_bytes, cast(doc_id % 50 AS string) AS updated_at, lpad(cast(doc_id AS string), 9, '0') AS cache_key FROM {documents}")


@query(EVICT_SQL)
def cache_eviction(v):
    return maintenance.evict(_artifacts(v), 100_000)


@query(EVICT_SQL + " AND k NOT IN (SELECT lpad(cast(doc_id AS string), 9, '0') FROM documents WHERE doc_id % 5 = 0)".replace("% 5", "% 5"))
def cache_eviction_in_use(v):
    return maintenance.evict(_artifacts(v), 100_000, v.sql("SELECT lpad(cast(doc_id AS string), 9, '0') AS cache_key FROM {documents} WHERE doc_id % 5 = 0"))


@query("SELECT cast(sum(n_chars) AS bigint) AS total_bytes FROM documents")
def cache_total(v):
    return v.table("documents").agg(F.sum("n_chars").alias("total_bytes"))


UPSERT_ROWS = "SELECT o_orderkey + 5000 AS o_orderkey, o_orderpriority AS status, cast(o_custkey AS string) AS created FROM {orders} WHERE o_orderkey % 3 = 0"
BASE_ROWS = "SELECT o_orderkey, o_orderstatus AS status, cast(o_orderkey AS string) AS created FROM {orders}"


@query(f"SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.status, o.status) AS status, coalesce(o.created, n.created) AS created FROM ({BASE_ROWS.format(orders='orders')}) o FULL JOIN ({UPSERT_ROWS.format(orders='orders')}) n ON n.o_orderkey = o.o_orderkey")
def upsert_overlay(v):
    return maintenance.upsert(v.sql(BASE_ROWS), v.sql(UPSERT_ROWS), ["o_orderkey"], keep=["created"])


@query(f"SELECT n.* FROM ({UPSERT_ROWS.format(orders='orders')}) n WHERE n.o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def insert_if_absent(v):
    return maintenance.insert_if_absent(v.sql(BASE_ROWS), v.sql(UPSERT_ROWS), ["o_orderkey"])


@query(f"SELECT n.* FROM ({UPSERT_ROWS.format(orders='orders')}) n JOIN ({BASE_ROWS.format(orders='orders')}) o USING (o_orderkey) WHERE n.status IS DISTINCT FROM o.status")
def insert_conflicts(v):
    return maintenance.conflicts(v.sql(BASE_ROWS), v.sql(UPSERT_ROWS), ["o_orderkey"], ["status"])


@query(f"SELECT * FROM ({BASE_ROWS.format(orders='orders')}) UNION ALL SELECT * FROM ({UPSERT_ROWS.format(orders='orders')})")
def insert_rows(v):
    return maintenance.insert(v.sql(BASE_ROWS), v.sql(UPSERT_ROWS))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'cancelled' ELSE o_orderstatus END AS status, cast(o_orderkey AS string) AS created FROM orders")
def update_rows(v):
    return maintenance.update(v.sql(BASE_ROWS), F.col("status") == "O", {"status": F.lit("cancelled")})


@query("SELECT c_custkey FROM customer c WHERE c_custkey % 2 = 1 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def delete_unreferenced(v):
    c = v.table("customer").select("c_custkey")
    return maintenance.delete_unreferenced(c, c.filter("c_custkey % 2 = 0"), "c_custkey", v.table("orders"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def delete_rows(v):
    return maintenance.delete(v.table("customer").select("c_custkey"), v.table("orders").filter("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_state(v):
    return maintenance.latest_state(v.table("events"), ["user_id"], ["event_id"]).select("user_id", "event_type")


@query("SELECT id, CASE WHEN s.o_orderkey IS NULL THEN ingest_session_id END AS ingest_session_id FROM files f LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) s ON cast(s.o_orderkey AS string) = f.ingest_session_id")
def clear_sessions(v):
    return maintenance.clear_session(v.files, v.table("orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("id"))).select("id", "ingest_session_id")


@query("SELECT s.id FROM sessions s WHERE s.status = 'copying' AND EXISTS (SELECT 1 FROM sources x WHERE x.id = s.source_id) AND NOT EXISTS (SELECT 1 FROM files f WHERE f.ingest_session_id = s.id)")
def adoptable_sessions(v):
    return maintenance.may_adopt(v.sessions.withColumn("status", F.when(F.col("status") == "copying", "discovering").otherwise(F.col("status"))), v.sources, v.files).select("id")


@query("SELECT session AS source_id, count(*) AS sample_count, cast(sum(bps) AS bigint) AS total, max_by(bps, seq) AS last FROM samples GROUP BY 1")
def running_stats(v):
    s = v.samples.withColumnRenamed("session", "source_id")
    old = maintenance.running_stats(s.filter("seq < 5000"), value="bps", order="seq")
    out = maintenance.add_samples(old, s.filter("seq >= 5000"), value="bps", order="seq")
    return out.select("source_id", F.col("sample_count").cast("long").alias("sample_count"), F.round(F.col("average_bytes_per_second") * F.col("sample_count")).cast("long").alias("total"), F.col("last_bytes_per_second").alias("last"))


@query("SELECT session AS source_id, count(*) AS sample_count, round(avg(bps), 1) AS mean FROM samples GROUP BY 1")
def running_mean_replay(v):
    # the mean of a replay differs from that of a sum in its last digits only
    out = maintenance.replay_mean(v.samples.withColumnRenamed("session", "source_id"), value="bps", order="seq")
    return out.select("source_id", "sample_count", F.round("average_bytes_per_second", 1).alias("mean"))


# change feeds

POLL_SQL = "SELECT DISTINCT cast(epoch(date_trunc('hour', ts)) / 3600 AS bigint) AS poll, user_id FROM events"


def _polls(v):
    return v.table("events").select((F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("poll"), "user_id").distinct()


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_id % 3 = 0 AND user_id % 2 = 0), b AS (SELECT DISTINCT user_id FROM events WHERE event_id % 5 = 0 AND user_id % 3 = 0) SELECT 'removed' AS change, user_id FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT 'arrived', user_id FROM b WHERE user_id NOT IN (SELECT user_id FROM a)")
def snapshot_diff(v):
    e = v.table("events")
    return feeds.snapshot_diff(e.filter("event_id % 3 = 0 and user_id % 2 = 0").select("user_id").distinct(), e.filter("event_id % 5 = 0 and user_id % 3 = 0").select("user_id").distinct(), ["user_id"])


@query(f"""WITH p AS ({POLL_SQL}), t AS (SELECT poll, dense_rank() OVER (ORDER BY poll) AS turn FROM (SELECT DISTINCT poll FROM p)), q AS (SELECT p.user_id, t.turn FROM p JOIN t USING (poll)), m AS (SELECT max(turn) AS last FROM t)
    SELECT t.poll, 'arrived' AS change, q.user_id FROM q JOIN t ON t.turn = q.turn WHERE q.turn > 1 AND NOT EXISTS (SELECT 1 FROM q b WHERE b.user_id = q.user_id AND b.turn = q.turn - 1)
    UNION ALL SELECT t.poll, 'removed', q.user_id FROM q JOIN t ON t.turn = q.turn + 1, m WHERE q.turn < m.last AND NOT EXISTS (SELECT 1 FROM q b WHERE b.user_id = q.user_id AND b.turn = q.turn + 1)""")
def poll_changes(v):
    return feeds.polls_to_changes(_polls(v).withColumn("failed", F.lit(False)), ["user_id"])


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'removed' ELSE 'arrived' END AS change, CASE WHEN event_id % 4 = 0 THEN event_type END AS known FROM events), g AS (SELECT user_id, max(event_id) FILTER (WHERE change = 'removed') AS gone FROM e GROUP BY 1),
    k AS (SELECT e.* FROM e JOIN g USING (user_id) WHERE change <> 'removed' AND (gone IS NULL OR event_id > gone)) SELECT cast(user_id AS string) AS key, max(event_id) AS last, max_by(known, event_id) FILTER (WHERE known IS NOT NULL) AS known_source_id FROM k GROUP BY 1""")
def detected_registry(v):
    e = v.table("events").select(F.col("event_id").alias("poll"), F.col("user_id").cast("string").alias("strong_id"), F.when(F.col("event_type") == "error", "removed").otherwise("arrived").alias("change"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("known_source_id"), F.col("event_id").cast("string").alias("path"), F.lit("x").alias("label"))
    return feeds.detected_registry(e).select("key", F.col("path").cast("long").alias("last"), "known_source_id")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS us, cast(round(value * 100) AS bigint) AS b, event_id FROM events), w AS (SELECT *, first_value(us) OVER f AS fu, first_value(b) OVER f AS fb FROM s WINDOW f AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 900000000 PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, CASE WHEN us <= fu THEN 0.0 ELSE greatest(0.0, (b - fb) / ((us - fu) / 1000.0)) END AS rate FROM w""")
def rolling_throughput(v):
    s = v.table("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.round(F.col("value") * 100).cast("long").alias("b"), "event_id")
    return feeds.rolling_throughput(s, "user_id", "us", "b", "event_id", 900_000_000).select("user_id", "event_id", F.col("bytes_per_second").alias("rate"))


@query("""WITH l AS (SELECT session, sum(b) AS done FROM (SELECT session, file, max_by(bytes, seq) AS b FROM progress WHERE kind = 'progress' GROUP BY 1, 2) GROUP BY 1)
    SELECT p.session, count(*) FILTER (WHERE kind = 'discovered') AS total_files, count(*) FILTER (WHERE kind = 'completed') AS completed_files, count(*) FILTER (WHERE kind = 'failed') AS failed_files, cast(coalesce(sum(bytes) FILTER (WHERE kind = 'discovered'), 0) AS bigint) AS total_bytes,
    max_by(status, seq) FILTER (WHERE kind = 'status') AS status, cast(coalesce(max(l.done), 0) AS bigint) AS completed_bytes FROM progress p LEFT JOIN l ON l.session = p.session GROUP BY 1""")
def session_fold(v):
    return feeds.session_fold(v.progress).select("session", "total_files", "completed_files", "failed_files", "total_bytes", "status", "completed_bytes")


@query("WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, event_id, before, event_type AS status FROM e WHERE before IS NOT NULL AND before || '>' || event_type NOT IN ('view>click', 'click>purchase', 'error>view')")
def invalid_transitions(v):
    moves = {"view": ("click",), "click": ("purchase",), "error": ("view",)}
    return constraints.bad_moves(v.table("events").withColumnRenamed("event_type", "status"), ["user_id"], ["event_id"], moves).select("user_id", "event_id", "before", "status")


MOVES_SQL = """WITH e AS (SELECT user_id, event_id, ([{states}])[event_id * 7 % {n} + 1] AS status FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e)
    SELECT user_id, event_id, before, status FROM b WHERE before IS NOT NULL AND before || '>' || status NOT IN ({allowed})"""
SESSION_PATH = "'discovering', 'analyzing', 'ready', 'copying', 'verifying'"


def _states(v, names):
    at = (F.col("event_id") * 7 % len(names) + 1).cast("int")
    return v.table("events").select("user_id", "event_id", F.element_at(F.array(*[F.lit(n) for n in names]), at).alias("status"))


@query(MOVES_SQL.format(states="'planned', 'started', 'failed', 'verified'", n=4, allowed="'planned>started', 'started>verified', 'started>failed', 'failed>started'"))
def copy_moves(v):
    return constraints.bad_moves(_states(v, schemas.COPY_STATUSES), ["user_id"], ["event_id"], schemas.COPY_MOVES).select("user_id", "event_id", "before", "status")


@query(MOVES_SQL.format(states=SESSION_PATH + ", 'completed', 'cancelled', 'failed'", n=8, allowed="'discovering>analyzing', 'analyzing>ready', 'ready>copying', 'copying>verifying', 'verifying>completed', " + ", ".join(f"{s.strip()[:-1]}>{e}'" for s in SESSION_PATH.split(",") for e in ("cancelled", "failed"))))
def session_moves(v):
    return constraints.bad_moves(_states(v, schemas.SESSION_STATUSES), ["user_id"], ["event_id"], schemas.SESSION_MOVES).select("user_id", "event_id", "before", "status")


@query("WITH e AS (SELECT user_id, event_id, (['planned', 'started', 'failed', 'verified'])[event_id * 7 % 4 + 1] AS status FROM events), b AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e) SELECT user_id, max_by(status, event_id) AS status, count(*) FILTER (WHERE before IS NOT NULL AND before || '>' || status NOT IN ('planned>started', 'started>verified', 'started>failed', 'failed>started')) = 0 AS valid FROM b GROUP BY 1")
def copy_state_fold(v):
    return feeds.copy_states(_states(v, schemas.COPY_STATUSES), "user_id", "event_id")


@query("WITH e AS (SELECT *, floor(value / 10) AS m, lag(floor(value / 10)) OVER w AS p, lead(event_id) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id FROM e WHERE p IS NULL OR m > p OR n IS NULL")
def throttled_progress(v):
    return feeds.throttle_progress(v.table("events"), "user_id", "value", "event_id", 10).select("user_id", "event_id")


@query("SELECT count(DISTINCT p_brand) AS n FROM part")
def single_flight(v):
    return feeds.single_flight(v.table("part"), "p_brand").agg(F.count(F.lit(1)).alias("n"))


# scalar functions

MEDIA_EXT = ".jpg .JPEG .nef .mov .R3D .insv .txt .webp .x3f .mkv".split()


@query("""WITH e AS (SELECT p_partkey, (['.jpg', '.JPEG', '.nef', '.mov', '.R3D', '.insv', '.txt', '.webp', '.x3f', '.mkv'])[p_partkey % 10 + 1] AS ext, CASE p_size % 5 WHEN 0 THEN 'image/x' WHEN 1 THEN ' VIDEO/mp4' WHEN 2 THEN 'text/plain' END AS mime FROM part)
    SELECT p_partkey, CASE WHEN mime = 'image/x' THEN 'photo' WHEN mime = ' VIDEO/mp4' THEN 'video' WHEN lower(ext) IN ('.jpg', '.jpeg', '.nef', '.webp', '.x3f') THEN 'photo' WHEN lower(ext) IN ('.mov', '.r3d', '.insv', '.mkv') THEN 'video' ELSE 'unknown' END AS media_type,
    CASE WHEN ext IN ('.jpg', '.nef') THEN 'image' WHEN ext IN ('.mov', '.mkv') THEN 'video' ELSE 'other' END AS media_kind FROM e""")
def media_types(v):
    e = v.table("part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in MEDIA_EXT]), (F.col("p_partkey") % 10 + 1).cast("int")).alias("ext"), F.when(F.col("p_size") % 5 == 0, "image/x").when(F.col("p_size") % 5 == 1, " VIDEO/mp4").when(F.col("p_size") % 5 == 2, "text/plain").alias("mime"))
    return e.select("p_partkey", media.media_type("ext", "mime").alias("media_type"), media.media_kind("ext").alias("media_kind"))


@query("SELECT doc_id, substr(CASE WHEN doc_id % 2 = 0 THEN sha256(text) ELSE sha256('zz' || cast(doc_id AS string)) END, 1, 8) AS short FROM documents")
def short_checksums(v):
    d = v.table("documents")
    return d.select("doc_id", hashing.short_checksum(F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("text", 256))).otherwise(F.concat(F.lit("zz"), F.col("doc_id").cast("string")))).alias("short"))


@query("SELECT page_id, cast(len(string_split(url, '/')) AS int) AS segments, string_split(url, '/')[-1] AS base, lower(regexp_extract(string_split(url, '/')[-1], '[^.](\\.[^.]*)$', 1)) AS ext FROM pages")
def path_parts(v):
    return v.table("pages").select("page_id", F.size(paths.segments("url")).alias("segments"), paths.basename("url").alias("base"), paths.extname("url").alias("ext"))



@query(r"""WITH r AS (SELECT page_id, (CASE page_id % 6 WHEN 0 THEN 'CON' WHEN 1 THEN 'camera... ' WHEN 2 THEN '..' WHEN 3 THEN 'lpt1.txt' WHEN 4 THEN url ELSE 'a<b>:c' || cast(page_id AS string) || '. ' END) AS t FROM pages), s AS (SELECT page_id, regexp_replace(regexp_replace(t, '[/\x00-\x1F<>:"|?*\\]', '_', 'g'), '[. ]+$', '') AS t FROM r),
    u AS (SELECT page_id, CASE WHEN t IN ('', '.', '..') THEN '_' ELSE t END AS t FROM s) SELECT page_id, CASE WHEN regexp_matches(t, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)') THEN '_' || t ELSE t END AS name FROM u""")
def sanitized_segments(v):
    k = F.col("page_id") % 6
    t = F.when(k == 0, "CON").when(k == 1, "camera... ").when(k == 2, "..").when(k == 3, "lpt1.txt").when(k == 4, F.col("url")).otherwise(F.concat(F.lit("a<b>:c"), F.col("page_id").cast("string"), F.lit(". ")))
    return v.table("pages").select("page_id", paths.sanitize_segment(t).alias("name"))


@query("SELECT cast(p_partkey AS string) AS file, '2021/2021-02-' || lpad(cast(p_size % 28 + 1 AS string), 2, '0') || '/' || coalesce(CASE WHEN p_size % 2 = 0 THEN 'nick' END, p_brand) || '-x/' || replace(p_name, ' ', '_') || '.jpg' AS path FROM part")
def template_paths(v):
    f = v.sql("SELECT cast(p_partkey AS string) AS file, '2021-02-' || lpad(cast(p_size % 28 + 1 AS string), 2, '0') AS day, p_brand, CASE WHEN p_size % 2 = 0 THEN 'nick' END AS nick, replace(p_name, ' ', '_') || '.jpg' AS name FROM {part}")
    return f.select("file", paths.compile_template("{YYYY}/{YYYY-MM-DD}/{nickname}-x/{originalFilename}", "day", "p_brand", "name", "nick", unicode=False).alias("path"))


CAPTURE_SQL = """WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y:%m:%d') AS d, o_orderkey % 9 AS k FROM orders)
    SELECT o_orderkey, replace(d, ':', '-') || CASE k WHEN 0 THEN 'T10:20:30Z' WHEN 1 THEN 'T10:20:30.123456789+02:00' WHEN 2 THEN 'T10:20:30' WHEN 3 THEN 'T11:00:00-05:30' WHEN 4 THEN 'T12:00:00' WHEN 5 THEN 'T00:00:00.000Z' WHEN 6 THEN 'T23:59:59+01:00' WHEN 7 THEN 'T01:02:03' ELSE 'T00:00:00.000Z' END AS capture_at,
    CASE k WHEN 0 THEN 'utc' WHEN 1 THEN 'offset' WHEN 2 THEN 'floating' WHEN 3 THEN 'offset' WHEN 4 THEN 'floating' WHEN 5 THEN 'fallback' WHEN 6 THEN 'offset' WHEN 7 THEN 'floating' ELSE 'fallback' END AS kind,
    CASE k WHEN 0 THEN 'DateTimeOriginal' WHEN 1 THEN 'DateTimeOriginal' WHEN 2 THEN 'CreateDate' WHEN 3 THEN 'DateTimeOriginal' WHEN 4 THEN 'CreateDate' WHEN 5 THEN 'filesystem-modifiedAt' WHEN 6 THEN 'MediaCreateDate' WHEN 7 THEN 'DateTimeOriginal' ELSE 'session-start' END AS source,
    cast(CASE k WHEN 0 THEN 0 WHEN 1 THEN 120 WHEN 3 THEN -330 WHEN 5 THEN 0 WHEN 6 THEN 60 WHEN 8 THEN 0 END AS int) AS minutes, replace(d, ':', '-') AS day, true AS consistent FROM r"""


@query(CAPTURE_SQL)
def capture_dates(v):
    o = v.table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy:MM:dd").alias("d"), (F.col("o_orderkey") % 9).alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    at = lambda k, text: F.when(F.col("k") == k, F.concat(F.col("d"), F.lit(text)))
    is_ = lambda k, text: F.when(F.col("k") == k, F.lit(text))
    c = {
        "DateTimeOriginal": F.coalesce(at(0, " 10:20:30Z"), at(1, "T10:20:30.123456789 +0200"), at(2, " 10:20:30+15:00"), at(3, " 11:00:00"), is_(4, "2021:02:30 10:00:00"), is_(5, "  "), at(7, " 01:02:03"), is_(8, "never")),
        "CreateDate": F.coalesce(at(2, " 10:20:30"), at(4, " 12:00:00")), "MediaCreateDate": at(6, " 23:59:59"), "OffsetTimeOriginal": is_(3, "-0530"), "TimeZone": F.coalesce(is_(6, "+01:00"), is_(7, "+99:00")),
    }
    names = [n.split()[0] for n in dates.CANDIDATES.split(", ")]
    rows = o.select("o_orderkey", F.struct(*[c.get(n, F.lit(None)).cast("string").alias(n) for n in names]).alias("c"), F.when(F.col("k") == 8, "bad").otherwise(F.col("iso")).alias("m"), F.col("iso").alias("s"))
    rows = rows.select("o_orderkey", dates.normalize_capture_date("c", "m", "s").alias("n"))
    return rows.select("o_orderkey", F.col("n.capture_at").alias("capture_at"), F.col("n.capture_timezone_kind").alias("kind"), F.col("n.capture_at_source").alias("source"), F.col("n.capture_offset_minutes").alias("minutes"), F.col("n.capture_day").alias("day"), dates.capture_is_consistent("n").alias("consistent"))


@query("SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN value * 1000000 < (event_id % 100) * 500000.0 ELSE value * 1000000 < 5000000 END AS is_slow FROM events")
def throughput_verdicts(v):
    return v.table("events").select("event_id", media.evaluate_throughput(F.col("value") * 1000000, (F.col("event_id") % 100) * 1000000.0, F.col("event_id") % 5)["is_slow"].alias("is_slow"))


@query("""WITH e AS (SELECT event_id, event_id % 50 AS t, event_id % 70 AS c, event_id % 9 AS r FROM events) SELECT event_id, cast(CASE WHEN t = 0 THEN 0 ELSE floor(least(c, t) / t * 100 + 0.5) END AS int) AS percent, cast(CASE WHEN t - least(c, t) = 0 OR r = 0 THEN NULL ELSE ceil((t - least(c, t)) / r) END AS bigint) AS eta_seconds, t - least(c, t) AS remaining_bytes FROM e""")
def progress_telemetry(v):
    return v.table("events").select("event_id", media.progress_telemetry(F.col("event_id") % 50, F.col("event_id") % 70, F.col("event_id") % 9).alias("p")).select("event_id", "p.*")


@query("WITH e AS (SELECT event_id, event_id % 7 + 1 AS a FROM events) SELECT event_id, cast(least(3600000, 30000 * pow(2, a - 1)) AS bigint) AS delay, CASE WHEN a < 5 THEN event_id + cast(least(3600000, 30000 * pow(2, a - 1)) AS bigint) END AS next FROM e")
def retry_backoff(v):
    a = F.col("event_id") % 7 + 1
    return v.table("events").select("event_id", media.retry_delay_ms(a).alias("delay"), media.next_retry_ms("event_id", a, F.lit(5)).alias("next"))


@query("WITH e AS (SELECT c_custkey, cast(floor(abs(c_acctbal) * power(10, c_custkey % 8)) AS bigint) AS b FROM customer) SELECT c_custkey, CASE WHEN b < 1024 THEN format('{} B', b) WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0::double) WHEN b < 1073741824 THEN printf('%.1f MiB', b / 1048576.0::double) ELSE printf('%.1f GiB', b / 1073741824.0::double) END || ' (' || format('{:,}', b) || ' B)' AS shown FROM e")
def exact_byte_labels(v):
    b = F.floor(F.abs("c_acctbal") * F.pow(F.lit(10.0), F.col("c_custkey") % 8)).cast("long")
    return v.table("customer").select("c_custkey", media.exact_bytes(b, halves="even").alias("shown"))


@query("SELECT l_orderkey, cast(pow(2, floor(log2(l_extendedprice) + 0.5)) AS bigint) AS bucket, least(4.0, greatest(0.0, l_quantity / 3)) AS poster FROM lineitem")
def capacity_buckets(v):
    return v.table("lineitem").select("l_orderkey", media.capacity_bucket("l_extendedprice").alias("bucket"), media.poster_second("l_quantity").alias("poster"))


@query("SELECT c_custkey, regexp_full_match(n, '[a-z0-9]+(-[a-z0-9]+)*') AND length(n) <= 63 AS ok FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment WHEN 2 THEN 'a--b' ELSE 'card-' || cast(c_custkey AS string) END AS n FROM customer)")
def nicknames(v):
    k = F.col("c_custkey") % 4
    n = F.when(k == 0, F.lower("c_mktsegment")).when(k == 1, F.col("c_mktsegment")).when(k == 2, "a--b").otherwise(F.concat(F.lit("card-"), F.col("c_custkey").cast("string")))
    return v.table("customer").select("c_custkey", media.is_nickname(n).alias("ok"))


@query("SELECT e.event_id, CASE event_id % 4 WHEN 0 THEN 'READ_FAILED' WHEN 1 THEN 'SOURCE_UNAVAILABLE' ELSE 'INGEST_FAILED' END AS code, CASE event_id % 4 WHEN 0 THEN 'A media file could not be copied.' WHEN 1 THEN 'The source became unavailable.' ELSE 'The ingest could not be completed.' END AS message FROM events e")
def safe_errors(v):
    k = F.col("event_id") % 4
    return v.table("events").select("event_id", media.safe_error(F.when(k == 0, "READ_FAILED").when(k == 1, "SOURCE_UNAVAILABLE").when(k == 2, "EPERM")).alias("e")).select("event_id", F.col("e.code"), F.col("e.message"))


@query("SELECT id, CASE status WHEN 'failed' THEN 'RECOVERY_FAILED' END AS error_code, upper(substr(status, 1, 1)) || substr(status, 2) AS label FROM sessions")
def recovery_errors(v):
    return v.sessions.select("id", media.recovery_error("status")["error_code"].alias("error_code"), media.phase_label("status").alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'confirmed-existing' WHEN event_id % 3 = 1 THEN 'created-new' WHEN event_id % 2 = 0 THEN 'auto-strong' ELSE 'created-new' END AS kind FROM events")
def audit_kinds(v):
    k = F.col("event_id") % 3
    return v.table("events").select("event_id", media.audit_kind(F.when(k == 0, "existing").when(k == 1, "new"), F.when(F.col("event_id") % 2 == 0, "exact").otherwise("medium")).alias("kind"))


@query("SELECT doc_id, CASE WHEN text LIKE '%@%' THEN 'a' ELSE 'b' END AS k, length(trim(source)) AS n FROM documents WHERE source = 'src1' OR lang = 'de'".replace("length(trim(source))", "cast(length(trim(source)) AS int)"))
def disjunctive_filter(v):
    d = any_of(v.table("documents"), [F.col("source") == "src1", F.col("lang") == "de"])
    return d.select("doc_id", F.when(F.col("text").like("%@%"), "a").otherwise("b").alias("k"), F.length(core.non_empty("source")).alias("n"))


@query("SELECT count(*) AS n FROM orders a WHERE nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM nullif(o_orderpriority, '5-LOW')")
def null_safe_equality(v):
    return v.table("orders").filter(same(F.nullif("o_orderstatus", F.lit("P")), F.nullif("o_orderpriority", F.lit("5-LOW")))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k, cast(props AS json) IS NOT NULL AS ok FROM events")
def json_fields(v):
    return v.table("events").select("event_id", hashing.json_field("props", "k int")["k"].alias("k"), hashing.is_json("props").alias("ok"))


@query("SELECT page_id, rtrim(replace(replace(to_base64(encode('{\"path\":\"' || url || '\",\"id\":\"' || cast(page_id AS string) || '\"}')), '+', '-'), '/', '_'), '=') AS cursor FROM pages")
def page_cursors(v):
    return v.table("pages").select("page_id", hashing.cursor("url", F.col("page_id").cast("string")).alias("cursor"))


@query("SELECT 'art-' || cast(p_partkey AS string) AS k, sha256('{\"checksum\":\"' || p_name || '\",\"format\":\"webp\",\"height\":480,\"version\":1,\"width\":480}') AS cache_key FROM part")
def thumbnail_keys(v):
    return v.table("part").select(F.concat(F.lit("art-"), F.col("p_partkey").cast("string")).alias("k"), hashing.thumbnail_cache_key("p_name", 480, 480).alias("cache_key"))


@query("SELECT conv_id, turn, replace(cast(timestamp '2024-01-01 00:00:00' AS string), ' ', 'T') || 'Z [INFO] ' || role || ' turn (' || cast(length(text) AS string) || ' bytes) [redacted]' AS line FROM conversations")
def log_lines(v):
    c = v.table("conversations").select("conv_id", "turn", F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.col("conv_id").cast("string").alias("session_id"), F.lit("info").alias("level"), F.col("role").alias("phase"), F.lit("turn").alias("message"), F.lit("/card/a").alias("source_path"), F.lit(None).cast("string").alias("destination_path"), F.length("text").alias("bytes"))
    both = writers.log_lines(c.withColumn("session_id", F.concat_ws(":", "conv_id", "turn")), redact=True)
    key = F.split(F.get_json_object("structured", "$.sessionId"), ":")
    return both.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), F.col("text").alias("line"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'acme' END AS make, CASE WHEN p_size % 2 = 0 THEN cast(p_size AS double) END AS width, (p_size % 3 = 0) AS gps, cast(p_size % 2 + 1 AS int) AS warnings FROM part")
def metadata_tags(v):
    t = F.create_map(
        F.lit("Make"), F.when(F.col("p_size") % 3 == 0, " acme ").otherwise("  "), F.lit("SourceImageWidth"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("-1"), F.lit("GPSLatitude"), F.when(F.col("p_size") % 3 == 0, "1.5"), F.lit("GPSLongitude"), F.lit("2"),
        F.lit("Warning"), F.when(F.col("p_size") % 2 == 0, F.lit("odd")).otherwise('["a", " b ", ""]'),
    )
    n = media.normalize_tags("tags")
    return v.table("part").select("p_partkey", t.alias("tags")).select("p_partkey", n["camera_make"].alias("make"), n["width"].alias("width"), n["gps_present"].alias("gps"), F.size(n["warnings"]).alias("warnings"))


@query("SELECT page_id, (CASE page_id % 5 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END) AS safe FROM pages")
def path_safety(v):
    k = F.col("page_id") % 5
    p = F.when(k == 0, "../a").when(k == 1, "/abs").when(k == 2, "DCIM/a..b.jpg").when(k == 3, "C:\\x").otherwise("a/b")
    return v.table("pages").select("page_id", F.coalesce(paths.is_safe_relative(p), F.lit(False)).alias("safe"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'DCIM/a.jpg' WHEN 2 THEN 'b' WHEN 3 THEN 'a/b' END AS path FROM part")
def relative_paths(v):
    k = F.col("p_partkey") % 4
    p = F.when(k == 0, "DCIM//./x/../a.jpg").when(k == 1, "../up").when(k == 2, "./b").otherwise("a/./b")
    return v.table("part").select("p_partkey", paths.canonical_path_key(paths.normalize_relative_path(p)).alias("path"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.mp4' END AS ext FROM part")
def setting_extensions(v):
    k = F.col("p_partkey") % 3
    return v.table("part").select("p_partkey", paths.normalize_extension(F.when(k == 0, " .JPG ").when(k == 1, "mp4").otherwise("tar.gz")).alias("ext"))


@query("SELECT id FROM files WHERE extension IN ('.jpg', '.mov', '.nef') AND relative_path NOT LIKE 'Brand#1/%'")
def listing_filters(v):
    return listing.filter_listing(v.files, excluded=["brand#1"]).select("id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'never' ELSE strftime(o_orderdate, '%b %-d, %Y, 10:05 AM') END AS time, CASE WHEN o_orderkey % 3 = 0 THEN '2021-02-30' ELSE strftime(o_orderdate, '%b %-d') END AS day FROM orders")
def display_times(v):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'10:05:00'Z'")
    return v.table("orders").select("o_orderkey", dates.display_time(F.when(F.col("o_orderkey") % 4 == 0, "never").otherwise(iso)).alias("time"), dates.display_day(F.when(F.col("o_orderkey") % 3 == 0, "2021-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("day"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '2020-05-06T07:08:09.000Z' ELSE '2021-01-02T03:04:05.000Z' END AS at, CASE WHEN p_size % 3 = 0 THEN 'session-start' ELSE 'filesystem-modifiedAt' END AS source, 'unknown' AS media_type, cast(0 AS int) AS minutes FROM part")
def fallback_metadata(v):
    m = dates.fallback_metadata(F.when(F.col("p_size") % 3 == 0, "bad").otherwise("2021-01-02T03:04:05Z"), F.lit("2020-05-06T07:08:09Z"))
    return v.table("part").select("p_partkey", m.alias("m")).select("p_partkey", F.col("m.capture.capture_at").alias("at"), F.col("m.capture.capture_at_source").alias("source"), "m.media_type", F.col("m.capture.capture_offset_minutes").alias("minutes"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 9007199254740991 END AS capacity, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS fact, CASE WHEN p_size % 2 = 0 THEN 'a b' END AS text, cast(floor(p_retailprice - 1000 + 0.5) AS bigint) AS rounded, strftime(timestamp '2021-01-01' + to_seconds(p_partkey), '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM part")
def small_values(v):
    k = F.col("p_size") % 4
    digits = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, "12x").when(k == 2, "9007199254740992").otherwise("9007199254740991")
    at = F.date_format(F.timestamp_seconds(F.col("p_partkey") + 1609459200), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return v.table("part").select(
        "p_partkey", core.safe_capacity(digits).alias("capacity"), core.boolean_fact(F.when(k == 0, "1").when(k == 1, "false").when(k == 2, "true").otherwise("yes")).alias("fact"), core.non_empty(F.when(F.col("p_size") % 2 == 0, " a b ").otherwise("  ")).alias("text"),
        core.js_round(F.col("p_retailprice") - 1000).cast("long").alias("rounded"), core.iso(core.instant(at)).alias("at"),
    )


@query("SELECT n_nationkey, format('{:,}', n_nationkey * 1000 + 2) || ' items' AS items, '2021-02-03: ' || n_nationkey || CASE WHEN n_nationkey = 1 THEN ' item' ELSE ' items' END AS label FROM nation")
def count_labels(v):
    n = F.col("n_nationkey")
    return v.table("nation").select("n_nationkey", media.count_label(n * 1000 + 2).alias("items"), media.day_label(F.lit("2021-02-03"), n).alias("label"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS due FROM part")
def thumbnails_due(v):
    k = F.col("p_size") % 5
    state = F.when(k == 0, None).when(k == 3, "ready").otherwise("failed")
    attempts = F.when(k == 2, 5).otherwise(2)
    return v.table("part").select("p_partkey", F.coalesce(media.retry_due(state, attempts, F.lit(5), F.when(k == 4, 10), F.lit(10)), F.lit(False)).alias("due"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'confirmed-strong-or-fingerprint' WHEN 1 THEN 'confirmed-strong-or-fingerprint' WHEN 2 THEN 'user-confirmed-mismatch' ELSE 'rejected-mismatch' END AS decision, p_size % 3 <> 1 AS same FROM part")
def reacquired_sources(v):
    k, f = F.col("p_size") % 4, F.col("p_size") % 3
    d = media.reacquired_decision(F.when(k == 0, "v").when(k > 1, "v"), F.when(k == 0, "v").when(k > 1, "w"), F.lit("p"), F.lit("p"), k == 2)
    return v.table("part").select("p_partkey", d.alias("decision"), media.same_facts(F.lit(1), F.lit("t"), F.when(f == 0, "x").when(f == 1, "y"), F.lit(1), F.lit("t"), F.when(f != 2, "x")).alias("same"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'a/b' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'x' END AS exclusion, p_size % 5 IN (0, 4) AS inside FROM part")
def path_rules(v):
    k = F.col("p_size") % 5
    value = F.when(k == 0, " a/b ").when(k == 1, "/abs").when(k == 2, "a/../b").when(k == 3, " ").otherwise("x")
    path = F.when(k == 0, "/card/a/b").when(k == 1, "/cards/a").when(k == 2, "/card/../x").when(k == 3, "/other").otherwise("/card")
    return v.table("part").select("p_partkey", paths.normalize_exclusion(value).alias("exclusion"), paths.under_root(path, F.lit("/card/")).alias("inside"))


@query("SELECT count(*) = 7 AS ok FROM part")
def plan_total(v):
    return plan.plan_total_matches(7, v.table("part"))


# constraints


@query("""SELECT 'lifecycle' AS rule, count(*) AS violations FROM copies WHERE status = 'failed' AND error_message IS NULL UNION ALL SELECT 'destination', cast(coalesce(sum(1), 0) AS bigint) FROM (SELECT destination_path FROM copies GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'source of session', count(*) FROM sessions s WHERE s.source_id NOT IN (SELECT id FROM sources WHERE kind = 'folder') UNION ALL SELECT 'session kind', count(*) FROM sessions WHERE status NOT IN ('completed', 'failed') UNION ALL SELECT 'paths', count(*) FROM files WHERE cast(id AS bigint) % 7 < 2
    UNION ALL SELECT 'thumbnail owner', count(*) FROM thumbnails t WHERE t.copied_file_id NOT IN (SELECT id FROM copies WHERE status = 'verified') UNION ALL SELECT 'terminal', count(*) FROM sessions WHERE (status = 'failed' AND cast(id AS bigint) % 4 = 0) OR (status = 'copying' AND cast(id AS bigint) % 5 = 0) OR (status = 'completed' AND cast(id AS bigint) % 3 = 0)""")
def constraint_report(v):
    folders, id = v.sources.filter("kind = 'folder'"), F.col("id").cast("long")
    # rows that break the rules on paths and on sessions that are over
    paths_ = v.files.withColumn("relative_path", F.when(id % 7 == 0, F.concat(F.lit("../"), "relative_path")).when(id % 7 == 1, F.concat(F.lit("/"), "relative_path")).otherwise(F.col("relative_path")))
    over = v.sessions.withColumn("error_message", F.when((F.col("status") == "failed") & (id % 4 == 0), None).otherwise(F.col("error_message")))
    over = over.withColumn("completed_at", F.when((F.col("status") == "copying") & (id % 5 == 0), F.col("started_at")).when((F.col("status") == "completed") & (id % 3 == 0), None).otherwise(F.col("completed_at")))
    return constraints.report({
        "lifecycle": constraints.lifecycle(v.copies), "destination": constraints.duplicates(v.copies, ["destination_path"]), "source of session": constraints.orphans(v.sessions, ["source_id"], folders, ["id"]), "session kind": constraints.not_in(v.sessions, "status", ["completed", "failed"]),
        "paths": constraints.unsafe_paths(paths_), "thumbnail owner": constraints.thumbnails_without_copy(v.thumbnails, v.copies), "terminal": constraints.terminal_fields(over),
    })


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def last_errors(v):
    e = v.table("events").select("event_id")
    return last_n(e, [F.desc("event_id")], 100, [F.asc("event_id")])


@query("SELECT id, size_bytes FROM files WHERE id = '42'")
def point_lookup(v):
    return by_key(v.files, "id", "42").select("id", "size_bytes")


@query("SELECT id, started_at, cast(row_number() OVER (ORDER BY started_at DESC, id DESC) AS int) AS place FROM sessions WHERE source_id = '9'")
def sessions_of_source(v):
    # ids of rows in one partition count up in its order, which makes the order a value
    return range_of(v.sessions, "source_id", "9", F.desc("started_at"), F.desc("id")).coalesce(1).select("id", "started_at", (F.monotonically_increasing_id() + 1).cast("int").alias("place"))


# volumes: trees of disks built from rows, one for each supplier

TREE_SQL = """SELECT s_suppkey, '{{"blockdevices":[{{"name":"sd' || cast(s_suppkey as string) || '","rm":"' || CASE s_suppkey % 3 WHEN 0 THEN '1' ELSE '0' END || '","tran":"' || CASE s_suppkey % 3 WHEN 1 THEN 'USB' ELSE 'sata' END || '","vendor":" V ","children":[{{"name":"a","label":"'
    || CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE ' ' END || '","fstype":"' || CASE WHEN s_suppkey % 11 = 0 THEN 'tmpfs' ELSE 'exfat' END || '","size":"' || cast(s_suppkey * 1000 as string) || '","mountpoints":["/media/c' || cast(s_suppkey as string) || '",null]}},{{"name":"b","uuid":"U'
    || cast(s_suppkey as string) || '","mountpoint":"' || CASE s_suppkey % 7 WHEN 0 THEN '/var/lib/docker' WHEN 1 THEN '/usr//' WHEN 2 THEN '/proc/x' WHEN 3 THEN '/usrlocal' ELSE '/home' END || '"}}]}}]}}' AS lsblk FROM {supplier}"""


@query("""WITH s AS (SELECT *, s_suppkey % 3 = 0 AS rm, CASE WHEN s_suppkey % 3 = 1 THEN 'usb' ELSE 'sata' END AS tran FROM supplier WHERE s_suppkey % 3 <> 2 AND s_suppkey % 7 > 1),
    v AS (SELECT s.*, '/media/c' || cast(s_suppkey AS string) AS mount_path, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS volume_label, NULL AS platform_volume_id, 'exfat' AS fs_type, s_suppkey * 1000 AS capacity_bytes FROM s WHERE s_suppkey % 11 <> 0
      UNION ALL SELECT s.*, CASE WHEN s_suppkey % 7 = 3 THEN '/usrlocal' ELSE '/home' END, NULL, 'U' || cast(s_suppkey AS string), NULL, NULL FROM s WHERE s_suppkey % 7 <> 2)
    SELECT cast(s_suppkey AS bigint) AS s_suppkey, mount_path, coalesce(volume_label, regexp_extract(mount_path, '[^/]*$')) AS display_name, volume_label, platform_volume_id, fs_type, cast(capacity_bytes AS bigint) AS capacity_bytes, 'V' AS device_vendor, CASE WHEN s_suppkey % 4 = 0 AND tran = 'mmc' THEN 'SD' END AS device_model, tran AS transport, rm AS removable_device FROM v""")
def linux_volumes(v):
    out = volumes.linux_volumes(v.sql(TREE_SQL).withColumn("s_suppkey", F.col("s_suppkey").cast("long")))
    return out.select("s_suppkey", "mount_path", "display_name", "volume_label", "platform_volume_id", "fs_type", "capacity_bytes", "device_vendor", "device_model", F.col("raw_facts")["transport"].alias("transport"), (F.col("raw_facts")["removableDevice"] == "true").alias("removable_device"))


WINDOWS_SQL = r"""SELECT s_suppkey, '{{"AccessPaths":["' || CASE WHEN s_suppkey % 2 = 0 THEN 'e' ELSE 'F' END || ':\\\\"],"Label":"' || CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END || '","FileSystem":"exFAT","Capacity":' || cast(s_suppkey * 64 as string) || ',"DriveType":"' || CASE s_suppkey % 4 WHEN 0 THEN 'Removable' ELSE 'Fixed' END
    || '","SerialNumber":"S' || cast(s_suppkey as string) || '","BusType":"' || CASE s_suppkey % 4 WHEN 1 THEN 'SD' ELSE 'SATA' END || '"' || CASE s_suppkey % 5 WHEN 0 THEN ',"IsRemovable":false' WHEN 1 THEN ',"IsRemovable":true' ELSE '' END || CASE s_suppkey % 13 WHEN 0 THEN ',"IsSystem":true' ELSE '' END || '}}' AS volumes FROM {supplier}"""


@query(r"""SELECT cast(s_suppkey AS bigint) AS s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'E:\' ELSE 'F:\' END AS mount_path, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 2 = 0 THEN 'E:' ELSE 'F:' END AS display_name, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS volume_label,
    'serial:S' || cast(s_suppkey AS string) AS platform_volume_id, 'exFAT' AS fs_type, cast(s_suppkey * 64 AS bigint) AS capacity_bytes FROM supplier WHERE s_suppkey % 13 <> 0 AND s_suppkey % 5 <> 0 AND (s_suppkey % 5 = 1 OR s_suppkey % 4 < 2)""")
def windows_volumes(v):
    out = volumes.windows_volumes(v.sql(WINDOWS_SQL).withColumn("s_suppkey", F.col("s_suppkey").cast("long")))
    return out.select("s_suppkey", "mount_path", "display_name", "volume_label", "platform_volume_id", "fs_type", "capacity_bytes")


@query("SELECT r_name AS mount_path, 's' || cast(r_regionkey AS string) AS source_id FROM region WHERE r_regionkey % 2 = 0")
def source_markers(v):
    r = v.table("region").select(F.col("r_name").alias("mount_path"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit('{"schemaVersion":1,"sourceId":"s'), F.col("r_regionkey").cast("string"), F.lit('","nickname":null,"createdAt":"a","updatedAt":"b"}'))).otherwise('{"schemaVersion":2').alias("marker"))
    return records.read_markers(r).select("mount_path", "source_id")




# the keyed store: every kind of commit over rows of a table, written and read back


def _rows(v, condition: str, value: str):
    return v.sql(f"SELECT cast(c_custkey AS string) AS key, {value} AS value_json, cast(c_nationkey AS string) AS updated_at FROM {{customer}} WHERE {condition}")


@query("""SELECT cast(c_custkey AS string) AS key, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 3 = 0 THEN 'back' WHEN c_custkey % 13 = 0 THEN c_name || '?!' WHEN c_custkey % 7 = 0 THEN c_mktsegment || '!' ELSE c_name || CASE WHEN c_custkey % 7 = 1 THEN '!' ELSE '' END END AS value_json,
    cast(c_nationkey AS string) AS updated_at FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey % 3 = 0""")
def store_changes(v):
    """Appends, merges, deletions, an update and a compaction between them."""
    store = Store(v.spark, new_folder(v.spark, "store"))
    store.append("settings", _rows(v, "c_custkey % 2 = 0", "c_name"))
    store.append("settings", _rows(v, "c_custkey % 2 = 1", "c_name"))
    store.merge("settings", _rows(v, "c_custkey % 7 = 0", "c_mktsegment"))
    store.merge("settings", _rows(v, "c_custkey % 11 = 0", "c_name").withColumn("_deleted", F.lit(True)))
    store.compact("settings")
    store.merge("settings", _rows(v, "c_custkey % 13 = 0 AND c_custkey % 11 > 0", "c_name || '?'"))
    store.update("settings", lambda t: maintenance.changed(t, (F.col("key") % 7 < 2) & (F.col("key") % 13 != 0), {"value_json": F.concat("value_json", F.lit("!"))}))
    store.update("settings", lambda t: maintenance.changed(t, F.col("key") % 13 == 0, {"value_json": F.concat("value_json", F.lit("!"))}))
    store.append("settings", _rows(v, "c_custkey % 11 = 0 AND c_custkey % 3 = 0", "'back'"))
    return store.read("settings")


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'removed' ELSE 'arrived' END AS change, CASE WHEN event_id % 4 = 0 THEN event_type END AS known FROM events), g AS (SELECT user_id, max(event_id) FILTER (WHERE change = 'removed') AS gone FROM e GROUP BY 1),
    k AS (SELECT e.* FROM e JOIN g USING (user_id) WHERE change <> 'removed' AND (gone IS NULL OR event_id > gone)) SELECT cast(user_id % 16 AS string) AS host, cast(user_id AS string) AS key, max(event_id) AS last, max_by(known, event_id) FILTER (WHERE known IS NOT NULL) AS known_source_id FROM k GROUP BY 1, 2""")
def registry_stream(v):
    """The registry as keyed state of a stream over the events, in several micro-batches."""
    spark, folder = v.spark, new_folder(v.spark, "registry")
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    changes = v.table("events").select(
        (F.col("user_id") % 16).cast("string").alias("host"), F.col("event_id").alias("poll"), F.when(F.col("event_type") == "error", "removed").otherwise("arrived").alias("change"), F.col("user_id").cast("string").alias("strong_id"),
        F.col("event_id").cast("string").alias("path"), F.lit("x").alias("label"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("known_source_id"),
    )
    files = spark.sparkContext.defaultParallelism  # of each of three micro-batches
    changes.repartition(3 * files, "poll").write.parquet(f"{folder}/changes")
    feed = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/changes")
    old = spark.conf.get(key)
    spark.conf.set(key, rocks)
    try:
        out = registry.stream_registry(feed).writeStream.outputMode("update").foreachBatch(lambda df, epoch: df.withColumn("at", F.lit(epoch)).write.mode("append").parquet(f"{folder}/updates"))
        out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, old)
    return registry.present(spark.read.parquet(f"{folder}/updates")).select("host", "key", F.col("path").cast("long").alias("last"), "known_source_id")


def _file_tree(v) -> str:
    """A folder for each nation with a file for each of its suppliers, written in tasks; returns the root."""
    from urllib.parse import urlparse

    root = urlparse(new_folder(v.spark, "tree")).path

    def write(batches):
        import os

        for b in batches:
            for path, size in zip(b["path"].to_pylist(), b["size"].to_pylist(), strict=True):
                full = os.path.join(root, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(b"x" * size)
            yield b.select(["path"])

    v.sql(f"SELECT {TREE_PATH} AS path, cast(s_suppkey % 50 AS int) AS size FROM {{supplier}}").mapInArrow(write, "path string").count()
    return root


TREE_PATH = """CASE s_nationkey % 5 WHEN 0 THEN '.hidden' WHEN 1 THEN '$Recycle.Bin' ELSE 'n' || cast(s_nationkey AS string) END || '/' || CASE WHEN s_suppkey % 3 = 0 THEN 'deep/er/' ELSE '' END || CASE WHEN s_suppkey % 17 = 0 THEN '.' ELSE '' END
    || 'f' || cast(s_suppkey AS string) || CASE s_suppkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mov' WHEN 2 THEN '.txt' ELSE '.Nef' END"""
TREE_FILES = f"t AS (SELECT {TREE_PATH} AS p, cast(s_suppkey % 50 AS bigint) AS size_bytes, s_suppkey, s_nationkey FROM supplier), f AS (SELECT p, regexp_extract(p, '[^/]*$') AS name, size_bytes, s_suppkey FROM t WHERE s_nationkey % 5 > 1 AND s_suppkey % 17 > 0 AND s_suppkey % 4 <> 2)"


@query(f"WITH {TREE_FILES} SELECT p AS relative_path, name, lower(regexp_extract(name, '[.][^.]*$')) AS extension, size_bytes, row_number() OVER (ORDER BY lower(p), p) AS place FROM f")
def listed_tree(v):
    """A scan of files: extensions in any case, hidden and excluded names left out, in the order of the walk."""
    from pyspark.sql import Window

    files = listing.files_of(listing.scan_media(v.spark, _file_tree(v)))
    return files.select("relative_path", "name", "extension", "size_bytes", F.row_number().over(Window.orderBy(F.lower("canonical_path_key"), "canonical_path_key", "relative_path")).cast("long").alias("place"))


@query(f"WITH {TREE_FILES} SELECT p AS relative_path, size_bytes FROM f WHERE p LIKE 'n2/%' AND s_suppkey % 4 = 1 UNION ALL SELECT p, size_bytes FROM f WHERE s_suppkey % 9 = 1 AND p NOT LIKE 'n2/%'")
def listed_by_filters(v):
    """A listing below a prefix with one extension, and one of exact paths: filters that the source takes."""
    root = _file_tree(v)
    flat = listing.list_media(v.spark, root).select("relative_path", "extension", "size_bytes")
    below = flat.filter(F.col("relative_path").startswith("n2/") & (F.col("extension") == ".mov")).drop("extension")
    asked = v.sql(f"SELECT {TREE_PATH} AS p FROM {{supplier}} WHERE s_suppkey % 9 = 1 AND s_nationkey % 5 > 1 AND s_suppkey % 17 > 0 AND s_suppkey % 4 <> 2").filter("p not like 'n2/%'")
    found = listing.lookup_files(v.spark, root, asked.select(F.col("p").alias("relative_path"), F.lit(None).cast("long").alias("hash_if_size")))
    return below.unionByName(found.filter("state = 'file'").select("relative_path", "size_bytes"))
