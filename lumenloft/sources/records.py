"""Small records: on-card markers, settings, metadata tags, thumbnail bytes."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloft.functions import dates, media
from lumenloft.sources.readers import Limits, read_all

MARKER = "schemaVersion int, sourceId string, nickname string, createdAt string, updatedAt string"
MAX_THUMBNAIL = 5 * 1024 * 1024
#: The settings that hold where none are stored.
DEFAULTS = {
    "schemaVersion": 2, "destinationRoot": None, "verifyCopies": True, "collisionStrategy": "prompt", "preserveTimestamps": True, "allowedExtensions": [".jpg", ".jpeg", ".png", ".heic", ".mov", ".mp4"], "excludedPathPatterns": [".Spotlight-V100", ".Trashes"],
    "destinationTemplate": "{YYYY}/{YYYY-MM-DD}/{sourceLabelOrCamera}/{originalFilename}", "copyConcurrency": 1, "groupByNicknameInDestination": False, "perCardEventLog": False, "autoIngest": False,
    "thumbnail": {"width": 480, "height": 480, "cachePolicy": "bounded", "cacheLimitBytes": 2_000_000_000},
}
STRATEGIES = ("prompt", "skip", "rename")


def read_markers(texts: DataFrame, column: str = "marker") -> DataFrame:
    """Valid markers only: anything else counts as none."""
    keys = [c for c in texts.columns if c != column]
    m = texts.select(*keys, F.from_json(column, MARKER).alias("m"), F.get_json_object(column, "$.nickname").alias("n"))
    full = lambda c: F.coalesce(F.col(f"m.{c}") != "", F.lit(False))
    ok = (F.col("m.schemaVersion") == 1) & full("sourceId") & full("createdAt") & full("updatedAt") & (F.col("n").isNull() | (F.col("n") != ""))
    return m.filter(ok).select(*keys, F.col("m.sourceId").alias("source_id"), F.col("m.nickname").alias("nickname"), F.col("m.createdAt").alias("created_at"), F.col("m.updatedAt").alias("updated_at"))


def check_settings(s: dict) -> list[str]:
    """What is wrong with settings; nothing if they hold."""
    import re

    out = [f"unknown {k}" for k in s if k not in DEFAULTS] + [f"missing {k}" for k in DEFAULTS if k not in s]
    if out:
        return out
    flag = lambda *ks: [k for k in ks if not isinstance(s[k], bool)]
    out += flag("preserveTimestamps", "groupByNicknameInDestination", "perCardEventLog", "autoIngest")
    whole = lambda v, a, b: isinstance(v, int) and not isinstance(v, bool) and a <= v <= b
    if s["schemaVersion"] != 2 or s["verifyCopies"] is not True:
        out.append("schemaVersion or verifyCopies")
    if not (s["destinationRoot"] is None or isinstance(s["destinationRoot"], str) and s["destinationRoot"]):
        out.append("destinationRoot")
    if s["collisionStrategy"] not in STRATEGIES:
        out.append("collisionStrategy")
    ext = s["allowedExtensions"]
    if not (isinstance(ext, list) and 1 <= len(ext) <= 128 and all(isinstance(e, str) and re.fullmatch(r"\.[a-z0-9]+", "." + e.strip().removeprefix(".").lower()) for e in ext)):
        out.append("allowedExtensions")
    bad = lambda e: not isinstance(e, str) or not 1 <= len(e.strip()) <= 512 or re.match(r"[\\/]|[A-Za-z]:[\\/]", e.strip()) or {"..", "."} & set(re.split(r"[\\/]", e.strip()))
    if not isinstance(s["excludedPathPatterns"], list) or len(s["excludedPathPatterns"]) > 128 or any(map(bad, s["excludedPathPatterns"])):
        out.append("excludedPathPatterns")
    if not isinstance(s["destinationTemplate"], str) or not 1 <= len(s["destinationTemplate"].strip()) <= 1024:
        out.append("destinationTemplate")
    if not whole(s["copyConcurrency"], 1, 4):
        out.append("copyConcurrency")
    t = s["thumbnail"]
    if not isinstance(t, dict) or set(t) != set(DEFAULTS["thumbnail"]) or not whole(t["width"], 64, 2048) or not whole(t["height"], 64, 2048) or t["cachePolicy"] not in ("bounded", "session") or not whole(t["cacheLimitBytes"], 1, 100_000_000_000):
        out.append("thumbnail")
    return out


def read_settings(text: str | None) -> dict:
    """Stored settings; those of older versions are carried over, those of newer ones as far as known, and what can't be
    read gives the defaults. One small record, on the driver."""
    try:
        s = json.loads(text or "null")
    except ValueError:
        s = None
    if not isinstance(s, dict):
        return dict(DEFAULTS)
    if not check_settings(s):
        return s
    if isinstance(s.get("schemaVersion"), (int, float)) and s["schemaVersion"] > 2:
        moved = DEFAULTS | {k: v for k, v in s.items() if k in DEFAULTS} | {"schemaVersion": 2}
    else:
        root = s.get("destinationRoot")
        moved = DEFAULTS | {"destinationRoot": root if isinstance(root, str) else None, "thumbnail": DEFAULTS["thumbnail"] | {"cacheLimitBytes": s.get("thumbnailCacheLimitBytes")}}
        moved |= {k: s.get(k) for k in ("collisionStrategy", "preserveTimestamps", "allowedExtensions", "excludedPathPatterns", "copyConcurrency")}
    return moved if not check_settings(moved) else dict(DEFAULTS)


def read_tags(files: DataFrame, reader: Callable[[str], dict[str, str]], path: str = "path", limits: Limits = Limits()) -> DataFrame:
    """path, tags (a map of texts), error: a reader runs in the tasks, in a bounded pool of processes, and a file that it
    fails, hangs or crashes on is an error row. Which library reads tags is the caller's choice."""

    def texts(p: str) -> list[tuple[str, str | None]]:
        return [(str(k), None if v is None else str(v)) for k, v in reader(p).items()]

    def run(batches):
        import pyarrow as pa

        items = (p for b in batches for p in b["path"].to_pylist())
        rows = []

        def made():
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.map_(pa.string(), pa.string())), pa.array(cols[2], pa.string())], ["path", "tags", "error"])

        for row in read_all(items, texts, limits):
            rows.append(row)
            if len(rows) >= 1000:
                yield made()
                rows.clear()
        yield made()

    return files.select(F.col(path).alias("path")).mapInArrow(run, "path string, tags map<string,string>, error string")


def metadata(tagged: DataFrame) -> DataFrame:
    """tagged(file, extension, modified_at, session_started_at, tags) with normalised tags, media type and capture date;
    without tags, only a date."""
    t = lambda k: F.element_at("tags", F.lit(k)).alias(k)
    names = [n.split()[0] for n in dates.CANDIDATES.split(", ")]
    capture = dates.normalize_capture_date("dates", "modified_at", "session_started_at")
    rows = tagged.select("*", F.struct(*[t(n) for n in names]).alias("dates"), media.normalize_tags("tags").alias("n"))
    return rows.select("file", media.media_type("extension", "n.mime_type").alias("media_type"), "n.*", capture.alias("capture"))


def thumbnail_bytes(spark: SparkSession, folder: str, artifacts: DataFrame) -> DataFrame:
    """cache_key, content of artifacts whose file has the recorded size and at most 5 MiB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content").filter(F.col("length") <= MAX_THUMBNAIL)
    a = artifacts.select("cache_key", F.element_at(F.split("relative_path", "/"), -1).alias("name"), F.col("size_bytes").alias("length"))
    return a.join(files, ["name", "length"]).select("cache_key", "content")
