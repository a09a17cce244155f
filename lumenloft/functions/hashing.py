"""Digests, fingerprints and codecs, all JVM-side."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloft.functions.core import col, instant, iso, safe_integer


def content_sha256(content) -> Column:
    return F.sha2(col(content), 256)


def content_facts(content) -> Column:
    return F.struct(content_sha256(content).alias("sha256"), F.octet_length(col(content)).cast("long").alias("size_bytes"))


def short_checksum(checksum) -> Column:
    """The first 8 of the first run of 8 or more hexadecimal digits, else of the checksum's own digest."""
    found = F.substring(F.regexp_extract(F.lower(col(checksum)), "[a-f0-9]{8,}", 0), 1, 8)
    return F.coalesce(F.nullif(found, F.lit("")), F.substring(F.sha2(col(checksum), 256), 1, 8))


def _field(text: Column) -> Column:
    """A text's bytes behind their number as 4 bytes, big-endian."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")), F.encode(text, "UTF-8"))


def quick_fingerprint(path_key, size_bytes, modified_at, session_started_at=None, namespace: str = "quick-fingerprint.v1") -> Column:
    """A digest of path key, size and modification time, without reading the file. A modification time that can't be read
    gives way to the session's start, if given. `namespace` separates catalogs; a catalog made elsewhere keeps its own."""
    when = instant(modified_at) if session_started_at is None else F.coalesce(instant(modified_at), instant(session_started_at))
    fields = [F.lit(namespace), col(path_key), safe_integer(size_bytes).cast("string"), iso(when)]
    return F.concat(F.lit("quick-v1:"), F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def thumbnail_cache_key(checksum, width: int, height: int, format: str = "webp", version: int = 1) -> Column:
    spec = F.struct(col(checksum).alias("checksum"), F.lit(format).alias("format"), F.lit(height).alias("height"), F.lit(version).alias("version"), F.lit(width).alias("width"))
    return F.sha2(F.to_json(spec), 256)


def source_id(fingerprint) -> Column:
    return F.concat(F.lit("source-"), F.right(col(fingerprint), F.lit(24)))


def version_key(quick, session) -> Column:
    return F.concat(col(quick), F.lit(":"), col(session))


def cursor(path, id) -> Column:
    """A page cursor: base64url of JSON, without padding."""
    body = F.to_json(F.struct(col(path).alias("path"), col(id).alias("id")))
    return F.rtrim(F.translate(F.base64(F.encode(body, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def encode_cursor(path: str, id) -> str:
    return base64.urlsafe_b64encode(json.dumps({"path": path, "id": id}, separators=(",", ":"), ensure_ascii=False).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple[str, object]:
    raw = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    if not isinstance(raw, dict) or set(raw) != {"path", "id"}:
        raise ValueError("not a page cursor")
    return raw["path"], raw["id"]


def json_text(*columns) -> Column:
    return F.to_json(F.struct(*[col(c) for c in columns]), {"ignoreNullFields": "false"})


def json_field(text, schema: str) -> Column:
    """Permissive read: null where the text isn't JSON."""
    return F.from_json(col(text), schema)


def is_json(text) -> Column:
    return F.try_parse_json(col(text)).isNotNull()
