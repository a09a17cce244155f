"""Sinks: verified copies, manifests, logs, markers."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloft.functions.core import col
from lumenloft.sources.readers import Limits, read_all

CHUNK = 256 * 1024
OUTCOMES = "file string, outcome string, checksum string, copied_bytes long, error_code string"
MARKER_FOLDER = ".lumenloft"


def copy_one(source: str, destination: str, root: str, temp: str) -> tuple[str, str | None, int, str | None]:
    """Copy, read back, compare, and move into place without ever replacing a file: (outcome, sha256, bytes, error)."""
    if os.path.commonpath([os.path.realpath(root), os.path.realpath(os.path.dirname(destination))]) != os.path.realpath(root):
        return "failed", None, 0, "DESTINATION_INVALID"
    n = 0
    try:
        before = os.stat(source)
        os.makedirs(os.path.dirname(destination), exist_ok=True)
        h = hashlib.sha256()
        with open(source, "rb") as a, open(temp, "wb") as b:
            while piece := a.read(CHUNK):
                h.update(piece)
                b.write(piece)
                n += len(piece)
            b.flush()
            os.fsync(b.fileno())
        after = os.stat(source)
        if (before.st_size, before.st_mtime_ns, before.st_ino) != (after.st_size, after.st_mtime_ns, after.st_ino) or n != before.st_size:
            return "failed", None, n, "SOURCE_CHANGED"
        again = hashlib.sha256()
        with open(temp, "rb") as b:
            while piece := b.read(CHUNK):
                again.update(piece)
        if again.digest() != h.digest():
            return "failed", None, n, "VERIFY_FAILED"
        os.utime(temp, ns=(before.st_atime_ns, before.st_mtime_ns))
        try:
            os.link(temp, destination)
        except FileExistsError:
            with open(destination, "rb") as d:
                if hashlib.file_digest(d, "sha256").digest() == h.digest() and os.stat(destination).st_size == n:
                    return "completed", h.hexdigest(), n, None  # a retried task meets its own earlier copy
            return "collision", None, n, "DESTINATION_COLLISION"
        except OSError:
            try:
                with open(destination, "xb") as d, open(temp, "rb") as b:
                    while piece := b.read(CHUNK):
                        d.write(piece)
                    d.flush()
                    os.fsync(d.fileno())
            except FileExistsError:
                return "collision", None, n, "DESTINATION_COLLISION"
        return "completed", h.hexdigest(), n, None
    except FileNotFoundError:
        return "failed", None, n, "SOURCE_UNAVAILABLE"
    except OSError:
        return "failed", None, n, "COPY_FAILED"
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temp)


def copy_files(plan: DataFrame, source_root: str, destination_root: str, session: str) -> DataFrame:
    """plan(file, relative_path, destination_path) -> outcomes. Tasks may run twice: the temporary name is fixed for a
    file, and a destination that already holds the same content counts as done."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for f, src, dst in zip(*[b[c].to_pylist() for c in ("file", "relative_path", "destination_path")], strict=True):
                full = os.path.join(destination_root, *dst.split("/"))
                temp = os.path.join(os.path.dirname(full), f".{os.path.basename(full)}.{session}.{f}.tmp")
                out.append((f, *copy_one(os.path.join(source_root, *src.split("/")), full, destination_root, temp)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "outcome", "checksum", "copied_bytes", "error_code"])

    return plan.select(F.col("file").cast("string"), "relative_path", "destination_path").mapInArrow(run, OUTCOMES)


def manifest_json(rows: DataFrame, by: str = "ingest_session_id") -> DataFrame:
    """session, manifest: a session's rows as one JSON document in order of path. A manifest is one file by its format."""
    fields = [c for c in rows.columns if c != by]
    items = F.array_sort(F.collect_list(F.struct("relative_path", *[c for c in fields if c != "relative_path"])))
    made = rows.groupBy(by).agg(items.alias("files"))
    return made.select(F.col(by).alias("session"), F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col(by).alias("session"), F.size("files").alias("fileCount"), "files"), {"ignoreNullFields": "false"}).alias("manifest"))


def write_atomically(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temp, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def log_lines(events: DataFrame, redact: bool = False) -> DataFrame:
    """structured, text: events(timestamp, session_id, level, phase, message, source_path, destination_path, bytes) as JSON
    (absent fields left out) and as a line to read."""
    hide = lambda c: F.when(col(c).isNotNull(), F.lit("[redacted]")) if redact else col(c)
    e = events.select("timestamp", F.col("session_id").alias("sessionId"), "level", "phase", "message", hide("source_path").alias("sourcePath"), hide("destination_path").alias("destinationPath"), "bytes")
    size: Column = F.coalesce(F.concat(F.lit(" ("), F.col("bytes").cast("string"), F.lit(" bytes)")), F.lit(""))
    where = F.concat_ws(" -> ", "sourcePath", "destinationPath")
    text = F.concat("timestamp", F.lit(" ["), F.upper("level"), F.lit("] "), "phase", F.lit(" "), "message", size, F.when(where != "", F.concat(F.lit(" "), where)).otherwise(""))
    return e.select(F.to_json(F.struct("*")).alias("structured"), text.alias("text"))


def write_logs(lines: DataFrame, folder: str) -> None:
    lines.select(F.col("structured").alias("value")).write.mode("append").text(f"{folder}/structured")
    lines.select(F.col("text").alias("value")).write.mode("append").text(f"{folder}/text")


def card_log(events: DataFrame, folder: str, by: str = "card") -> None:
    """An append-only log, a folder for each card."""
    events.write.mode("append").partitionBy(by).json(folder)


def recovery_audit(decisions: DataFrame, folder: str) -> None:
    decisions.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> list[Exception]:
    """Every sink gets the rows; the errors of some are returned, those of all are raised."""
    errors: list[Exception] = []
    for sink in sinks:
        try:
            sink(df)
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    if sinks and len(errors) == len(sinks):
        raise errors[0]
    return errors


def write_marker(mount: str, source_id: str, nickname: str | None, created_at: str, updated_at: str, folder: str = MARKER_FOLDER) -> str:
    """The card's own record; `folder` is a parameter, as other programs' cards keep theirs elsewhere."""
    path = os.path.join(mount, folder, "card.json")
    write_atomically(path, json.dumps({"schemaVersion": 1, "sourceId": source_id, "nickname": nickname, "createdAt": created_at, "updatedAt": updated_at}))
    return path


def append_card_event(mount: str, line: str, folder: str = MARKER_FOLDER) -> None:
    os.makedirs(os.path.join(mount, folder), exist_ok=True)
    with open(os.path.join(mount, folder, "events.log"), "a") as f:
        f.write(line.rstrip("\n") + "\n")


def quarantine(root: str, relative: str, session: str) -> str:
    """Move a file out of the way inside its folder, never over another; returns the new relative path."""
    base = os.path.join(root, *relative.split("/"))
    for n in range(1000):
        to = f"{base}.quarantine-{session}" + (f"-{n}" if n else "")
        try:
            os.link(base, to)
        except FileExistsError:
            continue
        os.unlink(base)
        return os.path.relpath(to, root).replace(os.sep, "/")
    raise FileExistsError(base)


def remove_owned_temp(root: str, relative: str, name_prefix: str) -> bool:
    """Remove a temporary file of ours; any other name stays."""
    name = relative.rsplit("/", 1)[-1]
    if not (name.startswith(name_prefix) and name.endswith(".tmp")):
        return False
    os.unlink(os.path.join(root, *relative.split("/")))
    return True


def remove_owned_temps(copies: DataFrame, root: str, session: str) -> DataFrame:
    """copies(file, destination_path) -> file, removed: the temporary files that copy_files leaves when it is torn down, by
    their exact names and below the root only. copies may carry source_file_id, whose name an ingest used."""
    from lumenloft.sources.listing import owned_file

    top = os.path.realpath(root)
    owners = ["file", "source_file_id"] if "source_file_id" in copies.columns else ["file"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for dst, *ids in zip(*[b[c].to_pylist() for c in ("destination_path", *owners)], strict=True):
                folder, _, name = dst.rpartition("/")
                n = 0
                for owner in set(ids):
                    temp = f"{folder}/" * bool(folder) + f".{name}.{session}.{owner}.tmp"
                    if owned_file(top, temp)[0] == "file":
                        with contextlib.suppress(FileNotFoundError):
                            os.unlink(os.path.join(top, *temp.split("/")))
                            n += 1
                out.append(n)
            yield pa.RecordBatch.from_arrays([b["file"], pa.array(out, pa.int64())], ["file", "removed"])

    return copies.select(F.col("file").cast("string"), "destination_path", *owners[1:]).mapInArrow(run, "file string, removed long")


def make_thumbnails(requests: DataFrame, root: str, generate: Callable[[bytes], bytes], limits: Limits = Limits()) -> DataFrame:
    """requests(cache_key, relative_path) -> cache_key, content, error: one generation for each key; the generator (an image
    library) is the caller's and runs in a bounded pool of processes."""

    def picture(request: tuple[str, str]) -> bytes:
        with open(os.path.join(root, *request[1].split("/")), "rb") as f:
            return generate(f.read())

    def run(batches):
        import pyarrow as pa

        items = (x for b in batches for x in zip(b["cache_key"].to_pylist(), b["relative_path"].to_pylist(), strict=True))
        for (key, _), content, error in read_all(items, picture, limits):  # a picture a batch, so that no more are held
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["cache_key", "content", "error"])

    return requests.dropDuplicates(["cache_key"]).select("cache_key", "relative_path").mapInArrow(run, "cache_key string, content binary, error string")


def failed_thumbnail(prior_attempts: int, in_job_retries: int, most: int, updated_ms: int) -> tuple[int, int | None]:
    """Attempts after a failure, and when the next may start."""
    n = min(most, prior_attempts + in_job_retries + 1)
    return n, None if n >= most else updated_ms + min(3_600_000, 30_000 * 2 ** (n - 1))
