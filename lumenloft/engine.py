"""The whole catalog behind one object: what a user of an ingest application asks for, by name.

Every method is a few DataFrame operators over the store's tables. Work on files (scan, hash, copy) runs in tasks; what
comes back to the driver is one session's counters or a page."""

from __future__ import annotations

import datetime
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloft import schemas
from lumenloft.functions import dates, hashing, media, paths
from lumenloft.operators import catalog, classify, identity, maintenance, plan, recover
from lumenloft.operators.core import range_of
from lumenloft.sinks import writers
from lumenloft.sources import listing, records, volumes
from lumenloft.store import Store
from lumenloft.streaming import registry
from lumenloft.streaming.feeds import SessionLock


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


class Engine:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], str] = now):
        self.spark, self.store, self.clock, self.lock = spark, Store(spark, root), clock, SessionLock()

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    # summaries

    def summary_days(self, **filters) -> DataFrame:
        return catalog.day_summary(self.table("copied_files"), self.table("source_files"), **filters)

    def summary_media(self, day: str, limit: int = catalog.PAGE, cursor: str | None = None, **filters) -> tuple[list, str | None]:
        """A page and the cursor of the next, if there's one."""
        rows = catalog.media_page(self.table("copied_files"), self.table("source_files"), self.table("thumbnails"), self.table("thumbnail_artifacts"), day, limit, cursor, **filters).collect()
        more = len(rows) > limit
        rows = rows[:limit]
        return rows, hashing.encode_cursor(rows[-1]["relative_path"], rows[-1]["id"]) if more else None

    def known_sources(self, online_ids: list[str] = ()) -> DataFrame:
        online = self.spark.createDataFrame([(i,) for i in online_ids], "id string")
        return catalog.known_sources(self.table("sources"), self.table("ingest_sessions"), self.table("copied_files"), self.table("source_identity_observations"), self.table("source_throughput_stats"), online)

    def session(self, id: str):
        one = self.table("ingest_sessions").filter(F.col("id") == id)
        mine = F.col("ingest_session_id") == id
        return catalog.session_snapshot(one, self.table("source_files").filter(mine), self.table("copied_files").filter(mine)).first()

    def recoverable_sessions(self) -> DataFrame:
        return catalog.recoverable_sessions(self.table("ingest_sessions"))

    def sessions_of(self, source_id: str) -> DataFrame:
        return range_of(self.table("ingest_sessions"), "source_id", source_id, F.desc("started_at"), F.desc("id"))

    def audit_of(self, source_id: str) -> DataFrame:
        return range_of(self.table("source_reconciliation_audit"), "source_id", source_id, F.desc("decided_at"), F.desc("id"))

    # settings

    def settings(self) -> dict:
        row = self.table("settings").filter("key = 'appSettings'").first()
        return records.read_settings(row["value_json"] if row else None)

    def update_settings(self, **changes) -> dict:
        new = self.settings() | changes
        if problems := records.check_settings(new):
            raise ValueError(", ".join(problems))
        if problems := paths.validate_template(new["destinationTemplate"]):
            raise ValueError(", ".join(problems))
        row = self.spark.createDataFrame([("appSettings", json.dumps(new), self.clock())], schemas.SETTINGS)
        self.store.merge("settings", row)
        return new

    def reset_destination(self) -> dict:
        return self.update_settings(destinationTemplate=paths.DEFAULT_TEMPLATE)

    @staticmethod
    def validate_template(template: str) -> list[str]:
        return paths.validate_template(template)

    # sources

    def set_nickname(self, source_id: str, nickname: str | None) -> None:
        if nickname is not None and not self.spark.range(1).select(media.is_nickname(F.lit(nickname))).first()[0]:
            raise ValueError("a nickname is in kebab case, 1 to 63 characters")
        values = {"nickname": F.lit(nickname).cast("string"), "updated_at": F.lit(self.clock())}
        self.store.update("sources", lambda t: maintenance.changed(t, F.col("id") == source_id, values))

    def register_source(self, root: str, nickname: str | None = None, strong_id: str | None = None) -> str:
        """Put a folder or card on record without an ingest: its source, its identity, and the marker on the card itself."""
        at = self.clock()
        who = self.identify(root, listing.files_of(self.scan(root)), strong_id)
        self._record_source(who["source_id"], root, who, strong_id, None, at)
        if nickname is not None:
            self.set_nickname(who["source_id"], nickname)
        row = self.store.get("sources", who["source_id"]).first()
        writers.write_marker(root, row["id"], row["nickname"], row["created_at"], at)
        return row["id"]

    @staticmethod
    def detected_sources(updates: DataFrame) -> DataFrame:
        """The cards that are present, from the updates that a registry stream has written."""
        return registry.present(updates).orderBy("host", "key")

    def claim_session(self, session: str, holder: str, ttl_ms: int = 60_000) -> int | None:
        """A token for work on a session that isn't over, or None where it is, or another holds it. The store refuses commits
        with the token (`fences`) once someone else has claimed the session."""
        row = self.store.get("ingest_sessions", session).first()
        return None if row is None or row["status"] in schemas.TERMINAL else self.store.acquire(f"session-{session}", holder, ttl_ms)

    def scan(self, root: str) -> DataFrame:
        s = self.settings()
        return listing.scan_media(self.spark, root, extensions=s["allowedExtensions"], excluded=[*listing.EXCLUDED, *s["excludedPathPatterns"]], ordered=False).persist()

    def count_media(self, root: str) -> DataFrame:
        return catalog.card_media(listing.files_of(self.scan(root)))

    def identify(self, root: str, files: DataFrame, strong_id: str | None = None) -> dict:
        """The source of a card: marker, strong id, fingerprint; with what must be confirmed."""
        facts = volumes.folder_facts(self.spark, root).select(F.lit("card").alias("source_id"), F.col("volume_label").alias("label"), "capacity_bytes", F.col("fs_type").alias("filesystem"))
        print_ = identity.fallback_identity(facts, files.withColumn("source_id", F.lit("card"))).first()["fingerprint"]
        marker = os.path.join(root, writers.MARKER_FOLDER, "card.json")
        if os.path.exists(marker):
            with open(marker) as f:
                found = records.read_markers(self.spark.createDataFrame([(f.read(),)], "marker string")).first()
            if found and not self.table("sources").filter(F.col("id") == found["source_id"]).isEmpty():
                return {"source_id": found["source_id"], "fingerprint": print_, "reconciliation": "candidate-found", "confidence": "exact", "reasons": ["on-card-marker"]}
        card = self.spark.createDataFrame([("card", strong_id, print_)], "card string, strong_id string, fingerprint string")
        m = identity.identify(card, identity.candidate_facts(self.table("source_identity_observations"), self.table("source_identity_aliases"))).persist()
        state, first = identity.reconcile(card, m).first()["reconciliation"], m.orderBy("confidence", "source_id").first()
        new = "source-" + print_[-24:]
        return {"source_id": first["source_id"] if first and state == "candidate-found" else new, "candidate": first["source_id"] if first else None, "fingerprint": print_, "reconciliation": state, "confidence": first["confidence"] if first else "low", "reasons": [first["reason"]] if first else ["new-source-confirmed"]}

    def _prepare(self, root: str, days: list[str], strong_id: str | None, source_id: str | None, read_tags: Callable[[str], dict] | None, started: str):
        found = self.scan(root)
        files, errors = catalog.on_days(listing.files_of(found), days), listing.errors_of(found)
        who = self.identify(root, files, strong_id)
        who["source_id"] = source_id or who["source_id"]
        # ids of a run's files come from their source and path, so a task that runs again makes the same ones
        rows = files.select(F.substring(F.sha2(F.concat_ws("\0", F.lit(who["source_id"]), F.lit(started), "relative_path"), 256), 1, 32).alias("file"), F.lit(who["source_id"]).alias("source_id"), "relative_path", "canonical_path_key", "name", "extension", "size_bytes", "modified_at")
        rows = rows.withColumn("quick_fingerprint", hashing.quick_fingerprint("canonical_path_key", "size_bytes", "modified_at", F.lit(started))).withColumn("full_checksum", F.lit(None).cast("string"))
        if read_tags is None:
            tagged = rows.select("file", F.lit(None).cast("map<string,string>").alias("tags"))
        else:
            read = records.read_tags(rows.select(F.concat(F.lit(root.rstrip("/") + "/"), "relative_path").alias("path")), read_tags)
            tagged = rows.join(read, F.concat(F.lit(root.rstrip("/") + "/"), "relative_path") == F.col("path"), "left").select("file", "tags")
        meta = records.metadata(rows.select("file", "extension", "modified_at").join(tagged, "file").withColumn("session_started_at", F.lit(started)))
        prior = classify.prior_files(self.table("source_files"), catalog.copy_states(self.table("copied_files")))
        verdict = classify.classify(rows, prior)
        return who, rows.join(verdict, "file").join(meta, "file").persist(), errors

    def review(self, root: str, days: list[str] = (), strong_id: str | None = None, source_id: str | None = None, read_tags: Callable[[str], dict] | None = None) -> dict:
        """What an ingest would do, without doing it."""
        who, rows, errors = self._prepare(root, list(days), strong_id, source_id, read_tags, self.clock())
        counts = classify.review(rows.select("file", "decision"), rows, errors).first()
        return {**who, **counts.asDict(), "by_day": [r.asDict() for r in classify.review_days(rows).collect()]}

    # ingest

    def ingest(self, root: str, destination: str, days: list[str] = (), strong_id: str | None = None, source_id: str | None = None, read_tags: Callable[[str], dict] | None = None, label: str | None = None, session: str | None = None) -> str:
        """Copy what is new and verify it; returns the session's id, a new one unless it is given."""
        started, session, s = self.clock(), session or uuid.uuid4().hex, self.settings()
        who, rows, _ = self._prepare(root, list(days), strong_id, source_id, read_tags, started)
        sid = who["source_id"]
        self._record_source(sid, root, who, strong_id, session, started)
        self.store.append("ingest_sessions", self.spark.createDataFrame([(session, sid, "copying", started, None, None, None, started, started)], schemas.SESSIONS))
        recovery = self.spark.createDataFrame([(session, destination, strong_id, who["fingerprint"], "1", started)], schemas.RECOVERY)
        self.store.merge("session_recovery_context", recovery)
        nick = self.table("sources").filter(F.col("id") == sid).first()["nickname"] if s["groupByNicknameInDestination"] else None
        todo = rows.filter("decision <> 'known'").select("file", "relative_path", F.col("capture.capture_day").alias("capture_day"), F.lit(label or os.path.basename(root.rstrip("/")) or "card").alias("label"), F.lit(nick).cast("string").alias("nickname"), F.col("name").alias("original_filename"), F.col("quick_fingerprint").alias("checksum"))
        taken = self.table("copied_files").select("destination_path", F.lit(None).cast("string").alias("verified_checksum"))
        planned = plan.plan_destinations(todo, taken, s["destinationTemplate"], compat="composed-app").join(todo.select("file", "relative_path"), "file")
        work = f"{self.store.root}/_work/{session}"
        planned.write.mode("overwrite").parquet(f"{work}/plan")
        planned = self.spark.read.parquet(f"{work}/plan")
        writers.copy_files(planned.filter("kind = 'new'"), root, destination, session).write.mode("overwrite").parquet(f"{work}/outcomes")
        self._record_files(session, sid, rows, planned, self.spark.read.parquet(f"{work}/outcomes"), started)
        self._finish(session, sid, destination, started)
        return session

    def _record_source(self, sid: str, root: str, who: dict, strong_id: str | None, session: str | None, at: str) -> None:
        name = os.path.basename(root.rstrip("/")) or root
        row = self.spark.createDataFrame([(sid, "removable-volume" if strong_id else "folder", name, None, at, at, at, at)], schemas.SOURCES)
        self.store.update("sources", lambda t: maintenance.upserted(t, row, ["id"], keep=["kind", "display_name", "nickname", "first_seen_at", "created_at"]))
        o = self.spark.createDataFrame([(uuid.uuid4().hex, sid, 1, who["fingerprint"], "{}", who["confidence"], strong_id, at)], schemas.OBSERVATIONS)
        self.store.append("source_identity_observations", o)
        self.store.merge("source_identity_aliases", identity.aliases(self.table("source_identity_observations").filter(F.col("source_id") == sid)))
        kind = "auto-strong" if who["confidence"] == "exact" else "created-new"
        self.store.append("source_reconciliation_audit", self.spark.createDataFrame([(uuid.uuid4().hex, sid, session, strong_id or who["fingerprint"], kind, json.dumps(who["reasons"]), at)], schemas.AUDIT))

    def _record_files(self, session: str, sid: str, rows: DataFrame, planned: DataFrame, outcomes: DataFrame, started: str) -> None:
        done = self.clock()
        r = rows.join(outcomes.select("file", "outcome", F.col("error_code").alias("code")), "file", "left")
        c = F.col("capture")
        status = F.when(F.col("decision") == "known", "skipped").when(F.col("outcome") == "completed", "completed").otherwise("failed")
        files = r.select(
            F.col("file").alias("id"), F.lit(sid).alias("source_id"), F.lit(session).alias("ingest_session_id"), "relative_path", "canonical_path_key", hashing.version_key("quick_fingerprint", F.lit(session)).alias("version_key"), "name", "extension", "size_bytes", "modified_at",
            media.media_kind("extension").alias("media_kind"), status.alias("status"), "quick_fingerprint", "full_checksum", F.when(status == "failed", F.coalesce("code", F.lit("DESTINATION_INVALID"))).alias("error_code"), F.when(status == "failed", media.safe_error("code")["message"]).alias("error_message"),
            "media_type", "mime_type", *[c[n].alias(n) for n in ("capture_at", "capture_at_source", "capture_at_raw", "capture_timezone_kind", "capture_offset_minutes", "capture_offset_source", "capture_offset_raw", "capture_day")], "camera_make", "camera_model", "lens_model", F.col("width").cast("long").alias("width"),
            F.col("height").cast("long").alias("height"), "duration_seconds", "gps_present", F.lit(started).alias("created_at"), F.lit(done).alias("updated_at"),
        )
        self.store.append("source_files", files)
        o = outcomes.join(planned.select("file", "destination_path"), "file").join(rows.select("file", "size_bytes"), "file")
        ok = F.col("outcome") == "completed"
        copies = o.select(
            F.concat(F.col("file"), F.lit("-c")).alias("id"), F.col("file").alias("source_file_id"), F.lit(sid).alias("source_id"), F.lit(session).alias("ingest_session_id"), "destination_path", F.when(ok, "verified").otherwise("failed").alias("status"), F.col("size_bytes").alias("expected_bytes"), "copied_bytes",
            F.when(ok, F.col("checksum")).alias("checksum"), F.lit(started).alias("started_at"), F.when(~ok, F.lit(done)).alias("failed_at"), F.when(ok, F.lit(done)).alias("verified_at"), F.when(~ok, F.col("error_code")).alias("error_code"), F.when(~ok, media.safe_error("error_code")["message"]).alias("error_message"),
            F.lit(started).alias("created_at"), F.lit(done).alias("updated_at"),
        )
        self.store.append("copied_files", copies)

    def _finish(self, session: str, sid: str, destination: str, started: str) -> None:
        done = self.clock()
        wrong = not self.table("source_files").filter((F.col("ingest_session_id") == session) & (F.col("status") == "failed")).isEmpty()
        values = {"status": "failed" if wrong else "completed", "completed_at": done, "updated_at": done, "error_code": "FILES_FAILED" if wrong else None, "error_message": "Some files could not be copied." if wrong else None}
        values = {k: F.lit(v).cast("string") for k, v in values.items()}
        self.store.update("ingest_sessions", lambda t: maintenance.changed(t, F.col("id") == session, values))
        seconds = max(0.001, (datetime.datetime.fromisoformat(done) - datetime.datetime.fromisoformat(started)).total_seconds())
        moved = self.table("copied_files").filter((F.col("ingest_session_id") == session) & (F.col("status") == "verified")).agg(F.sum("copied_bytes")).first()[0]
        if moved:
            one = self.spark.createDataFrame([(sid, float(moved / seconds), done)], "source_id string, bytes_per_second double, at string")
            self.store.update("source_throughput_stats", lambda t: maintenance.add_samples(t.filter(F.col("source_id") == sid), one).withColumn("updated_at", F.lit(done)))
        self.write_manifest(session, destination)

    def write_manifest(self, session: str, destination: str) -> str | None:
        rows = catalog.manifest_rows(self.table("source_files"), self.table("copied_files"), session)
        row = writers.manifest_json(rows).first()
        if row is None:
            return None
        path = os.path.join(destination, f".manifest-{session}.json")
        writers.write_atomically(path, row["manifest"])
        return path

    # recovery

    def recovery_plan(self, session: str) -> DataFrame:
        """Actions for the copies of an interrupted session, from its records and what is on disk at their own paths.

        Only those paths are looked at, in tasks, so neither the size of the archive nor a file's extension matters. Files are
        hashed where the record alone can't tell. A path that leaves the archive or isn't a regular file has the action
        `refused`."""
        context = self.table("session_recovery_context").filter(F.col("session_id") == session).first()
        mine = F.col("ingest_session_id") == session
        inputs = recover.recovery_inputs(self.table("copied_files").filter(mine), self.table("source_files").filter(mine))
        sound = F.coalesce((F.col("status") == "verified") & (F.col("stored_checksum") == F.col("expected_checksum")), F.lit(False))
        wanted = inputs.groupBy(F.col("final_path").alias("relative_path")).agg(F.max(F.when(~sound, F.col("expected_bytes"))).alias("hash_if_size"))
        found = listing.lookup_files(self.spark, context["destination_root"], wanted)
        disk = found.filter("state <> 'missing'").select(F.col("relative_path").alias("path"), "size_bytes", F.col("sha256").alias("checksum"), (F.col("state") == "refused").alias("refused"))
        return recover.recovery_actions(inputs, disk)

    def recover(self, session: str, source_root: str | None = None, cancelled: Callable[[], bool] = lambda: False) -> dict:
        """Finish an interrupted session: what is on disk and right is kept or taken as verified, what is wrong is moved aside,
        and what is missing is copied again from `source_root`.

        The disk is put right first. If copies are missing and the source isn't there, the session stays as it is (`paused`)
        and can be recovered again. One recovery of a session runs at a time, and who asks for it meanwhile gets its result. A
        run that fails or that `cancelled` stops marks the session. Each decision and each end goes to the logs beside the
        catalog."""
        return self.lock.run(session, "resume", lambda: self._recover(session, source_root, cancelled))

    def _recover(self, session: str, source_root: str | None, cancelled: Callable[[], bool]) -> dict:
        context = self.table("session_recovery_context").filter(F.col("session_id") == session).first()
        if context is None:
            raise KeyError(session)
        root, work, at = context["destination_root"], f"{self.store.root}/_work/{session}-{uuid.uuid4().hex}", self.clock()

        def told(outcome: str, detail: str | None = None) -> None:
            row = self.spark.createDataFrame([(session, at, "resume", outcome, detail)], "session string, at string, action string, outcome string, detail string")
            writers.recovery_audit(row, f"{self.store.root}/_recovery_events")

        def go_on() -> None:
            if cancelled():
                raise InterruptedError(session)

        try:
            go_on()
            self.recovery_plan(session).write.parquet(f"{work}/actions")
            actions = self.spark.read.parquet(f"{work}/actions")
            if bad := actions.filter("action = 'refused'").first():
                raise PermissionError(f"copy {bad['copy']} isn't a regular file inside the archive")
            writers.recovery_audit(actions.select(F.lit(session).alias("session"), F.lit(at).alias("decidedAt"), "copy", "action"), f"{self.store.root}/_recovery_audit")
            counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
            recover.quarantine_files(actions, root, session).write.parquet(f"{work}/moved")
            self._record_recovery(session, actions, None, self.clock())
            there = source_root is not None and os.path.isdir(source_root)
            if recover.session_outcome(actions, there).first()["outcome"] == "paused":
                self.write_manifest(session, root)
                told("paused", "source-unavailable")
                return {"outcome": "paused", "actions": counts, "copied": 0, "failed": 0}
            go_on()
            copies, files = self.table("copied_files"), self.table("source_files")
            todo = actions.filter("recopy").join(copies.select(F.col("id").alias("copy"), "source_file_id", "destination_path"), "copy").join(files.select(F.col("id").alias("source_file_id"), "relative_path"), "source_file_id")
            todo = todo.select(F.col("copy").alias("file"), "source_file_id", "relative_path", "destination_path")
            writers.remove_owned_temps(todo, root, session).write.parquet(f"{work}/temps")
            writers.copy_files(todo, source_root or root, root, session).write.parquet(f"{work}/outcomes")
            again = self.spark.read.parquet(f"{work}/outcomes")
            self._record_recovery(session, actions, again, self.clock())
            go_on()
            self._finish(session, files.filter(F.col("ingest_session_id") == session).first()["source_id"], root, at)
            n = {bool(r[0]): r["count"] for r in again.groupBy(F.col("outcome") == "completed").count().collect()}
            told("completed")
            return {"outcome": "recovered" if not n.get(False) else "failed", "actions": counts, "copied": n.get(True, 0), "failed": n.get(False, 0)}
        except Exception as e:
            ended = "cancelled" if isinstance(e, InterruptedError) else "failed"
            self._end(session, ended, "INGEST_CANCELLED" if ended == "cancelled" else "RECOVERY_FAILED")
            self.write_manifest(session, root)
            told(ended, None if ended == "cancelled" else str(e)[:500])
            raise

    def _end(self, session: str, status: str, code: str) -> None:
        at = self.clock()
        values = {"status": status, "completed_at": at, "updated_at": at, "error_code": code, "error_message": media.MESSAGES.get(code, "The recovery could not be finished.")}
        values = {k: F.lit(v).cast("string") for k, v in values.items()}
        self.store.update("ingest_sessions", lambda t: maintenance.changed(t, F.col("id") == session, values))

    def cleanup(self, session: str) -> int:
        """Remove the temporary files that an interrupted session left behind, by their exact names; how many there were."""

        def work() -> int:
            context = self.table("session_recovery_context").filter(F.col("session_id") == session).first()
            if context is None:
                return 0
            rows = self.table("copied_files").filter(F.col("ingest_session_id") == session).select(F.col("id").alias("file"), "source_file_id", "destination_path")
            removed = writers.remove_owned_temps(rows, context["destination_root"], session).agg(F.sum("removed")).first()[0] or 0
            writers.recovery_audit(self.spark.createDataFrame([(session, self.clock(), "cleanup", "completed")], "session string, at string, action string, outcome string"), f"{self.store.root}/_recovery_events")
            return removed

        return self.lock.run(session, "cleanup", work)

    def _record_recovery(self, session: str, actions: DataFrame, again: DataFrame | None, at: str) -> None:
        """Merge the session's copies as the recovery left them, and then its files' status. again: the outcomes of copies that
        were made anew, once there are any."""
        mine, text = F.col("ingest_session_id") == session, lambda v: F.lit(v).cast("string")
        found = actions.filter(F.col("action").isin("mark-verified", "promote")).select(F.col("copy").alias("_id"), F.lit("completed").alias("outcome"), text(None).alias("sum"), text(None).alias("code"))
        if again is not None:
            found = again.select(F.col("file").alias("_id"), "outcome", F.col("checksum").alias("sum"), F.col("error_code").alias("code"))
        files = self.table("source_files").filter(mine)

        def copies_after(copies: DataFrame) -> DataFrame:
            copies = copies.filter(mine)
            inputs = recover.recovery_inputs(copies, files).select(F.col("copy").alias("_copy"), "expected_checksum")
            r = copies.join(found, copies["id"] == F.col("_id")).join(inputs, copies["id"] == F.col("_copy"), "left")
            ok = F.col("outcome") == "completed"
            values = {
                "status": F.when(ok, "verified").otherwise("failed"), "copied_bytes": F.when(ok, F.col("expected_bytes")).otherwise(F.col("copied_bytes")), "checksum": F.when(ok, F.coalesce("sum", "expected_checksum")), "started_at": F.coalesce("started_at", text(at)), "recovery_started_at": text(at),
                "verified_at": F.when(ok, text(at)), "failed_at": F.when(~ok, text(at)), "error_code": F.when(~ok, F.coalesce("code", F.lit("COPY_FAILED"))), "error_message": F.when(~ok, media.safe_error("code")["message"]), "updated_at": text(at),
            }
            return r.select(*[values[c].alias(c) if c in values else copies[c] for c in copies.columns])

        self.store.update("copied_files", copies_after)
        touched = self.table("copied_files").filter(mine).join(found.select(F.col("_id").alias("id")), "id", "left_semi").select("source_file_id").distinct()
        states = self.table("copied_files").filter(mine).join(touched, "source_file_id", "left_semi").groupBy(F.col("source_file_id").alias("_file")).agg(F.max(F.col("status") == "verified").alias("_ok"))

        def files_after(table: DataFrame) -> DataFrame:
            f = table.filter(mine).filter("status <> 'skipped'").join(states, F.col("id") == F.col("_file"))
            ok = F.col("_ok")
            values = {
                "status": F.when(ok, "completed").otherwise("failed"), "error_code": F.when(~ok, F.coalesce("error_code", F.lit("COPY_FAILED"))), "error_message": F.when(~ok, F.coalesce("error_message", F.lit(media.MESSAGES["COPY_FAILED"]))), "updated_at": text(at),
            }
            return f.select(*[values[c].alias(c) if c in values else F.col(c) for c in table.columns])

        self.store.update("source_files", files_after)

    def cancel(self, session: str) -> None:
        """A session that isn't over ends as cancelled; its verified copies stay."""
        at = self.clock()
        live = (F.col("id") == session) & ~F.col("status").isin(*schemas.TERMINAL)
        values = {"status": "cancelled", "completed_at": at, "updated_at": at, "error_code": "INGEST_CANCELLED", "error_message": media.MESSAGES["INGEST_CANCELLED"]}
        values = {k: F.lit(v).cast("string") for k, v in values.items()}
        self.store.update("ingest_sessions", lambda t: maintenance.changed(t, live, values))

    # thumbnails

    def thumbnails_wanted(self, now_ms: int, n: int = 8) -> DataFrame:
        return catalog.thumbnails_wanted(self.table("copied_files"), self.table("thumbnails"), now_ms, n)

    def thumbnail(self, copy: str, folder: str) -> dict:
        """A copy's grid thumbnail: its state, and its picture where it is ready and its file under `folder` as recorded."""
        row = catalog.latest_thumbnails(self.table("thumbnails").filter(F.col("copied_file_id") == copy)).first()
        if row is None:
            return {"state": "missing", "content": None}
        artifact = self.table("thumbnail_artifacts").filter(F.col("cache_key") == row["artifact_cache_key"])
        found = records.thumbnail_bytes(self.spark, folder, artifact).first() if row["state"] == "ready" else None
        return {"state": row["state"], "content": bytes(found["content"]) if found else None}

    def retry_thumbnail(self, copy: str) -> bool:
        """Make a failed thumbnail due at once. False where its copy isn't verified or its attempts are used up."""
        held = self.store.get("copied_files", copy).first()
        mine = (F.col("copied_file_id") == copy) & (F.col("variant") == "grid") & (F.col("state") == "failed") & (F.col("attempt_count") < F.col("max_attempts"))
        if held is None or held["status"] != "verified" or held["checksum"] is None or self.table("thumbnails").filter(mine).isEmpty():
            return False
        at = F.lit(self.clock())
        self.store.update("thumbnails", lambda t: maintenance.changed(t, mine, {"next_retry_at": at, "updated_at": at}))
        return True

    def evict_thumbnails(self, copy: str | None = None) -> DataFrame:
        """Cache keys to drop under the settings' policy: the oldest beyond the limit, or, where only a session is kept, what
        no thumbnail of the session of `copy` shows. The artifacts go, and the thumbnails that refer to them."""
        t, artifacts, thumbnails = self.settings()["thumbnail"], self.table("thumbnail_artifacts"), self.table("thumbnails")
        if t["cachePolicy"] == "session":
            gone = maintenance.evict_other_sessions(artifacts, thumbnails, self.table("copied_files"), copy or "")
        else:
            gone = maintenance.evict(artifacts, t["cacheLimitBytes"])
        gone = gone.persist()
        gone.count()
        self.store.update("thumbnails", lambda t: maintenance.removed(t, gone.select(F.col("cache_key").alias("artifact_cache_key")), ["artifact_cache_key"]))
        self.store.update("thumbnail_artifacts", lambda t: maintenance.removed(t, gone, ["cache_key"]))
        return gone
