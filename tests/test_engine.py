"""Scan to summary on real files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lumenloft.engine import Engine


def test_ingest_twice(spark, tmp_path):
    card, archive = tmp_path / "CARD", tmp_path / "archive"
    for i, n in enumerate(["DCIM/a.jpg", "DCIM/sub/a.jpg", "DCIM/b.mov", "notes.txt"]):
        p = card / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(bytes([i]) * (10 + i))
        os.utime(p, (1_600_000_000 + 86400 * (i // 2),) * 2)
    times = iter(f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}.000Z" for i in range(600))
    e = Engine(spark, str(tmp_path / "catalog"), clock=lambda: next(times))
    assert e.settings()["copyConcurrency"] == 1
    with pytest.raises(ValueError):
        e.update_settings(copyConcurrency=9)
    e.update_settings(allowedExtensions=[".jpg", ".mov"])
    r = e.review(str(card))
    assert (r["total"], r["new"], r["known"], r["reconciliation"]) == (3, 3, 0, "new-source") and [(d["day"], d["photos"], d["videos"], d["other"], d["bytes"]) for d in r["by_day"]] == [("2020-09-13", 2, 0, 0, 21), ("2020-09-14", 0, 1, 0, 12)]
    s = e.ingest(str(card), str(archive))
    snap = e.session(s)
    assert (snap["status"], snap["completed_files"], snap["failed_files"], snap["completed_bytes"]) == ("completed", 3, 0, 10 + 11 + 12)
    names = sorted(str(p.relative_to(archive)) for p in archive.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert len(names) == 3 and names[0].startswith("2020/2020-09-13/CARD/a")
    assert len(json.loads((archive / f".manifest-{s}.json").read_text())["files"]) == 3
    days = [(d.capture_day, d.item_count) for d in e.summary_days().collect()]
    assert [d for d, _ in days] == sorted((d for d, _ in days), reverse=True) and sum(n for _, n in days) == 3
    page, more = e.summary_media(days[-1][0], 1)
    assert len(page) == 1 and more and len(e.summary_media(days[-1][0], 1, more)[0]) == 1
    # the card comes back: known by its fingerprint once confirmed, and nothing is copied again
    sid = e.known_sources().first()["id"]
    again = e.review(str(card))
    assert again["reconciliation"] == "confirmation-required" and again["candidate"] == sid
    again = e.review(str(card), source_id=sid)
    assert (again["known"], again["new"], again["estimated_bytes"]) == (3, 0, 0)
    e.set_nickname(sid, "trip-one")
    with pytest.raises(ValueError):
        e.set_nickname(sid, "No Good")
    known = e.known_sources().first()
    assert known["nickname"] == "trip-one" and known["verified_media_count"] == 3 and known["sample_count"] == 1
    s2 = e.ingest(str(card), str(archive), source_id=sid)
    assert (e.session(s2)["skipped_files"], e.session(s2)["status"]) == (3, "completed")
    assert e.recoverable_sessions().isEmpty() and e.sessions_of(sid).count() == 2 and e.audit_of(sid).count() == 2
    assert {a["action"] for a in e.recovery_plan(s).collect()} == {"keep"}
    (archive / names[0]).write_bytes(b"broken")
    assert sorted(a["action"] for a in e.recovery_plan(s).collect()) == ["keep", "keep", "quarantine-final"]
    assert e.thumbnails_wanted(0).count() == 3 and e.evict_thumbnails().isEmpty()
    assert e.count_media(str(card)).filter("is_total = 1").first()["photos"] == 2


def test_recover_and_evict(spark, tmp_path):
    """An interrupted session: one copy is right, one is on disk but not on record, one is broken, one is missing."""
    from lumenloft import schemas

    card, archive = tmp_path / "CARD", tmp_path / "archive"
    for i, n in enumerate("abcd"):
        (card / "DCIM").mkdir(parents=True, exist_ok=True)
        (card / "DCIM" / f"{n}.jpg").write_bytes(bytes([i]) * 20)
    e = Engine(spark, str(tmp_path / "catalog"))
    s = e.ingest(str(card), str(archive))
    rows = {r.destination_path[-5]: r for r in e.table("copied_files").collect()}
    where = {k: archive / r.destination_path for k, r in rows.items()}
    undone = {"status": "started", "verified_at": None, "copied_bytes": 5}
    new = [r.asDict() | (undone if k in "bd" else {}) for k, r in rows.items()]
    e.store.replace("copied_files", spark.createDataFrame([tuple(r[c] for c in schemas.COPIES.names) for r in new], schemas.COPIES))
    e.store.replace("ingest_sessions", e.table("ingest_sessions").withColumn("status", F.lit("copying")).withColumn("completed_at", F.lit(None).cast("string")))
    where["c"].write_bytes(b"broken")
    where["d"].unlink()
    temp = where["d"].parent / f".{where['d'].name}.{s}.{rows['d'].source_file_id}.tmp"
    temp.write_bytes(b"half")
    # without the card the disk is put right all the same: b is verified, c moved aside, and what is missing waits
    paused = e.recover(s)
    assert paused == {"outcome": "paused", "actions": {"keep": 1, "promote": 1, "quarantine-final": 1, "recopy": 1}, "copied": 0, "failed": 0} and e.session(s)["status"] == "copying"
    assert e.store.get("copied_files", rows["b"].id).first().status == "verified" and not where["c"].exists() and any(p.name.endswith(f".quarantine-{s}") for p in archive.rglob("*")) and temp.exists()
    assert e.recover(s, str(tmp_path / "no-card"))["outcome"] == "paused"
    done = e.recover(s, str(card))
    assert done == {"outcome": "recovered", "actions": {"keep": 2, "recopy": 2}, "copied": 2, "failed": 0} and not temp.exists()
    assert all(where[n].read_bytes() == bytes([i]) * 20 for i, n in enumerate("abcd"))
    assert {r.status for r in e.table("copied_files").collect()} == {"verified"} and e.session(s)["status"] == "completed" and e.session(s)["failed_files"] == 0
    assert sorted(r.outcome for r in spark.read.json(str(tmp_path / "catalog" / "_recovery_events")).collect()) == ["completed", "paused", "paused"]
    assert {a["action"] for a in e.recovery_plan(s).collect()} == {"keep"}
    assert spark.read.json(str(tmp_path / "catalog" / "_recovery_audit")).count() == 12
    # what is cached for other sessions goes, with the thumbnails that show it
    copies = [r.id for r in e.table("copied_files").orderBy("id").collect()]
    art = [(k, "p", "image/webp", 1, 1, 10, "a", "a") for k in ("k1", "k2")]
    thumbs = [(f"t{k}", c, "f", "grid", "ready", k, None, None, 1, 5, None, "a", "a") for k, c in (("k1", copies[0]), ("k2", "elsewhere"))]
    e.store.replace("thumbnail_artifacts", spark.createDataFrame(art, schemas.ARTIFACTS))
    e.store.replace("thumbnails", spark.createDataFrame(thumbs, schemas.THUMBNAILS))
    e.update_settings(thumbnail=e.settings()["thumbnail"] | {"cachePolicy": "session"})
    assert e.evict_thumbnails("unknown").isEmpty() and [r.cache_key for r in e.evict_thumbnails(copies[0]).collect()] == ["k2"]
    assert [r.artifact_cache_key for r in e.table("thumbnails").collect()] == ["k1"] and [r.cache_key for r in e.table("thumbnail_artifacts").collect()] == ["k1"]
    e.store.replace("ingest_sessions", e.table("ingest_sessions").withColumn("status", F.lit("copying")))
    e.cancel(s)
    assert e.session(s)["status"] == "cancelled" and e.session(s)["errors"][0]["code"] == "INGEST_CANCELLED"


def interrupted(spark, tmp_path, names, **settings):
    """A finished session, as if its end had been lost."""
    card, archive = tmp_path / "CARD", tmp_path / "archive"
    (card / "DCIM").mkdir(parents=True)
    for i, n in enumerate(names):
        (card / "DCIM" / n).write_bytes(bytes([i]) * 20)
    e = Engine(spark, str(tmp_path / "catalog"))
    if settings:
        e.update_settings(**settings)
    s = e.ingest(str(card), str(archive))
    e.store.update("ingest_sessions", lambda t: t.withColumn("status", F.lit("copying")).withColumn("completed_at", F.lit(None).cast("string")))
    return e, s, card, archive


def test_recovery_looks_at_its_own_paths(spark, tmp_path, monkeypatch):
    """Neither other files of the archive nor odd extensions, hidden or excluded folders make sound copies be made anew."""
    from lumenloft.sources import listing

    e, s, _, archive = interrupted(spark, tmp_path, ["a.xyz", "b.jpg"], allowedExtensions=[".xyz", ".jpg"])
    for i in range(300):
        (archive / f"other{i}.jpg").touch()
    monkeypatch.setattr(listing, "MAX_ENTRIES", 10)
    monkeypatch.setattr(listing, "walk", None)
    monkeypatch.setattr(listing, "list_media", None)
    assert {a["action"] for a in e.recovery_plan(s).collect()} == {"keep"}
    assert e.recover(s) == {"outcome": "recovered", "actions": {"keep": 2}, "copied": 0, "failed": 0} and e.session(s)["status"] == "completed"


def test_recovery_that_fails_or_is_cancelled(spark, tmp_path):
    e, s, card, archive = interrupted(spark, tmp_path, ["a.jpg", "b.jpg"])
    with pytest.raises(InterruptedError):
        e.recover(s, str(card), cancelled=lambda: True)
    assert e.session(s)["status"] == "cancelled"
    # a link in the place of a copy, or of a folder above it, is neither hashed nor moved
    path = archive / e.table("copied_files").orderBy("id").first().destination_path
    outside = tmp_path / "outside.jpg"
    outside.write_bytes(b"mine")
    path.unlink()
    path.symlink_to(outside)
    with pytest.raises(PermissionError):
        e.recover(s, str(card))
    assert e.session(s)["status"] == "failed" and outside.read_bytes() == b"mine" and path.is_symlink()
    events = spark.read.json(str(tmp_path / "catalog" / "_recovery_events")).collect()
    assert sorted(r.outcome for r in events) == ["cancelled", "failed"]
    temp = path.parent / f".{path.name}.{s}.{e.table('copied_files').orderBy('id').first().id}.tmp"
    temp.write_bytes(b"")
    other = path.parent / f".{path.name}.other.x.tmp"
    other.write_bytes(b"")
    assert (e.cleanup(s), e.cleanup(s), e.cleanup("none")) == (1, 0, 0) and other.exists()
    with pytest.raises(KeyError):
        e.recover("none")


def test_who_asks_twice_gets_one_run():
    import threading

    from lumenloft.streaming.feeds import SessionLock

    lock, go, ran, got = SessionLock(), threading.Event(), [], []

    def work():
        go.wait(10)
        ran.append(1)
        return len(ran)

    threads = [threading.Thread(target=lambda: got.append(lock.run("s", "resume", work))) for _ in range(3)]
    for t in threads:
        t.start()
    other = threading.Thread(target=lambda: got.append(lock.run("s", "cleanup", lambda: "clean")))
    other.start()
    go.set()
    for t in [*threads, other]:
        t.join(10)
    assert sorted(map(str, got)) == ["1", "1", "1", "clean"] and ran == [1]

    def fail():
        raise ValueError("no")

    for _ in range(2):
        with pytest.raises(ValueError):
            lock.run("s", "resume", fail)


def test_register_claim_and_thumbnails(spark, tmp_path):
    from lumenloft import schemas

    card = tmp_path / "CARD"
    (card / "DCIM").mkdir(parents=True)
    (card / "DCIM" / "a.jpg").write_bytes(b"a")
    e = Engine(spark, str(tmp_path / "catalog"))
    sid = e.register_source(str(card), nickname="trip", strong_id="vol-1")
    assert [(r.id, r.kind, r.nickname) for r in e.table("sources").collect()] == [(sid, "removable-volume", "trip")]
    assert json.loads((card / ".lumenloft" / "card.json").read_text())["sourceId"] == sid
    assert e.register_source(str(card), strong_id="vol-1") == sid and e.table("sources").count() == 1 and e.store.get("sources", sid).first().nickname == "trip"
    s = [("s1", sid, "copying"), ("s2", sid, "completed")]
    e.store.append("ingest_sessions", spark.createDataFrame(s, "id string, source_id string, status string"))
    assert e.claim_session("s1", "driver-a") == 1 and e.claim_session("s1", "driver-b") is None and e.claim_session("s2", "driver-a") is None and e.claim_session("s3", "driver-a") is None
    e.store.append("copied_files", spark.createDataFrame([("c1", "verified", "sum"), ("c2", "verified", "sum"), ("c3", "failed", None)], "id string, status string, checksum string"))
    (tmp_path / "thumbs").mkdir()
    (tmp_path / "thumbs" / "k1.webp").write_bytes(b"pic")
    e.store.append("thumbnail_artifacts", spark.createDataFrame([("k1", "k1.webp", "image/webp", 1, 1, 3, "a", "a")], schemas.ARTIFACTS))
    thumbs = [("t1", "c1", "f", "grid", "ready", "k1", None, None, 1, 5, None, "a", "a"), ("t2", "c2", "f", "grid", "failed", None, "DECODE", "m", 1, 5, "2999-01-01T00:00:00Z", "a", "a"), ("t3", "c3", "f", "grid", "failed", None, "DECODE", "m", 1, 5, "2999-01-01T00:00:00Z", "a", "a")]
    e.store.append("thumbnails", spark.createDataFrame(thumbs, schemas.THUMBNAILS))
    where = str(tmp_path / "thumbs")
    assert e.thumbnail("c1", where) == {"state": "ready", "content": b"pic"} and e.thumbnail("c2", where) == {"state": "failed", "content": None} and e.thumbnail("c9", where)["state"] == "missing"
    now = int(__import__("time").time() * 1000) + 5000
    assert e.thumbnails_wanted(now).isEmpty() and not e.retry_thumbnail("c3") and not e.retry_thumbnail("c1")
    assert e.retry_thumbnail("c2") and [r.id for r in e.thumbnails_wanted(now).collect()] == ["c2"]
