"""Relational and file-backed operators on small fixtures."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenloft import schemas
from lumenloft.operators import classify, constraints, identity, maintenance, plan, recover
from lumenloft.sinks import writers
from lumenloft.sources import listing, records, volumes
from lumenloft.streaming import feeds

CURRENT = "file string, source_id string, relative_path string, canonical_path_key string, size_bytes long, modified_at string, quick_fingerprint string, full_checksum string"


def verdict(spark, current, priors, **more):
    files = spark.createDataFrame([p[:8] for p in priors], CURRENT.replace("file string", "id string"))
    states = spark.createDataFrame([(p[0], p[8]) for p in priors if p[8]], "source_file_id string, copy_status string")
    r = classify.classify(spark.createDataFrame([current], CURRENT), classify.prior_files(files, states), **more).first()
    return r.decision, r.reason, r.needs_full_checksum, r.matched_file_id, r.cross_source_duplicate


NOW = ("f", "s", "a", "a", 1, "t", "q", None)
SUMMED = (*NOW[:7], "c")


@pytest.mark.parametrize(
    "current, priors, want",
    [
        (NOW, [("p", *NOW[1:], "verified")], ("known", "verified-exact-match", False, "p", None)),
        (NOW, [("p", *NOW[1:], None)], ("new", "unverified-prior-record", False, "p", None)),
        (NOW, [("p", *NOW[1:], "failed")], ("recoverable", "incomplete-prior-copy", False, "p", None)),
        (NOW, [("p", "s", "a", "a", 2, "t", "q", None, "verified")], ("ambiguous", "same-path-changed-facts", True, "p", None)),
        (NOW, [("p", "s", "b", "b", 1, "t", "q", None, "verified")], ("ambiguous", "same-size-different-path", True, "p", None)),
        (NOW, [("p", "x", "a", "a", 1, "t", "q", None, "verified")], ("new", "no-prior-match", False, None, None)),
        # one canonical key, spelled in two ways: another path of the same size
        (("f", "s", "caf\u00e9", "caf\u00e9", 1, "t", "q", None), [("p", "s", "cafe\u0301", "caf\u00e9", 1, "t", "q", None, "verified")], ("ambiguous", "same-size-different-path", True, "p", None)),
        (("f", "s", "caf\u00e9", "caf\u00e9", 2, "t", "q", None), [("p", "s", "cafe\u0301", "caf\u00e9", 1, "t", "q", None, "verified")], ("new", "no-prior-match", False, None, None)),
        (SUMMED, [("p", "s", "b", "b", 9, "u", "r", "c", "verified")], ("known", "verified-full-checksum-match", False, "p", None)),
        (SUMMED, [("p", "s", "b", "b", 9, "u", "r", "c", "started")], ("recoverable", "incomplete-prior-copy", False, "p", None)),
        (SUMMED, [("p", "s", "b", "b", 9, "u", "r", "c", None)], ("new", "unverified-prior-record", False, "p", None)),
        (SUMMED, [("p", "s", "a", "a", 9, "u", "r", "d", "verified"), ("o", "x", "z", "z", 9, "u", "r", "c", "verified")], ("new", "checksum-disproved-candidates", False, None, "o")),
        (SUMMED, [("o", "x", "z", "z", 9, "u", "r", "c", "verified")], ("new", "no-same-source-match", False, None, "o")),
        (SUMMED, [], ("new", "no-prior-match", False, None, None)),
        (NOW, [("_z", "s", "a", "a", 2, "t", "q", None, "verified"), ("B", "s", "a", "a", 3, "t", "q", None, "verified"), ("a", "s", "a", "a", 4, "t", "q", None, "failed")], ("ambiguous", "same-path-changed-facts", True, "_z", None)),
        (NOW, [("p", "s", "a", "a", 1, "t", "old", None, None), ("q", "s", "b", "b", 1, "t", "q", None, None)], ("ambiguous", "same-path-changed-facts", True, "p", None)),
    ],
)
def test_classify(spark, current, priors, want):
    assert verdict(spark, current, priors) == want


def test_classify_composed(spark):
    assert verdict(spark, SUMMED, [("p", *SUMMED[1:], "verified")], compat="composed-app")[1] == "verified-exact-match"


PLAN = "file string, relative_path string, capture_day string, label string, nickname string, original_filename string, checksum string"


def test_plan(spark):
    rows = [(f"f{i}", f"p{i}", "2021-02-03", "card", None, n, c) for i, (n, c) in enumerate([("a.jpg", "11111111"), ("a.jpg", "22222222"), ("a.jpg", "22222222x"), ("a-33333333.jpg", "4" * 8), ("a.jpg", "33333333")])]
    rows.append(("bad", "p9", "2021-02-30", "card", None, "a.jpg", "5" * 8))
    old = [("2021/2021-02-03/card/a.jpg", "11111111")]
    out = plan.plan_destinations(spark.createDataFrame(rows, PLAN), spark.createDataFrame(old, "destination_path string, verified_checksum string"))
    got = {r.file: (r.kind, (r.destination_path or "").rsplit("/", 1)[-1]) for r in out.collect()}
    assert got == {"f0": ("reuse", "a.jpg"), "f1": ("new", "a-22222222.jpg"), "f2": ("new", "a-22222222-2.jpg"), "f3": ("new", "a-33333333.jpg"), "f4": ("new", "a-33333333-2.jpg"), "bad": ("invalid", "")}
    app = plan.plan_destinations(spark.createDataFrame(rows[:1], PLAN), spark.createDataFrame(old, "destination_path string, verified_checksum string"), compat="composed-app").first()
    assert app.kind == "new" and app.destination_path.endswith("a-11111111.jpg")
    assert plan.keep_unique(out).isEmpty()


def test_identity(spark):
    cards = spark.createDataFrame([("c1", " v1 ", "x"), ("c2", "", "fp2"), ("c3", None, "old"), ("c4", "v9", "none"), ("c5", "dup", "fp2")], "card string, strong_id string, fingerprint string")
    known = spark.createDataFrame([("s1", "v1", "fp1", []), ("s2", None, "fp2", ["old", "fp2"]), ("s3", "dup", "z", None), ("s4", "dup", "y", None)], "source_id string, strong_id string, fingerprint string, aliases array<string>")
    m = identity.identify(cards, known)
    assert sorted(tuple(r) for r in m.collect()) == [("c1", "s1", "exact", "platform-volume-id", False), ("c2", "s2", "medium", "fallback-fingerprint", True), ("c3", "s2", "medium", "fallback-fingerprint-alias", True), ("c5", "s3", "exact", "platform-volume-id", True), ("c5", "s4", "exact", "platform-volume-id", True)]
    assert dict(identity.reconcile(cards, m).collect()) == {"c1": "candidate-found", "c2": "confirmation-required", "c3": "confirmation-required", "c4": "new-source", "c5": "confirmation-required"}


def test_fallback_fingerprint(spark):
    files = spark.createDataFrame([("s", f"d/{i:02d}.jpg", f"d/{i:02d}.jpg", i) for i in range(30)], "source_id string, relative_path string, canonical_path_key string, size_bytes long")
    facts = spark.createDataFrame([("s", "  My　Card ", 64_000_000_000, " ")], "source_id string, label string, capacity_bytes long, filesystem string")
    ends = [{"relativePath": f"d/{i:02d}.jpg", "canonicalPathKey": f"d/{i:02d}.jpg", "sizeBytes": i} for i in [*range(8), *range(22, 30)]]
    body = {"version": 1, "label": "my card", "capacityBucketBytes": 68719476736, "filesystem": None, "samples": ends}
    want = "source-fallback-v1:" + hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert identity.fallback_identity(facts, files).first().fingerprint == want


def test_recovery(spark):
    cols = "copy string, status string, final_path string, provisional_path string, expected_bytes long, expected_checksum string, stored_checksum string"
    rows = [("keep", "verified", "a", None, 1, "x", "x"), ("mark", "verified", "a", None, 1, "x", "y"), ("bad", "verified", "a", None, 2, "x", "x"), ("gone", "verified", "zz", None, 1, "x", "x"), ("promote", "started", "b", "b", 3, "q", None), ("wrong", "started", "b", "b", 3, None, None), ("again", "failed", "c", "c", 1, "x", None)]
    disk = spark.createDataFrame([("a", 1, "x"), ("b", 3, "q")], "path string, size_bytes long, checksum string")
    out = recover.recovery_actions(spark.createDataFrame(rows, cols), disk)
    assert {r.copy: r.action for r in out.collect()} == {"keep": "keep", "mark": "mark-verified", "bad": "quarantine-final", "gone": "recopy", "promote": "promote", "wrong": "quarantine-provisional", "again": "recopy"}
    assert recover.session_outcome(out, True).first().outcome == "scheduled" and recover.session_outcome(out, False).first().outcome == "paused"


def test_lifecycle(spark):
    base = dict(copied_bytes=0, expected_bytes=5, checksum=None, started_at=None, last_progress_at=None, failed_at=None, recovery_started_at=None, verified_at=None, error_code=None, error_message=None)
    good = [dict(base, status="planned"), dict(base, status="started", started_at="t"), dict(base, status="failed", started_at="t", failed_at="t", error_code="E", error_message="m"), dict(base, status="verified", started_at="t", copied_bytes=5, checksum="c", verified_at="t")]
    bad = [dict(good[0], copied_bytes=1), dict(good[1], checksum="c"), dict(good[2], error_message=""), dict(good[3], copied_bytes=4), dict(base, status="odd")]
    cols = "status string, " + ", ".join(f"{k} {'long' if 'bytes' in k else 'string'}" for k in base)
    make = lambda rows: spark.createDataFrame([tuple(r[c.split()[0]] for c in cols.split(", ")) for r in rows], cols)
    assert constraints.lifecycle(make(good)).isEmpty() and constraints.lifecycle(make(bad)).count() == len(bad)
    assert constraints.migration_history([(1, "a", "x"), (2, "b", "y")], [(1, "a", "x")]) == []
    assert constraints.migration_history([(1, "a", "x")], [(1, "a", "z")]) and constraints.migration_history([(1, "a", "x"), (2, "b", "y")], [(2, "b", "y")])


@pytest.mark.parametrize("limit", [0, 1, 5, 9, 10, 100])
def test_evict(spark, limit):
    rows = [("a", 3, "1"), ("b", 4, "2"), ("c", 2, "2"), ("d", 1, "3")]
    left, gone = sum(r[1] for r in rows), set()
    for k, n, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if left > limit:
            gone.add(k)
            left -= n
    df = spark.createDataFrame(rows, "cache_key string, size_bytes long, updated_at string")
    assert {r.cache_key for r in maintenance.evict(df, limit).collect()} == gone


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a", "x"), (None, "b", "y")], "k int, v string, w string"), spark.createDataFrame([(1, None, "z"), (None, "q", "r"), (3, "n", "m")], "k int, v string, w string")
    got = sorted(map(tuple, maintenance.upsert(old, new, ["k"], keep=["w"]).collect()), key=str)
    assert got == sorted([(1, None, "x"), (None, "q", "y"), (3, "n", "m")], key=str)


def tree(root, names):
    for n in names:
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(n.encode())


def test_scan(spark, tmp_path):
    tree(tmp_path, ["DCIM/_DSC1.JPG", "DCIM/b.mov", "DCIM/a.txt", "$RECYCLE.BIN/x.jpg", ".hidden/y.jpg", "z.jpg", "DCIM/deep/c.nef"])
    os.symlink("/etc", tmp_path / "out")
    out = listing.scan_media(spark, str(tmp_path))
    assert [r.relative_path for r in listing.files_of(out).collect()] == ["DCIM/_DSC1.JPG", "DCIM/b.mov", "DCIM/deep/c.nef", "z.jpg"]
    out = listing.scan_media(spark, str(tmp_path), hidden="true", follow="true", max_depth=1)
    assert {r.code for r in listing.errors_of(out).collect()} == {"SYMLINK_OUTSIDE_ROOT", "DEPTH_LIMIT_REACHED"}
    out = listing.scan_media(spark, str(tmp_path), max_entries=2)
    assert [r.code for r in listing.errors_of(out).collect()] == ["ENTRY_LIMIT_REACHED"]
    files = listing.files_of(listing.scan_media(spark, str(tmp_path), extensions=["mov"]))
    hashed = listing.hash_files(spark, str(tmp_path), files).first()
    assert hashed.sha256 == hashlib.sha256(b"DCIM/b.mov").hexdigest() and hashed.size_bytes == 10
    assert b"".join(r.content for r in listing.read_contents(spark, str(tmp_path), files, 4).orderBy("offset").collect()) == b"DCIM/b.mov"


def test_copy(spark, tmp_path):
    tree(tmp_path / "card", ["a.jpg", "b.jpg", "c.jpg"])
    dest = tmp_path / "archive"
    tree(dest, ["2021/b.jpg"])
    rows = [("1", "a.jpg", "2021/a.jpg"), ("2", "b.jpg", "2021/b.jpg"), ("3", "none.jpg", "2021/n.jpg"), ("4", "c.jpg", "../c.jpg")]
    p = spark.createDataFrame(rows, "file string, relative_path string, destination_path string")
    for _ in range(2):  # a second run finds its own copies
        got = {r.file: (r.outcome, r.error_code) for r in writers.copy_files(p, str(tmp_path / "card"), str(dest), "s").collect()}
        assert got == {"1": ("completed", None), "2": ("collision", "DESTINATION_COLLISION"), "3": ("failed", "SOURCE_UNAVAILABLE"), "4": ("failed", "DESTINATION_INVALID")}
    assert (dest / "2021/a.jpg").read_bytes() == b"a.jpg" and (dest / "2021/b.jpg").read_bytes() == b"2021/b.jpg" and not list(dest.rglob("*.tmp"))
    assert writers.quarantine(str(dest), "2021/a.jpg", "s") == "2021/a.jpg.quarantine-s"


def test_small_sinks(spark, tmp_path):
    path = writers.write_marker(str(tmp_path), "s1", None, "a", "b")
    m = spark.createDataFrame([("m", open(path).read()), ("n", "{"), ("o", '{"schemaVersion":2}')], "mount_path string, marker string")
    assert [tuple(r) for r in records.read_markers(m).collect()] == [("m", "s1", None, "a", "b")]
    calls = []
    assert len(writers.fan_out(m, [lambda d: calls.append(d.count()), lambda d: 1 / 0])) == 1 and calls == [3]
    with pytest.raises(ZeroDivisionError):
        writers.fan_out(m, [lambda d: 1 / 0])
    writers.card_log(m, str(tmp_path / "log"), "mount_path")
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    assert records.read_settings(None) == records.DEFAULTS and records.read_settings(json.dumps(records.DEFAULTS | {"schemaVersion": 3, "new": 1, "copyConcurrency": 4}))["copyConcurrency"] == 4
    old = {"schemaVersion": 1, "destinationRoot": "/d", "collisionStrategy": "prompt", "preserveTimestamps": False, "allowedExtensions": [".jpg"], "excludedPathPatterns": [], "copyConcurrency": 2, "thumbnailCacheLimitBytes": 5}
    assert records.read_settings(json.dumps(old))["thumbnail"]["cacheLimitBytes"] == 5


def test_volumes(spark, tmp_path):
    disks = [
        {"name": "sda", "rm": True, "children": [{"name": "sda1", "mountpoint": "/boot"}, {"name": "sda2", "mountpoint": "/media/no"}]},
        {"name": "mmcblk0", "tran": "mmc", "vendor": " V ", "children": [{"name": "p1", "uuid": "U", "size": "64", "fstype": "exfat", "mountpoints": ["/media/CARD", "/proc/x"]}, {"name": "p2", "fstype": "tmpfs", "mountpoint": "/media/tmp"}]},
        {"name": "sdc", "tran": "sata", "children": [{"name": "sdc1", "mountpoint": "/data"}]},
    ]
    out = volumes.linux_volumes(spark.createDataFrame([("h", json.dumps({"blockdevices": disks}))], "host string, lsblk string")).collect()
    assert [(r.mount_path, r.display_name, r.platform_volume_id, r.capacity_bytes, r.device_vendor) for r in out] == [("/media/CARD", "CARD", "U", 64, "V")]
    # the system's mount points hold for what is below them; a home folder is none of them
    one = lambda mount: json.dumps({"blockdevices": [{"name": "sdx", "rm": "1", "children": [{"name": "sdx1", "mountpoint": mount}]}]})
    mounts = ["/var/lib/docker", "/boot/", "/usr/share", "/", "//", "/home", "/usrlocal", "/srv/var"]
    out = volumes.linux_volumes(spark.createDataFrame([(m, one(m)) for m in mounts], "host string, lsblk string")).collect()
    assert sorted(r.host for r in out) == ["/home", "/srv/var", "/usrlocal"]
    kernel = tmp_path / "mmcblk0" / "device"
    kernel.mkdir(parents=True)
    for field, value in {"name": "SC64G\n", "oemid": "0x5344\n", "serial": " \n"}.items():
        (kernel / field).write_text(value)
    card = json.dumps({"blockdevices": [{"name": "mmcblk0", "tran": "MMC", "children": [{"name": "p1", "path": "/dev/p1", "type": "part", "mountpoint": "/media/CARD"}]}, {"name": "sdb", "tran": "usb", "model": "M", "mountpoint": "/media/b"}]})
    sd = volumes.sd_facts(spark, ["mmcblk0", "none"], str(tmp_path)).withColumn("host", F.lit("h"))
    out = {r.mount_path: r for r in volumes.linux_volumes(spark.createDataFrame([("h", card)], "host string, lsblk string"), sd=sd).collect()}
    assert out["/media/CARD"].device_model == "SC64G" and out["/media/b"].device_model == "M"
    assert out["/media/CARD"].raw_facts == {"removableDevice": "false", "hotplug": "false", "transport": "mmc", "devicePath": "/dev/p1", "deviceType": "part", "sdOemId": "0x5344"}
    import plistlib

    info = lambda **k: plistlib.dumps(k)
    listed = plistlib.dumps({"All": [{"DeviceIdentifier": "d1", "MountPoint": "/V/A"}, {"Parts": [{"DeviceIdentifier": "d2", "MountPoint": "/"}]}]})
    mac = volumes.macos_volumes(spark, listed, {"d1": info(MountPoint="/V/A", Ejectable=True, VolumeName="A", TotalSize=9), "d2": info(MountPoint="/", Ejectable=True)}).collect()
    assert [(r.mount_path, r.capacity_bytes) for r in mac] == [("/V/A", 9)]


def test_rolling(spark):
    s = spark.createDataFrame([("s", 0, 0, 0), ("s", 1000, 1000, 1), ("s", 10000, 10000, 2), ("s", 10000, 11000, 3), ("s", 30000, 20000, 4)], "session string, at_ms long, completed_bytes long, seq long")
    got = [r.bytes_per_second for r in feeds.rolling_throughput(s).orderBy("seq").collect()]
    assert got == [0.0, 1000.0, 1000.0, 1100.0, 0.0]


def test_streams(spark, tmp_path):
    rows = [("s", i * 1000, i * 500, i) for i in range(20)]
    schema = "session string, at_ms long, completed_bytes long, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = feeds.stream_rolling_throughput(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.seq: r.bytes_per_second for r in spark.table("rolled").collect()}
    want = {r.seq: r.bytes_per_second for r in feeds.rolling_throughput(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
    events = [("s", 0, "status", None, 0, "copying"), ("s", 1, "discovered", "a", 10, None), ("s", 2, "progress", "a", 4, None), ("s", 3, "progress", "a", 10, None), ("s", 4, "completed", "a", 0, None), ("s", 5, "failed", "b", 0, None)]
    schema = "session string, seq long, kind string, file string, bytes long, status string"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "ev"))
    q = feeds.stream_session_fold(spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))).writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [tuple(r) for r in spark.table("folded").collect()] == [("s", 1, 0, 1, 1, 10, 10, "copying")]


def test_volume_feed(spark, tmp_path):
    told, arrived = [], []
    feed = feeds.VolumeFeed(["id"], lambda d: told.append(sorted((r.change, r.id) for r in d.collect())), lambda d: arrived.append([r.id for r in d.collect()]))
    for epoch, ids in enumerate([["a"], ["a", "b"], ["b"], ["b"]]):
        feed(spark.createDataFrame([(i,) for i in ids], "id string"), epoch)
    assert told == [[("arrived", "b")], [("removed", "a")]] and arrived == [["b"]]


def test_transitions(spark):
    e = spark.createDataFrame([("a", 0, "planned"), ("a", 1, "started"), ("a", 2, "verified"), ("b", 0, "planned"), ("b", 1, "verified")], "copy string, seq long, status string")
    assert {r.copy: (r.status, r.valid) for r in feeds.copy_states(e).collect()} == {"a": ("verified", True), "b": ("verified", False)}
    assert constraints.bad_moves(e, ["copy"], ["seq"], schemas.COPY_MOVES).count() == 1


def test_polls(spark):
    p = spark.createDataFrame([(1, "a", False), (2, "a", False), (2, "b", False), (3, None, True), (4, "b", False), (5, "a", False), (5, "b", False)], "poll int, id string, failed boolean")
    assert sorted(tuple(r) for r in feeds.polls_to_changes(p, ["id"]).collect()) == [(2, "arrived", "b"), (4, "removed", "a"), (5, "arrived", "a")]
    assert feeds.throttle_progress(spark.createDataFrame([("c", i, i * 3) for i in range(6)], "copy string, seq int, copied_bytes long"), step=5).select("seq").collect() and F is not None


def test_evict_one_hour_in_many_tasks(spark):
    """A bulk import of one moment: sums by the keys' letters, and ties of time in order of the key."""
    rng = random.Random(1)
    rows = [(f"{rng.randrange(16**12):012x}", rng.randrange(1, 50), rng.choice(["2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00.001Z", "2024-01-01T00:59:00.000Z", "2024-01-01T01:00:00.000Z", None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "cache_key string, size_bytes long, updated_at string")
    total, gone = sum(r[1] for r in rows), set()
    for key, size, _ in sorted(rows, key=lambda r: (r[2] or "", r[0])):
        if total <= 20_000:
            break
        gone.add(key)
        total -= size
    assert {r.cache_key for r in maintenance.evict(df, 20_000).collect()} == gone and 0 < len(gone) < 3000


def test_replay_streams_a_source(spark):
    """One source's samples in many batches: the state is carried on, and the mean is that of a loop, bit by bit."""
    rng = random.Random(2)
    rows = [("hot", i, rng.random() * 1e7) for i in range(25_000)] + [("b", 2, 1.0), ("b", 1, 4.0), ("c", 1, None), (None, 1, 2.0)]
    mean = {}
    for k, _, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        n, m = mean.get(k, (0, 0.0))
        mean[k] = (n, m) if v is None else (n + 1, m + (v - m) / (n + 1))
    rng.shuffle(rows)
    got = maintenance.replay_mean(spark.createDataFrame(rows, "source_id string, at long, bytes_per_second double")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == mean
