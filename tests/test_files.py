"""Small writers and readers that work on files."""

import json

from lumenloft import schemas
from lumenloft.operators import plan, recover
from lumenloft.sinks import writers
from lumenloft.sources import records
from lumenloft.streaming import feeds


def test_logs_and_card_events(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01T00:00:00Z", "s", "info", "copy", "done", "/card/a", None, 5)], "timestamp string, session_id string, level string, phase string, message string, source_path string, destination_path string, bytes long")
    for _ in range(2):
        writers.write_logs(writers.log_lines(events, redact=True), str(tmp_path / "log"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "log" / "text")).collect()]
    assert lines == ["2024-01-01T00:00:00Z [INFO] copy done (5 bytes) [redacted]"] * 2
    assert {json.loads(r.value)["sourcePath"] for r in spark.read.text(str(tmp_path / "log" / "structured")).collect()} == {"[redacted]"}
    writers.append_card_event(str(tmp_path), "one\n", "own")
    writers.append_card_event(str(tmp_path), "two", "own")
    assert (tmp_path / "own" / "events.log").read_text() == "one\ntwo\n"


def test_temporary_files(spark, tmp_path):
    (tmp_path / "2021").mkdir()
    for name in (".a.jpg.s.c.tmp", ".b.jpg.x.c.tmp", "a.jpg"):
        (tmp_path / "2021" / name).write_bytes(b"x")
    listing = spark.createDataFrame([("2021/.a.jpg.s.c.tmp",), ("2021/.b.jpg.x.c.tmp",), ("2021/a.jpg",)], "path string")
    copies = spark.createDataFrame([("c", "s", "2021/a.jpg")], "copy string, session string, destination_path string")
    assert [tuple(r) for r in recover.owned_temps(listing, copies).collect()] == [("2021/.a.jpg.s.c.tmp", "c")]
    assert writers.remove_owned_temp(str(tmp_path), "2021/.a.jpg.s.c.tmp", ".a.jpg.s.") and not writers.remove_owned_temp(str(tmp_path), "2021/a.jpg", ".a.jpg.s.")
    assert sorted(p.name for p in (tmp_path / "2021").iterdir()) == [".b.jpg.x.c.tmp", "a.jpg"]


def test_thumbnails(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"picture")
    wanted = spark.createDataFrame([("k1", "a.jpg"), ("k1", "a.jpg"), ("k2", "none.jpg")], "cache_key string, relative_path string")
    made = {r.cache_key: (r.content and bytes(r.content), r.error) for r in writers.make_thumbnails(wanted, str(tmp_path), lambda data: data[:3]).collect()}
    assert made == {"k1": (b"pic", None), "k2": (None, "FileNotFoundError")}
    assert writers.failed_thumbnail(0, 0, 5, 1000) == (1, 31_000) and writers.failed_thumbnail(1, 2, 5, 0) == (4, 240_000) and writers.failed_thumbnail(3, 1, 5, 0) == (5, None)
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "k1.webp").write_bytes(b"abc")
    (cache / "k2.webp").write_bytes(b"abcd")
    rows = [(k, f"{k}.webp", "image/webp", 1, 1, 3, "a", "a") for k in ("k1", "k2")]
    got = records.thumbnail_bytes(spark, str(cache), spark.createDataFrame(rows, schemas.ARTIFACTS)).collect()
    assert [(r.cache_key, bytes(r.content)) for r in got] == [("k1", b"abc")]  # k2 doesn't have its recorded size


def test_tags_and_locks(spark):
    def reader(path):
        if path == "bad":
            raise OSError(path)
        return {"Make": "acme", "Width": None}

    out = {r.path: (r.tags, r.error) for r in records.read_tags(spark.createDataFrame([("a",), ("bad",)], "path string"), reader).collect()}
    assert out == {"a": ({"Make": "acme", "Width": None}, None), "bad": (None, "OSError")}
    lock = feeds.SessionLock()
    assert lock("a") is lock("a") and lock("a") is not lock("b")
    with lock("a"):
        assert not lock("a").acquire(blocking=False) and lock("b").acquire(blocking=False)


def test_plan_by_window_refuses_clashes(spark):
    import pytest

    rows = [("1", "p1", "a" * 64, "d/x.jpg"), ("2", "p2", "b" * 64, "d/x.jpg"), ("3", "p3", "c" * 64, "d/x-bbbbbbbb.jpg")]
    cols = "file string, relative_path string, checksum string, dest string"
    good = plan.plan_by_window(spark.createDataFrame(rows[:2], cols))
    assert {r.file: r.destination_path for r in good.collect()} == {"1": "d/x.jpg", "2": "d/x-bbbbbbbb.jpg"}
    with pytest.raises(Exception, match="two files plan one path"):
        plan.plan_by_window(spark.createDataFrame(rows, cols)).collect()
    assert plan.plan_total_matches(3, spark.createDataFrame(rows, cols)).first().ok
