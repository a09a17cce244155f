"""Decision functions against literals and plain Python."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lumenloft.functions import core, dates, hashing, media, paths


def one(spark, rows, schema, c):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(c).collect()]


def texts(spark, values, c):
    return one(spark, [(v,) for v in values], "v string", c)


def test_sanitize(spark):
    got = texts(spark, ["CON", "camera... ", "../bad:name", "../CON", "..", "", "com1.txt", "conx", "a\x01b", "e\u0301"], paths.sanitize_segment("v"))
    assert got == ["_CON", "camera", ".._bad_name", ".._CON", "_", "_", "_com1.txt", "conx", "a_b", "\u00e9"]
    assert texts(spark, ["a:b. ", "/x", "."], paths.sanitize_segment("v", "posix")) == ["a:b. ", "_x", "_"]


def test_names(spark):
    assert texts(spark, ["a.JPG", ".jpg", "a.", "a.b.c", "x"], paths.extname("v")) == [".jpg", "", ".", ".c", ""]
    assert texts(spark, ["a.JPG", ".jpg", "ab"], paths.suffix_filename("v", F.lit("s"))) == ["a-s.JPG", ".jpg-s", "ab-s"]
    assert texts(spark, ["a/b/../c.jpg", "/a", "../x", "a\\b", "", "./a"], paths.normalize_relative_path("v")) == ["a/c.jpg", None, None, "a\\b", None, "a"]
    assert texts(spark, ["a\\b", "C:\\x", "c/d"], paths.normalize_relative_path("v", "windows")) == ["a/b", None, "c/d"]
    assert texts(spark, ["e\u0301/A"], paths.canonical_path_key("v")) == ["\u00e9/A"]
    assert texts(spark, ["a/b", "a/../b", "/a", "C:/a", "a/..b"], paths.is_safe_relative("v")) == [True, False, False, False, True]
    assert texts(spark, [" .JPG", "tar.gz", ""], paths.normalize_extension("v")) == [".jpg", None, None]
    assert texts(spark, ["a/b.jpg"], paths.temp_path("v", F.lit("s"), F.lit("c"))) == ["a/.b.jpg.s.c.tmp"]


@pytest.mark.parametrize("template, bad", [(paths.DEFAULT_TEMPLATE, 0), ("", 3), ("/{originalFilename}", 2), ("a\\{originalFilename}", 1), ("{YYYY}", 1), ("{x}/{originalFilename}", 1), ("{originalFilename}/../{", 2), ("a//{originalFilename}", 1)])
def test_template_problems(template, bad):
    assert len(paths.validate_template(template)) == bad


def test_template(spark):
    rows = [("2021-02-03", "Card", "a.jpg", None), ("2021-02-30", "Card", "a.jpg", None), ("2021-02-03", "C" * 300, "a.jpg", None), ("2021-02-03", "Card", "a.jpg", "nick")]
    c = paths.compile_template("{YYYY}/{YYYY-MM-DD}/{nickname}/{originalFilename}", "d", "l", "f", "n")
    assert one(spark, rows, "d string, l string, f string, n string", c) == ["2021/2021-02-03/Card/a.jpg", None, None, "2021/2021-02-03/nick/a.jpg"]


def test_hashes(spark):
    s = hashlib.sha256(b"zz").hexdigest()[:8]
    assert texts(spark, ["ABCDEF0123", "zz", "xx-deadbeef99"], hashing.short_checksum("v")) == ["abcdef01", s, "deadbeef"]
    field = lambda t: len(t.encode()).to_bytes(4, "big") + t.encode()
    want = hashlib.sha256(b"".join(map(field, ["quick-fingerprint.v1", "\u00e9.jpg", "12", "2021-01-01T00:00:00.000Z"]))).hexdigest()
    assert texts(spark, ["\u00e9.jpg"], hashing.quick_fingerprint("v", F.lit(12), F.lit("2021-01-01T00:00:00Z"))) == ["quick-v1:" + want]
    cursor = texts(spark, ["a/\u00e9?>"], hashing.cursor("v", F.lit("7")))[0]
    assert hashing.decode_cursor(cursor) == ("a/\u00e9?>", "7") and cursor == hashing.encode_cursor("a/\u00e9?>", "7")
    key = {"checksum": "c", "format": "webp", "height": 2, "version": 1, "width": 3}
    assert texts(spark, ["c"], hashing.thumbnail_cache_key("v", 3, 2)) == [hashlib.sha256(json.dumps(key, separators=(",", ":")).encode()).hexdigest()]


DATES = [
    ({"DateTimeOriginal": "2021:02:03 04:05:06"}, ("2021-02-03T04:05:06", "floating", "DateTimeOriginal", None)),
    ({"DateTimeOriginal": "2021:02:03 04:05:06Z"}, ("2021-02-03T04:05:06Z", "utc", "DateTimeOriginal", 0)),
    ({"DateTimeOriginal": "2021:02:03 04:05:06.123456789-0730"}, ("2021-02-03T04:05:06.123456789-07:30", "offset", "DateTimeOriginal", -450)),
    ({"DateTimeOriginal": "2021:02:03 04:05:06+14:30", "CreateDate": "2020-01-01T00:00:00"}, ("2020-01-01T00:00:00", "floating", "CreateDate", None)),
    ({"DateTimeOriginal": "2021:02:03 04:05:06", "OffsetTimeOriginal": "+99:00"}, ("2021-02-03T04:05:06", "floating", "DateTimeOriginal", None)),
    ({"CreateDate": "2021:02:03 04:05:06", "CreateDateOffset": "+02:00", "TimeZone": "+05:00"}, ("2021-02-03T04:05:06+02:00", "offset", "CreateDate", 120)),
    ({"MediaCreateDate": "2021:02:29 00:00:00"}, ("2022-05-06T07:08:09.000Z", "fallback", "filesystem-modifiedAt", 0)),
    ({"MediaCreateDate": "1899:01:01 00:00:00"}, ("2022-05-06T07:08:09.000Z", "fallback", "filesystem-modifiedAt", 0)),
    ({}, ("2022-05-06T07:08:09.000Z", "fallback", "filesystem-modifiedAt", 0)),
]


@pytest.mark.parametrize("tags, want", DATES)
def test_capture_date(spark, tags, want):
    names = [n.split()[0] for n in dates.CANDIDATES.split(", ")]
    df = spark.createDataFrame([(tuple(tags.get(n) for n in names),)], f"c struct<{dates.CANDIDATES.replace(' string', ':string')}>")
    n = df.select(dates.normalize_capture_date("c", F.lit("2022-05-06T07:08:09Z"), F.lit("2022-01-01T00:00:00Z")).alias("n")).select("n.*", dates.capture_is_consistent("n").alias("ok")).first()
    assert (n.capture_at, n.capture_timezone_kind, n.capture_at_source, n.capture_offset_minutes) == want and n.ok


def test_media(spark):
    assert texts(spark, ["jpg", ".MOV", ".xyz"], media.media_type("v")) == ["photo", "video", "unknown"]
    assert texts(spark, [".jpg"], media.media_type("v", F.lit("video/x"))) == ["video"]
    rows = [(1.0, None, 0), (6e6, None, 0), (4.9, 10.0, 3), (5.0, 10.0, 3), (1.0, 10.0, 2)]
    got = one(spark, rows, "c double, a double, n int", media.evaluate_throughput("c", "a", "n"))
    assert [tuple(g) for g in got] == [(True, "below-baseline"), (False, "normal"), (True, "below-historical-average"), (False, "normal"), (True, "below-baseline")]
    rows = [(0, 5, 1.0), (200, 1, 2.0), (100, 150, 1.0), (100, 50, 0.0)]
    assert [tuple(g) for g in one(spark, rows, "t long, c long, r double", media.progress_telemetry("t", "c", "r"))] == [(0, None, 0), (1, 100, 199), (100, None, 0), (50, None, 50)]
    assert one(spark, [(512,), (1536,), (5 << 30,)], "v long", media.exact_bytes("v")) == ["512 B (512 B)", "1.5 KiB (1,536 B)", "5.0 GiB (5,368,709,120 B)"]
    assert one(spark, [(64_000_000_000,), (0,)], "v long", media.capacity_bucket("v")) == [68719476736, None]
    assert texts(spark, ["a-b", "a--b", "A", "x" * 64, None], media.is_nickname("v")) == [True, False, False, False, False]
    assert one(spark, [(1,), (3,), (20,)], "v int", media.retry_delay_ms("v")) == [30000, 120000, 3600000]
    assert texts(spark, ["12", "x", str(2**53)], core.safe_capacity("v")) == [12, None, None]
    assert one(spark, [(-2.5,), (2.5,)], "v double", core.js_round("v")) == [-2, 3]


def test_byte_labels_at_halves(spark):
    """Tenths against whole-number arithmetic: halves to the even tenth as printf has them, or up; sums up to 2^53 - 1."""

    def label(b, halves):
        p = 1 if b < 1024**2 else 2 if b < 1024**3 else 3
        tenths, rest = divmod(b * 10, 1024**p)
        tenths += 2 * rest > 1024**p or (2 * rest == 1024**p and (halves == "up" or tenths % 2 == 1))
        return f"{tenths // 10}.{tenths % 10} {['', 'KiB', 'MiB', 'GiB'][p]} ({b:,} B)"

    sizes = [47_360, 303_360, 1280, 1792, 1024, 1024**2 - 1, 5 * 2**18, 7 * 2**18, 7 * 2**28, 2**53 - 1, (2**23 - 1) * 2**30 + 161061274, *(k * 256 + 1024 for k in range(1, 60))]
    for halves in ("up", "even"):
        assert one(spark, [(b,) for b in sizes], "v long", media.exact_bytes("v", halves)) == [label(b, halves) for b in sizes]
    assert label(47_360, "even").startswith("46.2 ") and label(47_360, "up").startswith("46.3 ")
