"""The partitioned listing against the sequential walk, its pushed filters, its bound, and lookups of exact paths."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenloft.sources import listing


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("card")
    rng = random.Random(4)
    for _ in range(400):
        parts = [rng.choice(["DCIM", "a", "a b", "A", "b", "B", ".hide", "$RECYCLE.BIN", "é", "deep"]) for _ in range(rng.randrange(0, 6))]
        folder = root.joinpath(*parts)
        folder.mkdir(parents=True, exist_ok=True)
        name = rng.choice(["x", "X", "_DSC", ".dot", "z z", "ä", "é"]) + str(rng.randrange(30)) + rng.choice([".jpg", ".JPG", ".mov", ".txt", ""])
        if not (folder / name).exists():
            (folder / name).write_bytes(b"x" * rng.randrange(9))
    (root / "link").symlink_to(root / "DCIM")
    return root


def rows_of(scan):
    return [(r.type, tuple(r.file) if r.file else None, tuple(r.error) if r.error else None) for r in scan.collect()]


@pytest.mark.parametrize("options", [{}, {"hidden": True}, {"max_depth": 2}, {"extensions": ["txt", ".Mov"]}, {"excluded": ["A", "deep"]}, {"max_entries": 1}, {"max_entries": 37}, {"max_entries": 90, "hidden": True}, {"follow": True}])
@pytest.mark.parametrize("parts", [1, 3, 64])
def test_equals_the_walk(spark, tree, options, parts, monkeypatch):
    monkeypatch.setattr(listing, "SLICE", 7)
    want = list(listing.walk(str(tree), **options))
    got = rows_of(listing.scan_media(spark, str(tree), parts=parts, **options))
    assert sorted(got, key=str) == sorted(want, key=str) and want
    assert [r for r in got if r[0] == "file"] == [r for r in want if r[0] == "file"]  # in order


def test_partitions_share_the_work(tree, monkeypatch):
    monkeypatch.setattr(listing, "SLICE", 7)
    rules = listing.Rules.of({})
    units = listing.units_of(str(tree), rules, 8)
    lots = listing.packed(units, 8)
    assert 2 < len(lots) <= 8
    each = [[r for u in lot for r in listing.entries(u, rules)] for lot in lots]
    assert sum(bool(x) for x in each) > 2
    assert sorted(r[2] for x in each for r in x) == sorted(f[0] for k, f, _ in listing.walk(str(tree)) if k == "file")


def test_flat_folder_is_sliced(tmp_path):
    for i in range(100):
        (tmp_path / f"{i}.jpg").touch()
    listing_slice, listing.SLICE = listing.SLICE, 10
    try:
        units = listing.units_of(str(tmp_path), listing.Rules.of({}), 16)
        found = [[r[2] for r in listing.entries(u, listing.Rules.of({}))] for u in units]
    finally:
        listing.SLICE = listing_slice
    assert len(units) == 10 and sum(bool(x) for x in found) > 7 and sorted(x for y in found for x in y) == sorted(f"{i}.jpg" for i in range(100))


def test_filters_are_pushed(spark, tree, tmp_path):
    """A filter's rows are the filtered rows, and the source reads no more than it must."""
    flat = listing.list_media(spark, str(tree))
    all_ = {r.relative_path for r in flat.filter("type = 'file'").collect()}
    some = sorted(all_)[::7]
    assert {r.relative_path for r in flat.filter(F.col("relative_path").isin([*some, "none.jpg", "../x.jpg", "a//b.jpg"])).collect()} == set(some)
    assert {r.relative_path for r in flat.filter(F.col("relative_path").startswith("a/")).collect()} == {p for p in all_ if p.startswith("a/")}
    assert {r.relative_path for r in flat.filter(F.col("relative_path").startswith("a/b/x")).collect()} == {p for p in all_ if p.startswith("a/b/x")}
    assert {r.relative_path for r in flat.filter("extension = '.mov'").collect()} == {p for p in all_ if p.lower().endswith(".mov")}
    # a whole scan's struct hides nothing from the pushdown
    assert [r.relative_path for r in listing.files_of(listing.scan_media(spark, str(tree), max_entries=0)).filter(F.col("relative_path") == some[0]).collect()] == [some[0]]

    def reader(*filters):
        r = listing._Reader({"path": str(tree), "parts": "8"})
        assert list(r.pushFilters(list(filters))) == list(filters)
        return [u for p in r.partitions() for u in p.units]

    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    assert [(u.kind, u.paths) for u in reader(In(("relative_path",), ("a/x.jpg", "b.jpg")), EqualTo(("relative_path",), "b.jpg"))] == [("paths", ["b.jpg"])]
    assert all(u.path == "a/b" or u.path.startswith("a/b/") for u in reader(StringStartsWith(("relative_path",), "a/b/x")))
    assert reader(StringStartsWith(("relative_path",), "link/")) == [] == reader(StringStartsWith(("relative_path",), "../"))


def test_links_and_odd_roots(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"1")
    (tmp_path / "to").symlink_to(tmp_path / "a.jpg")
    assert [r.relative_path for r in listing.files_of(listing.scan_media(spark, str(tmp_path))).collect()] == ["a.jpg"]
    assert [(r.code, r.relative_path) for r in listing.errors_of(listing.scan_media(spark, str(tmp_path / "gone"))).collect()] == [("DIRECTORY_UNREADABLE", "")]
    (tmp_path / "empty").mkdir()
    assert listing.scan_media(spark, str(tmp_path / "empty")).collect() == []
    two = listing.scan_media(spark, str(tmp_path), str(tmp_path / "empty"))
    assert [r.relative_path for r in listing.files_of(two).collect()] == ["a.jpg"]


def test_lookup(spark, tmp_path):
    root = tmp_path / "archive"
    (root / "d").mkdir(parents=True)
    (root / "d" / "a.xyz").write_bytes(b"abc")
    (root / "d" / ".b").write_bytes(b"")
    (tmp_path / "out.jpg").write_bytes(b"abc")
    (root / "l.jpg").symlink_to(tmp_path / "out.jpg")
    (root / "up").symlink_to(tmp_path)
    os.mkfifo(root / "pipe")
    asked = [("d/a.xyz", 3), ("d/.b", None), ("d/a.xyz/x", 1), ("gone", 1), ("l.jpg", 3), ("up/out.jpg", 3), ("../out.jpg", 3), ("/etc/passwd", 1), ("d", 0), ("pipe", 0), ("", 0)]
    got = {r.relative_path: (r.state, r.size_bytes, r.sha256) for r in listing.lookup_files(spark, str(root), spark.createDataFrame(asked, "relative_path string, hash_if_size long")).collect()}
    refused = ("refused", None, None)
    assert got == {"d/a.xyz": ("file", 3, hashlib.sha256(b"abc").hexdigest()), "d/.b": ("file", 0, None), "d/a.xyz/x": refused, "gone": ("missing", None, None), "l.jpg": refused, "up/out.jpg": refused, "../out.jpg": refused, "/etc/passwd": refused, "d": refused, "pipe": refused, "": refused}
