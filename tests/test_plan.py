"""Destinations against a sequential brute force: clashing names, records inside families, shared short sums, hot names."""

import os
import random

import pytest

from lumenloft.operators import plan

FRESH = "directory string, name string, file string, relative_path string, checksum string, short string"


def brute(fresh, old):
    taken = {(d, n): v for d, n, v in old}
    out = {}
    for d, name, file, _, checksum, short in sorted(fresh, key=lambda r: (r[0], r[3], r[2])):
        stem, ext = os.path.splitext(name)
        turn, at = 0, name
        while (d, at) in taken and (taken[d, at] is None or taken[d, at] != checksum):
            turn += 1
            at = f"{stem}-{short}{ext}" if turn == 1 else f"{stem}-{short}-{turn}{ext}"
        out[file] = ("reuse" if (d, at) in taken else "new", f"{d}/{at}" if d else at, checksum)
        taken.setdefault((d, at), checksum)
    return out


def check(spark, fresh, old):
    got = plan.plan_names(spark.createDataFrame(fresh, FRESH), spark.createDataFrame(old, "directory string, name string, verified string")).collect()
    assert len(got) == len(fresh)
    assert {r.file: (r.kind, r.destination_path, r.checksum) for r in got} == brute(fresh, old)


@pytest.mark.parametrize("clashes", [True, False])
def test_random_batches(spark, clashes):
    rng = random.Random(7)
    sums = [f"{i:08x}" + x for i in range(4) for x in ("", "y" * clashes)]
    suffixes = [f"-{i:08x}{k}" for i in range(5) for k in ("", "-2", "-3", "-4", "-1", "-02")]
    fresh, old = [], {}
    for i in range(1500):
        base = rng.choice(["a", "b", "c.d", ".e", "f-00000001", "-00000002", "g-2", "", ".", "..h"])
        name = base + ("".join(rng.choice(suffixes) for _ in range(rng.randrange(3))) if clashes and rng.random() < 0.2 else "") + rng.choice([".jpg", "", ".JPG", "."])
        checksum = rng.choice(sums)
        fresh.append((f"d{rng.randrange(60)}" if i % 10 else "", name or "x", f"f{i}", f"p{rng.randrange(900):03d}", checksum, checksum[:8]))
    for _ in range(1500):
        d, name, *_ = rng.choice(fresh)
        stem, ext = os.path.splitext(name)
        at = name if rng.random() < 0.3 else stem + "".join(rng.choice(suffixes) for _ in range(rng.choice([1, 1, 1, 2]))) + ext
        old[d, at] = rng.choice([None, *sums])
    check(spark, fresh, [(d, n, v) for (d, n), v in old.items()])


def test_one_directory_is_spread(spark):
    """Many files of one directory, and many of one name, don't meet in one task; only clashing roots are read in order."""
    fresh = [("d", f"IMG_{i}.jpg", f"a{i}", f"p{i:05d}", f"{i:08x}", f"{i:08x}") for i in range(3000)]
    fresh += [("d", "hot.jpg", f"b{i}", f"q{i:05d}", f"{i % 700:08x}", f"{i % 700:08x}") for i in range(3000)]
    fresh += [("d", "clash.jpg", "c1", "r1", "0000000a", "0000000a"), ("d", "clash-0000000b.jpg", "c2", "r2", "0000000c", "0000000c"), ("d", "clash.jpg", "c3", "r3", "0000000b", "0000000b")]
    old = [("d", "hot-00000001.jpg", "00000001"), ("d", "hot-00000002.jpg", None), ("d", "hot-00000002-2.jpg", "00000003"), ("d", "IMG_7.jpg", "00000007")]
    check(spark, fresh, old)
    named = spark.createDataFrame(fresh, FRESH)
    claims = named.withColumn("root", plan.root_of(named["name"])).groupBy("directory", "root", "name", "checksum").agg({"short": "first"}).withColumnRenamed("first(short)", "short")
    assert [tuple(r) for r in plan.clashing_roots(claims).collect()] == [("d", "clash.jpg")]


def test_no_rows(spark):
    check(spark, [("d", "a.jpg", "f", "p", "0" * 8, "0" * 8)], [])
    empty = spark.createDataFrame([], FRESH)
    assert plan.plan_names(empty, spark.createDataFrame([("d", "a", None)], "directory string, name string, verified string")).collect() == []


def test_files_are_read_once(spark):
    """However many branches read the names, the files that they are made of are read once."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    files = spark.range(60).select(
        F.col("id").cast("string").alias("file"), F.format_string("p%03d", "id").alias("relative_path"), F.lit("2021-02-03").alias("capture_day"), F.lit("card").alias("label"), F.lit(None).cast("string").alias("nickname"),
        counted(F.concat(F.lit("a"), (F.col("id") % 7).cast("string"), F.lit(".jpg"))).alias("original_filename"), F.lpad((F.col("id") % 20).cast("string"), 8, "0").alias("checksum"),
    )
    old = spark.createDataFrame([("2021/2021-02-03/card/a1.jpg", "00000001")], "destination_path string, verified_checksum string")
    got = plan.plan_destinations(files, old).collect()
    assert seen.value == 60
    fresh = [("2021/2021-02-03/card", f"a{i % 7}.jpg", str(i), f"p{i:03d}", f"{i % 20:08d}", f"{i % 20:08d}") for i in range(60)]
    assert {r.file: (r.kind, r.destination_path, r.checksum) for r in got} == brute(fresh, [("2021/2021-02-03/card", "a1.jpg", "00000001")])
