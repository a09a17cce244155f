"""Readers that hang, crash, leak or fail lose their own files only."""

import os
import time

import pytest

from lumenloft.sources import records
from lumenloft.sources.readers import Limits, read_all


def reader(name):
    if name.startswith("hang"):
        time.sleep(60)
    if name.startswith("crash"):
        os._exit(3)
    if name.startswith("bad"):
        raise OSError(name)
    if name.startswith("odd"):
        return lambda: None  # can't be sent back
    return f"{name}:{os.getpid()}"


def outcomes(names, **limits):
    out = list(read_all(names, reader, Limits(**limits)))
    assert [n for n, _, _ in out] == list(names)
    return {n: e or v.split(":")[0] for n, v, e in out}, {v.split(":")[1] for _, v, e in out if not e}


def test_only_their_own_files():
    began = time.time()
    names = ["a", "hang1", "b", "crash1", "c", "bad1", "odd1", *[f"x{i}" for i in range(40)], "hang2", "d"]
    got, pids = outcomes(names, timeout_s=1.0, losses=3)
    want = {n: n for n in names} | {"hang1": "READ_TIMEOUT", "hang2": "READ_TIMEOUT", "crash1": "READER_CRASHED", "bad1": "OSError"}
    assert got.pop("odd1") not in ("odd1", "READ_TIMEOUT", "READER_CRASHED") and want.pop("odd1") and got == want
    assert time.time() - began < 20 and str(os.getpid()) not in pids


def test_recycling_and_circuit():
    got, pids = outcomes([f"x{i}" for i in range(20)], processes=1, files=4)
    assert set(got) == set(got.values()) and len(pids) == 5
    began = time.time()
    got, _ = outcomes([f"hang{i}" for i in range(30)] + ["late"], timeout_s=0.3, losses=4, processes=2)
    assert time.time() - began < 10
    assert list(got.values()).count("READ_TIMEOUT") in (4, 5) and got["late"] == "READER_UNAVAILABLE"
    assert outcomes([]) == ({}, set())
    with pytest.raises(ValueError):
        Limits(processes=0)
    with pytest.raises(ValueError):
        Limits(timeout_s=0)


def test_no_children_are_left():
    rows = read_all([f"x{i}" for i in range(50)] + ["hang"], reader, Limits(timeout_s=30))
    pid = int(next(rows)[1].split(":")[1])
    rows.close()  # a task that is cancelled
    with pytest.raises(ProcessLookupError):
        os.kill(pid, 0)


def test_in_tasks(spark):
    def tags(path):
        if path == "hang":
            time.sleep(60)
        if path == "crash":
            os._exit(1)
        return {"Make": path, "None": None}

    names = ["a", "hang", "b", "crash", "c"]
    df = spark.createDataFrame([(n,) for n in names], "path string").coalesce(1)
    got = {r.path: r.tags["Make"] if r.tags else r.error for r in records.read_tags(df, tags, limits=Limits(timeout_s=1.0)).collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "hang": "READ_TIMEOUT", "crash": "READER_CRASHED"}
