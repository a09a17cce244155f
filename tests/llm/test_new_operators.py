"""Runs, collision search and mixed stamps against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import duckdb
import numpy as np
import pytest

from lumenloft.llm import collisions, runs, stamps
from lumenloft.llm import queries as llm

SF = "/root/testdata/sf0.001"


# Runs


def brute_runs(w, shortest=6, repeats=4):
    n, out = len(w), []
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(shortest, repeats * p):
                part = w[i : i + length]
                if not any(all(a == b for a, b in zip(part, part[q:], strict=False)) for q in range(1, p)):
                    out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_smaller(w, sign):
    n = len(w)
    suffix = [[sign * x[0] for x in w[i:]] for i in range(n)]
    out = []
    for i in range(n):
        j = next((j for j in range(i + 1, n) if suffix[j] < suffix[i]), n)
        out.append((j, next((k for k in range(n - j) if w[i + k] != w[j + k]), n - j)))
    return out


@pytest.mark.parametrize(("letters", "most"), [(b"ab", 10), (b"abc", 7)])
def test_every_short_text(letters, most):
    for n in range(most + 1):
        for t in itertools.product([bytes([c]) for c in letters], repeat=n):
            w = list(t)
            for (less, end), sign in zip(runs.ORDERS, (1, -1), strict=True):
                assert list(zip(*runs.next_smaller(w, less, end), strict=True)) == brute_smaller(w, sign)
            for shortest, repeats in ((2, 2), (1, 3), (6, 4)):
                assert runs.runs(w, shortest, repeats) == brute_runs(w, shortest, repeats), w


def test_planted_runs():
    rng = random.Random(5)
    for _ in range(400):
        w = [bytes([97 + rng.randrange(rng.choice([1, 2, 5]))]) for _ in range(rng.randrange(10, 90))]
        for _ in range(rng.randrange(4)):
            a, p, m = rng.randrange(len(w)), rng.randrange(1, 12), rng.randrange(2, 8)
            w[a : a + p * m] = w[a : a + p] * m
        for shortest, repeats in ((2, 2), (6, 4)):
            assert runs.runs(w, shortest, repeats) == brute_runs(w, shortest, repeats)


def test_comparisons_are_linear():
    n = 30_000
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    rng = random.Random(1)
    noise = [bytes([97 + rng.randrange(2)]) for _ in range(n)]
    texts = [[b"a"] * n, b[:n], noise[: n // 2] * 2, noise[:100] * (n // 100), ([b"a"] * 300 + [b"b"]) * (n // 301), [b"a", b"b"] * (n // 2), [bytes([97 + (i & -i).bit_length()]) for i in range(1, n)]]
    for w in texts:
        for less, end in runs.ORDERS:
            effort = []
            runs.next_smaller(w, less, end, effort)
            assert effort[0] <= len(w)


def brute_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs.runs([x.encode() for x in w]) if n > 600 else brute_runs([x.encode() for x in w])
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_run_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = llm.op11_lyndon_runs(spark, SF).collect()
    assert len(got) == len(docs) and sum(r["n_runs"] for r in got)
    for r in got:
        assert tuple(r) == brute_report(r["doc_id"], docs[r["doc_id"]])


def test_run_cases(spark):
    long = "x y " * 400_000
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a " * 7), (3, "a " * 7), (None, "b " * 6), (5, "ä  " * 9), (6, long), (-7, "a b a b a b a b c"), (8, "w")]
    docs = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id long, text string, period string, n_runs int")
    got = sorted((tuple(r) for r in runs.op11_lyndon_runs(docs).collect()), key=str)
    assert got == sorted((brute_report(a, b) for a, b in rows), key=str)
    assert (5, 0, 9, 1) in [tuple(r) for r in runs.runs_of(docs).collect()]
    assert {r["doc_id"]: r["text"] for r in runs.collapsed(docs).collect()} | {0: None, 3: "a", -7: "a b c", 6: "x y"} == {r["doc_id"]: r["text"] for r in runs.collapsed(docs).collect()}
    assert runs.op11_lyndon_runs(docs.limit(0)).collect() == [] == runs.runs_of(docs.limit(0)).collect()


# Collision search


def brute_nearest(ids, x, query, k=5):
    s = (x * x[query]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[query] * x[query]).sum()))
    s[query] = -9
    order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
    return ids[order].tolist(), s[order]


@pytest.mark.parametrize("kind", ["noise", "clusters", "copies"])
def test_recall(kind, monkeypatch):
    rng = np.random.default_rng(3)
    n, dim = 6000, 32
    x = rng.standard_normal((n, dim))
    if kind == "clusters":
        x = rng.standard_normal((60, dim))[rng.integers(0, 60, n)] + 0.05 * x
    if kind == "copies":
        x[: n // 3] = x[0]
    ids = rng.permutation(n).astype(np.int64)
    index = collisions.Index(ids, x)
    hit = total = 0
    for q in range(0, n, 60):
        got, scores, verified = index.search(int(ids[q]), x[q], 5)
        want, best = brute_nearest(ids, x, q)
        assert ids[q] not in got and (np.diff(scores) <= 0).all()
        hit, total = hit + len(set(got.tolist()) & set(want)), total + 5
        if kind == "copies" and q < n // 3:
            assert got.tolist() == want and np.allclose(scores, 1)
        if kind == "clusters":
            assert verified < n / 10
    assert hit >= 0.9 * total


def test_search_query(spark, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK", 100)
    monkeypatch.setattr(collisions, "QUERIES", 4)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in llm.op12_collision_search(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert sorted(got) == [i for i in sorted(ids.tolist()) if i % 50 == 0]
    hit = 0
    for q, found in got.items():
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        at = int(np.flatnonzero(ids == q)[0])
        want, _ = brute_nearest(ids, x, at)
        hit += len(set(want) & {r["vec_id"] for r in found})
        for r in found:
            y = x[np.flatnonzero(ids == r["vec_id"])[0]]
            assert r["score"] == pytest.approx(x[at] @ y / np.sqrt((x[at] @ x[at]) * (y @ y)), abs=1e-12)
    assert hit >= 0.9 * 5 * len(got)


def test_search_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (3, [2.0, 0.2]), (2, [1.0, 0.1]), (50, [0.0, 1.0]), (100, None), (150, [0.0, 0.0]), (200, [nan, 1.0]), (4, [inf, 1.0]), (250, [None, 1.0]), (None, [1.0, 0.0]), (300, [1.0, 2.0, 3.0]), (350, [])]
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<float>, score int, block string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in collisions.op12_collision_search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 50), (50, 1, 1), (50, 2, 2), (50, 3, 3), (50, 4, 0)]
    assert collisions.op12_collision_search(df.limit(0)).collect() == []


# Stamps


def brute_stamps(rows):
    """rows of (id, source, zone, raw) -> (id, utc_us, rule, ambiguous) with Python's own dates and zones."""
    epoch = datetime(1970, 1, 1)
    months = {m: i + 1 for i, m in enumerate(stamps.MONTHS.split())}

    def micros(d):
        return (d - epoch) // timedelta(microseconds=1)

    def read(raw, zone):
        s = None if raw is None else raw.strip(" \t\n\x0b\x0c\r")
        if s is None:
            return None
        if re.fullmatch("[0-9]{10}", s):
            return "epoch", int(s) * 10**6
        if re.fullmatch("[0-9]{13}", s):
            return "epoch", int(s) * 1000
        m = re.fullmatch(r"(.*?)(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?( ?[AP]M)?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?", s, re.DOTALL)
        day, h, mi, sec, half, off = m.groups()
        dates = []
        for form, order in ((r"(20[0-9]{2})-([0-9]{2})-([0-9]{2})", "ymd"), (r"(20[0-9]{2})([0-9]{2})([0-9]{2})", "ymd"), (r"([0-9]{2})\.([0-9]{2})\.(20[0-9]{2})", "dmy"), (r"([0-9]{2}) ([A-Z][a-z]{2}) (20[0-9]{2})", "dmy"), (r"([0-9]{2})/([0-9]{2})/(20[0-9]{2})", "dmy"), (r"([0-9]{2})/([0-9]{2})/(20[0-9]{2})", "mdy")):
            if f := re.fullmatch(form, day):
                v = dict(zip(order, (months.get(x) if x in months else int(x) if x.isdigit() else 0 for x in f.groups()), strict=True))
                try:
                    dates.append(datetime(v["y"], v["m"], v["d"]))
                except ValueError:
                    dates.append(None)
        if not dates:
            return None
        h, mi, sec = int(h or 0), int(mi or 0), int(sec or 0)
        if half:
            h = h % 12 + (12 if half.strip() == "PM" else 0) if 1 <= h <= 12 else 99
        if off and off != "Z" and (int(off[1:3]) > 14 or int(off[-2:]) > 59) or h > 23 or mi > 59 or sec > 59:
            return None
        if not off:
            try:
                ZoneInfo(zone)
            except Exception:
                return None
        minutes = None if not off else 0 if off == "Z" else (int(off[1:3]) * 60 + int(off[-2:])) * (-1 if off[0] == "-" else 1)
        return "date", [d and d.replace(hour=h, minute=mi, second=sec) for d in dates], minutes

    facts = {k: read(r, z) for _, _, z, r in rows for k in [(r, z)]}
    score = {}
    for _, source, zone, raw in rows:
        f = facts[raw, zone]
        if f and f[0] == "date" and len(f[1]) == 2 and (f[1][0] is None) != (f[1][1] is None):
            score.setdefault(source, [0, 0])[f[1][0] is None] += 1
    for i, source, zone, raw in rows:
        f = facts[raw, zone]
        if f is None or f[0] == "date" and not any(f[1]):
            yield i, None, "bad", False
            continue
        if f[0] == "epoch":
            yield i, f[1], "epoch", False
            continue
        _, dates, off = f
        rule, d = "plain", next(x for x in dates if x)
        if len(dates) == 2 and all(dates) and dates[0] != dates[1]:
            a, b = score.get(source, (0, 0))
            rule, d = ("votes", dates[0]) if a > 3 * b else ("votes", dates[1]) if b > 3 * a else ("default", dates[1])
        if off is not None:
            yield i, micros(d - timedelta(minutes=off)), rule, rule != "plain"
            continue
        z = ZoneInfo(zone)
        first, second = d.replace(tzinfo=z, fold=0), d.replace(tzinfo=z, fold=1)
        odd = first.utcoffset() != second.utcoffset()
        yield i, micros(d - first.utcoffset()), rule, rule != "plain" or odd


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def fuzz(seed, n):
    rng = random.Random(seed)
    zones = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe", "Pacific/Apia", "America/Sao_Paulo", None, "Nowhere/Land"]
    for i in range(n):
        y, mo, d, h, mi, s = rng.choice([2000, 2011, 2016, 2024, 2024, 2099]), rng.randrange(0, 14), rng.randrange(0, 33), rng.randrange(0, 25), rng.choice([0, 1, 30, 59, 60]), rng.choice([0, 59, 60])
        date = rng.choice(["{y}-{mo:02}-{d:02}", "{y}{mo:02}{d:02}", "{d:02}.{mo:02}.{y}", "{d:02} {b} {y}", "{d:02}/{mo:02}/{y}", "{mo:02}/{d:02}/{y}", "{d:02}/{mo:02}/{y}", "{d}/{mo}/{y}", "{y}/{mo:02}/{d:02}"]).format(y=y, mo=mo, d=d, b=(stamps.MONTHS.split() * 2)[mo])
        time = rng.choice(["", "{t}{h:02}:{mi:02}", "{t}{h:02}:{mi:02}:{s:02}"]).format(t=rng.choice("T   t"), h=h, mi=mi, s=s)
        if time:
            time += rng.choice(["", "", "", "AM", " PM", "  PM"]) + rng.choice(["", "", "", "Z", " +05:30", "-0800", "+14:59", "+15:00", " -00:60", "+5:30"])
        raw = rng.choice([date + time] * 8 + ["1700000000", "1700000000123", "170000000", None, "", "ten", date + time + "\n\t ", " " * 100 + date + time, date + time + "x" * 100, "2024-01-01|", "１２/03/2024"])
        yield i, rng.choice(["a", "b", "b", "b", None]), rng.choice(zones), raw


def edges():
    for zone, days in (("America/New_York", ["2024-03-10", "2024-11-03"]), ("Europe/Berlin", ["2024-03-31", "2024-10-27"]), ("Australia/Lord_Howe", ["2024-04-07", "2024-10-06"]), ("Pacific/Apia", ["2011-12-29", "2011-12-30", "2011-12-31"]), ("America/Sao_Paulo", ["2018-11-04", "2018-02-17", "2018-02-18"])):
        for day in days:
            for h in range(24):
                for m in ("00", "15", "30", "59"):
                    yield zone, f"{day} {h:02}:{m}"
            yield zone, day


def test_stamp_fuzz(spark):
    rows = list(fuzz(1, 6000))
    rows += [(10_000 + i, "e", z, r) for i, (z, r) in enumerate(edges())]
    rows += [(20_000 + i, source, "UTC", f"{a:02}/{b:02}/2024") for i, (source, a, b) in enumerate([("d", 25, 3), ("d", 5, 6), ("m", 3, 25), ("m", 5, 6), ("m", 7, 7)])]
    df = spark.createDataFrame(rows, "stamp_id long, source string, zone string, raw string")
    got = [tuple(r) for r in stamps.op13_stamp_dictionary(df).collect()]
    want = list(brute_stamps(rows))
    assert {r for _, _, r, _ in want} == {"bad", "epoch", "plain", "votes", "default"} and sum(x[3] for x in want) > 100
    same(got, want)
    con = duckdb.connect()
    con.register("stamps", df.toPandas())
    same([tuple(r) for r in con.sql(f"select stamp_id, utc_us, rule, ambiguous from ({stamps.ORACLE})").fetchall()], want)


def test_stamp_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/stamps.parquet").select("stamp_id", "source", "zone", "raw").collect()]
    same([tuple(r) for r in llm.op13_stamp_dictionary(spark, SF).collect()], brute_stamps(rows))


def test_stamp_cases(spark):
    """Heavy and repeated rows, ties of votes, null sources, clashing columns, an empty table."""
    rows = [(1, "a", "UTC", "01/02/2024")] * 3 + [(i, "hot", "UTC", None) for i in range(500)] + [(i, None, "Europe/Berlin", "05/06/2024 10:00") for i in range(300)]
    rows += [(9, "a", "UTC", "13/02/2024")] * 3 + [(9, "a", "UTC", "02/13/2024"), (9, None, "UTC", "13/02/2024"), (None, "a", "UTC", "2024-01-01")]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "stamp_id long, source string, zone string, raw string, n int, salt int, rule string")
    same([tuple(r) for r in stamps.op13_stamp_dictionary(df).collect()], brute_stamps(rows))
    assert stamps.op13_stamp_dictionary(df.limit(0)).collect() == []


def test_search_costs_few_passes():
    """A search of noise, where windows hold half of each line, costs little more than verifying the whole block a few times."""
    import time

    rng = np.random.default_rng(5)
    x = rng.standard_normal((8192, 64))
    index = collisions.Index(np.arange(8192), x)

    def least(f):
        took = []
        for q in range(12):
            start = time.perf_counter()
            f(q)
            took.append(time.perf_counter() - start)
        return min(took)

    assert least(lambda q: index.search(q, x[q], 5)) < 4 * least(lambda q: (x[np.arange(8192)] * x[q]).sum(1))
    # what is found doesn't depend on the queries before
    got = [index.search(q, x[q], 5) for q in range(8)]
    again = collisions.Index(np.arange(8192), x)
    for q in range(7, -1, -1):
        ids, _, verified = again.search(q, x[q], 5)
        assert ids.tolist() == got[q][0].tolist() and verified == got[q][2]
