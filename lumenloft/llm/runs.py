"""Periodic runs of words, by the Lyndon arrays of Ellert and Fischer's linear-time algorithm for ordered alphabets.

A run is a stretch with smallest period q whose elements q apart are equal and which no neighbour extends. Under one of two
orders of the alphabet (the given one and its inverse, the end being smallest in both) every run with two or more periods
has a position whose next smaller suffix lies one period on. So runs are found from the next-smaller-suffix (Lyndon) arrays
of both orders: `next_smaller` walks from left to right with the stack of previous smaller suffixes, and compares elements
only by < and =. A comparison of two suffixes starts with what is known already:

  * the next suffix on the stack shares with the new one the smaller of two known extensions, or more if they are equal;
  * inside the second copy of the match that reaches furthest, a pair has the extension of its image in the first copy, or
    one that reaches the copy's end; nothing inside is compared again.

So each success moves the furthest reach, and an array takes linear time. No suffix array, tree or hash is made; the words
themselves, as UTF-8 bytes, are the alphabet. A run's root is then extended to the left by less than a period (an earlier
root of the same run is skipped), which is at most a period for each run with as many repeats as asked for.

Defined cases: null, empty and blank texts have no words and no runs; a null id is kept and, in the query, alters no text;
texts of any length are searched whole, each by one task; repeated rows give repeated results; other columns are ignored;
an empty table gives an empty result. Of runs of equal length the first start, then the shorter period, comes first."""

from __future__ import annotations

import hashlib
import operator
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, plain

SHORTEST, REPEATS = 6, 4  # a reported run has at least so many words, and so many periods
AT_ONCE = 1 << 20  # bytes of text that are turned into Python words at a time; a longer text stands alone


def next_smaller(words: list[bytes], less: Callable[[bytes, bytes], bool], end: bytes, effort: list[int] | None = None) -> tuple[list[int], list[int]]:
    """For each position i the next j > i whose suffix is smaller, and how many elements both suffixes share.

    `end` stands behind the last element and is smaller than any under `less`. effort: gets the number of equal elements
    that were compared, for tests."""
    n = len(words)
    s = [*words, end]
    after, shared = [n] * n, [0] * n  # of i with its next smaller suffix
    before, common = [-1] * (n + 1), [0] * (n + 1)  # of i with its previous smaller suffix
    reach = copy = shift = 0  # the match that reaches furthest: its end, where its second copy starts, and how far it is from the first
    equal = 0
    for i in range(1, n + 1):
        a, k = s[i], i - 1
        while k >= 0 and less(a, s[k]):
            after[k] = i
            k = before[k]
        known = 0
        while k >= 0 and (known or s[k] == a):
            e, done = known, False
            if i + e < reach:
                if k < copy:
                    e = reach - i
                else:
                    x, y = k - shift, i - shift
                    e = shared[x] if after[x] == y else common[y] if before[y] == x else -1
                    done = 0 <= e < reach - i
                    e = e if done else known if e < 0 else reach - i
            if not done:
                start = e
                while s[k + e] == s[i + e]:
                    e += 1
                equal += e - start
                if i + e > reach:
                    reach, copy, shift = i + e, i, i - k
            if not less(s[i + e], s[k + e]):
                common[i] = e
                break
            # suffix k is larger; so are those before it that share more with it than e elements
            after[k], shared[k] = i, e
            m, k = common[k], before[k]
            while k >= 0 and m > e:
                after[k], shared[k] = i, e
                m, k = common[k], before[k]
            if k >= 0 and m < e:
                common[i] = m
                break
            known = e
            if not known:  # what shares nothing may have other first elements
                while k >= 0 and less(a, s[k]):
                    after[k] = i
                    k = before[k]
        before[i] = k
    if effort is not None:
        effort.append(equal)
    return after, shared


ORDERS = ((operator.lt, b""), (operator.gt, b"\xff"))  # UTF-8 has no byte 255, and words aren't empty


def runs(words: list[bytes], shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run with at least `shortest` words and `repeats` (2 or more) periods, in order."""
    if repeats < 2:
        raise ValueError("a run has two periods at least")
    n = len(words)
    found = set()
    for less, end in ORDERS if n >= max(shortest, repeats) else ():
        after, shared = next_smaller(words, less, end)
        extent, to = np.array(shared, np.int64), np.array(after, np.int64)
        period = to - np.arange(n)
        # less than a period lies to the left of a run's first root
        for i in np.flatnonzero((extent > (repeats - 2) * period) & (extent + 2 * period > shortest)).tolist():
            p, e = after[i] - i, shared[i]
            if i >= p and after[i - p] == i and shared[i - p] >= p:
                continue
            left = 0
            while left < i and left < p and words[i - 1 - left] == words[i - 1 - left + p]:
                left += 1
            if left < p and left + p + e >= max(shortest, repeats * p):
                found.add((i - left, left + p + e, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], of: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that a run holds behind its first period."""
    if not of:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in of:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Batches of few bytes with the words of each text."""
    for batch in batches:
        for b in pieces(batch, "text", AT_ONCE):
            texts = b["text"].cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            yield b, [(t or b"").split() for t in texts]  # bytes split at blanks and the controls 9 to 13


def runs_of(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """A row for each run of each text: doc_id, start, length, period (words), in order of start and period."""

    def work(batches):
        for b, texts in each_text(batches):
            ids = b["doc_id"].to_pylist()
            rows = [(ids[k], *r) for k, words in enumerate(texts) for r in runs(words, shortest, repeats)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "period"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """doc_id and text, in which each run keeps its first period only and words stand one blank apart; null texts stay null."""

    def work(batches):
        for b, texts in each_text(batches):
            null = b["text"].is_null().to_pylist()
            out = [None if gone else b" ".join(collapse(w, runs(w, shortest, repeats))).decode() for w, gone in zip(texts, null, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, "doc_id long, text string")


def altered(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the query searches: in a tenth of the documents, by id, a tail repeats its beginning."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REPORT.split(", ")]
    for b, texts in each_text(batches):
        rows = []
        for doc_id, words in zip(b["doc_id"].to_pylist(), texts, strict=True):
            words = altered(doc_id, words)
            found = runs(words)
            best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
            top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            listed = "".join(f"{start},{length},{period}\n" for start, length, period in found)
            kept = b" ".join(collapse(words, found))
            rows.append((doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k.endswith("sha256") else pa.int64()) for k, c in zip(names, cols, strict=True)], names)


def op11_lyndon_runs(docs: DataFrame) -> DataFrame:
    """The runs of each document's words, after the contract's alteration; a row for each document."""
    return plain(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(report, REPORT)
