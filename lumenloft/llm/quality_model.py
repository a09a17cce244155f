"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (shares of character classes, words, lines, repetition) are cut into at most 64 bins by
quantiles; trees of fixed depth grow level by level on gradient histograms. The trees are flattened into arrays
(feature, threshold, leaf value), complete binary trees whose node i has the children 2i + 1 and 2i + 2, so that numpy
takes all documents of a batch through a level of a tree at once.

Training rows are a bounded sample, `bound`: the labelled rows outside the held-out fold with the smallest hashes of
their ids. The score never sees labels, language, source or id.

Null texts count as empty; empty texts get the score of their (zero) statistics. Without labels, or with one kind only,
the score is the smoothed share of label 1. Null labels aren't used; a document with both labels counts with
each, equal labels count once, and of rows that repeat a labelled id one is trained on. Repeated rows get one score, ties
at the threshold are 1, null ids are scored and not held out. A very long text is taken whole, alone in its batch. Other
columns aren't read; an empty table gives an empty result."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .textvec import Words

BOUND, FOLDS, THRESHOLD = 12_000, 5, 0.3
TREES, DEPTH, RATE, BINS, LEAST = 80, 4, 0.15, 64, 20.0
NAMES = (
    "log_words log_bytes word_bytes upper lower digit punctuation symbol pipe non_ascii white newline longest_word "
    "distinct_words repeated_2 repeated_3 lines duplicate_lines line_bytes stop_end sentence_words exclamation capital_words"
).split()


def _lut(chars: str) -> np.ndarray:
    a = np.zeros(256, bool)
    a[[ord(c) for c in chars]] = True
    return a


UPPER, DOWN, DIGIT = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut("abcdefghijklmnopqrstuvwxyz"), _lut("0123456789")
PUNCT, SYMBOL, END = _lut(".,;:!?'\"()-"), _lut("#*$%&<>"), _lut(".!?")


def statistics(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    w = Words(column)
    n = len(w.counts)
    cum = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.off])
    size = np.diff(w.off)
    per_byte, words = np.maximum(size, 1), np.maximum(w.counts, 1)
    length = (w.stop - w.start).astype(float)
    sum_words = lambda v: np.bincount(w.of, weights=v, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, w.of, length)

    def repeated(k: int) -> np.ndarray:
        total = np.where(w.counts >= k, w.counts - k + 1, np.minimum(w.counts, 1))
        return 1 - w.distinct(k) / np.maximum(total, 1) * (total > 0) - (total == 0)

    lines, dup = np.zeros(n), np.zeros(n)
    for i, t in enumerate(column.to_pylist()):
        if t:
            parts = t.split("\n")
            lines[i], dup[i] = len(parts), len(parts) - len(set(parts))
    last = w.buf[w.stop - 1] if len(w.stop) else np.zeros(0, np.uint8)
    ends = sum_words(END[last].astype(float))
    upper = cum(UPPER[w.buf])
    newline = cum(w.buf == 10)
    columns = [
        np.log1p(w.counts), np.log1p(size), sum_words(length) / words, upper / per_byte, cum(DOWN[w.buf]) / per_byte, cum(DIGIT[w.buf]) / per_byte, cum(PUNCT[w.buf]) / per_byte, cum(SYMBOL[w.buf]) / per_byte, cum(w.buf == 124) / per_byte,
        cum(w.buf >= 128) / per_byte, (size - sum_words(length)) / per_byte, newline / per_byte, np.minimum(longest, 1000), w.distinct(1) / words, repeated(2), repeated(3), np.log1p(lines), dup / np.maximum(lines, 1), size / np.maximum(lines, 1),
        ends / np.maximum(lines, 1), w.counts / np.maximum(ends, 1), cum(w.buf == 33) / words, sum_words(UPPER[w.buf[w.start]].astype(float) if len(w.start) else np.zeros(0)) / words,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1) if n else np.zeros((0, len(NAMES)))


class Trees:
    def __init__(self, prior: float):
        self.prior, self.feature, self.threshold, self.leaf = prior, np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosting on the logistic loss."""
    p = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return model
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(n, model.prior)
    made = ([], [], [])
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        feature, threshold, at = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            base, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            for j in range(width):
                key = (at - base) * BINS + bins[:, j]
                hg, hh = (np.bincount(key, weights=v, minlength=nodes * BINS).reshape(nodes, BINS).cumsum(1) for v in (g, h))
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + 1) + (tg - hg) ** 2 / (th - hh + 1) - tg**2 / (th + 1)
                gain[(hh < LEAST / 20) | (th - hh < LEAST / 20)] = 0
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(1)
                top = gain[np.arange(nodes), cut]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[base + better], threshold[base + better] = j, edges[j][cut[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + 1)
        raw += value[leaf]
        for kept, v in zip(made, (feature, threshold, value), strict=True):
            kept.append(v)
    model.feature, model.threshold, model.leaf = (np.array(m) for m in made)
    return model


def fold(column):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def sample(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """Statistics and label of the training rows, at most `bound` of them however often ids repeat in either table."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("y")).filter(F.col("y").isNotNull() & (fold("id") != 0)).distinct()
    rows = rows.orderBy(F.xxhash64("id"), "id", "y").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(rows), "id").select("id", "text", "y")  # `rows` has at most `bound` rows of two numbers

    def run(batches):
        for b in batches:
            for c in pieces(b, "text", 1 << 20):
                x = statistics(c["text"])
                yield pa.RecordBatch.from_arrays([c["id"], pa.array(list(x), pa.list_(pa.float64())), c["y"]], ["id", "x", "y"])

    # rows that repeat an id give one row, with the least statistics, counted by each task before they meet
    return texts.mapInArrow(run, "id long, x array<double>, y double").groupBy("id", "y").agg(F.min("x").alias("x"))


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Trees:
    rows = sample(docs, labels, bound).toPandas()
    x, y = np.array(rows["x"].tolist()).reshape(-1, len(NAMES)), rows["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # sums in one order make reruns agree
    return grow(x[order], y[order])


def score(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches):
        for b in batches:
            for c in pieces(b, "text", 1 << 20):
                s = model.score(statistics(c["text"]))
                held = [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in c["doc_id"].to_pylist()]
                yield pa.RecordBatch.from_arrays([c["doc_id"], pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs whose text the model doesn't reject."""

    def run(batches):
        for b in batches:
            for c in pieces(b, "text", 1 << 20):
                yield c.filter(pa.array(model.score(statistics(c["text"])) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_trees(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
