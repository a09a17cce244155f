"""N-gram Jaccard join: a size-aware heavy-light join of documents' shingle sets, exact at its threshold.

Documents of equal sets form a class, and the join is between classes. Light sets have at most `b` shingles, heavy ones
more; b is chosen by cost from the histogram of small sizes.

Light with light: for sizes n <= m that can link, both sides enumerate their subsets of the size o that a link needs in
common; two sets that share one have at least o shingles in common, so they link, and nothing is left to verify.

Heavy with anything: inverted lists. Each set goes through its shingles from rare to frequent and enters the lists of its
first m - ceil(0.75 m) + 1; a list matters where one of its sets is among the first n - ceil(6 n / 7) + 1 of a set no
larger than the other (a shorter prefix suffices for the smaller side). Lists are cut by bands of size, as sets of more
than 4/3 of another's size can't link.

Frequencies are those of all shingles. Batches of texts send their distinct shingles, once each with a count, to buckets
of the range of hashes; a bucket adds up and tells each batch which of its shingles others have too, and how often. The
order needs no more than a number that is the same wherever a shingle is seen: the shingles travel as the leading bits of
their hashes, as many as make chance collisions rare for the corpus at hand, and a collision only makes a shingle look
less rare. What stands in one text alone is in no list, so only the shared shingles travel back. A frequent shingle, one
in a third of all texts, costs one entry for each batch.

Candidates are verified as pairs, once their parity bitmaps allow a link: the bits in which the bitmaps of two sets differ
never outnumber the shingles in which the sets differ, so a pair too far apart is dropped without a loss. In the first
round each list asks its sets against one of them, the head; what links there is a component. The sets of a list that are
in other components than its head are then compared with the list's other sets, in blocks, by bitmaps. Of the pairs that
may link a block names those of a spanning forest of its components, the closest first; these are verified by their sets,
and what fails is left out of the next round's forest. A round looks again at the lists that named a pair in the last one
and may name more pairs for two components than that did, until no list names any. So the copies of one text cost a pair
each and not a pair for every two of them, and no pairs of a group are written out. What stays quadratic is the comparison
of bitmaps, where a list has many sets that don't link with its head.

A third of all rows may be one text: batches see it once each, and it is one class. A shingle in a third of all classes
is counted by partial sums, its list's head is found by partial minima and joined from its single row, so that its
partition can be split, and the list is compared in blocks of BLOCK by BLOCK.

Null texts count as empty; without words a set is empty, size 0, linked with nothing: such a document is its own
component. Texts of 1 to 4 words have one shingle, the whole sequence. doc_id names a document: rows that repeat an id are
one document, even with different texts, and a link of one of them is a link of that id. Null ids link with nothing.
Ties are links (similarity of exactly 0.75). Very long texts are whole: a batch holds at least one text, so memory follows
the longest. Sets are compared by 64-bit hashes of shingles, classes by 128 bits. Extra columns aren't read; an empty
table gives an empty result."""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, pieces, replayable
from .components import components, extended
from .textvec import U, Words, mix

WORDS = 5
SMALLEST = 14  # sizes up to here may be light; their sets travel whole
BATCH, BUCKET = 1_500_000, 2_000_000  # shingles of a batch of texts and of a bucket
BLOCK, MORE = 256, 8  # sets of a list that are compared at once; how the pairs named for two components grow by round
#: What a row costs: a shingle that is counted and told, an entry of a list, a subset of a light set, a shingle verified.
COUNTED, ENTRY, SUBSET, VERIFIED = 1.0, 6.0, 2.0, 1.0
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(4 * BANDS[-1] // 3 + 1)
BANDS = np.array(BANDS)


def need(n, m):
    """Shingles that sets of sizes n and m must share: 100 common >= 75 (n + m - common)."""
    return -(-3 * (n + m) // 7)


def keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(1, U)])
    out = []
    for c in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat ^ U(c)), dtype=U)])
        at = np.concatenate([[0], np.cumsum(size)])
        out.append(mix(total[at[1:]] - total[at[:-1]] + size.astype(U) * U(c | 1)).view(np.int64))
    return out[0], out[1]


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2 and, where the set may be light, the set."""
    names = ["doc_id", "n", "k1", "k2", "small"]

    def run(batches):
        for b in batches:
            for c in pieces(b, "text", 1 << 20):
                sets = Words(c["text"]).sets(WORDS)
                small = pa.array([s.view(np.int64) if len(s) <= SMALLEST else None for s in sets], pa.list_(pa.int64()))
                k1, k2 = keys(sets)
                yield pa.RecordBatch.from_arrays([c["doc_id"], pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(k1), pa.array(k2), small], names)

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, small array<long>")


# light


def subset_plan(b: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each size up to b: (other size, subset size, side). Side 2: both sets have this size."""
    plan: dict[int, list[tuple[int, int, int]]] = {n: [] for n in range(1, b + 1)}
    for n in plan:
        for m in range(n, b + 1):
            o = need(n, m)
            if o <= n and not o == n == m:  # equal sets are one class
                plan[n].append((m, o, 2 if n == m else 0))
                if n != m:
                    plan[m].append((n, o, 1))
    return plan


def in_lists(n, b: int):
    """Heavy sets, and light ones that are large enough to link with one."""
    return (n > b) | (4 * n >= 3 * (b + 1))


def choose_boundary(counts: dict[int, int]) -> int:
    """The b at which all small sets together cost least: a light set the subsets that it enumerates; one in the lists its
    shingles, counted and, where it has a candidate, verified, and its entries."""

    def cost(b: int) -> float:
        plan, total = subset_plan(b), 0.0
        for n, c in counts.items():
            total += c * SUBSET * sum(math.comb(n, o) for _, o, _ in plan.get(n, []))
            total += c * ((COUNTED + VERIFIED) * n + ENTRY * (n - -(-3 * n // 4) + 1)) if in_lists(n, b) else 0
        return total

    return min(range(SMALLEST + 1), key=lambda b: (cost(b), b))


def light_links(classes: DataFrame, b: int) -> DataFrame:
    """Edges (a, b) between light classes: a spanning forest of the sets that share a subset."""
    plan = subset_plan(b)

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for rep, small in zip(batch["rep"].to_pylist(), batch["small"].to_pylist(), strict=True):
                whole = np.array(small, np.int64).view(U)
                for other, o, side in plan[len(small)]:
                    low, high = sorted((len(small), other))
                    some = np.array(list(combinations(range(len(small)), o)))
                    a, c = keys([*whole[some]])
                    out += [(x, y ^ (low << 8 | high), side, rep) for x, y in zip(a.tolist(), c.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["s1", "s2", "side", "rep"])

    rows = classes.filter(F.col("n").between(1, b)).select("rep", "small").mapInArrow(run, "s1 long, s2 long, side int, rep long")
    low = lambda *sides: F.min(F.when(F.col("side").isin(*sides), F.col("rep")))
    heads = rows.groupBy("s1", "s2").agg(low(0).alias("h0"), low(1).alias("h1"), low(2).alias("h2"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    other = F.when(F.col("side") == 0, F.col("h1")).when(F.col("side") == 1, F.col("h0")).otherwise(F.col("h2"))
    return rows.join(heads, ["s1", "s2"]).select(F.col("rep").alias("a"), other.alias("b")).filter("b is not null and a <> b")


# frequencies and prefixes


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, compressed byte plane by byte plane."""
    head = np.array([[len(a), a.itemsize] for a in arrays], np.int64).tobytes()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw, out = zstandard.ZstdDecompressor().decompress(data), []
    at = 16 * n
    for size, width in np.frombuffer(raw, np.int64, 2 * n).reshape(n, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(np.dtype(f"u{width}")).ravel())
        at += size * width
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which wrap around where the next is smaller; np.cumsum undoes it."""
    return np.diff(a, prepend=a.dtype.type(0)) if len(a) else a


def text_batches(batches, ask: bool, boundary: int, bits: int, buckets: int):
    """The distinct shingles of a batch of texts for the buckets (ask), or its sets as places in that list. A batch is
    named by a hash of its sets, so both passes name it alike; batches of equal sets get equal answers."""
    held: dict[tuple[int, int], np.ndarray] = {}
    size = 0

    def finish():
        k = np.array(list(held), np.int64).reshape(-1, 2)
        name = int.from_bytes(hashlib.blake2b(k.tobytes(), digest_size=8).digest(), "little", signed=True)
        sizes = np.array([len(s) for s in held.values()], np.uint32)
        key, at, count = np.unique(np.concatenate(list(held.values())) >> U(64 - bits), return_inverse=True, return_counts=True)
        if ask:
            bucket = (key >> U(bits - buckets)).astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            stop = [*begin[1:].tolist(), len(key)]
            data = [pack(gaps(key[s:e]), count[s:e].astype(np.uint32)) for s, e in zip(begin.tolist(), stop, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array([name] * len(data), pa.int64()), pa.array(begin, pa.int64()), pa.array(data, pa.binary())], ["bucket", "batch", "first", "data"])
        data = pack(k[:, 0].astype(U), k[:, 1].astype(U), sizes, gaps(at.astype(np.uint32)))  # sets are sorted, so their places are
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([1], pa.int32()), pa.array([data], pa.binary())], ["batch", "kind", "data"])

    for b in batches:
        for c in pieces(b, "text", 1 << 20):
            sets = Words(c["text"]).sets(WORDS)
            for k1, k2, s in zip(*[k.tolist() for k in keys(sets)], sets, strict=True):
                if len(s) and in_lists(len(s), boundary) and (k1, k2) not in held:
                    held[k1, k2] = s
                    size += len(s)
            if size >= BATCH:
                yield finish()
                held, size = {}, 0
    if held:
        yield finish()


def count_buckets(batches):
    """Rows of a bucket come together. Adds up how often each shingle is asked for, and tells the batches of those asked for
    more than once: their places, the shingles and the numbers."""

    def told(asked):
        parts = [unpack(data, 2) for _, _, data in asked]
        key = [np.cumsum(p[0], dtype=U) for p in parts]
        every, at = np.unique(np.concatenate(key), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([p[1] for p in parts]).astype(float)).astype(np.uint32)
        rows, start = [], 0
        for (batch, first, _), k in zip(asked, key, strict=True):
            df = total[at[start : start + len(k)]]
            start += len(k)
            many = np.flatnonzero(df > 1)
            if len(many):
                rows.append((batch, 0, pack(gaps((first + many).astype(np.uint32)), gaps(k[many]), df[many])))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["batch", "kind", "data"])

    here, asked = None, []
    for b in batches:
        for bucket, batch, first, data in zip(*[b[c].to_pylist() for c in ("bucket", "batch", "first", "data")], strict=True):
            if bucket != here and asked:
                yield told(asked)
                asked = []
            here = bucket
            asked.append((batch, first, data))
    if asked:
        yield told(asked)


def prefixes(batches):
    """A batch's answers come before its sets. key, k1, k2, n, band, lead: the shared shingles among each set's first."""
    here, answers = None, []
    for b in batches:
        for batch, kind, data in zip(b["batch"].to_pylist(), b["kind"].to_pylist(), b["data"].to_pylist(), strict=True):
            if batch != here:
                here, answers = batch, []
            if kind == 0:
                answers.append(unpack(data, 3))
                continue
            if not answers:
                continue
            k1, k2, sizes, at = unpack(data, 4)
            at = np.cumsum(at, dtype=np.uint32).astype(np.int64)
            place = np.concatenate([np.cumsum(a[0], dtype=np.uint32) for a in answers]).astype(np.int64)
            df, key = np.zeros(int(at.max()) + 1, np.int64), np.zeros(int(at.max()) + 1, U)
            df[place], key[place] = np.concatenate([a[2] for a in answers]), np.concatenate([np.cumsum(a[1], dtype=U) for a in answers])
            n = sizes.astype(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            shared = np.flatnonzero(df[at] > 0)
            order = shared[np.lexsort((at[shared], df[at[shared]], owner[shared]))]
            own = owner[order]
            many = np.bincount(own, minlength=len(n))
            rank = np.arange(len(order)) - (np.cumsum(many) - many)[own] + (n - many)[own]  # what no other has comes first
            keep = rank < (n - -(-3 * n // 4) + 1)[own]
            own, rank, order = own[keep], rank[keep], order[keep]
            columns = [key[at[order]].view(np.int64), k1[own].view(np.int64), k2[own].view(np.int64), n[own], np.searchsorted(BANDS, n, side="right").astype(np.int32)[own], rank < (n - -(-6 * n // 7) + 1)[own]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "k1", "k2", "n", "band", "lead"])


def list_entries(docs: DataFrame, total: int, b: int) -> DataFrame:
    """key, k1, k2, n, band, lead of the sets that the lists hold."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(n, -(-total // BUCKET)).bit_length()  # 2 ** buckets of them
    bits = min(64, max(32, total.bit_length() + 8, buckets))
    asked = docs.mapInArrow(lambda it: text_batches(it, True, b, bits, buckets), "bucket long, batch long, first long, data binary")
    told = asked.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(count_buckets, "batch long, kind int, data binary")
    held = docs.mapInArrow(lambda it: text_batches(it, False, b, bits, buckets), "batch long, kind int, data binary")
    both = told.unionByName(held).repartition(n, "batch").sortWithinPartitions("batch", "kind")
    return both.mapInArrow(prefixes, "key long, k1 long, k2 long, n long, band int, lead boolean")


def inverted_lists(docs: DataFrame, classes: DataFrame, total: int, b: int) -> DataFrame:
    """key, band, node (a class by its document), k1, k2, n, lead: the entries of lists with a leading set and another one."""
    rows = materialize(list_entries(docs, total, b), "jaccard-prefixes")
    rows = rows.select("key", F.explode(F.array("band", F.col("band") - 1)).alias("at"), "k1", "k2", "n", (F.col("lead") & (F.col("at") == F.col("band"))).alias("lead")).withColumnRenamed("at", "band")
    one = F.struct("k1", "k2")
    full = rows.groupBy("key", "band").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.max("lead").alias("led")).filter("led and lo <> hi").select("key", "band")
    rows = rows.join(full, ["key", "band"]).distinct().join(classes.select("k1", "k2", F.col("rep").alias("node")), ["k1", "k2"])
    return materialize(rows.select("key", "band", "node", "k1", "k2", "n", "lead"), "jaccard-lists")


# verification


def bitmap(s: np.ndarray) -> bytes:
    """The parity, for each place, of the shingles that fall on it; at least 16 places for a shingle, up to 2 ** 18, so that
    few of the shingles in which two sets differ fall on one place."""
    size = 1 << min(18, max(8, int(16 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & U(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def set_members(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """node, n, data, bits: the sets that stand in lists, and their bitmaps."""

    def run(batches):
        seen: tuple = (None, set())
        for b in batches:
            for c in pieces(b, "text", 1 << 20):
                sets, out = Words(c["text"]).sets(WORDS), []
                for node, w1, w2, k1, k2, s in zip(*[c[x].to_pylist() for x in ("node", "k1", "k2")], *[k.tolist() for k in keys(sets)], sets, strict=True):
                    if node != seen[0]:  # rows of a node come together, and may repeat
                        seen = (node, set())
                    if (w1, w2) == (k1, k2) and k1 not in seen[1]:
                        seen[1].add(k1)
                        out.append((node, len(s), s.tobytes(), bitmap(s)))
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "n", "data", "bits"])

    wanted = lists.select("node", "k1", "k2").distinct()
    # a merge join at every size: where few sets are wanted Spark would send them to all executors, but their number grows
    rows = docs.join(wanted.hint("merge"), F.col("doc_id") == F.col("node")).select("node", "k1", "k2", "text")
    return materialize(rows.mapInArrow(run, "node long, n long, data binary, bits binary"), "jaccard-members")


def verify(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*[batch[c] for c in ("a", "b", "x", "y")], strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(np.intersect1d(x, y, assume_unique=True)) >= need(len(x), len(y)):
                    out.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    side = lambda node, data: members.select(F.col("node").alias(node), F.col("data").alias(data)).hint("merge")
    return pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").mapInArrow(run, "a long, b long").distinct()


def head_pairs(lists: DataFrame) -> DataFrame:
    """Each set of a list with the list's head, where their sizes allow a link."""
    heads = lists.filter("lead").groupBy("key", "band").agg(F.min(F.struct("node", "n")).alias("head"))
    rows = lists.join(heads, ["key", "band"]).filter((F.col("node") != F.col("head.node")) & (4 * F.least("n", "head.n") >= 3 * F.greatest("n", "head.n")))
    return rows.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()


def fold(bits: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of `size` bytes as rows of 64-bit words; a longer one is folded onto itself, which keeps the parity."""
    out = np.zeros((len(bits), size), np.uint8)
    for i, x in enumerate(bits):
        out[i] = np.frombuffer(x, np.uint8) if len(x) == size else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0)
    return out.view(U)


def apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=-1, dtype=np.int64)


def may_link(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*[batch[c].to_pylist() for c in ("x", "y", "n", "m")], strict=True):
                left, right = fold([x, y], min(len(x), len(y)))
                keep.append(bool(apart(left, right) <= n + m - 2 * need(n, m)))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep, pa.bool_())), batch["b"].filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    side = lambda node, bits, n: members.select(F.col("node").alias(node), F.col("bits").alias(bits), F.col("n").alias(n)).hint("merge")
    return pairs.select("a", "b").join(side("a", "x", "n"), "a").join(side("b", "y", "m"), "b").mapInArrow(run, "a long, b long").distinct()


def forest(asks: dict, others: dict, budget: int) -> list[tuple[int, int]]:
    """Pairs of one block that may link: a spanning forest of its components, up to `budget` pairs for each edge of it, the
    closest first."""
    size = min(min(map(len, asks["bits"])), min(map(len, others["bits"])))
    left, right = fold(asks["bits"], size), fold(others["bits"], size)
    m, node, comp, led = (np.array(others[c]) for c in ("n", "node", "component", "lead"))
    found = []
    for i, (n, own, lead, failed) in enumerate(zip(asks["n"], asks["component"], asks["lead"], asks["failed"], strict=True)):
        may = (comp != own) & (4 * np.minimum(m, n) >= 3 * np.maximum(m, n)) & (lead & (n <= m) | led & (m <= n))
        if not may.any():
            continue
        d = apart(right, left[i])
        may &= d <= n + m - 2 * need(n, m)
        if failed:
            may &= ~np.isin(node, failed)
        at = np.flatnonzero(may)
        if len(at):
            found.append(np.stack([d[at] / (n + m[at]), np.full(len(at), i), at]))
    if not found:
        return []
    score, i, j = np.concatenate(found, axis=1)
    i, j = i.astype(int), j.astype(int)
    order = np.lexsort((node[j], np.array(asks["node"])[i], score))
    root: dict[int, int] = {}
    edges: dict[tuple[int, int], int] = {}
    out = []

    def top(c):
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = asks["component"][x], others["component"][y]
        edge = (min(a, b), max(a, b))
        if edge not in edges:
            ta, tb = top(a), top(b)
            if ta == tb:
                continue
            root[ta], edges[edge] = tb, 0
        if edges[edge] < budget:
            edges[edge] += 1
            out.append((min(asks["node"][x], others["node"][y]), max(asks["node"][x], others["node"][y])))
    return out


def block_pairs(batches, budget: int):
    """Rows of a block come together: key, band, a, b of each block's forest."""
    names = ("node", "n", "lead", "component", "bits", "failed")
    here, sides = None, ({c: [] for c in names}, {c: [] for c in names})
    made: list[tuple[int, int, int, int]] = []

    def close():
        asks, others = sides
        if asks["node"] and others["node"]:
            made.extend((here[0], here[1], a, b) for a, b in forest(asks, others, budget))
        for side in sides:
            for c in names:
                side[c] = []

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*made, strict=True) if made else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["key", "band", "a", "b"])
        made.clear()
        return out

    for batch in batches:
        for block, ask, *row in zip(zip(*[batch[c].to_pylist() for c in ("key", "band", "i", "j")], strict=True), batch["asks"].to_pylist(), *[batch[c].to_pylist() for c in names], strict=True):
            if block != here:
                close()
                here = block
            side = sides[0 if ask else 1]
            for c, x in zip(names, row, strict=True):
                side[c].append(x)
        yield rows()
    close()
    yield rows()


def across(lists: DataFrame, members: DataFrame, joined: DataFrame, failed: DataFrame, budget: int) -> DataFrame:
    """key, band, a, b: pairs of sets in one list, in different components, that may link and didn't fail yet."""
    rows = lists.join(joined, "node", "left").select("key", "band", "node", "n", "lead", F.coalesce("component", "node").alias("component"))
    mark = lambda seed: F.bit_xor(F.xxhash64("node", "lead", F.lit(seed)))
    by = rows.groupBy("key", "band").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k"), mark(0).alias("m0"), mark(1).alias("m1"), F.min(F.when(F.col("lead"), F.struct("node", "component"))).alias("head"),
    )
    # lists of two are done, and lists of the same sets are one
    by = by.filter("lo <> hi and k > 2").groupBy("k", "m0", "m1").agg(F.min(F.struct("key", "band", F.col("head.component").alias("main"))).alias("l")).select("k", "l.*")
    rows = rows.join(by, ["key", "band"]).withColumn("asks", F.col("component") != F.col("main"))
    asking = rows.groupBy("key", "band").agg(F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(asking, ["key", "band"]).withColumn("of", F.ceil(F.col("k") / BLOCK).cast("int")).join(members.select("node", "bits").hint("merge"), "node")
    partners = failed.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("p")), F.struct(F.col("b").alias("node"), F.col("a").alias("p")))).alias("e"))
    rows = rows.join(partners.groupBy("e.node").agg(F.collect_list("e.p").alias("failed")), "node", "left")
    own = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "band", "node", "n", "lead", "component", "bits"]
    asks = rows.filter("asks").select(*columns, "failed", F.lit(True).alias("asks"), own(0, "parts").alias("i"), every("of").alias("j"))
    others = rows.select(*columns, F.lit(None).cast("array<long>").alias("failed"), F.lit(False).alias("asks"), own(1, "of").alias("j"), every("parts").alias("i"))
    blocks = asks.unionByName(others).repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j")
    return blocks.mapInArrow(lambda it: block_pairs(it, budget), "key long, band int, a long, b long")


def heavy_links(docs: DataFrame, classes: DataFrame, total: int, b: int) -> DataFrame:
    """Edges (a, b) between classes that join all that the lists' links join."""
    lists = inverted_lists(docs, classes, total, b)
    members = set_members(docs, lists)
    pairs = materialize(may_link(head_pairs(lists), members), "jaccard-pairs")
    links = materialize(verify(pairs, members), "jaccard-links")
    failed = materialize(pairs.join(links, ["a", "b"], "left_anti"), "jaccard-failed", instead_of=[pairs])
    joined = materialize(components(links, "jaccard-joined"), "jaccard-joined")
    budget, active = 1, lists
    while True:
        found = materialize(across(active, members, joined, failed, budget), "jaccard-found", instead_of=[active] if active is not lists else [])
        if found.isEmpty():
            break
        new = found.select("a", "b").distinct()
        more = materialize(verify(new, members), "jaccard-more")
        failed = materialize(failed.unionByName(new.join(more, ["a", "b"], "left_anti")), "jaccard-failed", instead_of=[failed])
        active = materialize(lists.join(found.select("key", "band").distinct(), ["key", "band"]), "jaccard-active", instead_of=[found])
        if not more.isEmpty():
            joined = materialize(extended(joined, more, "jaccard-joined"), "jaccard-joined", instead_of=[joined])
            links = materialize(links.unionByName(more), "jaccard-links", instead_of=[links, more])
        budget *= MORE
    for old in (lists, members, failed, joined, found):
        forget(old)
    return links


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not replayable(docs):
        docs = materialize(docs, "jaccard-docs")
    rows = materialize(set_rows(docs), "jaccard-sets")
    named = docs.filter("doc_id is not null")
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("small").alias("small"))
    classes = materialize(classes, "jaccard-classes")
    total = int(rows.agg(F.sum("n")).first()[0] or 0)
    counts = {r["n"]: r["c"] for r in classes.filter(F.col("n") <= 2 * SMALLEST).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    b = choose_boundary(counts)
    edges = heavy_links(named, classes, total, b)
    if any(subset_plan(b).values()):
        edges = edges.unionByName(light_links(classes, b))
    # ids that repeat with different texts tie their classes together
    several = (F.min("k1") != F.max("k1")) | (F.min("k2") != F.max("k2"))
    tied = rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(several.alias("several")).filter("several").select("doc_id")
    if not tied.isEmpty():
        same = rows.filter("n > 0").join(tied, "doc_id").select("doc_id", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
        edges = edges.unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(edges, "jaccard-links")
    of = classes.select("k1", "k2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    linked = rows.drop("small").join(of, ["k1", "k2"], "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when one document of each component does, the one with the smallest id. Rows that repeat
    an id are that document: of those with one text one stays, the first in order of the row written as JSON; those with
    other texts stay too. Documents without words and null ids stay."""
    found = materialize(link(docs), "jaccard-found")
    out = F.min((F.col("component_id") != F.col("doc_id")).cast("int"))
    marks = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__of")).agg(out.alias("__out"), F.count(F.lit(1)).alias("__times"))
    marks = materialize(marks.filter("__out = 1 or __times > 1"), "jaccard-marks", instead_of=[found])
    rows = docs.join(marks.hint("merge"), F.col("doc_id").cast("long") == F.col("__of"), "left")
    once = rows.filter("__of is null").select(*docs.columns)
    if marks.filter("__out = 0").isEmpty():
        return once
    whole = F.struct(*docs.columns)
    again = rows.filter("__out = 0").groupBy("__of", F.sha2(F.col("text").cast("string"), 256).alias("__text")).agg(F.min_by(whole, F.to_json(whole)).alias("__row"))
    return once.unionByName(again.select("__row.*"))


def op4_jaccard_join(docs: DataFrame) -> DataFrame:
    return link(docs)
