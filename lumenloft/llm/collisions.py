"""Approximate nearest neighbours by cosine, through collision counting over query-centred windows.

Unit vectors are dealt into blocks of about BLOCK rows. A block's index is one array for each of `projections` random
directions: the vectors' places on that line, in 256 steps. A query meets a block at radius R: on each line its window reaches REACH * R
to both sides of its own place, and every vector inside collides with it once. A vector at distance R or nearer lies in a
window with the chance P = 2 * Phi(REACH) - 1, whatever R is, so it collides at least `threshold` times but for a chance of
MISSED, if lines were independent; as they are orthogonal in lots of the dimension, the numbers of collisions vary less and
the chance is about 3 %. Vectors that collide so often are verified by their cosine in double precision. Virtual rehashing: where the k-th best
verified vector is further than R, the radius grows to its distance, or by GROWTH at most, and windows are widened; nothing
is hashed again. A search ends once k verified vectors lie within R, or the windows hold the block.

The whole block takes part, every row is indexed, and no window, candidate list or bucket is capped. Each block gives a
query's k best; the best k of all blocks are its answer. Queries are dealt to the blocks in chunks of QUERIES, so a task
holds a block's vectors and lines and streams its queries; the work is queries times blocks, as a search of this kind is.
Collisions of a query with a block are counted a line at a time in bytes: near the radius where noise is found, windows hold
half of each line, and reading all codes costs a fraction of gathering those rows from sorted lists.

Defined cases: null ids, null or zero vectors and vectors with null or non-finite components take no part, neither as
queries nor as candidates; vectors meet those of their own length only; where an id has several rows, the smallest vector
counts, so repeated rows change nothing; ties go to the smaller id; a query with fewer than k candidates gets all of them,
one without any has no row; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain

BLOCK, QUERIES = 8192, 4096
PROJECTIONS, REACH, MISSED, GROWTH, SEED = 128, 1.0, 0.1, 1.25, 12
FIRST = 0.05  # the first radius; vectors of one direction have the distance 0
FOUND = "query_id long, vec_id long, score double"


def threshold(projections: int = PROJECTIONS) -> int:
    """How often a vector at the radius collides at least, but for a chance of MISSED."""
    p = 2 * NormalDist().cdf(REACH) - 1
    return max(1, math.floor(projections * p + NormalDist().inv_cdf(MISSED) * math.sqrt(projections * p * (1 - p))))


@lru_cache(maxsize=8)
def directions(dim: int, projections: int) -> np.ndarray:
    """Gaussian-length random directions, orthogonal in lots of `dim`, which evens out the number of collisions."""
    rng = np.random.default_rng(SEED)
    lots = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-projections // dim))]
    return np.concatenate(lots)[:projections] * math.sqrt(dim)


class Index:
    """The lines of one block; ids ascend, so that of equal scores the first is the one to keep."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.lines = directions(vectors.shape[1], projections)
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        places = self.lines @ (self.vectors / self.norms[:, None]).T
        self.base = places.min()
        self.step = max(float(places.max() - self.base) / 255, 1e-12)
        self.codes = self.code(places)
        self.sums = np.uint8 if projections < 256 else np.uint16
        self.least = threshold(projections)
        self.level = 0

    def code(self, places: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((places - self.base) / self.step), 0, 255).astype(np.uint8)

    def colliding(self, at: np.ndarray, radius: float) -> np.ndarray:
        """Which vectors collide often enough. Windows end with the codes of their ends, so they are a little wide."""
        low, high = self.code(at - REACH * radius), self.code(at + REACH * radius)
        # codes below the window wrap around to large ones
        inside = (self.codes - low[:, None]) <= (high - low)[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=self.sums) >= self.least

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and cosines of the k best verified vectors, best first, and how many were verified."""
        n = len(self.ids)
        norm = math.sqrt((query * query).sum())
        at = self.lines @ (query / norm)
        scores = np.full(n, -np.inf)
        open_ = self.ids != query_id
        wanted = min(k, int(open_.sum()))
        verified = 0
        if wanted:
            radius, colliding = self.first(at, open_, wanted)
        while wanted:
            new = np.flatnonzero(colliding & open_)
            # row by row, so that equal vectors have equal scores wherever they stand
            scores[new] = (self.vectors[new] * query).sum(1) / (self.norms[new] * norm)
            open_[new] = False
            verified += len(new)
            kth = np.partition(scores, n - wanted)[n - wanted]
            # a little more than the distance, against rounding
            need = math.sqrt(max(0.0, 2 - 2 * float(kth))) + 1e-9
            if need <= radius:
                break
            radius = min(need, radius * GROWTH)
            colliding = self.colliding(at, radius)
        known = np.flatnonzero(scores > -np.inf)
        best = known[np.lexsort((self.ids[known], -scores[known]))[:k]]
        return self.ids[best], scores[best], verified

    def first(self, at: np.ndarray, open_: np.ndarray, wanted: int) -> tuple[float, np.ndarray]:
        """The smallest radius FIRST * GROWTH ** level at which `wanted` vectors collide, and which do; in the end windows hold the
        whole lines. The steps begin at the
        level of the query before, which saves most of them and changes nothing in what is found."""

        def enough(level: int) -> np.ndarray | None:
            colliding = self.colliding(at, FIRST * GROWTH**level)
            return colliding if np.count_nonzero(colliding & open_) >= wanted else None

        level = self.level
        found = enough(level)
        if found is None:
            while found is None:
                level += 1
                found = enough(level)
        else:
            while level and (smaller := enough(level - 1)) is not None:
                level, found = level - 1, smaller
        self.level = level
        return FIRST * GROWTH**level, found


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null, NaN or infinite, and not all of them 0."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(rows: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, one for each id."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5, projections: int = PROJECTIONS) -> DataFrame:
    """queries, candidates: vec_id, vector (see vectors_of) -> query_id, rank, vec_id, score: each query's k nearest candidates found.

    Both tables are read again and again, so they should be written ones."""
    rows, asked = candidates.count(), queries.count()
    blocks, chunks = max(1, -(-rows // BLOCK)), max(1, -(-asked // QUERIES))
    dim = F.size("vector").alias("dim")

    def dealt(df: DataFrame, kind: int, block: Column, chunk: Column) -> DataFrame:
        return df.select(block.alias("block"), dim, chunk.alias("chunk"), F.lit(kind).alias("kind"), "vec_id", "vector")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    hashed = F.xxhash64("vec_id", F.lit(SEED))
    index = dealt(candidates, 0, F.pmod(hashed, F.lit(blocks)).cast("int"), F.lit(0)).withColumn("chunk", every(chunks))
    asking = dealt(queries, 1, F.lit(0), F.pmod(hashed, F.lit(chunks)).cast("int")).withColumn("block", every(blocks))
    both = index.unionByName(asking).repartition(min(4096, blocks * chunks * 2), "block", "dim", "chunk")
    found = both.sortWithinPartitions("block", "dim", "chunk", "kind").mapInArrow(lambda it: search_blocks(it, k, projections), FOUND)
    return best(found, k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties to the smaller id. A task hands on k rows of a query at most."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_blocks(batches: Iterator[pa.RecordBatch], k: int, projections: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of block, dim, chunk and kind: a block's vectors (0), then its queries (1)."""
    at, ids, parts, index = None, [], [], None
    for batch in batches:
        keys = np.stack([batch[c].to_numpy() for c in ("block", "dim", "chunk", "kind")], 1)
        vec_id = batch["vec_id"].to_numpy()
        flat, offsets = batch["vector"].flatten().to_numpy(), batch["vector"].offsets.to_numpy()
        offsets = offsets - offsets[0]
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            *key, kind = keys[a].tolist()
            if key != at:
                at, ids, parts, index = key, [], [], None
            vectors = flat[offsets[a] : offsets[b]].reshape(b - a, key[1])
            if kind == 0:
                ids.append(vec_id[a:b])
                parts.append(vectors)
                continue
            if index is None and ids:
                index = Index(np.concatenate(ids), np.concatenate(parts), projections)
                ids, parts = [True], []
            if index is not None:
                out = [(q, *index.search(q, v, k)[:2]) for q, v in zip(vec_id[a:b].tolist(), vectors, strict=True)]
                yield pa.RecordBatch.from_arrays([np.repeat([q for q, _, _ in out], [len(x) for _, x, _ in out]).astype(np.int64), np.concatenate([x for _, x, _ in out]), np.concatenate([s for _, _, s in out])], ["query_id", "vec_id", "score"])


def op12_collision_search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of each row whose id is divisible by `every`, among all other rows."""
    vectors = materialize(vectors_of(plain(embeddings, "vec_id", "embedding")), "vectors")
    return nearest(vectors.filter(F.col("vec_id") % every == 0), vectors, k)
