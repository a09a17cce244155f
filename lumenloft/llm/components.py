"""Connected components of an edge table, by forests: tasks reduce the edges that they hold to spanning stars, and edges meet
at their ends until nothing moves. The same steps run at every size.

  1. Each task unites what its own edges join and hands on one edge for each node, to the smallest node that it saw. There are
     LEAST_TASKS tasks at least, so that no size is done by one.
  2. In each round an edge goes to the tasks of both its ends, so that all edges of a node meet in one task, which unites
     them again. A row that a task didn't have before is `moved`; a round without one has found the components: then every
     node has one edge, to a node that has none.

A round cuts the edges to the nodes that tasks see, at most two a node, and is one shuffle. Paths shorten like by pointer
jumping, so rounds grow with the logarithm of the longest path; a group of near copies takes two or three.

Tasks get about LOT edges. Where that can't hold for a node by itself (at least one in SHARE of all edges lead to it; there
are at most SHARE such nodes, whose ids alone are broadcast), its edges are dealt over SALTS tasks, and its own few edges to
smaller nodes are copied to each of these."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LOT, LEAST_TASKS = 500_000, 8
SHARE, SALTS = 1024, 64
AT_ONCE = 50_000  # rows of a batch that is handed on


def unite(edges: dict[tuple[int, int], None] | Iterator[tuple[int, int]]) -> dict[int, int]:
    """The smallest node that each node reaches."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: top(x) for x in root}


def handed(seen: dict[tuple[int, int], None]) -> Iterator[pa.RecordBatch]:
    out = [(x, y, (x, y) not in seen) for x, y in unite(seen).items() if x != y]
    for i in range(0, len(out), AT_ONCE):
        u, v, moved = zip(*out[i : i + AT_ONCE], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(moved)], ["u", "v", "moved"])


FOREST = "u long, v long, moved boolean"


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a task's edges, in lots: for edges that no one has dealt out yet."""
    seen: dict[tuple[int, int], None] = {}
    for b in batches:
        seen.update(dict.fromkeys(zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)))
        if len(seen) >= LOT:
            yield from handed(seen)
            seen = {}
    yield from handed(seen)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of all edges of a task, which has every edge of some nodes."""
    seen: dict[tuple[int, int], None] = {}
    for b in batches:
        seen.update(dict.fromkeys(zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True)))
    yield from handed(seen)


def tasks_for(n: int) -> int:
    return max(LEAST_TASKS, -(-2 * n // LOT))


def dealt(e: DataFrame, n: int) -> DataFrame:
    """Each edge for the tasks of both its ends."""
    ends = F.array(F.struct(F.col("u").alias("at"), F.lit(0).alias("salt")), F.struct(F.col("v").alias("at"), F.lit(0).alias("salt")))
    if 2 * n > LOT:  # else no node has more edges than a task may get
        hot = e.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") * SHARE >= n).select("v")
        up, down = F.broadcast(hot.select(F.col("v").alias("hot_u"))), F.broadcast(hot.select(F.col("v").alias("hot_v")))
        e = e.join(up, F.col("u") == F.col("hot_u"), "left").join(down, F.col("v") == F.col("hot_v"), "left")
        salts = F.when(F.col("hot_u").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        own = F.when(F.col("hot_v").isNotNull(), F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")).otherwise(0)
        ends = F.concat(F.transform(salts, lambda s: F.struct(F.col("u").alias("at"), s.alias("salt"))), F.array(F.struct(F.col("v").alias("at"), own.alias("salt"))))
    # a task may take several partitions whole, where the session makes more of them than the edges need
    return e.select("u", "v", F.explode(ends).alias("t")).repartition(tasks_for(n), "t.at", "t.salt").select("u", "v").coalesce(tasks_for(n))


def components(edges: DataFrame, tag: str, most_rounds: int = 100) -> DataFrame:
    """edges(a, b) of longs -> (node, component): the smallest node reachable, for every node with an edge to another."""
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), f"{tag}-edges")
    n = e.count()
    # neighbouring files are read by one task, so that its forest spans more
    e = materialize(e.coalesce(tasks_for(n)).mapInArrow(forests, FOREST), f"{tag}-edges", instead_of=[e])
    for _ in range(most_rounds):
        e = materialize(dealt(e.select("u", "v"), n).mapInArrow(met, FOREST), f"{tag}-edges", instead_of=[e])
        if e.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError("the components didn't settle")
    # tasks of both ends may have handed on one row; as many tasks as the edges need
    leaves = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    centres = e.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component"))
    return leaves.coalesce(tasks_for(n)).unionByName(centres.coalesce(tasks_for(n)))


def extended(joined: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
    """The components (node, component) of a table that has them already and of further edges (a, b).

    Only components that the edges join are found anew; the rest are relabelled, without a shuffle where the edges are few."""
    edges = edges.select("a", "b")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    fresh = ends.join(joined.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    moved = materialize(components(between, tag).filter("node <> component"), f"{tag}-moved").select(F.col("node").alias("component"), F.col("component").alias("to"))
    return joined.select("node", "component").unionByName(fresh).join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
