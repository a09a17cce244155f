"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken `rate` times, rate = target / size of the source. The whole part of the
rate is certain; the rest is a fraction of one copy. Two fractional documents meet, and words move from one to the
other at random until one of them holds none or all of its words; the other goes on. A group of at most about
`chunk` documents leaves one fractional document, and these meet in a tree of groups of `fan` until each source has
one, which is drawn by its fraction. Words are moved, not copies, so a source's total stays within one document of
its target. All draws come from hashes of the data, so a rerun agrees on any layout.

Rows of one doc_id, source and text are alike. They are counted first and dealt to groups by their number among their
like, so a third of all rows may share an id, or have none, or be one row repeated, without sharing a group; which of them
is taken doesn't matter. Sources may be as many as hosts: their ranks come from a sort over partitions and their targets
from a few sums.

Null texts count as empty. Empty documents take no words; a draw of their own decides about them. Null sources form
one source, the last in order; null ids are an id like others. Repeated rows are rows of their own. Ties in draws go by
doc_id, size, text and number. A very long text is counted whole. Empty tables give empty results. Other columns aren't
read."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, plain

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
LOT = 1 << 16  # alike rows that one task numbers at a time
ONE = 1 << 20  # a word, as the integer in which mass is counted


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text), mark (a hash of the text), times: a row for all rows that are alike."""

    def count(batches):
        for b in batches:
            n = pc.fill_null(pc.count_substring_regex(b["text"], pattern=WORD), 0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], n.cast(pa.int64()), b["mark"]], ["doc_id", "source", "size", "mark"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), text_mark().alias("mark"))
    rows = df.mapInArrow(count, "doc_id long, source string, size long, mark long")
    return rows.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("times"))


def text_mark() -> Column:
    return F.xxhash64(F.col("text").cast("string"), F.col("text").isNull())


def each(rows: DataFrame, times: Column, number: str) -> DataFrame:
    """Rows as often as `times` says, numbered; a row of very many is cut into lots first, which are dealt anew."""
    rows = rows.withColumn("__times", times.cast("long"))
    few = rows.filter(F.col("__times").between(1, LOT)).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    lots = rows.filter(F.col("__times") > LOT).withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__times - 1) div {LOT}")))).repartition("__lot")
    last = F.least(F.col("__lot") * LOT + LOT, "__times") - 1
    return few.unionByName(lots.withColumn(number, F.explode(F.sequence(F.col("__lot") * LOT, last))).drop("__lot")).drop("__times")


def ranked(by: DataFrame) -> DataFrame:
    """rank: the place of a source in order of code points, null last. The sort spreads over partitions; the window sees
    a row for each partition."""
    rows = materialize(by.orderBy(F.col("source").asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("__at", 33)
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select("__part", before.alias("__before"))
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__part", part).join(starts, "__part").withColumn("rank", rank).drop("__part", "__before", "__at")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, n_docs, target: the total is shared by weight; a source stops at `most` times its size and
    the excess goes to the others by weight, until none is above. Each turn is one sum over the sources, and at least one
    more of them stops in it."""
    by = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    by = materialize(ranked(by).select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "mix-sources")
    total = float(share) * float(by.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        stops = F.col("cap") < F.col("weight") * level
        used, rest, n = by.agg(F.sum(F.when(stops, F.col("cap")).otherwise(0.0)), F.sum(F.when(stops, 0.0).otherwise(F.col("weight"))), F.count_if(stops)).first()
        if n == stopped or not rest:
            break
        level, stopped = (total - used) / rest, n
    full = F.col("cap") if not rest else F.least(F.col("cap"), F.col("weight") * level)
    return by.select("source", "source_size", "n_docs", full.alias("target"))


def uniform(*parts: Column) -> Column:
    """In 0 to 1, from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


FIELDS = "doc_id long, mark long, turn long, source string, size long, source_size long, target double, copies long, mass long, draw double, done boolean, up long"


def pair(rows: pd.DataFrame, fan: int) -> pd.DataFrame:
    """One group: all but at most one row come out done; that row goes to group `up` of the next level."""
    rows = rows.sort_values(["draw", "doc_id", "size", "mark", "turn"], kind="stable").reset_index(drop=True)
    mass, size, draw = rows["mass"].tolist(), rows["size"].tolist(), rows["draw"].tolist()
    copies, done = rows["copies"].to_numpy(copy=True), np.ones(len(rows), bool)
    left = -1
    for i, (b, n) in enumerate(zip(mass, size, strict=True)):
        whole = n * ONE
        if b <= 0 or b >= whole:
            copies[i] += b > 0
            continue
        if left < 0:
            left, a, cap = i, b, whole
            continue
        give, take = min(cap - a, b), min(a, whole - b)
        if draw[i] * (give + take) < take:
            a, b = a + give, b - give
        else:
            a, b = a - take, b + take
        if a in (0, cap):
            copies[left] += a > 0
            if b in (0, whole):
                copies[i] += b > 0
                left = -1
            else:
                left, a, cap = i, b, whole
        else:
            copies[i] += b > 0
    if left >= 0:
        done[left] = False
        mass[left] = a
    return rows.assign(copies=copies, mass=mass, done=done, up=rows["up"] // fan)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7, chunk: int = 2048, fan: int = 64) -> DataFrame:
    """doc_id, source, mark, size, source_size, target, copies, taken for each row of docs."""
    sized = materialize(sizes(docs), "mix-sizes")
    by = materialize(targets(sized, weights, share, most), "mix-targets")  # a row for each source
    groups = int(by.agg(F.max(F.ceil(F.col("n_docs") / chunk))).first()[0] or 1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.withColumnRenamed("source", "s").join(by, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    rows = each(rows, F.col("times"), "turn")
    who = [F.col(c) for c in ("doc_id", "size", "mark", "turn")]
    rows = rows.select("doc_id", "mark", "turn", "source", "size", "source_size", "target", rate.alias("rate"), F.floor(rate).cast("long").alias("whole"), F.ceil(F.col("n_docs") / chunk).alias("n_groups"), uniform(*who, F.lit(seed)).alias("draw"))
    part = F.col("rate") - F.col("whole")
    copies = F.col("whole") + F.when((F.col("size") == 0) & (F.col("draw") < part), 1).otherwise(0)
    rows = rows.select("doc_id", "mark", "turn", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), F.round(part * F.col("size") * ONE).cast("long").alias("mass"), "draw", F.lit(False).alias("done"), F.pmod(F.xxhash64(*who, F.lit(seed + 1)), F.col("n_groups").cast("long")).cast("long").alias("up"))
    one = lambda pdf: pair(pdf, fan)
    level = materialize(rows.groupBy("source", "up").applyInPandas(one, FIELDS), "mix-level")
    out, turn = level.filter("done"), 0
    while groups > 1:
        groups, turn = -(-groups // fan), turn + 1
        again = level.filter("not done").withColumn("draw", uniform(*who, F.lit(seed + 1 + turn)))
        level = again.groupBy("source", "up").applyInPandas(one, FIELDS)
        out = out.unionByName(level.filter("done"))
    last = level.filter("not done")
    chosen = uniform(*who, F.lit(seed - 1)) * F.col("size") * float(ONE) < F.col("mass")
    out = out.unionByName(last.withColumn("copies", F.col("copies") + F.when(chosen, 1).otherwise(0)))
    return out.select("doc_id", "source", "mark", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_mix_sources(docs: DataFrame) -> DataFrame:
    return mix(plain(docs, "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs as often as the mix takes them. Rows of one id, source and text share what the mix takes of them: in
    order of the row written as JSON, the first of them get the extra copies."""
    mixed = mix(plain(docs, "doc_id", "source", "text"), **options)
    plan = mixed.groupBy(F.col("doc_id").alias("__of"), F.col("source").alias("__source"), F.col("mark").alias("__mark")).agg(F.sum("copies").alias("__taken"), F.count(F.lit(1)).alias("__rows"))
    plan = materialize(plan.filter("__taken > 0"), "mix-plan")
    names = list(docs.columns)
    rows = docs.join(plan.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__of")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (text_mark() == F.col("__mark")))
    single = each(rows.filter("__rows = 1"), F.col("__taken"), "__copy").select(*names)
    if plan.filter("__rows > 1").isEmpty():
        return single
    # alike rows are counted before they meet; those that other columns tell apart take their shares of the copies in turn
    whole = F.struct(*names)
    like = rows.filter("__rows > 1").groupBy("__of", "__source", "__mark", "__taken", "__rows", F.to_json(whole).alias("__json")).agg(F.first(whole).alias("__row"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__of", "__source", "__mark").orderBy("__json").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = F.expr("__taken div __rows")
    extra = F.greatest(F.lit(0), F.least("__n", F.expr("__taken % __rows") - F.col("__before")))
    like = like.withColumn("__before", before).withColumn("__copies", F.col("__n") * base + extra)
    return single.unionByName(each(like, F.col("__copies"), "__copy").select("__row.*"))
