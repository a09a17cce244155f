"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

A list entry is a host, a path prefix and a verdict; it fits a URL whose host is that host or a subdomain of it and
whose path starts with that prefix. Each URL gives its canonical keys: every suffix of its host at a dot, with every
prefix of its path of a length that the list has. Keys that the filter can't rule out are joined exactly with the list,
which removes false positives; of the entries that fit, the longest wins.

The filter has a block of 256 bits for every 16 keys of the list, but at most MOST_BLOCKS (2 MB), so what every task holds
is bounded; beyond a million keys more of them pass to the join. Everything is DataFrame functions.

Null URLs and URLs without :// have an empty host and path and no rule, hence the default verdict. An empty list leaves
every URL at the default. Entries of one host and path must agree; of entries that don't, block wins. Repeated rows keep
their number: the longest entry is found per row within the row's own keys. Other columns aren't read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: host, path prefix, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MOST_BLOCKS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_bits(key: Column, blocks: int) -> list[Column]:
    """The block of a key and, for each of 8 words of 32 bits, the one bit that the key sets."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    second = F.xxhash64(key, F.lit(1))
    return [block, *[F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(second, 5 * i).bitwiseAND(31).cast("int")) for i in range(8)]]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row: `bloom`, an array of blocks * 8 words."""
    names = [f"w{i}" for i in range(8)]
    block, *words = key_bits(F.col("key"), blocks)
    rows = listed.select(block.alias("block"), *[w.alias(n) for w, n in zip(words, names, strict=True)])
    rows = rows.unionByName(listed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), *[F.lit(0).alias(n) for n in names]))
    rows = rows.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])
    made = rows.agg(F.sort_array(F.collect_list(F.struct("block", F.array(*names).alias("words")))).alias("all"))
    return made.select(F.flatten("all.words").alias("bloom"))


def might_contain(words: Column, key: Column, blocks: int) -> Column:
    block, *bits = key_bits(key, blocks)
    hit = F.lit(True)
    for i, b in enumerate(bits):
        hit &= F.get(words, block * 8 + i).bitwiseAND(b) != 0
    return hit


def rule_list(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def blocks_for(listed: DataFrame) -> int:
    """Blocks of a filter for a list: one for every 16 keys, a power of two from 64 to MOST_BLOCKS."""
    return min(MOST_BLOCKS, 1 << max(6, (listed.count() // 16).bit_length()))


def filter_urls(pages: DataFrame, listed: DataFrame, lengths: Sequence[int], id_column: str = "page_id", default: str = "allow", blocks: int | None = None) -> DataFrame:
    """id, host, path, rule, verdict. `lengths`: the lengths of the list's path prefixes, of which lists of any size have few.

    Rows without a possible hit don't shuffle. The others are joined by key and brought together again by id, host and
    path."""
    blocks = blocks or blocks_for(listed)
    clean = listed.groupBy(F.concat("host", "path").alias("key")).agg(F.min_by("verdict", F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("listed_verdict"))
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id_column}`").alias(id_column), F.col("url").cast("string").alias("url")).select(id_column, host.alias("host"), path.alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(set(lengths))])
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    rows = rows.withColumn("keys", F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))
    rows = rows.select("*", bloom(clean, blocks).scalar().alias("bloom"))
    rows = rows.select(id_column, "host", "path", F.filter("keys", lambda k: might_contain(F.col("bloom"), k, blocks)).alias("keys"))
    free = rows.filter(F.size("keys") == 0).select(id_column, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # a row's first key counts it; the list has one row for each key, so a frequent key multiplies nothing
    keyed = rows.filter(F.size("keys") > 0).select(id_column, "host", "path", F.posexplode("keys").alias("at", "key"))
    joined = keyed.join(clean, "key", "left")
    hit = F.when(F.col("listed_verdict").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), F.col("listed_verdict").alias("verdict")))
    best = joined.groupBy(id_column, "host", "path").agg(F.max(hit).alias("best"), F.count_if(F.col("at") == 0).alias("times"))
    judged = best.select(id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_")).drop("_")
    return free.unionByName(judged)


def op3_url_filter(pages: DataFrame) -> DataFrame:
    rules = rule_list(pages.sparkSession)
    return filter_urls(pages, rules, [len(p) for _, p, _ in RULES])


ORACLE = """
WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.*, (SELECT max((length(h || r.p), h || r.p, v)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)) AS best FROM p)
SELECT page_id, host, path, best[2] AS rule, coalesce(best[3], 'allow') AS verdict FROM m
"""
