"""Which known source a card is: marker, strong id, then fingerprint."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloft.functions import media
from lumenloft.functions.core import col, non_empty
from lumenloft.operators.core import any_of

EDGE = 8


def normalize_label(text):
    """NFKC, trimmed, single blanks, lower case."""
    from lumenloft.functions.paths import nfkc

    return F.lower(F.regexp_replace(F.regexp_replace(nfkc(col(text)), r"^\s+|\s+$", ""), r"\s+", " "))


def edge_samples(files: DataFrame, by: str = "source_id", edge: int = EDGE) -> DataFrame:
    """The first and last files of each source in order of folded key, key, path and size; each once."""
    rows = files.select(by, "relative_path", "canonical_path_key", "size_bytes").distinct()
    order = [F.lower("canonical_path_key"), F.col("canonical_path_key"), F.col("relative_path"), F.col("size_bytes")]
    first = rows.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("r") <= edge).drop("r")
    last = rows.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(*[c.desc() for c in order]))).filter(F.col("r") <= edge).drop("r")
    return first.unionByName(last).distinct()


def _fingerprint(label, capacity, filesystem, samples) -> str:
    body = {"version": 1, "label": label, "capacityBucketBytes": capacity, "filesystem": filesystem, "samples": samples}
    return "source-fallback-v1:" + hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).strip()).lower()


def fallback_identity(facts: DataFrame, files: DataFrame, edge: int = EDGE) -> DataFrame:
    """source_id, fingerprint of each row of facts(source_id, label, capacity_bytes, filesystem) and its files: a digest of
    canonical JSON with a fixed order of keys and explicit nulls, over at most 2 * edge files."""
    order = F.struct(F.lower("canonical_path_key").alias("f"), "canonical_path_key", "relative_path", "size_bytes")
    samples = edge_samples(files, edge=edge).groupBy("source_id").agg(F.array_sort(F.collect_list(order)).alias("samples"))
    rows = facts.select("source_id", "label", media.capacity_bucket("capacity_bytes").alias("capacity"), non_empty("filesystem").alias("filesystem")).join(samples, "source_id", "left")
    rows = rows.select("source_id", "label", "capacity", "filesystem", F.to_json("samples").alias("samples"))

    @F.pandas_udf(T.StringType())
    def digest(label: pd.Series, capacity: pd.Series, filesystem: pd.Series, samples: pd.Series) -> pd.Series:
        def one(a, b, c, d):
            listed = [{"relativePath": s["relative_path"], "canonicalPathKey": s["canonical_path_key"], "sizeBytes": s["size_bytes"]} for s in json.loads(d or "[]")]
            return _fingerprint(_plain(a or ""), None if pd.isna(b) else int(b), None if c is None else _plain(c), listed)

        return pd.Series([one(*r) for r in zip(label, capacity, filesystem, samples, strict=True)])

    return rows.select("source_id", digest("label", "capacity", "filesystem", "samples").alias("fingerprint"))


def identity_candidates(sources: DataFrame, observations: DataFrame, strong_id: str | None = None, fingerprint: str | None = None, algorithm_version: int | None = None) -> DataFrame:
    """Sources with an observation of this strong id, or of this fingerprint and version; none without either."""
    wanted = []
    if strong_id:
        wanted.append(F.col("strong_platform_id") == strong_id)
    if fingerprint is not None and algorithm_version is not None:
        wanted.append((F.col("fingerprint") == fingerprint) & (F.col("algorithm_version") == algorithm_version))
    hits = any_of(observations, wanted).select(F.col("source_id").alias("id"))
    return sources.join(hits, "id", "left_semi")


def aliases(observations: DataFrame) -> DataFrame:
    """First and last time of each fingerprint of a source."""
    return observations.groupBy("source_id", "algorithm_version", "fingerprint").agg(F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))


def candidate_facts(observations: DataFrame, known_aliases: DataFrame) -> DataFrame:
    """A row for each source: its last strong id and fingerprint, and all its fingerprints."""
    seen = F.struct("observed_at", "id")
    o = observations.groupBy("source_id").agg(F.max_by("fingerprint", seen).alias("fingerprint"), F.max_by("strong_platform_id", F.when(F.col("strong_platform_id").isNotNull(), seen)).alias("strong_id"))
    a = known_aliases.groupBy("source_id").agg(F.sort_array(F.collect_set("fingerprint")).alias("aliases"))
    return o.join(a, "source_id", "left")


def identify(detected: DataFrame, candidates: DataFrame) -> DataFrame:
    """detected(card, strong_id, fingerprint), candidates(source_id, strong_id, fingerprint, aliases): a row for each match
    with confidence, reason and whether it must be confirmed. Strong matches shut out fingerprint matches; one strong match
    is certain, several must be confirmed, and so must every fingerprint match."""
    d = detected.select("card", non_empty("strong_id").alias("strong"), F.col("fingerprint").alias("print"))
    c = candidates.select("source_id", non_empty("strong_id").alias("c_strong"), "fingerprint", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    strong = d.join(c, d["strong"] == c["c_strong"]).select("card", "source_id", F.lit(True).alias("is_strong"), F.lit("platform-volume-id").alias("reason"))
    prints = c.select("source_id", "fingerprint", F.explode(F.array_distinct(F.concat(F.array("fingerprint"), "aliases"))).alias("p"))
    weak = d.join(prints, d["print"] == prints["p"]).select("card", "source_id", F.lit(False).alias("is_strong"), F.when(F.col("p") == F.col("fingerprint"), "fallback-fingerprint").otherwise("fallback-fingerprint-alias").alias("reason"))
    by = W.partitionBy("card")
    both = strong.unionByName(weak).withColumn("any_strong", F.max("is_strong").over(by)).filter("is_strong = any_strong")
    both = both.withColumn("n", F.count(F.lit(1)).over(by))
    return both.select("card", "source_id", F.when(F.col("is_strong"), "exact").otherwise("medium").alias("confidence"), "reason", (~F.col("is_strong") | (F.col("n") > 1)).alias("requires_confirmation"))


def reconcile(detected: DataFrame, matches: DataFrame) -> DataFrame:
    """new-source without a match, candidate-found with exactly one that needs no confirmation, else confirmation-required."""
    m = matches.groupBy("card").agg(F.count(F.lit(1)).alias("n"), F.max("requires_confirmation").alias("ask"))
    out = detected.select("card").join(m, "card", "left")
    return out.select("card", F.when(F.col("n").isNull(), "new-source").when((F.col("n") == 1) & ~F.col("ask"), "candidate-found").otherwise("confirmation-required").alias("reconciliation"))


def resolve_volume(volumes: DataFrame, markers: DataFrame, sources: DataFrame, observations: DataFrame) -> DataFrame:
    """The known source of each mounted volume: that of its marker if it exists, else that of its strong id."""
    m = markers.select("mount_path", F.col("source_id").alias("marked")).join(sources.select(F.col("id").alias("marked")), "marked", "left_semi")
    s = observations.filter("strong_platform_id is not null").groupBy("strong_platform_id").agg(F.max_by("source_id", F.struct("observed_at", "id")).alias("strong"))
    out = volumes.join(m, "mount_path", "left").join(s, volumes["platform_volume_id"] == s["strong_platform_id"], "left")
    return out.select(*[volumes[c] for c in volumes.columns], F.coalesce("marked", "strong").alias("known_source_id"))


def source_of_path(selected: DataFrame, volumes: DataFrame) -> DataFrame:
    """The mounted volume at each selected path, or the folder itself."""
    v = volumes.select(F.col("mount_path").alias("_mount"), "source_type", "display_name", "platform_volume_id", "fs_type", "capacity_bytes")
    out = selected.join(v, selected["path"] == v["_mount"], "left")
    return out.select("path", F.coalesce("source_type", F.lit("folder")).alias("source_type"), F.coalesce("display_name", F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1)).alias("display_name"), "platform_volume_id", "fs_type", "capacity_bytes", F.col("_mount").isNotNull().alias("removable"))


def merge_cards(known: DataFrame, detected: DataFrame) -> DataFrame:
    """known(id, name, online) and detected(id, label, online, known_source_id) as one list of cards, online first. A
    detected card whose known source doesn't exist stays a new card; of several for one source, the last id counts."""
    live = detected.filter("known_source_id is not null").groupBy("known_source_id").agg(F.max_by("online", "id").alias("live_online"), F.max("id").alias("live_id"))
    a = known.join(live, known["id"] == live["known_source_id"], "left")
    a = a.select(F.lit("known").alias("kind"), known["id"], "name", (F.col("online") | F.coalesce("live_online", F.lit(False))).alias("online"), "live_id")
    ids = known.select(F.col("id").alias("known_source_id"))
    b = detected.join(ids, "known_source_id", "left_anti").select(F.lit("new").alias("kind"), "id", F.col("label").alias("name"), "online", F.lit(None).cast(detected.schema["id"].dataType).alias("live_id"))
    return a.unionByName(b).orderBy(F.desc("online"), F.collate("name", "en_USA"), "id")


def online_counts(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count_if("online").alias("online_count"), F.count_if(~F.col("online")).alias("offline_count"))
