"""The queries of this folder, by name; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collisions, flac, html_crf, jaccard_join, mixing, piece_table, quality_model, quality_rules, runs, secrets, stamps, token_counts, urls
from .common import table


def op1_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.op1_piece_table(table(spark, sf_dir, "documents"))


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op2_divergence_rules(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.op3_url_filter(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op4_jaccard_join(table(spark, sf_dir, "documents"))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op5_quality_trees(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op6_secret_scan(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op7_mix_sources(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.op8_main_text(table(spark, sf_dir, "pages"))


def op9_flac_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.op9_flac_columns(table(spark, sf_dir, "documents"))


def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op10_section_tokens(table(spark, sf_dir, "documents"))


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.op11_lyndon_runs(table(spark, sf_dir, "documents"))


def op12_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.op12_collision_search(table(spark, sf_dir, "embeddings"))


def op13_stamp_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.op13_stamp_dictionary(table(spark, sf_dir, "stamps"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SQL: dict[str, str] = {"op2_divergence_rules": quality_rules.ORACLE, "op3_url_filter": urls.ORACLE, "op13_stamp_dictionary": stamps.ORACLE}
