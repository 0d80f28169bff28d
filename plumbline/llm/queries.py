"""Queries of the training-data operators over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_tree, common, gru_lm, html_extract, id_files, mixing, packing, quality, sharding, simhash, suffix_dedup


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.table(spark, sf_dir, "pages"))


def op2_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.ids_query(common.table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(common.table(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(common.table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.ann_query(common.table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_query(common.table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(common.table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_query(common.table(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_query(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_ids, op3_simhash, op4_lm, op5_ann, op6_packing, op7_sharding, op8_quality, op9_mixing, op10_suffix)}


def oracle_sql() -> dict[str, str]:
    return {"op8_quality": quality.QUALITY_SQL, "op9_mixing": mixing.MIXING_SQL}
