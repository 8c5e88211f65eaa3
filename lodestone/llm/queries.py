"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, media, minhash, packing, pii, quality, secrets, sharding, substrings, toxicity
from .common import read
from .oracle import ORACLE_SQL as ORACLE_SQL

#: byte limit of one shard
SHARD_BYTES = 1 << 20


def op1_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.digest(quality.score(docs, model))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, percent=80)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeated(read(spark, sf_dir, "documents")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), SHARD_BYTES)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(read(spark, sf_dir, "documents")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.pairs(decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.plan(read(spark, sf_dir, "documents"))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.digest(toxicity.score(docs, model))


def op10_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.media_rows(read(spark, sf_dir, "documents"), keep_media=False))


_ALL = (
    op1_quality_attention, op2_near_duplicates, op3_substring_dedup, op4_secret_scan, op5_extendible_shards,
    op6_personal_data, op7_benchmark_decontamination, op8_best_fit_packing, op9_toxicity_chain, op10_media_clips,
)
QUERIES = {f.__name__: f for f in _ALL}
