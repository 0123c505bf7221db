"""The registered opN_ queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.llm import chat, decontam, langid, packing, pii, quality, secrets, sharding, simhash, substrings
from tesserix.llm import sql as twins
from tesserix.llm.common import read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


Query = Callable[[SparkSession, str], DataFrame]


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_passages(read(spark, sf_dir, "documents"))


def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(read(spark, sf_dir, "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(read(spark, sf_dir, "documents"))
    return out.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read(spark, sf_dir, "documents")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_byte_shards": op3_byte_shards,
    "op4_passage_dedup": op4_passage_dedup,
    "op5_chat_perspectives": op5_chat_perspectives,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
}
ORACLES: dict[str, str] = twins.TWINS
