"""The operators of this package applied to their whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe.llm import alignment, decontamination, fim, jaccard_join, line_dedup, near, pii, piece_bpe, quality, secrets, sharding, toxicity, warc
from leakframe.llm.oracles import ORACLES
from leakframe.llm.scratch import ready

SHARDS = 8
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.groups(table(spark, sf_dir, "documents"), shingle_words=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]), "doc_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    rows = sharding.assign(docs, "doc_id", SHARDS).withColumn("law", F.lit("key"))
    return sharding.number(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    one = lambda run: F.concat_ws("-", run["first"].cast("string"), run["last"].cast("string"))
    return found.select(
        "doc_id",
        F.aggregate("runs", F.lit(0).cast("long"), lambda n, run: n + run["last"] - run["first"] + 1).alias("n_deleted"),
        F.array_join(F.transform("runs", one), ",").alias("deleted"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("text_sha256"),
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]), "doc_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(F.encode(text, "utf-8"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest("output").alias("output_sha256"), digest(fim.restored()).alias("restored_sha256"),
    )


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(PIECE_MODEL)).drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_decontamination, op3_secret_scan, op4_sharding, op5_line_dedup, op6_sentencepiece, op7_warc,
        op8_quality_rules, op9_toxicity, op10_pii, op11_fill_in_middle, op12_jaccard_join, op13_token_alignment,
    )
}
__all__ = ["ORACLES", "PIECE_MODEL", "QUERIES", "table"]
