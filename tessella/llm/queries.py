"""The registered queries of this folder and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster, conversation_repair, divergence, exact_dedup, license_scan, line_rules, packing, pii, quality, secret_scan, sentencepiece_codec, simhash, spans, substring_dedup, token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(_documents(spark, sf_dir)))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_documents(spark, sf_dir)).select("doc_id", *spans.digest(F.col("spans"), pii.KINDS))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(_documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_documents(spark, sf_dir)).select("doc_id", *spans.digest(F.col("spans"), secret_scan.KINDS[:3]))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{cluster.scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_file(_documents(spark, sf_dir), path)
    out = cluster.materialize(token_files.read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    cluster.delete(spark, path)
    return out


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(_documents(spark, sf_dir)).drop("clean_text")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_documents(spark, sf_dir)).select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "round_trip")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_documents(spark, sf_dir))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir)).drop("matches")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"), damage=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_pii, op3_quality, op4_packing, op5_secret_scan, op6_token_files, op7_line_rules, op8_sentencepiece, op9_simhash_dedup,
        op10_exact_dedup, op11_divergence, op12_license_scan, op13_conversation_repair,
    )
}

ORACLES = {"op1_substring_dedup": substring_dedup.SQL, "op7_line_rules": line_rules.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_divergence": divergence.SQL, "op13_conversation_repair": conversation_repair.SQL}
