"""Corpus pipeline over the table documents: each stage takes (spark, docs, sf_dir) and returns the documents it keeps.

Stages are held together by Parquet: what one returns is written and read again as the next one's docs. The last returns the
packed pieces. A stage begins by deleting what stages before it have left in the scratch folder, but for tables that its docs read; so
of a corpus there is the stage's input, and one copy with numbered rows where rows are dropped.

Nulls and edges: a null text counts as empty in every stage and stays null where columns are passed on; empty texts are scored,
deduplicated and packed like others; very long texts are read whole; of repeated rows, ids and ties one row of each group of copies
stays; an empty table gives an empty result; further columns, whatever they are called, are passed on up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import cluster, exact_dedup, near_dup, packing, pii, quality, simhash


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores under its threshold go. It is trained on labels and documents of sf_dir."""
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest id."""
    cluster.release(spark, keep=docs)
    return exact_dedup.drop_copies(docs)


def stage_simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash, as op9 links them (fingerprints at 3 or fewer differing bits), or by a five-word Jaccard of 0.8 or more, over any chain
    of either, one row stays, that with the least id."""
    cluster.release(spark, keep=docs)
    return near_dup.keep_first(docs, bits=simhash.RADIUS)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars, if there is such a column, follows the text."""
    cluster.release(spark, keep=docs)
    masked = pii.mask_pii(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, neighbours on the curve together."""
    cluster.release(spark, keep=docs)
    return packing.packed_digest(docs)


STAGES = [("quality", stage_quality), ("exact_dedup", stage_exact_dedup), ("simhash_dedup", stage_simhash_dedup), ("pii", stage_pii), ("packing", stage_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cluster.materialize(docs)
    cluster.release(spark, keep=docs)
    return docs


#: Trained scores, fingerprints and the field's spans have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None
