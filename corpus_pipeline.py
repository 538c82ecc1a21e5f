"""The corpus pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes what the one before it kept.  ``run`` writes every stage's rows to the shared
folder and reads them again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableward.llm import packing, shingle_sets, subwords, toxicity
from tableward.sources.folders import scratch_folder

QUALITY_AT_LEAST, TOXIC_FROM = 0.3, 0.7


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def _shell(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, so that no column of theirs clashes with a stage's own."""
    return docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = subwords.train(docs, _labels(spark, sf_dir), "doc_id", "text", "quality", 5, 0)
    scored = subwords.score(_shell(docs), "_text", ["_row"], model)
    return scored.filter(F.col("score") >= QUALITY_AT_LEAST).select("_row.*")


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    model = toxicity.char_model(docs, "text")
    rates, base = toxicity.train(docs, _labels(spark, sf_dir), "doc_id", "text", "toxic", 3, 1, model)
    scored = toxicity.score(_shell(docs), "_text", ["_row"], model, rates, base)
    return scored.filter(F.col("score") < TOXIC_FROM).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash tries over five-word shingles with three bits, bands for
    what differs in more, and an exact check for similarity 0.8 or more."""
    return shingle_sets.keep_one(docs, "doc_id", "text", width=5, percent=80, budget=3)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows."""
    pieces = packing.pack(docs, "text", ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "tier", "step_group")


STAGES = [("quality", quality), ("toxicity", nontoxic), ("near_dedup", near_dedup), ("packing", packed)]

#: Learned models and tokenizers are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
