"""A corpus pipeline: every stage works on what the stage before it kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.cotraining import VERDICT, score_quality
from assay.llm.exact_dedup import exact_dedup
from assay.llm.piece_codec import encode_pieces
from assay.llm.positional_index import decontaminate
from assay.llm.shingle_join import shingle_join
from assay.llm.tables import documents, stored, without_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter(f"{VERDICT}.keep").drop(VERDICT)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id."""
    return without_ids(docs, exact_dedup(docs).filter("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked near duplicates: the one with the smallest id."""
    return without_ids(docs, shingle_join(docs).filter("doc_id <> component_id"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_ids(docs, decontaminate(docs, items).filter("contaminated"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, their number, and whether they decode to its text again."""
    coded = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), digest, F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", clean),
    ("piece_encoding", pieces),
]

# The first stage is a trained classifier, which SQL cannot express; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
