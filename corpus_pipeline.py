"""Toxicity, near-duplicates, repeated passages, source mixing and packing, one after another over the documents.

Each stage works on all that the one before it kept and returns the columns of documents, but for the last, which returns
the packed rows. run() writes each stage to the shared folder, so that a lost executor repeats a part of one stage only.

Defined results: null and empty texts are not toxic, are near copies of nothing (of rows equal in doc_id and text one stays), lose
no words, are mixed in once and packed with length 0. Rows without doc_id, or that repeat one, are judged by their own text in
each stage. Further columns of documents go through all stages but the last, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curato.llm import mixing, neardup, packing, shared, substrings, toxicity
from curato.session import ready


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest doc_id stays."""
    ready(spark)
    return neardup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier window of 20 words go; texts that lose none stay as they are. n_chars follows."""
    ready(spark)
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("mixing", mix), ("packing", pack)]
#: The stages fit a model, join by similarity and choose boundaries step by step, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
