"""Queries opN_<name> of the training-data operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curato.llm import chat, divergence, fingerprints, mixing, neardup, neighbours, packing, pieces, runs, sharding, substrings, toxicity, warc
from curato.session import ready


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def _on(table: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: work(_read(spark, sf_dir, table))


def model() -> str:
    """The file of the public SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": _on("documents", sharding.shard_records),
        "op2_warc": _on("pages", warc.page_digests),
        "op3_packing": _on("documents", packing.pack),
        "op4_chat": _on("conversations", chat.link_conversations),
        "op5_fingerprints": _on("documents", fingerprints.digest),
        "op6_toxicity": lambda spark, sf_dir: toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")),
        "op7_mixing": _on("documents", mixing.mix_documents),
        "op8_substrings": _on("documents", substrings.digest),
        "op9_neighbours": _on("embeddings", neighbours.nearest_neighbours),
        "op10_neardup": _on("documents", neardup.near_duplicates),
        "op11_pieces": lambda spark, sf_dir: pieces.digest(_read(spark, sf_dir, "documents"), model()),
        "op12_runs": _on("documents", runs.digest),
        "op13_divergence": _on("documents", divergence.audit),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle_sql(), "op2_warc": warc.ORACLE_SQL, "op13_divergence": divergence.oracle_sql()}
