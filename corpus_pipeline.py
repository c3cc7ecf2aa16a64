"""The corpus pipeline: five filters and encoders, each over all that the one before it kept.

Belongs to ``palimpsest.llm``. ``run`` applies the stages to ``documents``; what the
classifier keeps is cut there, since near-dedup reads its input more than once, and the rest is one lazy plan. A driver that
wants a table per stage writes each stage's result and gives it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontam, pieces, pii, quality, simhash
from palimpsest.llm.common import cut, read


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the least doc_id."""
    return simhash.dedup(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs, count="n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces: ids, n_tokens and lossless beside the columns of ``documents``."""
    return pieces.encode(docs)


STAGES = [("quality", good), ("near_dedup", single), ("decontamination", unseen), ("pii", private), ("sentencepiece", encoded)]
#: Boosted trees, fingerprints and edit distances have no SQL; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == "quality":
            docs = cut(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
