"""A cleaning pipeline over ``documents``: each stage's table is written as Parquet and reread as the next one's input.

Stages keep all columns by position, so that extra columns may have any names. Defined cases, stage by stage, are in the stages'
docstrings; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterlake.llm import decontam, lattice, pii, quality_rules, simhash
from rasterlake.llm.common import fresh, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules keep.

    Null, blank and short texts (under 50 words) go; null languages are one stratum; equal rows and ids are judged each by itself."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: of the smallest id, then of the least digest of the row.

    Null ids stay only where their class has no other; equal rows are one; blank texts are one class; rows with equal ids and
    different texts stand for their own classes."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those with over 0.8 of their words in such passages go.

    Null and empty texts stay as they are; equal rows and ids are cleaned alike; ``n_chars`` follows changed texts."""
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind.

    Null and empty texts stay as they are; equal rows and ids are changed alike; ``n_chars`` follows changed texts."""
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document: two different ones, or all where the text has fewer.

    Null and empty texts have the one empty segmentation; samples depend on the id, so that equal rows have equal ones."""
    import public_tokenizers

    # workers of the stages before may still hold memory
    return lattice.sampled(docs, public_tokenizers.path("piece_bpe_32k.model"), room=0.25)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("sentencepiece", encode),
]

#: Sampling and the trained field have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
