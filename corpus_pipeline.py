"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns documents for the next one,
with the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, linedup, neardup, packing, quality
from tessera.llm.queries import tokenizer_path
from tessera.llm.support import scratch_scope, stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines."""
    done = linedup.drop_lines(docs, "source")
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else done


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 of 5-word shingles)."""
    return neardup.keep_one(docs, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [(f.__name__, f) for f in (quality_rules, line_dedup, near_dedup, decontamination, best_fit_packing)]

#: Near-duplicate components, latent search and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one run writes between them is deleted by that run alone,
    as soon as the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    with scratch_scope(spark) as scratch:
        for k, (name, f) in enumerate(STAGES):
            docs = f(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = stage(docs, name)
                scratch.release(docs)
    return docs
