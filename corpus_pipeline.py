"""Corpus pipeline: quality, toxicity, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns a DataFrame. All but
the last return the columns of the documents. Filters decide inside one pass over the texts; only the near-duplicate
stage shuffles documents. Models are fitted on the documents that reach the stage and their labels.

Nulls and empty texts pass through the filters by their scores; texts without words are no duplicates of each other and
hold no benchmark words. Repeated rows are copies: one stays. Extra columns are kept until the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm import additive, bpe, jaccard, suffixes, toxicity
from tactus.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The rows of all but the last stage's result; no SQL states the learned filters.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model accepts (score of at least 0.5)."""
    model, _ = additive.fitted(docs, _table(spark, sf_dir, "labels"), "quality", 3, 1)
    return additive.keep_good(docs, model)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar accepts (score below 0.3)."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"), modulus=4, held_out=2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return suffixes.remove(docs, _table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
