"""A training-data pipeline over ``documents``: five stages, one after the other."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import decontaminate, mixing, near_duplicates, quality_rules, token_files
from tapeloom.llm.queries import MIX_OTHER, MIX_WEIGHTS
from tapeloom.runtime import shared_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return near_duplicates.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the target mixture."""
    return mixing.mixed(docs, MIX_WEIGHTS, other=MIX_OTHER, every_source=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as wavelet-matrix shards in the order of the mixture, and the documents read back from them.

    Files keep no order of rows, so the places in the mixture are worked out again.
    """
    path = shared_path(spark)
    placed = mixing.placed(docs, MIX_WEIGHTS, other=MIX_OTHER, every_source=True)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    # the workers that write also run the near-duplicate stage of the next table
    token_files.write(placed, path, tokenizer, order=("mix_slot", "mix_rank"), keep_words=False)
    return token_files.read_documents(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_quality),
    ("near_duplicates", without_copies),
    ("decontaminate", uncontaminated),
    ("mix_sources", mixed),
    ("token_files", token_ids),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before kept, written and read again in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        path = shared_path(spark)
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
