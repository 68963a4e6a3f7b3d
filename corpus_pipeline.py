"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

``run`` writes every stage's rows as Parquet under the shared folder and reads them again as the next one's
documents, so a lost executor repeats one stage's work at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.llm import decontaminate, near, packing, pii, quality
from ledgerlift.llm.common import table
from ledgerlift.llm.queries import pii_key, tokenizer_path
from ledgerlift.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now has it."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.lit(0).cast("bigint"))) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays; rows that share an id are judged each for itself."""
    return near.keep_one(docs, width=5, percent=80, by_row=True)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut; documents that are mostly such passages go."""
    return _with_length(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return _with_length(pii.replaced(docs, pii_key(spark)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("personal_data", personal_data), ("sequences", sequences),
]

#: Token merging, keyed permutations and best-fit packing can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), name)
    return docs
