"""A corpus from raw documents to packed sequences, stage by stage."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from estatelens.llm.line_dedup import dedup_lines
from estatelens.llm.minhash import Near, without_near_duplicates
from estatelens.llm.packing import pack_documents
from estatelens.llm.quality import good_documents
from estatelens.llm.queries import vocabulary
from estatelens.llm.secrets import redact
from estatelens.llm.workers import small_batches
from estatelens.session import configure, durable, release, written

#: Checkpoint folders of the stages so far.
_made: list[str] = []


def tidy(stage):
    """A stage that first deletes the checkpoint folders of earlier stages that nobody reads any more.

    What earlier stages returned has been written and read again by then; folders that ``docs`` itself
    still reads stay.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for folder in release(spark, _made, still_read=docs):
            _made.remove(folder)
        before = set(written())
        out = stage(small_batches(configure(spark)), docs, sf_dir)
        _made.extend(f for f in written() if f not in before)
        return out

    return run_stage


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rejected documents and without lines that too many documents of a host carry."""
    return good_documents(docs)


@tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that are similar to an earlier line of the corpus."""
    return dedup_lines(docs)


@tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are 80 % the same."""
    return without_near_duplicates(docs, Near(words=5, percent=80))


@tidy
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With credentials masked that look real, unless they are widely copied."""
    return redact(docs)


@tidy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces and their places in sequences of 1024 tokens."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Token ids are beyond SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
