"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, source mix, shards.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and other columns, which they
pass on unchanged. Null and empty texts are scored as empty ones, are no near duplicates, hold no benchmark passage and
have size 0, so a mix may leave them out. Of rows that repeat an id and a text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, mixing, near_dedup, quality, sharding
from corvane.llm._common import Scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality model, fitted on the labels, rejects."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark passage occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group linked by five-word shingles at 0.8 or more."""
    return near_dedup.keep_one(docs, shingle=5, repeats=False)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks: not at all, once or twice."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str, store: str | None = None) -> DataFrame:
    """Commits all rows to target-sized shards in the folder ``store`` and returns them from the newest version, with their
    shard in a column that no other has as its name. Without a folder the shards go when the application ends."""
    return sharding.shard_documents(docs, store or Scratch(spark, "corpus").path("store")).read()


STAGES = [("quality", good_quality), ("near duplicates", one_of_each_group), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, store: str | None = None) -> DataFrame:
    """Applies all stages to the documents; each one's result is written and read again. The corpus stays in ``store``, if
    that is given: a folder without a store."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir, store) if stage is sharded else stage(spark, docs, sf_dir)
        docs = scratch.write(docs, name.replace(" ", "-"))
        if k > 1:
            scratch.drop(STAGES[k - 2][0].replace(" ", "-"))
    return docs
