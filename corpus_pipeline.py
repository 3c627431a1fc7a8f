"""A corpus pipeline: rejects poor documents, near-copies and benchmark leaks, mixes sources, shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's input.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, mixing, quality_classifier, sharding
from quern.llm import near_copies as copies
from quern.llm.common import discard, stored, work_folder
from quern.llm.queries import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rule ensemble rejects."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least id, of each group of like texts: five-word shingles, Jaccard 0.8 or more."""
    return copies.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, at most twice over, in the order of the blocks; shows every document with text once at least."""
    placed = stored(mixing.mixed(docs, prefix="__mix_"), "placed-mix")
    return placed.repartitionByRange("__mix_block", "__mix_place").sortWithinPartitions("__mix_block", "__mix_place").select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as compacted shards and says where each document is."""
    return sharding.sharded(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", leaks),
    ("source_mixing", mix),
    ("sharding", shards),
]

#: Trees and lasso weights, components and file names have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        docs.stored_at = path
        if hasattr(before, "stored_at"):  # all that was made of it is stored
            discard(before)
    return docs
