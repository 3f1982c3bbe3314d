"""The corpus pipeline: five stages, each over all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to
the shared folder and rereads it as the next one's ``docs``. All but the last return the columns
of ``docs``. Null texts are empty texts to every stage; empty tables pass through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import decontamination, hash_tree, mixing, near_copies, quality
from wayfold.llm.common import discard, read, written

#: Words of a shingle for near duplicates in the pipeline.
SHINGLE = 5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts as label 0."""
    return quality.kept_by_quality(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near copies:
    texts that a chain of pairs links whose shingles have a Jaccard similarity of 0.8 or more."""
    return near_copies.one_of_each(docs, SHINGLE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it."""
    return mixing.mix_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    return hash_tree.sharded(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table is deleted as soon as the next one is written."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if i:
            discard(before)
    return docs


#: The classifier, the shingle sets and the walks have no SQL form: tests/llm compares with brute force.
ORACLE_SQL = None
