"""Corpus pipeline: each stage works on all that the one before it kept, and is written before the next one reads it."""
from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meterloom.llm import bpe, contamination, disclosure, jaccard, line_frequency, staging


_scratch: list[str] = []


def stage(fn):
    """A stage begins by deleting scratch tables of those before it that its input doesn't read: all of them, where the
    input was written and read again."""
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _scratch else []
        held = [x for x in _scratch if any(x.rsplit("/", 1)[-1] in f for f in read)]
        staging.delete(spark, [x for x in _scratch if x not in held])
        known = len(staging.made)
        out = fn(spark, docs, sf_dir)
        _scratch[:] = held + staging.made[known:]
        return out

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines of the others go."""
    return line_frequency.filtered(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, k=5, percent=80)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, terms that reveal it are generalised or removed."""
    return disclosure.sanitised(docs)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of the text."""
    return bpe.encode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("text")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("byte-level BPE", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = staging.folder(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
