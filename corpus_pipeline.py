"""The training-data pipeline: quality, exact copies, near copies, mixing, BPE.

``run`` applies the stages to ``documents``; each stage's rows are written as Parquet
below ``spark.checkpoint.dir`` and read again as the next stage's documents, so a lost
executor repeats one stage's tasks and no earlier stage.

Defined results: a null text counts as empty, and a text without words is rejected by the
quality rules, as are very short ones; a null id counts as larger than any id, so its row goes
before a copy with an id; rows that repeat an id and a text count as one from the near copies
on; of equal or similar texts the smallest id stays; a very long text is worked on whole; a
null source is a source of its own; an empty table gives empty stages; further columns pass
through all stages but the last, whatever their names.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hirestream.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from hirestream.llm.common import table
from hirestream.llm.queries import tokenizer_path
from hirestream.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text, the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word-shingle similarity, the one with the smallest id."""
    return jaccard_join.keep_representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_mix(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and a digest of what they decode to."""
    return bpe.encode_digests(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("exact copies", exact_copies), ("near copies", near_copies),
          ("source mix", source_mix), ("BPE", bpe_ids)]

#: SQL has no byte-pair encoding and no pivotal rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for n, (_, stage) in enumerate(STAGES):
        out = f"{base}/{n}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
