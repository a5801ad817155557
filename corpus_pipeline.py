"""The corpus pipeline: quality rules, line dedup, near-dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it
kept; its result is written as Parquet and read again. All stages but the last
return the columns of ``documents``, with ``n_chars`` of the text as it then is.
Nulls, empty tables, repeated rows and further columns are treated as the
operators' docstrings define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinex.llm import line_dedup, near_copies, packing, quality
from ordinex.llm.common import materialize
from ordinex.llm.queries import MAX_TOKENS, PACK_END, WORD_BPE

#: SQL has no SimHash, no packing and no tokenizer.
ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    judged = quality.judged(docs).filter("ox_kept")
    return _counted(judged.withColumn("text", F.col("ox_text")), docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of 40 characters or more that five or more of them share."""
    return _counted(line_dedup.drop_lines(docs), docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked by a Jaccard similarity of their five-word shingles of 0.8
    or more, the one row with the least id (null ids last)."""
    return near_copies.survivors(docs, shingle=5, k=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 4,096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE), MAX_TOKENS, PACK_END)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
