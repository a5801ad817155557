"""Token ids in ORC: written in ascending order of document ids, read back by stripe.

A row is a document: ``doc_id``, its place in the file's own stream of ids
(``local_start``), ``n_tokens``, ``ids`` (integers, run-length encoded by the
format), and the number of its file (``part``). Files follow the order of ids, as
do the rows within: row indexes and stripe statistics prune ranges of ids, Bloom
filters single ids, and stripes are read in parallel. Where a document starts
among all ids is known once all files are written: the totals of the files before it
(a number for each file) and its place in its own.

Defined results: a null text is empty and has the end id alone; null ids come first;
rows that repeat an id follow one another by text; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import texts
from .word_bpe import encoder

STRIPE_BYTES, INDEX_ROWS, FALSE_POSITIVES = 16 << 20, 1000, 0.01


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2) -> None:
    """Encode ``docs`` and write their ids under ``path``. Texts are shuffled once, by
    ranges of ids, and encoded where they are written."""
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    t = texts(docs)
    tie = F.xxhash64("text")  # rows that repeat an id can be dealt to several files
    ordered = t.withColumn("ox_tie", tie).repartitionByRange("doc_id", "ox_tie").sortWithinPartitions("doc_id", "ox_tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at, part = encoder(tokenizer_path), 0, TaskContext.get().partitionId()
        for b in batches:
            step = 1000
            for k in range(0, b.num_rows, step):
                rows = b.slice(k, step)
                ids = [x + end for x in enc.encode_all(rows.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(at + ends[:-1]), pa.array(n), lists, pa.array(np.full(len(ids), part, np.int32))], names=["doc_id", "local_start", "n_tokens", "ids", "part"])
                at += int(ends[-1])

    kind = t.schema["doc_id"].dataType.simpleString()
    out = ordered.mapInArrow(run, f"doc_id {kind}, local_start long, n_tokens long, ids array<int>, part int")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_POSITIVES), "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(INDEX_ROWS), "orc.create.index": "true"}
    out.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows under ``path`` with ``start``: the ids of all documents before. Filters on
    ``doc_id`` reach the stripes' statistics and Bloom filters."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each file
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few ids, by stripe and Bloom filter."""
    return spark.read.orc(path).filter(F.col("doc_id").isin([int(x) for x in doc_ids])).select("doc_id", "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """``tokens`` (of :func:`read_tokens`) with ``ids_crc32`` in place of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat, ends = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
            sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
