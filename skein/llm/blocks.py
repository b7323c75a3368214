"""Columns of longs dealt to buckets as blocks, so that a shuffle moves, sorts and decodes few rows.

A row is (bucket, kind, data): the share that one batch of a task has of a bucket, its columns one after the other as bytes. A
partition has ``PER`` buckets and gets them one after the other, each in order of ``kind``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "bucket int, kind int, data binary"
PER = 8


def bucket_count(spark: SparkSession) -> int:
    return PER * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0..n-1 by the upper half of evenly spread longs."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.min_scalar_type(n))


def blocks(columns: list[np.ndarray], of: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """One row for each bucket in ``of``, its values in their order."""
    order = np.argsort(of, kind="stable")
    of, values = of[order], np.stack([c[order] for c in columns])
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)])
    data = [values[:, a:b].tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)])]
    return pa.RecordBatch.from_arrays([pa.array(of[starts].astype(np.int32)), pa.array(np.full(len(starts), kind, np.int32)), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def read(batches: Iterator[pa.RecordBatch], *width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bucket, kind, array of columns) of every block; a block of kind k has ``width[k]`` columns."""
    for batch in batches:
        data = batch.column(2)
        for j, (bucket, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            yield bucket, kind, np.frombuffer(data[j].as_buffer(), np.int64).reshape(width[kind], -1)


def deal(rows: DataFrame, n: int) -> DataFrame:
    """Blocks by bucket, of ``n``, and kind; each bucket is whole in one partition."""
    return rows.repartitionById(n // PER, F.expr(f"cast(bucket div {PER} as int)")).sortWithinPartitions("bucket", "kind")


def packed(rows: DataFrame, n: int, kind: int = 0) -> DataFrame:
    """``rows`` of longs, none of them null, as blocks by the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            yield blocks(columns, bucket_of(columns[0], n), kind)

    return rows.mapInArrow(run, SCHEMA)
