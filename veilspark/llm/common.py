"""Helpers shared by the corpus operators: durable intermediate tables, Arrow access, hashing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.store import discard, freeze, shared_root

__all__ = ["NOT_WORD", "SEPARATORS", "WORD", "bound_batches", "cut", "discard", "freeze", "give_back", "hash_fraction", "mix64", "partitions", "read_dealt", "read_table", "shared_root", "sized_batches", "string_bytes"]

#: ASCII white space that ends a word in every operator here: space and U+0009 to U+000D.
SEPARATORS = " \t\n\x0b\x0c\r"
NOT_WORD = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small intermediate results of iterations; Spark deletes it when it is unreachable."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def bound_batches(df: DataFrame) -> DataFrame:
    """Session settings for what Spark sends to Python at once, so that a worker's memory doesn't follow long texts."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = str(conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_dealt(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt out to all cores where its files give fewer splits than there are cores."""
    rows, cores = read_table(spark, sf_dir, table).select(*columns), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null's range may hold anything
        if (np.diff(ends)[np.asarray(column.is_null())] != 0).any():
            return string_bytes(pa.array([x or "" for x in column.to_pylist()], column.type))
    return raw[ends[0] : ends[-1]], ends - ends[0]


def give_back() -> None:
    """What a task no longer uses goes back to the system: a worker that Spark reuses must not keep every task's peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def sized_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``max_bytes`` of ``column``: memory doesn't follow the Arrow batch size."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, ends = string_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_fraction(*columns, seed: int = 0):
    """A uniform number in (0, 1) that depends on the row's values only, so reruns agree."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
