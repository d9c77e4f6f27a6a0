"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.session import discard, fresh_path, release, shared_dir, written  # noqa: F401

#: ASCII white space, the separator of every "words" contract: [^\x20\x09-\x0D]+
WORD = r"[^\x20\x09-\x0D]+"

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def encoded(text: str | None) -> bytes:
    """UTF-8; a lone surrogate cannot come out of a Parquet string."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() separates at exactly \\x20 and \\x09-\\x0D."""
    return encoded(text).split()


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive entries of h."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    out = h[:size].copy()
    for k in range(1, n):
        out = out * base + h[k : k + size]
    return mix(out)


#: bytes of an Arrow batch, so that a run of very long texts is many batches
BATCH_BYTES = 8 << 20


def batch_rows(spark: SparkSession, rows: int, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that carry whole texts, by rows and by bytes.

    These are settings of the session, read when the plan runs, and stay until the next operator's.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def trimmed(run: Callable) -> Callable:
    """The same function over Arrow batches; a worker that has ended a task gives back what it freed."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return ran


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator needs, so that others never leave the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
