"""Token-ID binary output: Simple-8b files in document order, and their reader.

A file holds one segment: consecutive documents of one range partition, in ascending doc_id. The
files go through Spark's own Parquet committer (one row with one binary column a file), so they can
be in any file system that Spark writes, and lost or repeated tasks leave no half files.

Layout of the binary, little-endian: magic ``PWS8``, 8 header integers (part, ids before in the part,
documents, ids, words, blocks, raw words, 0) as int64; doc_id as int64; 1 byte a document for a null
doc_id; tokens a document as uint32; block offsets, raw words and words as uint64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import batch_rows, fresh_path, shuffle_partitions, text_rows, trimmed, written
from .tokens import BATCH_BYTES, BATCH_ROWS, tokenizer

MAGIC = b"PWS8"
#: ids after which a segment is closed; a document is never divided
SEGMENT_IDS = 2_000_000


def pack_segment(part: int, before: int, doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    words, offsets, raw = simple8b.encode(ids)
    head = np.array([part, before, len(doc_ids), len(ids), len(words), len(offsets) - 1, len(raw), 0], "<i8")
    return b"".join(
        [
            MAGIC,
            head.tobytes(),
            np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array(counts, "<u4").tobytes(),
            offsets.astype("<u8").tobytes(),
            raw.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def unpack_segment(data: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """part, ids before it in the part, doc_ids, tokens a document, all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    part, before, docs, n, n_words, blocks, n_raw, _ = np.frombuffer(data, "<i8", 8, 4).tolist()
    at = 4 + 64
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    at += 8 * docs
    null = np.frombuffer(data, np.uint8, docs, at)
    at += docs
    counts = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    offsets = np.frombuffer(data, "<u8", blocks + 1, at)
    at += 8 * (blocks + 1)
    raw = np.frombuffer(data, "<u8", n_raw, at)
    at += 8 * n_raw
    words = np.frombuffer(data, "<u8", n_words, at)
    ids = simple8b.decode(words, offsets, raw, n)
    return part, before, [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)], counts, ids


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of every text, in ascending doc_id (nulls first, repeated ids by text).

    A null text is empty; end_id, if any, follows each document. One shuffle, by ranges of doc_id.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        tok = tokenizer(tokenizer_path)
        doc_ids, counts, ids, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal before, held
            values = np.concatenate([np.empty(0, "<u4"), *ids])
            data = pack_segment(part, before, doc_ids, counts, values)
            before += len(values)
            held = 0
            for x in (doc_ids, counts, ids):
                x.clear()
            return pa.RecordBatch.from_pydict({"payload": pa.array([data], pa.binary())})

        for batch in batches:
            flat, many = tok.encode_all(batch["text"].to_pylist(), end_id)
            ends = np.cumsum(many)
            at, from_id = 0, 0
            # a segment is closed with the document that fills it
            while at < len(many):
                stop = int(np.searchsorted(ends, from_id + segment_ids - held)) + 1
                stop = min(stop, len(many))
                to_id = int(ends[stop - 1])
                doc_ids += batch["doc_id"].slice(at, stop - at).to_pylist()
                counts += many[at:stop].tolist()
                ids.append(flat[from_id:to_id])
                held += to_id - from_id
                at, from_id = stop, to_id
                if held >= segment_ids:
                    yield closed()
        if doc_ids:
            yield closed()

    batch_rows(docs.sparkSession, BATCH_ROWS, BATCH_BYTES)
    ordered = text_rows(docs).repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(trimmed(segments), "payload binary").write.option("maxRecordsPerFile", 1)
    files.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start_in_part, n_tokens, ids_crc32 (of little-endian uint32 ids) of every document."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["payload"]:
                part, before, doc_ids, counts, ids = unpack_segment(data.as_py())
                flat = ids.astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "part": pa.array([part] * len(doc_ids), pa.int32()),
                        "start_in_part": pa.array(starts + before, pa.int64()),
                        "n_tokens": pa.array(counts.astype(np.int64)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    files = spark.read.schema("payload binary").parquet(path)
    return files.mapInArrow(trimmed(documents), "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")


def token_file_index(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the files, read them back, and place each document in the whole stream of ids."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id, segment_ids)
    found = written(read_token_files(spark, path), "token-index")
    # one number for each range partition: their count is the session's setting, not the data's
    sizes = {r["part"]: r["n"] for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, base))
        base += sizes[part]
    bases = spark.createDataFrame(rows, "part int, base long")
    return found.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )
