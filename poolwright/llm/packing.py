"""Best-fit packing by hierarchical residual packing.

Each partition packs its own items best-fit decreasing and emits the bins that are nearly full.
Underfull bins are items of the next round: eight partitions meet in one, pack again, and so on up
the tree. Two bins that are at most half full would have been put together, so at most one bin of
a partition is; the others can only take in such small bins. Going up, a partition therefore keeps
its small bin and the FORWARD emptiest others, and closes the rest: what climbs does not grow with
the data, and every piece is in exactly one closed bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, text_rows, trimmed, written
from .tokens import tokenizer

#: partitions that meet in one in each round
FAN_IN = 8
#: underfull bins, over half full, that a partition sends up
FORWARD = 256


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of the items of each bin. Ties by position."""
    bins: list[list[int]] = []
    by_residual: dict[int, list[int]] = {}
    open_residuals = 0  # bit r: a bin has r places left
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        fitting = open_residuals >> need
        if fitting:
            r = need + (fitting & -fitting).bit_length() - 1
            b = by_residual[r].pop()
            if not by_residual[r]:
                open_residuals &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        by_residual.setdefault(r - need, []).append(b)
        open_residuals |= 1 << (r - need)
    return bins


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32: every document's ids and end_id, cut into pieces.

    Only documents over capacity are cut; their first piece is the short one. A null text is empty.
    uid is (partition, row): it tells repeated rows of one doc_id apart.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            ids, counts = tok.encode_all(batch["text"].to_pylist(), end_id)
            at = 0
            for doc_id, n in zip(batch["doc_id"].to_pylist(), counts.tolist(), strict=True):
                cut = n if n <= capacity else n % capacity or capacity
                start, piece = 0, 0
                while start < n:
                    rows.append((uid, doc_id, piece, start, cut - start, zlib.crc32(ids[at + start : at + cut])))
                    start, cut, piece, uid = cut, cut + capacity, piece + 1, uid + 1
                at += n
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    batch_rows(docs.sparkSession, 3_000)
    return text_rows(docs).mapInArrow(trimmed(pieces), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


_BINS = "node int, closed boolean, fill long, uids array<long>, lengths array<long>"


def _round(capacity: int, slack: int, last: bool):
    """Pack the rows of each node of the partition; rows come sorted by node."""

    def packed(node: int, fills: list[int], uids: list, lengths: list) -> list[tuple]:
        out = []
        for members in best_fit(fills, capacity):
            out.append(
                (sum(fills[i] for i in members), [u for i in members for u in uids[i]], [x for i in members for x in lengths[i]])
            )
        out.sort(key=lambda b: b[0])
        forward = sum(b[0] * 2 <= capacity for b in out) + FORWARD
        return [(node, last or k >= forward or b[0] >= capacity - slack, *b) for k, b in enumerate(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(node: int, held: list[list]) -> pa.RecordBatch:
            rows = packed(node, *held) if held[0] else []
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "closed", "fill", "uids", "lengths"]
            )

        node, held = None, [[], [], []]
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("node", "fill", "uids", "lengths")]
            for n, fill, uids, lengths in zip(*columns, strict=True):
                if n != node:
                    if node is not None:
                        yield closed(node, held)
                    node, held = n, [[], [], []]
                for to, x in zip(held, (fill, uids, lengths), strict=True):
                    to.append(x)
        if node is not None:
            yield closed(node, held)

    return run


def pack(pieces: DataFrame, capacity: int = 1024, items_per_node: int = 50_000, slack: int = 0) -> DataFrame:
    """sequence_id and offset for each uid of pieces (uid, length): gapless, no sequence over capacity."""
    whole = pieces.where(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    total = rest.count()
    nodes = max(1, -(-total // items_per_node))
    spark = pieces.sparkSession
    level = rest.select(
        F.pmod(F.xxhash64("uid"), F.lit(nodes)).cast("int").alias("node"),
        F.col("length").alias("fill"),
        F.array("uid").alias("uids"),
        F.array("length").alias("lengths"),
    )
    done = []
    while True:
        dealt = level.repartition(nodes, "node").sortWithinPartitions("node", F.col("uids")[0])
        bins = written(dealt.mapInArrow(_round(capacity, slack, nodes == 1), _BINS), "bins")
        done.append(bins.where("closed"))
        if nodes == 1:
            break
        nodes = -(-nodes // FAN_IN)
        level = bins.where("not closed").select(F.floor(F.col("node") / FAN_IN).cast("int").alias("node"), "fill", "uids", "lengths")
    closed = done[0]
    for more in done[1:]:
        closed = closed.unionByName(more)
    # a sequence is named by its first piece
    members = closed.select(F.col("uids")[0].alias("sequence_id"), F.posexplode("uids").alias("at", "uid"), "lengths").select(
        "uid", "sequence_id", F.expr("aggregate(slice(lengths, 1, at), 0L, (a, x) -> a + x)").alias("offset")
    )
    return whole.unionByName(members)


def packed_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row for each piece of each document, with its sequence and its place there."""
    pieces = written(tokenized_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    placed = pack(pieces.select("uid", "length"), capacity)
    return pieces.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
