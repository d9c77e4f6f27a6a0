"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven code points sets the boundaries: at block size b = 2 ** k a chunk ends
where the hash is b - 1 modulo b. Every chunk gives one character of the signature. A fingerprint is
``b:signature at b:signature at 2 b``; b is the smallest size that is expected to give at most
64 chunks, halved while it gives fewer than 16 (texts that repeat themselves have few boundaries). Signatures are compared at equal block sizes only, so fingerprints are comparable whose
b are equal or differ by a factor of two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, mix, shuffle_partitions, text_rows

WINDOW = 7
#: characters of a signature; the last one stands for the rest of the text
LENGTH = 64
#: signatures that share no run of so many characters (half of a shorter one) have likeness 0
COMMON = 5
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(WINDOW)]


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def _rolling(cp: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW code points that end at each place (fewer at the start)."""
    x = mix(cp.astype(np.uint64) + np.uint64(1))
    out = x.copy()
    for k in range(1, min(WINDOW, len(x))):
        out[k:] += x[:-k] * _POWERS[k]
    return out >> np.uint64(24)


def _signature(cp: np.ndarray, rolling: np.ndarray, block: int) -> str:
    n = len(cp)
    ends = np.flatnonzero((rolling & np.uint64(block - 1)) == np.uint64(block - 1)) + 1
    ends = ends[: LENGTH - 1]
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    # a chunk's hash depends on its content and order only
    place = np.arange(n) - np.repeat(starts, ends - starts)
    mixed = mix(cp.astype(np.uint64) * _BASE + place.astype(np.uint64))
    total = mix(np.add.reduceat(mixed, starts))
    return _ALPHABET[(total >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    """An empty text has the fingerprint ``1::``."""
    cp = code_points(text)
    if not len(cp):
        return "1::"
    block = 1
    while block * LENGTH < len(cp):
        block *= 2
    rolling = _rolling(cp)
    first, second = _signature(cp, rolling, block), _signature(cp, rolling, 2 * block)
    while len(first) < LENGTH // 4 and block > 1:
        block //= 2
        first, second = _signature(cp, rolling, block), first
    return f"{block}:{first}:{second}"


def _common_run(a: str, b: str) -> bool:
    k = min(COMMON, max(1, min(len(a), len(b)) // 2))
    runs = {a[i : i + k] for i in range(len(a) - k + 1)}
    return any(b[i : i + k] in runs for i in range(len(b) - k + 1))


def _edit_likeness(a: str, b: str) -> float:
    """1 - (insertions and deletions between them) / (both lengths), bit-parallel."""
    if a == b:
        return 1.0
    if not a or not b or not _common_run(a, b):
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    v = mask
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & mask
    same = len(a) - v.bit_count()
    return 2.0 * same / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; the best of the signatures of equal block size. Equal fingerprints: 1."""
    if a == b:
        return 1.0
    size_a, a1, a2 = a.split(":")
    size_b, b1, b2 = b.split(":")
    x, y = int(size_a), int(size_b)
    if x == y:
        return max(_edit_likeness(a1, b1), _edit_likeness(a2, b2))
    if x == 2 * y:
        return _edit_likeness(a1, b2)
    if y == 2 * x:
        return _edit_likeness(a2, b1)
    return 0.0


def edited(text: str, after: str) -> str:
    """The last quarter replaced by the start of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (part, copy of the next part's first row last, order)."""
    out: list[tuple] = []
    held = None  # (part, doc_id, text, fingerprint) that waits for the next text

    def finished(after: str, after_print: str) -> None:
        _, doc_id, text, own = held
        changed = edited(text, after)
        changed_print = own if changed == text else fingerprint(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((doc_id, len(text), digest, own, changed_print, likeness(own, changed_print), likeness(own, after_print)))

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("part", "doc_id", "text", "guest")]
        for part, doc_id, text, guest in zip(*columns, strict=True):
            text = text or ""
            if held and held[0] != part:
                held = None
            if held or not guest:
                own = fingerprint(text)
                if held:
                    finished(text, own)
                held = None if guest else (part, doc_id, text, own)
        yield _batch(out)
        out.clear()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. The next document is the next row by (doc_id, text), nulls first; after
    the last comes the first. One shuffle by ranges of doc_id moves the texts; the first row of
    each range also goes to the range before it. Range bounds come from a pass over doc_id alone.
    """
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    rows = text_rows(docs).withColumn("d", F.coalesce("doc_id", F.lit(-(2**63))))
    parts = shuffle_partitions(spark)
    # one bound for each partition: their number is the session's setting
    cuts = rows.agg(F.percentile_approx("d", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    part = F.size(F.filter(bounds, lambda b: b < F.col("d"))).cast("int")
    firsts = {r["part"]: r["first"] for r in rows.select("d", part.alias("part")).groupBy("part").agg(F.min("d").alias("first")).collect()}
    order = sorted(firsts)
    to = spark.createDataFrame([(firsts[p], order[i - 1]) for i, p in enumerate(order)], "d long, part int")
    own = rows.select("doc_id", "text", "d", part.alias("part"), F.lit(False).alias("guest"))
    guests = rows.join(F.broadcast(to), "d").select("doc_id", "text", "d", "part", F.lit(True).alias("guest"))
    dealt = own.unionByName(guests).repartition(parts, "part").sortWithinPartitions("part", "guest", "d", "text")
    return dealt.select("part", "doc_id", "text", "guest").mapInArrow(
        _compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
