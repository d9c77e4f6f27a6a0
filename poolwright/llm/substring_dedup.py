"""Substring deduplication by seed and extend.

Seeds are winnowed word 5-grams: of the nine in every window of 13 words the one with the smallest
hash, so two equal windows have the same seed at the same place. Documents meet on the seeds that
occur in different texts. A seed's occurrences are extended to both sides to the windows that it
stands for; windows that are equal in documents of different ids are matches, and those that touch
or overlap join to the maximal repeats, whose words are removed where a smaller doc_id has them.

Within a group of equal windows only the smallest doc_id is compared with each member, so no pairs
within a group are listed. Whole copies of a text meet by the text's hash and give no seeds; a
passage that very many documents share is joined through a partial minimum and a join that Spark
splits on skew. 64-bit window hashes stand for the words; between n distinct windows an accidental
match has probability n * n / 2 ** 65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, gram_hashes, release, text_rows, word_hashes, words_of, written

SEED_WORDS = 5
#: a document without an id is compared with all others as the last
NO_ID = 2**63 - 1


def seed_of_windows(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds of a document's words; for every window, where its seed is.

    The smallest hash wins, the last one on ties.
    """
    grams = gram_hashes(h, min(SEED_WORDS, window))
    span = window - min(SEED_WORDS, window) + 1
    n = len(h) - window + 1
    if n <= 0:
        return grams, np.empty(0, np.int64)
    at = np.arange(len(grams))
    length = 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] <= grams[a], b, a)

    while length * 2 <= span:
        at = better(at[: len(at) - length], at[length:])
        length *= 2
    if length < span:
        at = better(at[: len(at) - (span - length)], at[span - length :])
    return grams, at[:n]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _columns(parts: list[list], names: list[str]) -> pa.RecordBatch:
    empty = np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *own])) for own in parts], names)


def _seeds(window: int):
    """Seeds of each row (d, r), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, ds, rs = [], [], []
            for d, r, text in zip(*(batch[c].to_pylist() for c in ("d", "r", "text")), strict=True):
                grams, at = seed_of_windows(word_hashes(words_of(text)), window)
                if len(at):
                    own = _signed(np.unique(grams[np.unique(at)]))
                    seeds.append(own)
                    ds.append(np.full(len(own), d, np.int64))
                    rs.append(np.full(len(own), r, np.int64))
            yield _columns([seeds, ds, rs], ["seed", "d", "r"])

    return run


def _windows(window: int):
    """Hashes of the windows whose seed is among the row's live ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ds, rs = [], [], []
            for d, r, text, live in zip(*(batch[c].to_pylist() for c in ("d", "r", "text")), batch["seeds"], strict=True):
                h = word_hashes(words_of(text))
                grams, at = seed_of_windows(h, window)
                keep = np.isin(_signed(grams), live.values.to_numpy(zero_copy_only=False))[at] if len(at) else np.zeros(0, bool)
                if keep.any():
                    own = _signed(np.unique(gram_hashes(h, window)[keep]))
                    found.append(own)
                    ds.append(np.full(len(own), d, np.int64))
                    rs.append(np.full(len(own), r, np.int64))
            yield _columns([found, ds, rs], ["window", "d", "r"])

    return run


def _cut(window: int):
    """Remove the words of repeated windows; a text that is a whole copy is removed whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = (batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["windows"], batch["copied"].to_pylist())
            for doc_id, text, windows, copied in zip(*columns, strict=True):
                words = words_of(text)
                n = len(words)
                gone = np.zeros(n, bool)
                if n >= window:
                    if copied:
                        gone[:] = True
                    elif windows.is_valid and len(windows):
                        grams = gram_hashes(word_hashes(words), window)
                        hit = np.isin(_signed(grams), windows.values.to_numpy(zero_copy_only=False))
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, np.flatnonzero(hit), 1)
                        np.add.at(edge, np.flatnonzero(hit) + window, -1)
                        gone = np.cumsum(edge[:n]) > 0
                kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x]) if gone.any() else b" ".join(words)
                out.append((doc_id, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: every document without its repeated words.

    A word goes if a window of `window` consecutive words covers it that also starts in a document
    with a smaller doc_id; windows are judged on the input. A null text has no words. Rows of one
    doc_id are not compared with each other; a null doc_id comes after all others.
    """
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    # a row is known by its doc_id and text, so that rows without an id do not all meet under one key
    rows = text_rows(docs).withColumn("d", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("r", F.xxhash64("text"))
    row = ["d", "r"]

    # whole copies: all but the smallest doc_id of each text
    texts = written(rows.select(*row).distinct(), "texts")
    first = texts.groupBy("r").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    copies = written(texts.join(first, "r").where("d > first").select(*row), "copies")

    # seeds that occur in different texts
    seeds = rows.mapInArrow(_seeds(window), "seed long, d long, r long")
    live = seeds.groupBy("seed").agg(F.min("r").alias("a"), F.max("r").alias("b")).where("a < b").select("seed")
    live = written(live, "seeds")
    release(spark)
    held = seeds.join(live, "seed").groupBy(*row).agg(F.collect_set("seed").alias("seeds")).join(copies, row, "left_anti")
    held = written(held, "held")
    release(spark)

    # extended to windows, matched with the smallest doc_id that has them
    windows = rows.join(held, row).select(*row, "text", "seeds").mapInArrow(_windows(window), "window long, d long, r long")
    windows = written(windows, "windows")
    release(spark)
    smallest = windows.groupBy("window").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    matches = windows.join(smallest, "window").where("d > first").groupBy(*row).agg(F.collect_set("window").alias("windows"))
    whole = copies.select(*row, F.lit(None).cast("array<long>").alias("windows"), F.lit(True).alias("copied"))
    marks = written(matches.withColumn("copied", F.lit(False)).unionByName(whole), "marks")
    release(spark)
    return (
        rows.join(marks, row, "left")
        .select("doc_id", "text", "windows", "copied")
        .mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    )


#: The same in DuckDB, by brute force over all windows.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS window_text FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), f AS (SELECT window_text, min(doc_id) AS first FROM g GROUP BY 1),
h AS (SELECT doc_id, list(i) AS starts FROM g JOIN f USING (window_text) WHERE first < doc_id GROUP BY 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 13)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM h)) GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN c ON c.doc_id = w.doc_id
"""
