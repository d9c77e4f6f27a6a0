"""Language identification by bit-sliced Bloom filters of letter n-grams.

All languages share one filter whose slots are bitmasks: the masks at an n-gram's hash positions,
combined with AND, name every language that contains the n-gram. A text's n-grams are looked up at
once, hits are counted for each language, corrected for the false positives that the language's
fill predicts, and weighed; the largest count decides.

An n-gram belongs to a language if it is at least RATIO times as frequent there as in the mean of
all. Frequencies come from labelled documents: all of them up to SAMPLE_DOCS a language, beyond that
a hash sample of that expected size (a bounded sample of labelled rows to fit a classifier on).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, mix, trimmed, written

#: expected number of labelled documents of a language that the filters are fitted on
SAMPLE_DOCS = 4_000
#: letters of an n-gram; words are padded with one space on each side
SIZES = (2, 3, 4)
SLOTS = 1 << 20
HASHES = 3
#: how much more frequent in a language than on average
RATIO = 1.5
#: occurrences in a language's sample below which an n-gram is left out
LEAST = 4
#: languages that one mask word names; more languages have more words a slot
WORD_LANGUAGES = 64
UNKNOWN = "und"

_SEEDS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BASE = np.uint64(0x100000001B3)
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for what is no letter."""
    global _LETTERS
    if _LETTERS is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS = table
    return _LETTERS


def ngrams(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of a text's words, in order; empty without a letter."""
    if not text:
        return np.empty(0, np.uint64)
    cp = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    letter = cp != 0
    if not letter.any():
        return np.empty(0, np.uint64)
    # runs of other characters become one space
    keep = letter | np.concatenate([[False], letter[:-1]])
    x = np.concatenate([[0], cp[keep], [0]]).astype(np.uint64)
    if x[-2] == 0:
        x = x[:-1]
    space = x == 0
    out = []
    h = x + np.uint64(1)
    for n in range(2, max(SIZES) + 1):
        if len(x) < n:
            break
        h = h[:-1] * _BASE + x[n - 1 :] + np.uint64(1)
        if n in SIZES:
            # no n-gram reaches over a space inside
            inner = np.zeros(len(h), bool)
            for k in range(1, n - 1):
                inner |= space[k : k + len(h)]
            out.append(mix(h[~inner] + np.uint64(n)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _positions(grams: np.ndarray) -> list[np.ndarray]:
    return [(mix(grams ^ seed) & np.uint64(SLOTS - 1)).astype(np.int64) for seed in _SEEDS[:HASHES]]


@dataclass
class LanguageFilters:
    languages: list[str]
    slots: np.ndarray  # a bitmask of languages in each slot: (mask words, SLOTS)
    false_positive: np.ndarray  # rate of each language
    typical: np.ndarray  # corrected share of hits in a text of each language

    def counts(self, text: str | None) -> np.ndarray | None:
        """Corrected share of the text's n-grams in each language; None without a letter."""
        grams = ngrams(text)
        if not len(grams):
            return None
        mask = None
        for at in _positions(grams):
            mask = self.slots[:, at] if mask is None else mask & self.slots[:, at]
        n = len(grams)
        hits = np.array([np.count_nonzero(mask[i // WORD_LANGUAGES] & np.uint64(1 << i % WORD_LANGUAGES)) for i in range(len(self.languages))], float)
        return np.maximum(hits - n * self.false_positive, 0) / (n * (1 - self.false_positive))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how far the best is ahead, 0 to 1, lowered where even the best has few hits."""
        share = self.counts(text)
        if share is None or not self.languages:
            return UNKNOWN, 0.0
        share = share / self.typical
        best = int(share.argmax())
        total = share.sum()
        score = share[best] / total * min(1.0, share[best]) if total > 0 else 0.0
        return self.languages[best], round(float(score), 6)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _counted(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found.setdefault(lang, []).append(ngrams(text))
            langs, grams, counts = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for lang, parts in found.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                langs.append(np.full(len(g), index[lang], np.int32))
                grams.append(g)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.empty(0, np.int32), *langs])),
                    pa.array(np.concatenate(grams).view(np.int64)),
                    pa.array(np.concatenate(counts).astype(np.int64)),
                ],
                ["lang", "gram", "n"],
            )

    return run


def fit_filters(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LanguageFilters:
    """Fit on (doc_id, text, lang) rows; rows without text or lang are left out.

    Slot masks are built by a grouped bit_or; the driver gets SLOTS masks for each 64 languages at most.
    """
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(per_lang)
    if not languages:
        return LanguageFilters([], np.zeros((1, SLOTS), np.uint64), np.zeros(0), np.zeros(0))
    index = {x: i for i, x in enumerate(languages)}
    share = spark.createDataFrame([(x, sample_docs / n) for x, n in per_lang.items()], "lang string, share double")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << 30)) / float(1 << 30)
    sample = written(rows.join(F.broadcast(share), "lang").where(unit < F.col("share")).select("text", "lang"), "sample")
    grams = sample.mapInArrow(trimmed(_counted(index)), "lang int, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    grams = written(grams, "grams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = grams.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    mean = rate.groupBy("gram").agg((F.sum("rate") / len(languages)).alias("mean"))
    own = rate.join(mean, "gram").where((F.col("n") >= LEAST) & (F.col("rate") >= (RATIO if len(languages) > 1 else 0) * F.col("mean")))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch["gram"].to_numpy().view(np.uint64)
            lang = batch["lang"].to_numpy().astype(np.uint64)
            bit = np.uint64(1) << lang % np.uint64(WORD_LANGUAGES)
            at = np.concatenate(_positions(g) or [np.empty(0, np.int64)])
            word = np.tile((lang // np.uint64(WORD_LANGUAGES)).astype(np.int32), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(at.astype(np.int32)), pa.array(np.tile(bit, HASHES).view(np.int64))], ["word", "slot", "mask"])

    table = own.select("gram", "lang").mapInArrow(slots, "word int, slot int, mask long").groupBy("word", "slot").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    filled = np.zeros((-(-len(languages) // WORD_LANGUAGES), SLOTS), np.uint64)
    filled[table["word"].to_numpy(), table["slot"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(filled[i // WORD_LANGUAGES] & np.uint64(1 << i % WORD_LANGUAGES)) for i in range(len(languages))]) / SLOTS
    model = LanguageFilters(languages, filled, fill**HASHES, np.ones(len(languages)))
    shared = spark.sparkContext.broadcast(model)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, values = [], []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if (c := shared.value.counts(text)) is not None:
                    langs.append(lang)
                    values.append(float(c[index[lang]]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(values, pa.float64())], ["lang", "share"])

    typical = sample.mapInArrow(trimmed(shares), "lang string, share double").groupBy("lang").agg(F.percentile_approx("share", 0.5, 10_000).alias("share")).collect()
    for r in typical:
        model.typical[index[r["lang"]]] = max(round(r["share"], 6), 0.01)
    return model


def predict_languages(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred, score and the other columns of docs; whole texts, nothing but the text.

    Null texts and texts without a letter are `und` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    batch_rows(docs.sparkSession, 1000)
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    schema = ", ".join([f"`{n}` {t}" for n, t in docs.dtypes] + ["lang_pred string, score double"])
    return docs.mapInArrow(trimmed(predicted), schema)


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the labelled rows that are not held out.

    Repeated rows each get a row; a null doc_id is not held out. Of equal shares the language that
    comes first in code-point order is predicted.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = fit_filters(rows.where(~held_out(F.col("doc_id"))), sample_docs)
    found = predict_languages(rows.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
