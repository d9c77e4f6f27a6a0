"""The corpus pipeline: documents in, packed token sequences out.

STAGES are applied in turn; each one's rows are written as Parquet and read again as the next one's
documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.llm import jaccard_join, lang_id, mixing, packing, pii
from poolwright.llm.common import WORD, read_table, release, written
from poolwright.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: a text with a lower score has hardly an n-gram of any language
MIN_LANGUAGE_SCORE = 0.05


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars after what the stage did to the text (null for a null text)."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.length("text").cast("long").alias("n_chars"),
    )


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, without a text or without a recognisable language go."""
    docs = _columns(docs)
    model = lang_id.fit_filters(docs.where(~lang_id.held_out(F.col("doc_id"))))
    found = lang_id.predict_languages(docs, model)
    return _columns(found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Documents link that are alike to 80 % or more in their sets of five-word shingles.

    Of repeated rows with equal id and text one stays. Rows without an id cannot be told apart by
    a group's smallest id; they stay, repeated ones once.
    """
    docs = _columns(docs)
    found = jaccard_join.jaccard_components(docs, percent=80, n=5)
    stay = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "stay")
    kept = docs.join(stay.select("doc_id"), "doc_id", "left_semi")
    odd = stay.where("rows > 1").select("doc_id")
    loose = docs.where("doc_id is null")
    if odd.isEmpty() and loose.isEmpty():
        return _columns(kept)
    once = kept.join(odd, "doc_id", "left_semi").unionByName(loose).dropDuplicates(["doc_id", "text"])
    return _columns(kept.join(odd, "doc_id", "left_anti").unionByName(once))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets."""
    found = pii.find_spans(_columns(docs))
    return _columns(found.withColumn("text", F.col("redacted")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a share of its words is its first words.

    Rows that agree in id, source and size are taken alike.
    """
    docs = _columns(docs)
    taken = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.max("taken").alias("taken")).where("taken > 0")
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    on = sized["doc_id"].eqNullSafe(taken["doc_id"]) & sized["source"].eqNullSafe(taken["source"]) & (sized["size"] == taken["size"])
    repeated = sized.join(taken, on).select(*[sized[c] for c in (*COLUMNS, "size")], "taken")
    repeated = repeated.withColumn("turn", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.col("taken") - F.col("turn") * F.col("size")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(left >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), left.cast("int")), " "))
    return _columns(repeated.withColumn("text", text))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.packed_documents(_columns(docs), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: The stages' models, searches and tokenizers have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
            release(spark)
    return docs
