"""Quality rules with cross-document line frequency, in DataFrame expressions only.

Normalised lines (lower case, white space runs as one space) are hashed; for every host the
documents that hold a line are counted; lines above the host's limit are removed, and a document
that too little is left of is rejected. Lines go through partial aggregates and a join that Spark
splits on skew, so a line that a third of all documents share meets in no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def line_table(docs: DataFrame, host: Column) -> DataFrame:
    """One row a document: its base measures, and its distinct normalised lines with their words.

    A null text has no words and no lines.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("")).alias("host"),
        text.alias("text"),
    )
    split = raw.select(
        "*",
        _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda s: F.regexp_like(s, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    n = F.size("words")
    grams = split.select(
        "*",
        F.when(
            n >= 3,
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("grams"),
        F.transform("lines", lambda s: F.lower(F.trim(F.regexp_replace(s, SPACES, " ")))).alias("normal"),
    )
    counted = grams.select(
        "*",
        F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"),
            F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).alias("ordered"),
        F.transform("normal", lambda s: F.struct(F.xxhash64(s).alias("line"), F.regexp_count(s, F.lit(WORD)).alias("words"))).alias("hashed"),
    )
    # windows found twice or more stand next to each other in the order
    again = F.filter(
        "ordered", lambda e, j: (e["g"] == F.get("ordered", j - 1)["g"]) | (e["g"] == F.get("ordered", j + 1)["g"])
    )
    covered = F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return counted.select(
        "doc_id",
        "host",
        F.xxhash64("doc_id", "host", "text").alias("row_key"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        "hashed",
    ).withColumn("n_repeat_words", F.when(F.col("n_repeat_words") < 0, 0).otherwise(F.col("n_repeat_words")))


def line_quality(
    docs: DataFrame,
    host: str = "source",
    max_docs: int = 200,
    max_share: float = 0.05,
    least_docs: int = 5,
    min_left_words: int = 30,
    min_left_share: float = 0.4,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """doc_id, the base measures, base_failed, removed_words and kept of every document.

    A line is above the limits of its host (null: a host of its own) if at least least_docs
    documents hold it and they are over max_share of the host's documents or over max_docs. A
    document that passes the base rules is kept if at least min_left_words words and
    min_left_share of its words are left. Repeated rows of one doc_id count as one document.
    """
    rows = written(line_table(docs, F.col(host)), "lines")
    lines = rows.select("row_key", "host", "doc_id", F.explode("hashed").alias("l")).select(
        "row_key", "host", "doc_id", F.col("l.line").alias("line"), F.col("l.words").alias("words")
    )
    per_host = rows.groupBy("host").agg(F.countDistinct(F.coalesce("doc_id", F.lit(-1))).alias("host_docs"))
    frequent = (
        lines.groupBy("host", "line", F.coalesce("doc_id", F.lit(-1)).alias("d"))
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("docs"))
        .where(F.col("docs") >= least_docs)
        .join(per_host, "host")
        .where((F.col("docs") > max_share * F.col("host_docs")) | (F.col("docs") > max_docs))
        .select("host", "line")
    )
    # a line counts as often as the document has it; identical rows have one row_key
    removed = (
        lines.join(frequent, ["host", "line"])
        .groupBy("row_key", "line", "words")
        .agg(F.count("*").alias("times"))
        .groupBy("row_key")
        .agg(F.sum(F.col("words") * F.col("times")).alias("removed_words"))
    )
    same = rows.groupBy("row_key").agg(F.count("*").alias("same"))
    left = removed.join(same, "row_key").select("row_key", (F.col("removed_words") / F.col("same")).cast("long").alias("removed_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rest = F.col("n_words") - F.col("removed_words")
    return (
        rows.drop("hashed")
        .join(left, "row_key", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (rest >= min_left_words) & (rest >= min_left_share * F.col("n_words")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
    )


#: The same in DuckDB; max_docs and the other limits are those of line_quality's defaults.
ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t
), w AS (
  SELECT r, generate_subscripts(words, 1) AS i, words FROM s WHERE len(words) >= 3
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM w WHERE i <= len(words) - 2
), c AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n >= 2) GROUP BY r
), l AS (
  SELECT r, doc_id, host, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS line
  FROM (SELECT r, doc_id, host, unnest(lines) AS line FROM s)
), h AS (
  SELECT host, count(DISTINCT coalesce(doc_id, -1)) AS host_docs FROM t GROUP BY host
), f AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT coalesce(doc_id, -1)) AS docs FROM l GROUP BY host, line) JOIN h USING (host)
  WHERE docs >= 5 AND (docs > 0.05 * host_docs OR docs > 200)
), x AS (
  SELECT r, sum(len(list_filter(regexp_split_to_array(line, ' '), lambda w: w <> ''))) AS removed_words
  FROM l JOIN f USING (host, line) GROUP BY r
), b AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS wc,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM s LEFT JOIN c USING (r) LEFT JOIN x USING (r)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 30 AND n_words - removed_words >= 0.4 * n_words AS kept, removed_words
FROM v
"""
