"""Text functions over the driver's documents, pages and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.functions import text as t
from poolwright.operators import matching
from poolwright.sources.tables import table

from .base import query, rounded

c = F.col


@query(
    r"""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://doi.org/10.1234/AB' || doc_id || '.' WHEN 1 THEN 'doi: 10.55555/x(' || doc_id || ')' WHEN 2 THEN '10.1/too-short'
      WHEN 3 THEN 'HTTP://dx.doi.org/10.4321/Q+' || doc_id ELSE 'none' END AS doi FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(doi)), '^(https?://)?(dx\.)?doi\.org/|^doi:\s*', ''), '[.,;:)\]]+$', '') AS x FROM d)
    SELECT doc_id, CASE WHEN regexp_matches(x, '^10\.\d{4,9}/\S+$') THEN x ELSE '' END AS doi FROM b"""
)
def normalise_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = c("doc_id") % 5, c("doc_id").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("https://doi.org/10.1234/AB"), s, F.lit("."))).when(k == 1, F.concat(F.lit("doi: 10.55555/x("), s, F.lit(")")))
        .when(k == 2, "10.1/too-short").when(k == 3, F.concat(F.lit("HTTP://dx.doi.org/10.4321/Q+"), s)).otherwise("none")
    )
    return table(spark, sf_dir, "documents").select("doc_id", t.normalise_doi(raw).alias("doi"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(nfc_normalize(strip_accents(replace(text, 'ß', ''))), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS title FROM documents"""
)
def fold_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without accents, case and punctuation."""
    plain = F.regexp_replace(F.lower(t.fold_ascii(c("text"))), "[^a-z0-9 ]", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(plain, " +", " ")).alias("title"))


_SPELLED = " ".join(f"WHEN regexp_matches(w, '{pattern}') THEN regexp_replace(w, '{pattern}', '{to.replace('$', chr(92))}')" for pattern, to in t.SPELLINGS)


@query(
    rf"""WITH x AS (SELECT doc_id, regexp_extract(text, '^[^.\n]*') AS s FROM documents),
    p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(nfc_normalize(strip_accents(replace(s, 'ß', ''))), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS title FROM x)
    SELECT doc_id, array_to_string(list_transform(string_split(title, ' '), lambda w: CASE {_SPELLED} ELSE w END), ' ') AS title FROM p"""
)
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences under labels of six kinds; their keys are those of the sentences alone."""
    s, k = F.regexp_extract("text", r"^[^.\n]*", 0), c("doc_id") % 6
    bracketed = F.when(F.trim(s) == "", s)
    labelled = (
        F.when(k == 1, F.concat(F.lit("Correction: "), s)).when(k == 2, F.concat(F.lit("Author Manuscript "), s))
        .when(k == 3, F.coalesce(bracketed, F.concat(F.lit("[Article in German] "), s))).when(k == 4, F.concat(F.lit("Erratum to: Author manuscripts: "), s))
        .when(k == 5, F.coalesce(bracketed, F.concat(F.lit("[Retracted article. [Editorial - "), s, F.lit("]]")))).otherwise(s)
    )
    return table(spark, sf_dir, "documents").select("doc_id", t.normalise_title(labelled).alias("title"))


@query()
def title_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likely duplicate titles (a text's first sentence) of one source and near years, with their ratio."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "source", t.normalise_title(F.regexp_extract("text", r"^[^.\n]*", 0)).alias("title"), (c("n_chars") % 4 + 2000).alias("year")
    )
    pairs = matching.near_title_pairs(d, "doc_id", "title", "year", "source")
    found = matching.possible_duplicates(pairs, t.matching_ratio(c("title_a"), c("title_b")))
    return found.select(c("a").alias("doc_id"), c("b").alias("other"), "ratio")


@query(
    r"""WITH x AS (SELECT doc_id, regexp_replace(text, '\b(90|95|99)(\.0+)?\s*%', ' ', 'g') AS s FROM documents),
    w AS (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS i FROM x WHERE regexp_matches(s, '[0-9]')),
    p AS (SELECT doc_id, i, regexp_extract(substr(s, i, 40), '^-?[0-9]+(\.[0-9]+)?') AS m, substr(s, i - 1, 1) AS prior, s FROM w WHERE regexp_matches(substr(s, i, 2), '^(-[0-9]|[0-9])')),
    q AS (SELECT doc_id, count(*) AS n FROM p WHERE (i = 1 OR NOT regexp_matches(prior, '[A-Za-z0-9_.]')) AND length(m) < 40
          AND NOT regexp_matches(substr(s, i + length(m), 1), '[A-Za-z0-9_]') AND NOT (m[1:1] <> '-' AND i > 1 AND prior = '-' AND (i = 2 OR NOT regexp_matches(substr(s, i - 2, 1), '[A-Za-z0-9_.]'))) GROUP BY 1)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS numbers FROM x LEFT JOIN q USING (doc_id)"""
)
def numbers_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers each whole text has (their values are held against fixed cases in the tests)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t.numbers_in(c("text"))).cast("long").alias("numbers"))


_P = "CASE l_linenumber WHEN 1 THEN '31.5' WHEN 2 THEN '31.51' WHEN 3 THEN '32' ELSE '0.125' END"


@query(f"SELECT l_orderkey, l_linenumber, round(0.5 * power(10.0, -length(regexp_extract({_P}, '\\.(\\d+)', 1))), 9) + 0.0 AS tolerance FROM lineitem")
def precision_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("l_linenumber")
    printed = F.when(n == 1, "31.5").when(n == 2, "31.51").when(n == 3, "32").otherwise("0.125")
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.precision_tolerance(printed).alias("tolerance")), 9)


_TERMS = ("the", "of-the", "licensed under", "and")


@query(
    "WITH x AS (SELECT doc_id, replace(lower(text), '-', ' ') AS s FROM documents) SELECT doc_id, ("
    + " + ".join(rf"regexp_matches(s, '(^|[^\w]){w.replace('-', ' ')}([^\w]|$)')::INT" for w in _TERMS)
    + ")::INT AS hits FROM x"
)
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms of a block stand in each text as whole words."""
    return table(spark, sf_dir, "documents").select("doc_id", t.coverage(c("text"), list(_TERMS)).alias("hits"))


@query(
    """SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 7) || '…' ELSE p_name END AS short, regexp_replace(p_brand || '-20240101-7', '(-\\d+)+$', '') AS family,
       trim(regexp_replace(p_brand || ' / ' || p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS safe, greatest(1, length(p_name) // 4)::BIGINT AS tokens,
       CASE WHEN p_name SIMILAR TO '.*[ -].*' THEN '"' || p_name || '"' ELSE p_name END AS term FROM part""".replace("\\\\", "\\")
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short labels, model families, file names, token estimates and quoted terms."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        t.elide(c("p_name"), 8).alias("short"),
        t.model_family(F.concat("p_brand", F.lit("-20240101-7"))).alias("family"),
        t.safe_name(F.concat("p_brand", F.lit(" / "), "p_name")).alias("safe"),
        t.approx_tokens(c("p_name")).alias("tokens"),
        t.render_term(c("p_name")).alias("term"),
    )


@query(
    r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
       len(list_distinct(regexp_extract_all(html, 'href=["'']([^"'']+\.pdf(\?[^"'']*)?)["'']', 1)))::INT AS pdfs FROM pages"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host of each page and how many PDF files it links."""
    return table(spark, sf_dir, "pages").select("page_id", t.host_of(c("url")).alias("host"), F.size(t.pdf_links(c("html"))).alias("pdfs"))


@query(
    """WITH w AS (SELECT event_id % 50 AS doc, 'w' || (event_id % 7) AS word, event_id // 50 AS pos FROM events)
    SELECT doc, string_agg(word, ' ' ORDER BY pos) AS abstract FROM w GROUP BY 1"""
)
def abstract_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from inverted indexes."""
    e = table(spark, sf_dir, "events")
    w = e.select((c("event_id") % 50).alias("doc"), F.concat(F.lit("w"), (c("event_id") % 7).cast("string")).alias("word"), F.floor(c("event_id") / 50).alias("pos"))
    index = w.groupBy("doc", "word").agg(F.collect_list("pos").alias("at")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("doc", t.abstract_from_index(c("index")).alias("abstract"))


_CAPTION = """CASE s_suppkey % 6 WHEN 0 THEN 'Means; error bars show SEM.' WHEN 1 THEN 'Mean ± SD' WHEN 2 THEN 'Error bars: 95% CI' WHEN 3 THEN 'Error bars are 2 SD' WHEN 4 THEN 'SD and SE error bars' ELSE 'No bars' END"""


@query(f"SELECT s_suppkey, CASE {_CAPTION} WHEN 'Means; error bars show SEM.' THEN 'SE' WHEN 'Mean ± SD' THEN 'SD' WHEN 'Error bars: 95% CI' THEN 'CI95' END AS spread FROM supplier")
def caption_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread that a caption names, only where it names exactly one."""
    texts = ["Means; error bars show SEM.", "Mean ± SD", "Error bars: 95% CI", "Error bars are 2 SD", "SD and SE error bars", "No bars"]
    caption = F.element_at(F.array(*[F.lit(x) for x in texts]), (c("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", t.dispersion_type(caption).alias("spread"))


@query(
    """WITH u AS (SELECT s_suppkey, (['deg', 'Degrees; signed', 'cm', '% of baseline', 'furlongs', 'ms'])[s_suppkey % 6 + 1] AS unit FROM supplier)
    SELECT s_suppkey, CASE unit WHEN 'deg' THEN 'deg' WHEN 'Degrees; signed' THEN 'deg' WHEN 'cm' THEN 'cm' WHEN '% of baseline' THEN '%' WHEN 'ms' THEN 'ms' ELSE '' END AS key,
           CASE unit WHEN 'deg' THEN true WHEN 'Degrees; signed' THEN true WHEN 'furlongs' THEN true ELSE false END AS like_degrees FROM u"""
)
def unit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.array(*[F.lit(x) for x in ("deg", "Degrees; signed", "cm", "% of baseline", "furlongs", "ms")])
    u = table(spark, sf_dir, "supplier").select("s_suppkey", t.unit_key(F.element_at(units, (c("s_suppkey") % 6 + 1).cast("int"))).alias("key"))
    return u.withColumn("like_degrees", t.same_unit(c("key"), F.lit("deg")))


@query(
    """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'study' WHEN 'ECONOMY' THEN 'class' WHEN 'LARGE' THEN 'arm' ELSE 'box' END AS word FROM part"""
)
def singular_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = c("p_type")
    plural = F.when(kind == "SMALL", "studies").when(kind == "ECONOMY", "classes").when(kind == "LARGE", "arms").otherwise("boxes")
    return table(spark, sf_dir, "part").select("p_partkey", t.singular(plural).alias("word"))


@query(
    """WITH n AS (SELECT l_orderkey, l_linenumber, (['1,234.5', '−3.2', '12 %', '7e-2', 'n/a', '1 000', ' .5'])[l_linenumber] AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 1234.5 WHEN 2 THEN -3.2 WHEN 3 THEN 12.0 WHEN 4 THEN 0.07 WHEN 6 THEN 1000.0 WHEN 7 THEN 0.5 END::DOUBLE AS value FROM n"""
)
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.element_at(F.array(*[F.lit(x) for x in ("1,234.5", "−3.2", "12 %", "7e-2", "n/a", "1 000", " .5")]), c("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.parse_number(shown).alias("value"))


def quote_places(quotes: DataFrame, docs: DataFrame, most_heads: int = 1000) -> DataFrame:
    """item_id, places, first: the documents that hold a quote.

    Quotes meet the documents on their first eight characters (every place of a text is a key; quotes
    that are shorter are keys of their own length), so the containment test runs on few pairs.
    """
    keyed = quotes.withColumn("key", F.left("quote", F.lit(8)))
    heads = [r["key"] for r in keyed.select("key").distinct().limit(most_heads + 1).collect()]
    if len(heads) <= most_heads:  # few quotes: look for their starts only
        found = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(h)), F.lit(h)) for h in heads])) if heads else F.array().cast("array<string>")
    else:
        sizes = sorted(r["size"] for r in keyed.select(F.length("key").alias("size")).where("size is not null").distinct().collect())
        grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - (n - 1))), lambda i: F.substr("text", i, F.lit(n)))
        found = F.array_distinct(F.concat(*[grams(n) for n in sizes])) if sizes else F.array().cast("array<string>")
    hits = docs.withColumn("key", F.explode(found)).join(keyed, "key").where(F.contains("text", c("quote"))).groupBy("item_id").agg(F.count("*").alias("places"), F.min("doc_id").alias("first"))
    return quotes.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("places", F.lit(0)).alias("places"), "first")


@query(
    """WITH b AS (SELECT item_id, text AS quote FROM benchmark)
    SELECT item_id, count(doc_id) AS places, min(doc_id) AS first FROM b LEFT JOIN documents ON contains(text, quote) GROUP BY 1"""
)
def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a quote word for word."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", c("text").alias("quote"))
    return quote_places(quotes, table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    """SELECT o_orderkey, array_to_string(list_transform(list_slice(a, 1, 3), lambda x: x), ', ') || CASE WHEN len(a) > 3 THEN ' et al.' ELSE '' END AS authors
    FROM (SELECT l_orderkey AS o_orderkey, list('S' || l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS a FROM lineitem GROUP BY 1)"""
)
def authors_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")))
    a = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(ordered.alias("x"))
    names = F.transform("x", lambda e: F.concat(F.lit("S"), e["l_suppkey"].cast("string")))
    return a.select("o_orderkey", t.authors_line(names).alias("authors"))


@query(
    """WITH b AS (SELECT r_regionkey, list(DISTINCT p_type ORDER BY p_type) AS a, list(DISTINCT p_name ORDER BY p_name)[1:2] AS b FROM region, part WHERE p_partkey % 5 = r_regionkey GROUP BY 1)
    SELECT r_regionkey, '(' || array_to_string(list_transform(a, lambda x: CASE WHEN x SIMILAR TO '.*[ -].*' THEN '"' || x || '"' ELSE x END), ' OR ') || ') AND (' ||
           array_to_string(list_transform(b, lambda x: CASE WHEN x SIMILAR TO '.*[ -].*' THEN '"' || x || '"' ELSE x END), ' OR ') || ')' AS query FROM b"""
)
def boolean_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search strings from concept blocks."""
    g = table(spark, sf_dir, "part").groupBy((c("p_partkey") % 5).cast("int").alias("r_regionkey"))
    b = g.agg(F.array_sort(F.collect_set("p_type")).alias("a"), F.slice(F.array_sort(F.collect_set("p_name")), 1, 2).alias("b"))
    return b.select("r_regionkey", t.render_query(F.array("a", "b")).alias("query"))
