"""Text functions of record matching and grounding.

Expressions where Spark has them; Arrow-batched functions for Unicode normalisation and sequence
matching, which it lacks.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: British endings of a word and what they are folded to; the first that fits is used
SPELLINGS = (
    (r"^(.{3,})our(s|al|ally|able|ed|ing|ist|ite)?$", "$1or$2"),
    (r"^(.{4,})is(e|ed|es|er|ers|ing|ation|ations)$", "$1iz$2"),
    (r"^(.{3,})lys(e|ed|es|ing)$", "$1lyz$2"),
)
# fixed values: labels that publishers and archives put before a title, those of the second row with a sign behind them
LABELS = r"author\s+manuscripts?|reply\s+to"
NOTICES = r"correction|corrigendum|erratum|retraction|retracted(?:\s+article)?|editorial"
NOTICE_END = r"(?:\s+(?:to|on|of|for|in))?\s*[:.-]"
NOTE = r"\[[^\]]{0,160}\](?=\s*\S)"
_LABEL = rf"^\s*(?:{NOTE}|{LABELS}|(?:{NOTICES}){NOTICE_END})\s*[:.-]?\s*"


@F.pandas_udf(T.StringType())
def fold_ascii(s: pd.Series) -> pd.Series:
    """Without accents and other signs beyond ASCII (compatibility decomposition)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def compatible(s: pd.Series) -> pd.Series:
    """NFKC and case folding."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def without_labels(title: Column) -> Column:
    """A lower-case title without brackets around the whole and labels in front, however many there are."""
    # a turn that changes anything takes an opening bracket or a label away
    turns = F.regexp_count(title, F.lit(rf"\[|{LABELS}|{NOTICES}")) + 1
    turn = lambda text, _: F.regexp_replace(F.regexp_replace(text, r"^\s*\[([^\n]+)\]\s*$", "$1"), _LABEL, "")
    return F.reduce(F.sequence(F.lit(1), turns), title, turn)


def folded_spelling(word: Column) -> Column:
    out = word
    for pattern, to in reversed(SPELLINGS):
        out = F.when(F.regexp_like(word, F.lit(pattern)), F.regexp_replace(word, pattern, to)).otherwise(out)
    return out


def normalise_title(title: Column) -> Column:
    """What titles are compared by: no labels, accents, case and punctuation, and one spelling."""
    bare = without_labels(F.lower(fold_ascii(title)))
    plain = F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]", " "), " +", " "))
    return F.array_join(F.transform(F.split(plain, " "), folded_spelling), " ")


def normalise_doi(doi: Column) -> Column:
    """Decoded once, lower case, without resolver prefix and trailing punctuation; empty if it is no DOI."""
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(doi, r"\+", "%2B")), doi)
    bare = F.regexp_replace(F.trim(F.lower(decoded)), r"^(https?://)?(dx\.)?doi\.org/", "")
    bare = F.trim(F.regexp_replace(bare, r"^(info:)?doi:\s*", ""))
    bare = F.regexp_replace(bare, r"[.,;:)\]}’'\"]+$", "")
    return F.when(F.regexp_like(bare, F.lit(r"^10\.\d{4,9}/\S+$")), bare).otherwise("")


def surname(author: Column) -> Column:
    """Before the comma, else the last word; letters only."""
    name = F.when(F.contains(author, F.lit(",")), F.element_at(F.split(author, ","), 1)).otherwise(F.element_at(F.split(F.trim(author), r"\s+"), -1))
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def numbers_in(text: Column) -> Column:
    """All numbers; 90, 95 and 99 before a per cent sign name a level and are left out."""
    kept = F.regexp_replace(text, r"\b(90|95|99)(?:\.0+)?\s*%", " ")
    return F.transform(F.regexp_extract_all(kept, F.lit(r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w])"), F.lit(0)), lambda x: x.cast("double"))


def precision_tolerance(printed: Column) -> Column:
    """Half a unit in the last printed decimal."""
    return 0.5 * F.pow(F.lit(10.0), -F.length(F.regexp_extract(printed, r"\.(\d+)", 1)))


def coverage(text: Column, terms: list[str]) -> Column:
    """Terms that stand in the text as whole words, regardless of case; a hyphen is a space."""
    folded = F.regexp_replace(F.lower(text), "-", " ")
    hits = [F.regexp_like(folded, F.lit(rf"(?<!\w){re.escape(t.lower().replace('-', ' '))}(?!\w)")).cast("int") for t in terms]
    return sum(hits[1:], hits[0]) if hits else F.lit(0)


def elide(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def model_family(model: Column) -> Column:
    return F.regexp_replace(model, r"(-\d+)+$", "")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def authors_line(authors: Column, most: int = 3) -> Column:
    line = F.array_join(F.slice(authors, 1, most), ", ")
    return F.when(F.size(authors) > most, F.concat(line, F.lit(" et al."))).otherwise(line)


def dispersion_type(caption: Column) -> Column:
    """The one spread that a caption names for its error bars; none if several, or a multiple, are named."""
    low = F.lower(caption)
    kinds = F.array_compact(
        F.array(
            F.when(F.regexp_like(low, F.lit(r"\b(sem?|standard errors?)\b")), "SE"),
            F.when(F.regexp_like(low, F.lit(r"\b(sds?|standard deviations?)\b")), "SD"),
            F.when(F.regexp_like(low, F.lit(r"\b95 ?% (ci|confidence)")), "CI95"),
        )
    )
    anchored = F.regexp_like(low, F.lit(r"error bars?|±"))
    multiple = F.regexp_like(low, F.lit(r"\b[2-9] ?(sds?|sem?|standard)"))
    return F.when(anchored & ~multiple & (F.size(kinds) == 1), F.get(kinds, F.lit(0)))


def abstract_from_index(index: Column) -> Column:
    """Text of an inverted index {word: [positions]}; a null index gives an empty text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def pdf_links(html: Column) -> Column:
    """Distinct link targets that end in .pdf, in page order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""href=["']([^"']+\.pdf(?:\?[^"']*)?)["']"""), F.lit(1)))


def render_term(term: Column) -> Column:
    return F.when(F.regexp_like(term, F.lit("[ -]")), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)


def render_query(blocks: Column) -> Column:
    """(a OR "b c") AND (d): blocks is an array of arrays of terms."""
    return F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("("), F.array_join(F.transform(b, render_term), " OR "), F.lit(")"))), " AND ")


def singular(word: Column) -> Column:
    """A plural without its ending; what only looks like one (-ss, -us, -is, three letters) stays."""
    stays = (F.length(word) <= 3) | F.regexp_like(word, F.lit("(ss|us|is)$"))
    return (
        F.when(stays, word)
        .when(F.endswith(word, F.lit("ies")) & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(F.regexp_like(word, F.lit("(ss|x|ch|sh)es$")), F.regexp_replace(word, "es$", ""))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def parse_number(text: Column) -> Column:
    """A printed number: Unicode minus, white space, thousands commas, a decimal comma, per cent and degree
    signs are put up with; else null."""
    plain = F.regexp_replace(F.translate(text, "−–%°", "--"), r"[\s\u00a0\u2009\u202f]+", "")
    thousands, decimal = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$", r"^[+-]?\d+,\d+$"
    plain = F.when(F.regexp_like(plain, F.lit(thousands)), F.regexp_replace(plain, ",", "")).when(F.regexp_like(plain, F.lit(decimal)), F.regexp_replace(plain, ",", ".")).otherwise(plain)
    return F.when(F.regexp_like(plain, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), plain.cast("double"))


# fixed values: names of a unit by its key
UNITS = {"deg": ("deg", "degree", "degrees", "°"), "cm": ("cm", "centimeter", "centimeters"), "mm": ("mm",), "ms": ("ms", "msec"), "s": ("s", "sec", "seconds"), "%": ("%", "percent", "pct")}


def unit_key(unit: Column) -> Column:
    """Key of the first known name before a semicolon; empty if none is known."""
    tokens = F.filter(F.split(F.lower(F.substring_index(F.coalesce(unit, F.lit("")), ";", 1)), r"[\s()\[\]/]+"), lambda t: t != "")
    table = F.create_map(*[F.lit(x) for key, names in UNITS.items() for name in names for x in (name, key)])
    return F.coalesce(F.get(F.filter(F.transform(tokens, lambda t: F.element_at(table, t)), lambda k: k.isNotNull()), F.lit(0)), F.lit(""))


def same_unit(a: Column, b: Column) -> Column:
    return (a == "") | (b == "") | (a == b)
