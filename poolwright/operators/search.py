"""Search planning: how wide terms are, what to drop, and rounds over a citation graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.session import written

c = F.col


def _pattern(term: str) -> str:
    return rf"(?<!\w){re.escape(term.lower())}(?!\w)"


def term_widths(docs: DataFrame, text: str, terms: list[str]) -> dict[str, int]:
    """Documents that hold each term: one pass for all terms."""
    low = docs.select(F.lower(text).alias("low"))
    counts = [F.count_if(F.regexp_like("low", F.lit(_pattern(t)))).alias(f"t{i}") for i, t in enumerate(terms)]
    row = low.agg(*counts).first() if terms else ()
    return {t: int(row[i]) for i, t in enumerate(terms)}


def query_hits(docs: DataFrame, text: str, blocks: list[list[str]]) -> DataFrame:
    """Documents that hold a term of every block."""
    low = F.lower(text)
    hit = F.lit(True)
    for block in blocks:
        hit = hit & F.regexp_like(low, F.lit("|".join(_pattern(t) for t in block))) if block else F.lit(False)
    return docs.where(hit)


def prune(docs: DataFrame, text: str, blocks: list[list[str]], variants: set[str], protected: set[str], most: int, margin: float = 2.0) -> tuple[list[list[str]], list[tuple[str, int]]]:
    """Drop terms until a query has `most` hits at most: (blocks, dropped terms with their widths).

    Each round drops from the widest block that can lose a term: its widest variant, unless a term of
    the plan is over `margin` times as wide. A block keeps its last term; protected terms stay.
    """
    blocks = [list(b) for b in blocks]
    width = term_widths(docs, text, sorted({t for b in blocks for t in b}))
    dropped: list[tuple[str, int]] = []
    while query_hits(docs, text, blocks).count() > most:
        open_blocks = [b for b in blocks if len(b) > 1 and any(t not in protected for t in b)]
        if not open_blocks:
            break
        block = max(open_blocks, key=lambda b: sum(width[t] for t in b))
        free = [t for t in block if t not in protected]
        planned = max((t for t in free if t not in variants), key=lambda t: width[t], default=None)
        variant = max((t for t in free if t in variants), key=lambda t: width[t], default=None)
        victim = variant if variant is not None and (planned is None or margin * width[variant] >= width[planned]) else planned
        block.remove(victim)
        dropped.append((victim, width[victim]))
    return blocks, dropped


def snowball(edges: DataFrame, seeds: DataFrame, rounds: int, per_round: int | None = None) -> DataFrame:
    """(id, round): what links reach in each round that no round had before; at most per_round by id."""
    known = written(seeds.select("id", F.lit(0).alias("round")).distinct(), "snowball")
    for k in range(1, rounds + 1):
        last = known.where(c("round") == k - 1)
        fresh = edges.join(last.select(c("id").alias("a")), "a").select(c("b").alias("id")).distinct().join(known.select("id"), "id", "left_anti")
        if per_round is not None:
            fresh = fresh.orderBy("id").limit(per_round)
        fresh = written(fresh.select("id", F.lit(k).alias("round")), "snowball")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    return known


def selection_ladder(records: DataFrame) -> DataFrame:
    """Counters of a selection from its rows: found_by (array), rows, state, duplicate, excluded, fetched."""
    return records.agg(
        F.sum(F.greatest(F.greatest(F.size("found_by"), F.lit(1)), "rows")).cast("long").alias("identified"),
        F.count("*").alias("unique"),
        F.count_if("duplicate").alias("possible_duplicates"),
        F.count_if("excluded").alias("excluded_by_rule"),
        F.count_if(c("state") == "include").alias("included"),
        F.count_if(c("state") == "unsure").alias("unsure"),
        F.count_if(c("state") == "exclude").alias("screened_out"),
        F.count_if(c("state").isNull()).alias("unread"),
        F.count_if("fetched").alias("fetched"),
    )
