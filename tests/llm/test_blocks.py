"""Which nodes the Jaccard join ties together, and what it leaves on disk."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest

from poolwright.llm import jaccard_join
from poolwright.operators.graph import connected_components
from poolwright.session import shared_dir


def _tied(spark, listing, listed):
    """listing: node -> (keys, need). The components, as a dict of nodes."""
    many = Counter(k for keys, _ in listing.values() for k in set(keys))
    rows = [(k, node, need, many[k]) for node, (keys, need) in listing.items() for k in set(keys)]
    df = spark.createDataFrame(rows, "key long, node long, tag int, many long").repartition(4)
    return {r["node"]: r["component"] for r in connected_components(jaccard_join.tied_nodes(df, listed)).collect()}


def test_chance_meetings_with_others_tie_nothing(spark):
    """Every node shares its three keys, each with another node: no pair shares two."""
    listing = {n: ([(n + d) % 40 if d < 2 else 100 + n // 2 for d in range(3)], 2) for n in range(0, 40)}
    pairs = [set(listing[a][0]) & set(listing[b][0]) for a, b in combinations(listing, 2)]
    apart = {n: ([k for k in keys if k < 100], need) for n, (keys, need) in listing.items()}
    assert max(map(len, pairs)) == 2
    assert _tied(spark, apart, 4) == {}
    assert len(set(_tied(spark, listing, 4).values())) == 20


@pytest.mark.parametrize("listed", [1, 2, 5, 100])
def test_every_pair_with_enough_keys_is_tied(spark, listed):
    rng = random.Random(listed)
    listing = {n: ([rng.choice([rng.randrange(12), rng.randrange(400)]) for _ in range(rng.randrange(4, 30))], rng.randrange(1, 8)) for n in range(150)}
    found = _tied(spark, listing, listed)
    enough = 0
    for a, b in combinations(listing, 2):
        if len(set(listing[a][0]) & set(listing[b][0])) >= max(listing[a][1], listing[b][1]):
            enough += 1
            assert found[a] == found[b]
    assert enough > 50


def test_used_tables_go(spark):
    at = Path(shared_dir(spark).removeprefix("file://"))
    before = set(at.iterdir())
    texts = [" ".join(f"w{(i // 2 * 50 + j) % 997}" for j in range(40)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs).where("component_id < doc_id").count() == 30
    left = Counter(p.name.split("-")[0] for p in set(at.iterdir()) - before)
    assert not {"keys", "postings", "members", "blocks", "placed"} & set(left), left
