"""N-gram Jaccard join by T-occurrence search.

A document is its set of word shingles; two link when the sets' Jaccard similarity reaches a
threshold. Documents with equal sets are one node.

Blocks say which nodes an inverted index holds together. Nodes of similar size split the universe of
shingles into m parts by hash, with some parts more than the most shingles in which two linked sets
of that size can differ. Linked sets then agree on several whole parts, so every node is listed under
the hashes of its parts and linked nodes share a known number of keys at least. A node that shares
fewer of its keys with others has no link and leaves, and with it what it shared, in two rounds.
Of the keys left, those of few nodes list their pairs, and a pair counts if it shares that number
of keys, where each key of many nodes is taken for shared. Keys of many nodes list no pairs: nodes that
have that number of such keys alone are tied to the key's smallest one. Linked nodes are thus tied, and
chance meetings, which are with another node in each key, are not, however many nodes there are. Nodes
that are tied are one block.

Search. Links are found by T-occurrence search alone: a block has an inverted list of nodes for each
shingle, and a node links with those that stand in T of its lists, T being the overlap that the
threshold asks for. DivideSkip takes the longest L lists aside; the short ones are merged over a heap
(long merges count in arrays instead, with equal results), and nodes that reach T - L there are
looked up in the long lists by binary search. A node that is linked leaves the lists, so a group of
copies is searched about once and not once for each pair. Nothing is capped: a block over
chunk_shingles is cut into chunks, of which every two meet in one index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolwright.operators.graph import connected_components

from .common import batch_rows, discard, encoded, gram_hashes, mix, release, shuffle_partitions, text_rows, trimmed, word_hashes, written

#: stands for a null doc_id; rows that share it are told apart by their sets
NO_ID = 2**63 - 1
#: finer splits that a node with too many small parts tries before it lists single shingles
SPLITS = 6
NEED = 1 << 20
#: rounds in which nodes with too few shared keys leave
PRUNINGS = 2
#: shares of the keys that are shuffled one after the other, each from its own reading of the texts
SLICES = 2
#: bits of a key; equal ones only bring nodes together
KEY_BITS = 40
#: nodes of a key up to which its pairs are listed
LISTED = 16
#: cost of a look-up against that of merging an entry (the mu of DivideSkip)
MU = 1.0
#: entries of the short lists up to which they go over a heap
HEAP_ENTRIES = 4096
#: rows up to which the nodes to search are broadcast: some 10 MB
BROADCAST_ROWS = 100_000
_PART = np.uint64(0xA24BAED4963EE407)
_SIZE = np.uint64(0x9FB21C651E98DF25)
_PREFIX = np.uint64(0xD6E8FEB86659FD93)
c = F.col


def needed_overlap(sizes: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least intersection of two sets whose sizes add up to `sizes`: percent * union <= 100 * it."""
    return -(-percent * sizes // (100 + percent))


@lru_cache(maxsize=64)
def size_bands(percent: int, most: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of each band of sizes: its first size, the most shingles in which two linked sets of it (or of it
    and the next band) differ, the least size of a part that is listed, the parts to spare.

    A linked partner of a set in a band is in the band or the next one.
    """
    starts, differ, least, spare = [1], [], [], []
    while starts[-1] <= most:
        low = starts[-1]
        high = max(low, low * 5 // 4 - 1)
        starts.append(high + 1)
        partner = high * 100 // percent
        sums = np.arange(max(2 * low, high + partner - 200), high + partner + 1)
        differ.append(int((sums - 2 * needed_overlap(sums, percent)).max(initial=0)))
        # parts have about low / m shingles, with the spread of a Poisson distribution
        m = differ[-1] + 1
        least.append(max(1, low // m // 3))
        small = 0.0
        for _ in range(4):
            mean = low / (m + small)
            term, below = np.exp(-mean), 0.0
            for k in range(least[-1]):
                below += term
                term *= mean / (k + 1)
            expected = below * (m + small)
            small = float(np.ceil(expected + 3 * np.sqrt(expected))) if m > 1 else 0.0
        spare.append(int(small))
    # the next band must hold all partners
    for k in range(len(differ) - 1):
        assert (starts[k + 1] - 1) * 100 // percent <= starts[k + 2] - 1
    return starts, differ, least, spare


def shingle_set(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted hashes of the distinct n-shingles of the lower-cased (A-Z) words; all words if fewer."""
    h = word_hashes(encoded(text).lower().split())
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(h, min(n, len(h))) + np.uint64(min(n, len(h))))


def block_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a set is listed, and a tag of each: its split, and how many keys of this split the
    set shares with any set that it links with (split * NEED + that number).

    With `spare` parts more than shingles can differ, linked sets agree on spare + 1 parts. If one of
    them has no more than `spare` small parts, which are not listed, they agree on one that both list;
    else both go on to the next split.
    """
    n = len(s)
    starts, differ, least, spare = size_bands(percent, 1 << max(10, int(n * 1.3).bit_length()))
    band = int(np.searchsorted(starts, n, side="right")) - 1
    bands = [band]
    if band and n * percent <= 100 * (starts[band] - 1):
        bands.append(band - 1)
    keys, tags = [], []
    for k, b in enumerate(bands):
        extra = spare[b]
        for split in range(SPLITS + 1):
            label = mix(np.uint64([b * (SPLITS + 1) + split])) * _SIZE
            need = 1
            if split == SPLITS:
                prefix = n - -(-percent * n // 100) + 1
                own = mix(np.sort(mix(s ^ _PREFIX))[:prefix] ^ label)
            else:
                m = differ[b] + 1 + extra
                mixed = mix(s ^ (_PART + label))
                part = (mixed % np.uint64(m)).astype(np.int64)
                total = np.zeros(m, np.uint64)
                np.add.at(total, part, mixed)
                listed = np.bincount(part, minlength=m) >= least[b]
                own = mix(total + np.arange(m, dtype=np.uint64) * _PART + label)[listed]
                small = m - int(listed.sum())
                need = max(1, extra + 1 - small)
            keys.append(own)
            tags.append(np.full(len(own), (k * (SPLITS + 1) + split) * NEED + min(need, NEED - 1), np.int32))
            if split == SPLITS or small <= extra:
                break
            extra += 2 + extra // 4
    return np.concatenate(keys), np.concatenate(tags)


def node_of(s: np.ndarray) -> int:
    """The node of a set: a 64-bit hash, equal for equal sets."""
    with np.errstate(over="ignore"):
        x = np.uint64(len(s)) * _SIZE + mix(s).sum(dtype=np.uint64)
    return int(mix(np.uint64([x])).view(np.int64)[0])


class InvertedLists:
    """For each shingle the sets that hold it, ascending; sets that were taken leave the lists."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every, token = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
        ends = np.cumsum(self.sizes)
        self.tokens = [token[b - n : b] for b, n in zip(ends.tolist(), self.sizes.tolist(), strict=True)]
        self.left = np.ones(len(sets), bool)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(token, kind="stable")
        self.owners, self.of = owner[order], token[order].astype(np.int32)
        self.many = len(every)
        self._index()

    def _index(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.of, minlength=self.many))])
        self.held = int(self.left.sum())

    def take(self, which: np.ndarray) -> None:
        self.left[which] = False
        if int(self.left.sum()) * 2 < self.held:
            stays = self.left[self.owners]
            self.owners, self.of = self.owners[stays], self.of[stays]
            self._index()

    def search(self, x: int, mu: float = MU, heap_entries: int = HEAP_ENTRIES) -> np.ndarray:
        """The sets still in the lists that link with set x (T-occurrence search by DivideSkip)."""
        n = int(self.sizes[x])
        fewest = -(-self.percent * n // 100)  # T for the smallest possible partner
        tokens = self.tokens[x]
        low = self.starts[tokens]
        length = self.starts[tokens + 1] - low
        used = np.flatnonzero(length)
        none = np.empty(0, np.int64)
        if len(used) < fewest:
            return none
        used = used[np.argsort(length[used], kind="stable")]
        low, length = low[used], length[used]
        long = min(fewest - 1, int(fewest / (mu * np.log2(max(2, length[-1])) + 1)))
        short = len(used) - long
        lists = [self.owners[a : a + k] for a, k in zip(low.tolist(), length.tolist(), strict=True)]
        if length[:short].sum() <= heap_entries:
            merged = heapq.merge(*[x.tolist() for x in lists[:short]])
            found = [(i, sum(1 for _ in run)) for i, run in groupby(merged)]
            found = [(i, k) for i, k in found if k >= fewest - long]
            if not found:
                return none
            cand, shared = (np.array(c, np.int64) for c in zip(*found, strict=True))
        else:
            count = np.bincount(np.concatenate(lists[:short]), minlength=len(self.sizes))
            cand = np.flatnonzero(count >= fewest - long)
            shared = count[cand]
        size = self.sizes[cand]
        fits = self.left[cand] & (cand != x) & (size * 100 >= self.percent * n) & (n * 100 >= self.percent * size)
        cand, shared = cand[fits], shared[fits]
        needed = needed_overlap(n + self.sizes[cand], self.percent)
        for k in range(short, len(lists)):
            # what cannot reach its overlap any more is not looked up
            hopes = shared + (len(lists) - k) >= needed
            cand, shared, needed = cand[hopes], shared[hopes], needed[hopes]
            if not len(cand):
                return none
            here = lists[k]
            spot = np.searchsorted(here, cand)
            shared = shared + (here[np.minimum(spot, len(here) - 1)] == cand)
        return cand[shared >= needed]


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links among the sets connect."""
    lists, links = InvertedLists(sets, percent), []
    for first in range(len(sets)):
        if not lists.left[first]:
            continue
        lists.take(np.array([first]))
        open_ = [first]
        while open_ and lists.left.any():
            x = open_.pop()
            found = lists.search(x)
            lists.take(found)
            links += [(x, y) for y in found.tolist()]
            open_ += found.tolist()
    return links


def _nodes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                ],
                ["doc_id", "n_shingles", "node"],
            )

    return run


def _postings(n: int, percent: int, part: int, parts: int):
    """Keys of one of the parts of all keys, with their nodes and tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a set within a task
        for batch in batches:
            keys, nodes, tags = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            if len(seen) > 200_000:
                seen.clear()
            for text in batch["text"].to_pylist():
                s = shingle_set(text, n)
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    own, tag = block_keys(s, percent)
                    here = (own >> np.uint64(KEY_BITS)) % np.uint64(parts) == part
                    keys.append(own[here] & np.uint64((1 << KEY_BITS) - 1))
                    nodes.append(np.full(len(keys[-1]), node, np.int64))
                    tags.append(tag[here])
            columns = [np.concatenate(keys).view(np.int64), np.concatenate(nodes), np.concatenate(tags)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "tag"])

    return run


_CELL = ("block", "i", "j")


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets = [], []
            for k, (node, text) in enumerate(zip(batch["node"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                s = shingle_set(text, n)
                if len(s) and node_of(s) == node:  # another row of the same doc_id has another set
                    rows.append(k)
                    sets.append(s.view(np.int64))
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *sets]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), flat)
            kept = batch.select([*_CELL, "node"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, lists], [*_CELL, "node", "shingles"])

    return run


def _search(percent: int):
    """Links in each cell; rows come sorted by cell, one cell is held at a time."""

    def links(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = [(nodes[i], nodes[j]) for i, j in spanning_links(sets, percent) if nodes[i] != nodes[j]] if len(nodes) > 1 else []
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, sets = None, [], []
        for batch in batches:
            flat = batch["shingles"].values.to_numpy().view(np.uint64)
            at = batch["shingles"].offsets.to_pylist()
            columns = [batch[c].to_pylist() for c in (*_CELL, "node")]
            for k, (*own, node) in enumerate(zip(*columns, strict=True)):
                if own != cell:
                    if len(nodes) > 1:
                        yield links(nodes, sets)
                    cell, nodes, sets = own, [], []
                nodes.append(node)
                sets.append(flat[at[k] : at[k + 1]].copy())
        if nodes:
            yield links(nodes, sets)

    return run


def _shared(rows: DataFrame, *more: Column) -> DataFrame:
    """The rows of keys that two nodes have."""
    key = Window.partitionBy("key")
    ends = rows.select("*", F.min("node").over(key).alias("low"), F.max("node").over(key).alias("high"), *more)
    return ends.where("low < high").drop("low", "high")


def tied_nodes(rows: DataFrame, listed: int = LISTED) -> DataFrame:
    """(a, b) that connect all nodes that share as many keys as their tags ask for.

    rows: key, node, tag, many (nodes of the key). With `lots` keys of over `listed` nodes a node can share no more than
    those beyond the keys whose pairs are listed.
    """
    own = Window.partitionBy("node", "tag")  # no more rows than a text has keys
    rows = rows.select("key", "node", "tag", "many", F.count_if(c("many") > listed).over(own).alias("lots"))
    stars = rows.where((c("many") > listed) & (c("lots") >= c("tag") % NEED))
    centers = stars.groupBy("key").agg(F.min("node").alias("a"))
    stars = stars.join(centers, "key").select("a", c("node").alias("b")).where("a < b").distinct()
    few = rows.where(c("many") <= listed).select("key", "node", (c("tag").cast("long") * 2**32 + c("lots")).alias("asks"))
    other = few.select("key", c("node").alias("b"), c("asks").alias("asks_b"))
    met = few.join(other, "key").where("node < b").groupBy(c("node").alias("a"), "b", "asks", "asks_b").agg(F.count("*").alias("both"))
    need = lambda asks: F.shiftright(asks, 32) % NEED
    most = c("both") + F.least(c("asks") % 2**32, c("asks_b") % 2**32)
    pairs = met.where(most >= F.greatest(need("asks"), need("asks_b"))).select("a", "b")
    return stars.unionByName(pairs)


def similar_nodes(docs: DataFrame, nodes: DataFrame, percent: int, n: int, chunk_shingles: int) -> DataFrame:
    """Verified links (a, b) between nodes; they connect all linked nodes."""
    spark = docs.sparkSession
    # keys that several nodes have, then those of the nodes that share enough of theirs
    slices = []
    for k in range(SLICES):
        postings = text_rows(docs).mapInArrow(trimmed(_postings(n, percent, k, SLICES)), "key long, node long, tag int")
        slices.append(written(_shared(postings).distinct(), "postings"))
        release(spark)
    rows = reduce(DataFrame.unionByName, slices)
    own = Window.partitionBy("node", "tag")
    for _ in range(PRUNINGS):
        kept = written(rows.withColumn("have", F.count("*").over(own)).where(c("have") >= c("tag") % NEED).select("key", "node", "tag"), "postings")
        discard(*slices)
        release(spark)
        rows = written(_shared(kept, F.count("*").over(Window.partitionBy("key")).alias("many")), "postings")
        discard(kept)
        slices = [rows]
        release(spark)
    members = written(tied_nodes(rows), "members")
    discard(rows)
    release(spark)
    blocks = written(connected_components(members), "blocks")
    discard(members)
    release(spark)

    # one document of each node; a block is one cell, or one for every two of its chunks
    reps = nodes.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("d"), F.min("n_shingles").alias("size"))
    placed = written(blocks.withColumnRenamed("component", "block").join(reps, "node"), "placed")
    discard(blocks)
    cuts = placed.groupBy("block").agg(F.ceil(F.sum("size") / F.lit(chunk_shingles)).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("node"), "cuts").cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: (x != F.col("own")) | (F.col("cuts") == 1))
    cells = (
        placed.join(cuts, "block")
        .withColumn("own", own)
        .select("block", "node", "d", "own", F.explode(others).alias("other"))
        .select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "d")
    )
    cells = written(cells, "cells")
    discard(placed)
    texts = text_rows(docs).withColumn("d", F.coalesce("doc_id", F.lit(NO_ID)))
    few = cells.count() <= BROADCAST_ROWS
    found = texts.join(F.broadcast(cells) if few else cells, "d").select(*_CELL, "node", "text")
    sets = found.mapInArrow(trimmed(_sets(n)), "block long, i int, j int, node long, shingles array<long>")
    dealt = sets.repartition(shuffle_partitions(spark), *_CELL).sortWithinPartitions(*_CELL, "node")
    return dealt.mapInArrow(trimmed(_search(percent)), "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = 90, n: int = 3, chunk_shingles: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) of every document.

    A null text, or one without a word, has the empty set and links with nothing. A row without a
    doc_id takes its component from the rows it links with (null if none has an id). Repeated rows
    each get a row.
    """
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    nodes = written(text_rows(docs).mapInArrow(trimmed(_nodes(n)), "doc_id long, n_shingles long, node long"), "nodes")
    listed = nodes.where("node is not null")
    components = connected_components(similar_nodes(docs, listed, percent, n, chunk_shingles))
    grouped = listed.join(components, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
    grouped = written(grouped, "grouped")
    first = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    empty = nodes.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.join(first, "component").select("doc_id", "n_shingles", "component_id").unionByName(empty)


#: The same in DuckDB, by brute force over all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT w.doc_id, count(shingle) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b)
SELECT n.doc_id, any_value(n.n)::BIGINT AS n_shingles, min(c)::BIGINT AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1
"""
