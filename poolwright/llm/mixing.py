"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come from weights and a limit on repeats. Blocks of equal size are allocated to the
sources by highest quotients (target / (2 * blocks + 1)), and a source's blocks to its shards in
the same way by the shards' sizes. A shard lists its documents in a seeded order; its blocks are
cut along that list, repeated as often as needed, and its quota is the first so many blocks. A
shard holds a bounded number of documents, so a large source has many and no task holds it whole.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, written


def fill_targets(sizes: list[int], weights: list[float], total: float, repeats: float) -> list[float]:
    """Shares of total by weight, none over repeats * size; what is over goes to the others by weight."""
    target = [0.0] * len(sizes)
    left, active = total, list(range(len(sizes)))
    while active:
        unit = left / sum(weights[i] for i in active)
        full = [i for i in active if unit * weights[i] > repeats * sizes[i]]
        if not full:
            for i in active:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = float(repeats * sizes[i])
            left -= target[i]
        active = [i for i in active if i not in set(full)]
    return target


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients votes / (2 s + 1); ties to the lower index; at most `most` each.

    A divisor that allocates too few seats at once is found first; the heap deals out the rest.
    """
    votes = np.asarray(votes, float)
    most = np.full(len(votes), np.inf) if most is None else np.asarray(most, float)
    seats = int(min(seats, most[votes > 0].sum())) if len(votes) else 0
    if seats <= 0 or not votes.sum() > 0:
        return np.zeros(len(votes), np.int64)
    low, high = 0.0, 1.0 / votes[votes > 0].min()  # seats for votes * x, rounded, grow with x
    count = lambda x: np.minimum(np.floor(votes * x + 0.5), most)
    while count(high).sum() <= seats and not (count(high) >= most)[votes > 0].all():
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if count(mid).sum() <= seats else (low, mid)
    got = count(low * (1 - 1e-9)).astype(np.int64)  # below any tie, which the heap settles
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    repeats: int = 2,
    block: int = 16,
    shard_docs: int = 1_000,
    most_shards: int = 100_000,
    seed: int = 7,
) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of every document.

    Sources in code-point order, null last, have the weights in turn. A null text or one without a
    word has size 0 and is never taken. Repeated rows are documents of their own. Equal inputs give
    equal results, however they are partitioned. The driver sees one number for each source and
    shard.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = written(sized, "sizes").withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    per_source = sorted(
        ((r["source"], r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()),
        key=lambda r: (r[0] is None, r[0] or ""),
    )
    sizes = [r[1] for r in per_source]
    # shards are small, but their number, which the driver sees, is bounded
    shard_docs = max(shard_docs, -(-sum(r[2] for r in per_source) // most_shards))
    target = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), repeats) if sizes else []
    seats = sainte_lague(np.array(target), round(sum(target) / block)) if sizes else []
    keys = ["n" if s is None else "s" + s for s, _, _ in per_source]
    plan = spark.createDataFrame(
        [(k, int(-(-n // shard_docs)), int(size), float(t)) for k, (_, size, n), t in zip(keys, per_source, target, strict=True)],
        "key string, shards int, source_size long, target double",
    )
    order = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed))
    dealt = sized.join(F.broadcast(plan), "key").withColumn("order", order).withColumn("shard", F.pmod(F.shiftright("order", 20), "shards"))
    shards: dict[str, list[tuple[int, int]]] = {}
    for r in dealt.groupBy("key", "shard").agg(F.sum("size").alias("size")).collect():
        shards.setdefault(r["key"], []).append((r["shard"], r["size"]))
    quotas = []
    for key, n in zip(keys, seats, strict=True):
        mine = sorted(shards.get(key, []))
        held = np.array([s for _, s in mine], float)
        got = sainte_lague(held, int(n), np.ceil(repeats * held / block)) if len(mine) else []
        quotas += [(key, shard, int(min(q * block, repeats * s))) for (shard, s), q in zip(mine, got, strict=True)]
    quota = spark.createDataFrame(quotas, "key string, shard long, quota long")
    own = Window.partitionBy("key", "shard")
    line = own.orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(quota, ["key", "shard"]).withColumn("end", F.sum("size").over(line)).withColumn("all", F.sum("size").over(own))
    once = F.when(F.col("all") > 0, F.floor(F.col("quota") / F.col("all"))).otherwise(0)
    rest = F.when(F.col("all") > 0, F.pmod("quota", "all")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    return placed.select(
        "doc_id", "size", "source_size", "target", (once * F.col("size") + part).cast("long").alias("taken"), "source"
    )
