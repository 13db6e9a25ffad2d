"""Public candidates from noisy item counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.itemsets import Item, Itemset, canonical

CANDIDATE_TYPE = "itemset array<struct<attr:int,value:bigint>>, score double, guess double"


@dataclass(frozen=True)
class Candidate:
    itemset: Itemset
    score: float
    guess: float


def frequent_items(noisy: DataFrame, limit: int) -> DataFrame:
    """attr, value, noisy of the highest counts (negative ones are 0), ties by the item."""
    cleaned = noisy.select("attr", "value", F.greatest(F.col("noisy"), F.lit(0.0)).alias("noisy"))
    return cleaned.orderBy(F.desc("noisy"), "attr", "value").limit(limit)


def _product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, x: a * x)


def item_products(pool: DataFrame, n: float, min_size: int, max_size: int) -> DataFrame:
    """itemset, score, guess for every legal itemset of the pool.

    score is the product of 0.9 c / max c, guess n times the product of c / n, with counts clipped to
    [0, n]. A pool without a positive count has none. The pool is a handful of items, so its joins
    with itself, by attribute order, stay on the scale of the candidates.
    """
    clipped = F.least(F.greatest(F.col("noisy"), F.lit(0.0)), F.lit(float(n)))
    items = pool.select(F.struct(F.col("attr").cast("int").alias("attr"), F.col("value").cast("bigint").alias("value")).alias("item"), clipped.alias("c"))
    top = items.agg(F.max("c").alias("top")).where("top > 0")
    items = F.broadcast(items.crossJoin(F.broadcast(top)).select("item", "c", (F.lit(0.9) * F.col("c") / F.col("top")).alias("share"), (F.col("c") / F.lit(float(n))).alias("part")))
    level = items.select(F.array("item").alias("itemset"), F.array("share").alias("shares"), F.array("part").alias("parts"), F.col("item.attr").alias("last"))
    out = None
    for size in range(1, max_size + 1):
        if size > 1:
            level = level.join(items, F.col("item.attr") > F.col("last")).select(
                F.concat("itemset", F.array("item")).alias("itemset"), F.concat("shares", F.array("share")).alias("shares"),
                F.concat("parts", F.array("part")).alias("parts"), F.col("item.attr").alias("last"),
            )
        if size >= min_size:
            out = level if out is None else out.union(level)
    return out.select("itemset", _product(F.col("shares")).alias("score"), (F.lit(float(n)) * _product(F.col("parts"))).alias("guess"))


def ranked_candidates(pool: DataFrame, n: float, count: int | None, min_size: int, max_size: int) -> DataFrame:
    """The count best by score, ties by the itemset."""
    out = item_products(pool, n, min_size, max_size).orderBy(F.desc("score"), "itemset")
    return out if count is None else out.limit(count)


def joint_first_candidates(pool: DataFrame, n: float, count: int | None, min_size: int, max_size: int) -> DataFrame:
    """Itemsets of several items come first, but one place is kept for a single item; without a count single items come last."""
    every = item_products(pool, n, min_size, max_size).withColumn("single", F.size("itemset") == 1)
    if count is None:
        return every.orderBy("single", F.desc("score"), "itemset").drop("single")
    place = F.row_number().over(Window.partitionBy("single").orderBy(F.desc("score"), "itemset"))
    placed = every.withColumn("place", place)
    sizes = placed.groupBy().agg(F.count_if("single").alias("singles"), F.count_if(~F.col("single")).alias("joints"))
    quota = F.least("joints", F.greatest(F.lit(count - 1), F.lit(0)))
    singles = F.least("singles", F.lit(count) - quota)
    joints = F.least("joints", F.lit(count) - singles)
    kept = placed.crossJoin(F.broadcast(sizes)).where(F.when(F.col("single"), F.col("place") <= singles).otherwise(F.col("place") <= joints))
    return kept.select("itemset", "score", "guess", "single", "place", quota.alias("quota")).orderBy(
        F.when(F.col("single"), 1).when(F.col("place") <= F.col("quota"), 0).otherwise(2), F.desc("score"), "itemset"
    ).select("itemset", "score", "guess")


def collect_candidates(table: DataFrame, order: str = "score") -> list[Candidate]:
    """The list on the driver, best first; its length is the protocol's own bound."""
    rows = [Candidate(tuple((x["attr"], x["value"]) for x in r["itemset"]), r["score"], r["guess"]) for r in table.collect()]
    return sorted(rows, key=lambda c: (-getattr(c, order), c.itemset))


def enough(found: Sequence[Candidate], multiplier: float, k: int) -> None:
    import math

    if len(found) < math.ceil(multiplier * k):
        raise ValueError(f"{len(found)} candidates, {math.ceil(multiplier * k)} asked for")


def search(items: Sequence[tuple[Item, float]], n: float, count: int, min_size: int, max_size: int) -> tuple[list[Candidate], dict]:
    """As ranked_candidates, by levels on the driver: an itemset whose score is under the count-th best so far isn't extended, as factors are 0.9 at most."""
    clipped = {i: min(max(c, 0.0), n) for i, c in items}
    top = max(clipped.values(), default=0.0)
    if top <= 0:
        return [], {"visited": 0, "pruned": 0}
    share = {i: 0.9 * c / top for i, c in clipped.items()}
    best: list[Candidate] = []
    level: list[tuple[Item, ...]] = [(i,) for i in sorted(share)]
    visited = pruned = 0
    for size in range(1, max_size + 1):
        scored = []
        for s in level:
            score = guess = 1.0
            for i in s:
                score, guess = score * share[i], guess * clipped[i] / n
            visited += 1
            scored.append((s, score))
            if size >= min_size:
                best.append(Candidate(canonical(s), score, n * guess))
        best = sorted(best, key=lambda c: (-c.score, c.itemset))[:count]
        floor = best[-1].score - 1e-12 if len(best) == count else -1.0
        stay = [s for s, score in scored if score >= floor]
        pruned += len(scored) - len(stay)
        level = [(*s, i) for s in stay for i in sorted(share) if i[0] > s[-1][0]]
    return best, {"visited": visited, "pruned": pruned}
