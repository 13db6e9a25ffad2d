"""Exact counts: predicates, histograms, supports, mutual information, and top itemsets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.itemsets import OTHER, Item, Itemset
from . import bitmaps
from .encode import attributes, to_long

#: Conditional sums of one aggregate; more go to the next one, so that code generation holds.
SUMS = 200


def matches(itemset: Itemset) -> Column:
    """Whether a row has all items."""
    out = F.lit(True)
    for a, v in itemset:
        out = out & (F.col(f"a{a}") == F.lit(v))
    return out


def matches_bins(key: Itemset, members: dict[Item, Sequence[int]]) -> Column:
    """Whether a row's values are in the bins (attribute, bin) of a key."""
    out = F.lit(True)
    for a, b in key:
        out = out & F.col(f"a{a}").isin(list(members[a, b]))
    return out


def matches_category(item: Item, targets: Sequence[int]) -> Column:
    """Whether a row has the value, or, for OTHER, none of the targets."""
    a, v = item
    return ~F.col(f"a{a}").isin(list(targets)) if v == OTHER else F.col(f"a{a}") == F.lit(v)


def supports(wide: DataFrame, itemsets: Sequence[Itemset]) -> dict[Itemset, int]:
    """Rows with all items, for each itemset, zero included: conditional sums, a few passes at most."""
    out: dict[Itemset, int] = {}
    for at in range(0, len(itemsets), SUMS):
        some = itemsets[at : at + SUMS]
        row = wide.agg(*(F.count_if(matches(s)).alias(f"s{k}") for k, s in enumerate(some))).first()
        out |= {s: row[k] for k, s in enumerate(some)}
    return out


def support_table(wide: DataFrame, itemsets: Sequence[Itemset]) -> DataFrame:
    """candidate (place) and support: conditional sums, unpivoted; one aggregate for every SUMS candidates, so that code generation holds."""
    out = None
    for at in range(0, max(len(itemsets), 1), SUMS):
        some = list(enumerate(itemsets))[at : at + SUMS]
        row = wide.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(matches(s)).alias(f"s{k}") for k, s in some))
        cells = [F.struct(F.lit(k).alias("candidate"), F.col(f"s{k}").alias("support")) for k, _ in some]
        none = F.array().cast("array<struct<candidate:int,support:bigint>>")
        one = row.select(F.explode(F.array(*cells) if cells else none).alias("x")).select("x.*")
        out = one if out is None else out.union(one)
    return out


def histogram(wide: DataFrame) -> DataFrame:
    """attr, value, n over the values that occur; partial sums make a row for each value and task."""
    return to_long(wide).groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))


def full_histogram(wide: DataFrame, domain: DataFrame) -> DataFrame:
    """attr, value, n over the public domain, 0 where a value doesn't occur."""
    return domain.join(histogram(wide), ["attr", "value"], "left").select("attr", "value", F.coalesce("n", F.lit(0)).alias("n"))


def mutual_information(wide: DataFrame, base2: bool = False) -> DataFrame:
    """left, right, nmi for each pair of attributes: I / sqrt(H H) in [0, 1], 0 where an entropy is 0.

    One pass over the rows counts all pairs of values (partial sums), and everything else works on
    those counts.
    """
    log = (lambda x: F.log2(x)) if base2 else F.log
    pairs = list(combinations(attributes(wide), 2))
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"a{a}").alias("x"), F.col(f"a{b}").alias("y")) for a, b in pairs)))
    joint = wide.select(cells.alias("c")).groupBy("c.left", "c.right", "c.x", "c.y").agg(F.count(F.lit(1)).alias("n"))
    joint = joint.toDF("left", "right", "x", "y", "n")
    total = F.sum("n").alias("total")
    px = joint.groupBy("left", "right", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("left", "right", "y").agg(F.sum("n").alias("ny"))
    n = joint.groupBy("left", "right").agg(total)

    def entropy(side: DataFrame, count: str, name: str) -> DataFrame:
        p = F.col(count) / F.col("total")
        return side.join(n, ["left", "right"]).groupBy("left", "right").agg((-F.sum(p * log(p))).alias(name))

    full = joint.join(px, ["left", "right", "x"]).join(py, ["left", "right", "y"]).join(n, ["left", "right"])
    p = F.col("n") / F.col("total")
    mi = full.groupBy("left", "right").agg(F.sum(p * log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi"))
    both = mi.join(entropy(px, "nx", "hx"), ["left", "right"]).join(entropy(py, "ny", "hy"), ["left", "right"])
    nmi = F.when((F.col("hx") <= 1e-15) | (F.col("hy") <= 1e-15), F.lit(0.0)).otherwise(F.least(F.greatest(F.col("mi") / F.sqrt(F.col("hx") * F.col("hy")), F.lit(0.0)), F.lit(1.0)))
    return both.select("left", "right", nmi.alias("nmi"), "mi", "hx", "hy")


def group_report(wide: DataFrame, groups: Sequence[int]) -> DataFrame:
    """One row: mean entropy in bits, mean mutual information within and across groups of columns, mean share of the most frequent value."""
    of = F.array(*(F.lit(g) for g in groups))
    pairs = mutual_information(wide, base2=True).withColumn("within", F.get(of, F.col("left")) == F.get(of, F.col("right")))
    nmi = pairs.agg(F.avg(F.when(F.col("within"), F.col("nmi"))).alias("within_nmi"), F.avg(F.when(~F.col("within"), F.col("nmi"))).alias("across_nmi"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("attr"))
    each = histogram(wide).withColumn("p", share).groupBy("attr").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.max("p").alias("top"))
    return each.agg(F.avg("h").alias("entropy_bits"), F.avg("top").alias("top_share")).crossJoin(nmi)


def _order(pair: tuple[Itemset, int]) -> tuple:
    return (-pair[1], pair[0])


def top_itemsets(wide: DataFrame, k: int, max_size: int = 4, min_size: int = 1, allowed: set[Item] | None = None, domain: dict[int, list[int]] | None = None) -> tuple[list[tuple[Itemset, int]], dict]:
    """The k itemsets of most support among all of min_size to max_size, ties by the itemset; and counters.

    One pass counts items. Only items at or above the support of the k-th itemset found so far can be
    part of the answer (those at it stay, for ties), so the next pass packs each block of rows to bitmaps of its
    frequent items. Larger itemsets are tried level by level in the tasks, as items after the frequent itemsets
    of the level before (`bitmaps`), and their supports are summed; only those that reach the floor come back, which
    rises as the answer fills, and go out again as the next level's prefixes: about k of them, and ties. Levels below
    min_size give no floor, and are passed within the tasks.
    """
    counts: dict[Item, int] = {(a, v): 0 for a, vs in (domain or {}).items() for v in vs}
    counts |= {(r["attr"], r["value"]): r["n"] for r in histogram(wide).collect()}  # a row for each public value
    if allowed is not None:
        counts = {i: n for i, n in counts.items() if i in allowed}
    found: list[tuple[Itemset, int]] = []
    ties: dict[int, int] = {}

    def keep(more: list[tuple[Itemset, int]]) -> None:
        found[:] = sorted([*found, *more], key=_order)[:k]
        for _, n in more:
            ties[n] = ties.get(n, 0) + 1

    if min_size == 1:
        keep([((i,), n) for i, n in counts.items()])
    floor = lambda: found[-1][1] if len(found) == k else 0
    first_floor = floor()
    items = sorted((i for i, n in counts.items() if n >= first_floor), key=lambda i: (-counts[i], i))
    visited = len(counts)
    if max_size > 1 and items:
        packed = bitmaps.blocks(wide, items)
        level: list[tuple[int, ...]] = [(j,) for j in range(len(items))] if min_size <= 2 else [()]
        for size in range(max(2, min_size), max_size + 1):
            visited += bitmaps.tried(items, level, size)
            table = bitmaps.level_supports(packed, items, level, size).where(F.col("n") >= floor()).cache()
            # The new floor is that of the k best of this level and those before; what reaches it comes to the driver.
            best = [(tuple(r["members"]), r["n"]) for r in table.orderBy(F.desc("n")).limit(k).collect()]
            reached = sorted([n for _, n in found] + [n for _, n in best], reverse=True)
            floor_now = reached[k - 1] if len(reached) >= k else 0
            more = [(tuple(r["members"]), r["n"]) for r in table.where(F.col("n") >= floor_now).collect()]
            table.unpersist()
            keep([(tuple(sorted(items[j] for j in s)), n) for s, n in more])
            level = [s for s, n in more if n >= floor()]
            if not level:
                break
        packed.unpersist()
    cutoff = found[-1][1] if found else None
    return found, {
        "exact": True, "returned_count": len(found), "singleton_count": len(counts), "initial_support_floor": first_floor,
        "cutoff_support": cutoff, "cutoff_tie_count": ties.get(cutoff, 0), "visited": visited,
    }


def universe(domain: dict[int, list[int]], max_size: int, limit: int) -> list[Itemset]:
    """All itemsets of public values up to max_size, or an error where they are more than limit."""
    from itertools import product

    count = universe_size([len(v) for v in domain.values()], max_size)
    if count > limit:
        raise ValueError(f"{count} public candidates, over the limit {limit}")
    return [
        tuple(zip(attrs, values, strict=True))
        for size in range(1, min(max_size, len(domain)) + 1)
        for attrs in combinations(sorted(domain), size)
        for values in product(*(sorted(domain[a]) for a in attrs))
    ]


def universe_size(sizes: Sequence[int], max_size: int) -> int:
    """Elementary symmetric polynomials of the domain sizes, summed up to max_size."""
    sums = [1] + [0] * max_size
    for s in sizes:
        for d in range(max_size, 0, -1):
            sums[d] += sums[d - 1] * s
    return sum(sums[1:])


def combinations_upto(n: int, size: int) -> int:
    return sum(comb(n, s) for s in range(1, size + 1))
