"""Dealing attributes to clients."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prf import uniform_value


def sizes_equal(count: int, clients: int) -> list[int]:
    """Contiguous parts; the first count mod clients have one more."""
    return [count // clients + (k < count % clients) for k in range(clients)]


def sizes_by_ratio(count: int, ratios: Sequence[float]) -> list[int]:
    """Largest remainders, ties by place; then every client gets at least one, from whoever is most above quota."""
    if any(r <= 0 for r in ratios):
        raise ValueError("ratios must be positive")
    quotas = [count * r / sum(ratios) for r in ratios]
    sizes = [math.floor(q) for q in quotas]
    order = sorted(range(len(ratios)), key=lambda k: (-(quotas[k] - sizes[k]), k))
    for k in order[: count - sum(sizes)]:
        sizes[k] += 1
    for empty in [k for k, s in enumerate(sizes) if not s]:
        donors = [k for k, s in enumerate(sizes) if s > 1]
        if not donors:
            raise ValueError("too few attributes")
        donor = max(donors, key=lambda k: (sizes[k] - quotas[k], -k))
        sizes[donor] -= 1
        sizes[empty] += 1
    return sizes


def order_of(count: int, seed: int | None) -> list[int]:
    return list(range(count)) if seed is None else sorted(range(count), key=lambda a: (uniform_value(seed, "partition", a), a))


def deal(order: Sequence[int], sizes: Sequence[int]) -> list[tuple[int, ...]]:
    out, at = [], 0
    for s in sizes:
        out.append(tuple(order[at : at + s]))
        at += s
    return out


def owner_map(parts: Sequence[Sequence[int]]) -> dict[int, int]:
    return {a: c for c, attrs in enumerate(parts) for a in attrs}


def owner_table(spark: SparkSession, parts: Sequence[Sequence[int]]) -> DataFrame:
    rows = sorted(owner_map(parts).items())
    return spark.createDataFrame(rows, "attr int, owner int")


def deal_table(attrs: DataFrame, clients: int, order: str = "attr") -> DataFrame:
    """attr and owner by ntile over an order, which cuts like sizes_equal. The table has a row for each attribute."""
    return attrs.withColumn("owner", F.ntile(clients).over(Window.orderBy(order)) - 1)


def affinity(scores: dict[tuple[int, int], float], count: int, sizes: Sequence[int]) -> list[tuple[int, ...]]:
    """Groups of related attributes within capacities.

    Seeds: the attribute of most affinity in all, then each time the one whose nearest seed is farthest,
    by (smallest affinity to the seeds, most affinity in all, number). Then again and again the
    attribute and group of the highest mean affinity, ties to the smaller group, then the first.
    """

    def score(a: int, b: int) -> float:
        return 1.0 if a == b else scores.get((min(a, b), max(a, b)), 0.0)

    total = {a: sum(score(a, b) for b in range(count)) for a in range(count)}
    free, groups = set(range(count)), [[] for _ in sizes]
    for k, size in enumerate(sizes):
        if size > 0:
            held = [a for g in groups for a in g]
            seed = min(free, key=lambda a: (min((score(a, b) for b in held), default=0.0) if k else 0.0, -total[a], a))
            groups[k].append(seed)
            free.discard(seed)
    while free:
        options = [
            (sum(score(a, b) for b in g) / len(g) if g else 0.0, -len(g), -k, -a)
            for a in free for k, g in enumerate(groups) if len(g) < sizes[k]
        ]
        if not options:
            raise ValueError("the capacities are too small")
        _, _, k, a = max(options)
        groups[-k].append(-a)
        free.discard(-a)
    return [tuple(g) for g in groups]
