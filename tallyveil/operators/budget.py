"""Privacy budgets: splits, per-coordinate parameters and the account for overlapping keys."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.itemsets import Itemset


def _legal(epsilon: float, delta: float) -> None:
    if epsilon <= 0 or not 0 < delta < 1:
        raise ValueError("epsilon must be positive and delta in (0, 1)")


def split_equal(epsilon: float, delta: float, count: int) -> tuple[float, float]:
    _legal(epsilon, delta)
    if count < 1:
        raise ValueError("nothing to split among")
    return epsilon / count, delta / count


def split_weighted(epsilon: float, delta: float, weights: Sequence[float]) -> list[tuple[float, float]]:
    _legal(epsilon, delta)
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return [(epsilon * w / sum(weights), delta * w / sum(weights)) for w in weights]


def group_of(key: Itemset) -> tuple[int, ...]:
    """The key's attributes: keys of one group differ in a value, so that a row matches one at most."""
    return tuple(a for a, _ in key)


def split_grouped(epsilon: float, delta: float, keys: Sequence[Itemset]) -> dict[Itemset, tuple[float, float]]:
    """An equal share for each group of attributes, whole for each of its keys."""
    share = split_equal(epsilon, delta, len({group_of(k) for k in keys}))
    return {k: share for k in keys}


def key_budgets(keys: Sequence[Itemset], epsilon: float, delta: float, mixed: bool, mixed_weight: float, joint_weight: float = 1.0) -> dict[Itemset, tuple[float, float]]:
    """Mixed modes share by group, or equally where mixed_weight is 0; others by weight, joint keys with joint_weight."""
    if mixed and mixed_weight > 0:
        return split_grouped(epsilon, delta, keys)
    if mixed:
        return {k: split_equal(epsilon, delta, len(keys)) for k in keys}
    shares = split_weighted(epsilon, delta, [joint_weight if len(k) > 1 else 1.0 for k in keys])
    return dict(zip(keys, shares, strict=True))


def group_column(key: Column) -> Column:
    return F.transform(key, lambda x: x["attr"])


def grouped_budget_table(keys: DataFrame, epsilon: float, delta: float) -> DataFrame:
    """keys (client, key) with groups, the client's number of groups, and each key's epsilon and delta."""
    place = F.dense_rank().over(Window.partitionBy("client").orderBy("group"))
    ranked = keys.withColumn("group", group_column(F.col("key"))).withColumn("place", place)
    groups = F.max("place").over(Window.partitionBy("client"))
    return ranked.withColumn("groups", groups).select("client", "key", "groups", (F.lit(epsilon) / F.col("groups")).alias("epsilon"), (F.lit(delta) / F.col("groups")).alias("delta"))


def weighted_budget_table(keys: DataFrame, epsilon: float, delta: float, weight: Column) -> DataFrame:
    total = F.sum(weight).over(Window.partitionBy("client"))
    return keys.select("client", "key", (F.lit(epsilon) * weight / total).alias("epsilon"), (F.lit(delta) * weight / total).alias("delta"))


def phases(epsilon: float, delta: float, clients: int, phase1_ratio: float, noisy_n_ratio: float) -> dict[str, float]:
    """A client's share of the counts, the row number and the second round."""
    first = epsilon * phase1_ratio
    return {
        "epsilon_n": first * noisy_n_ratio / clients, "epsilon_counts": first * (1 - noisy_n_ratio) / clients,
        "epsilon_reports": epsilon * (1 - phase1_ratio) / clients, "delta_reports": delta / clients,
    }


def coordinate_epsilon(epsilon: float, delta: float, m: int) -> float:
    _legal(epsilon, delta)
    return epsilon / (4.0 * math.sqrt(m * math.log(1.0 / delta)))


def coordinate_epsilon_column(epsilon: Column, delta: Column, m: int) -> Column:
    return epsilon / (F.lit(4.0) * F.sqrt(F.lit(float(m)) * F.log(F.lit(1.0) / delta)))


def overlap_bound(keys: Sequence[Itemset]) -> int:
    """Keys that one row can match: one for each attribute with single-item keys, and every joint key."""
    return len({k[0][0] for k in keys if len(k) == 1}) + sum(len(k) > 1 for k in keys)


def group_bound(keys: Sequence[Itemset]) -> int:
    return len({group_of(k) for k in keys})


def overlap_account(m: int, delta: float, bounds: Mapping[object, int], coordinates: Mapping[object, float]) -> dict[str, float]:
    """Approximate DP of sketches with shared hashes whose keys overlap, through Renyi DP at the best order of 2 or more."""
    if set(bounds) != set(coordinates) or m < 1 or not 0 < delta < 1:
        raise ValueError("bounds and coordinate budgets must be of the same clients")
    overlap = sum(bounds[c] * coordinates[c] ** 2 for c in bounds)
    if overlap == 0:
        return {"weighted_overlap": 0.0, "rdp_coefficient": 0.0, "rdp_order": 2.0, "rdp_epsilon": 0.0}
    slope, log = 2.0 * m * overlap, math.log(1.0 / delta)
    order = max(2.0, 1.0 + math.sqrt(log / slope))
    return {"weighted_overlap": overlap, "rdp_coefficient": slope, "rdp_order": order, "rdp_epsilon": slope * order + log / (order - 1.0)}


def overlap_account_table(clients: DataFrame, m: int, delta: float) -> DataFrame:
    """overlap_account of a table (client, bound, coordinate)."""
    slope = F.lit(2.0 * m) * F.sum(F.col("bound") * F.col("coordinate") ** 2)
    log = F.lit(math.log(1.0 / delta))
    out = clients.agg(slope.alias("rdp_coefficient"))
    order = F.when(F.col("rdp_coefficient") > 0, F.greatest(F.lit(2.0), F.lit(1.0) + F.sqrt(log / F.col("rdp_coefficient")))).otherwise(F.lit(2.0))
    out = out.withColumn("rdp_order", order)
    total = F.col("rdp_coefficient") * F.col("rdp_order") + log / (F.col("rdp_order") - F.lit(1.0))
    return out.withColumn("rdp_epsilon", F.when(F.col("rdp_coefficient") > 0, total).otherwise(F.lit(0.0)))


def certificate(spent: Mapping[str, float], total: float, slack: float = 1e-12) -> bool:
    """Whether the phases together stay in the budget."""
    return sum(spent.values()) <= total + slack
