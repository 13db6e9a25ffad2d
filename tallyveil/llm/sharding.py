"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import dense_slots


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest w / -ln(u), u in (0, 1) from a hash of key and shard number.

    A shard's score doesn't depend on the other shards: one that is added only wins rows for itself,
    one that is removed only gives up its own. A null key counts as the empty string. Shards of
    weight 0 get nothing.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("at least one shard needs a positive weight")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.lit(weight) / -F.log(u)).alias("score"), F.lit(-shard).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights) if w > 0]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["shard"]).cast("int")


def shard_rows(rows: DataFrame, key: str, weights: Sequence[float], grown: float | None = None) -> DataFrame:
    """Adds shard, slot (gapless from 0 in each shard) and grown_shard (with one more shard of weight grown).

    Only key decides: equal keys, repeated rows among them, share a shard and get slots of their own;
    rows with a null key share one shard too. An empty table gives an empty result. Columns of the
    input called shard, slot or grown_shard are replaced. Slots are dealt by dense_slots, so that a
    hot key or shard isn't gathered in one task.
    """
    rows = rows.drop("shard", "slot", "grown_shard")
    rows = rows.withColumn("shard", rendezvous(F.col(key), weights))
    more = rendezvous(F.col(key), [*weights, grown]) if grown else F.lit(None).cast("int")
    rows = rows.withColumn("grown_shard", more)
    return dense_slots(rows, ["shard"], [F.col(key)], "slot")
