"""The size of messages in a compact binary layout. Nothing is sent; sizes are computed."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.itemsets import Itemset
from .binning import Plan

#: Bytes of the layout's types.
U16, U32, I64, F64, BOOL = 2, 4, 8, 8, 1
#: Fixed value: bytes of one encrypted bit at 128-bit security.
CIPHERTEXT = 2536


def text_bytes(value: str) -> int:
    return U16 + len(value.encode())


def text_column(value: Column) -> Column:
    return F.lit(U16) + F.octet_length(value)


def itemset_bytes(size: int) -> int:
    return U16 + size * (U32 + I64)


def itemset_column(items: Column) -> Column:
    return F.lit(U16) + F.size(items) * (U32 + I64)


def first_round_table(counts: DataFrame) -> DataFrame:
    """client, bytes of first-round reports (client, attr, value, noisy)."""
    name = F.concat(F.lit("client_"), F.col("client").cast("string"))
    sums = counts.groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    return sums.select("client", (text_column(name) + 3 * F64 + U32 + F.col("n") * (U32 + I64 + F64)).alias("bytes"))


def candidate_message(candidates: DataFrame, guess: bool = False, counts: int | None = None) -> DataFrame:
    """One row: bytes of the list of candidates for one client, with their guesses and the item counts where asked."""
    one = itemset_column(F.col("itemset")) + F.lit(F64 if guess else 0)
    extra = 0 if counts is None else U32 + counts * (U32 + I64 + F64)
    return candidates.agg((F.lit(U32 + extra) + F.coalesce(F.sum(one), F.lit(0))).alias("bytes"))


def binning_message(plan: Plan | None, attrs: Sequence[int] | None = None) -> int:
    """Cut points where an attribute's bins follow one another without a gap, else lists of values."""
    if plan is None:
        return 0
    total = U32
    for a in plan if attrs is None else attrs:
        bins = plan[a]
        follow = all(bins[k][-1] + 1 == bins[k + 1][0] for k in range(len(bins) - 1))
        total += U32 + U16 + (max(len(bins) - 1, 0) * I64 if follow else sum(U16 + len(b) * I64 for b in bins))
    return total


def report_bytes(key: Itemset | Column, m: int):
    rest = 3 * F64 + BOOL + U32 + m * F64
    return itemset_column(key) + rest if isinstance(key, Column) else itemset_bytes(len(key)) + rest


def second_round_table(keys: DataFrame, m: int) -> DataFrame:
    """client, bytes of second-round reports (client, key), each a sketch of m numbers."""
    name = F.concat(F.lit("client_"), F.col("client").cast("string"))
    sums = keys.groupBy("client").agg(F.sum(report_bytes(F.col("key"), m)).alias("n"))
    return sums.select("client", (text_column(name) + U32 + F.col("n")).alias("bytes"))


def total_table(first: DataFrame, second: DataFrame, down: DataFrame, bins: Mapping[int, int] | None = None) -> DataFrame:
    """client, uplink1, downlink, bins, uplink2, total for every client that sends or gets something."""
    both = first.withColumnRenamed("bytes", "uplink1").join(second.withColumnRenamed("bytes", "uplink2"), "client", "full").crossJoin(F.broadcast(down.withColumnRenamed("bytes", "downlink")))
    extra = F.lit(0)
    for client, size in (bins or {}).items():
        extra = F.when(F.col("client") == client, F.lit(size)).otherwise(extra)
    out = both.select("client", F.coalesce("uplink1", F.lit(0)).alias("uplink1"), "downlink", extra.alias("bins"), F.coalesce("uplink2", F.lit(0)).alias("uplink2"))
    return out.withColumn("total", F.col("uplink1") + F.col("downlink") + F.col("bins") + F.col("uplink2"))


def randomizer_bytes(bits1: int, bits2: int, clients: int, candidates: Sequence[Itemset], counts: int) -> int:
    """Both rounds' bits, a row number from each client, and candidates with guesses and item counts to each."""
    down = U32 + sum(itemset_bytes(len(c)) + F64 for c in candidates)
    return math.ceil(bits1 / 8) + F64 * clients + math.ceil(bits2 / 8) + clients * (down + U32 + counts * (U32 + I64 + F64))


def preflight(rows: int, sizes: Sequence[int], max_size: int) -> dict[str, int | bool]:
    """What encrypting the whole table and testing every public candidate would take; feasible up to 100,000 candidates and 4 GiB."""
    from .counts import universe_size

    candidates, cipher = universe_size(sizes, max_size), rows * sum(sizes) * CIPHERTEXT
    return {
        "public_items": sum(sizes), "public_candidates": candidates, "ciphertext_bytes": cipher,
        "row_candidate_tests": rows * candidates, "feasible": candidates <= 100_000 and cipher <= 4 << 30,
    }
