"""Unary encoding of values in every row, and the central model."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce
from itertools import combinations
from operator import and_, mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.prf import laplace, tag
from .encode import attributes


def parameters(epsilon: float) -> tuple[float, float]:
    """Chance of a one for the row's own value, and for any other."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    return 0.5, 1.0 / (math.exp(epsilon) + 1.0)


#: Uniform numbers that one digest gives: 13 hex digits each.
CUTS, DIGITS = 4, 13


def digest(seed: int, name: str, block: Column | int, *row: Column | str | int) -> Column:
    """The digest that bits CUTS * block to CUTS * block + CUTS - 1 of a row are cut from."""
    return F.sha2(tag(seed, name, *row[:-1], block, row[-1]), 256)


def cut_bit(digests: Column, place: Column | int, truth: Column, epsilon: float) -> Column:
    """The keyed random bit at a place: whether the digest's digits there, as a number in (0, 1), are below the chance of a one.

    A number (d + 0.5) / 16 ** DIGITS is below a chance exactly if d is below a whole number, so that digits are compared as text.
    """
    below = [F.lit(f"{math.ceil(Fraction(x) * 16**DIGITS - Fraction(1, 2)):0{DIGITS}x}") for x in parameters(epsilon)]
    cut = place % CUTS
    digits = F.substring(digests, 1 + DIGITS * cut, DIGITS) if isinstance(cut, int) else F.substr(digests, 1 + F.lit(DIGITS) * cut, F.lit(DIGITS))
    return (digits < F.when(truth, below[0]).otherwise(below[1])).cast("int")


def debiased(total: Column, rows: Column, epsilon: float) -> Column:
    p, q = parameters(epsilon)
    return (total - rows * F.lit(q)) / F.lit(p - q)


#: Sums of one aggregate; more go to the next one, so that code generation holds.
SUMS = 200


def column_sums(wide: DataFrame, domain: Mapping[int, Sequence[int]], epsilon: float | Mapping[int, float], seed: int) -> DataFrame:
    """attr, value, ones, rows: sums of every row's bits over each attribute's public values; bits are made in the sum and never stored.

    One pass over the rows makes SUMS of them, whatever attributes they are of. epsilon may differ by attribute. A value's
    bit goes by its place among the attribute's public values, CUTS of them to a digest of the row.
    """
    cells = [(a, k, v) for a in attributes(wide) for k, v in enumerate(domain[a])]
    budget = epsilon if isinstance(epsilon, Mapping) else dict.fromkeys(domain, epsilon)
    out = None
    for at in range(0, len(cells), SUMS):
        some = cells[at : at + SUMS]
        blocks = sorted({(a, k // CUTS) for a, k, _ in some})
        rows = wide.select(*(f"a{a}" for a in sorted({a for a, _ in blocks})), *(digest(seed, "oue", b, a, F.col("tid")).alias(f"d{a}_{b}") for a, b in blocks))
        sums = rows.agg(F.count(F.lit(1)).alias("rows"), *(F.sum(cut_bit(F.col(f"d{a}_{k // CUTS}"), k, F.col(f"a{a}") == v, budget[a])).alias(f"s{n}") for n, (a, k, v) in enumerate(some)))
        each = (F.struct(F.lit(a).alias("attr"), F.lit(v).cast("bigint").alias("value"), F.coalesce(f"s{n}", F.lit(0)).alias("ones")) for n, (a, _, v) in enumerate(some))
        one = sums.select(F.explode(F.array(*each)).alias("x"), "rows").select("x.*", "rows")
        out = one if out is None else out.union(one)
    return out


def first_round(wide: DataFrame, domain: Mapping[int, Sequence[int]], owners: DataFrame, epsilon: float, clients: int, n: float, seed: int, limit: int | None = None) -> DataFrame:
    """client, attr, value, noisy: estimates clipped to [0, n], the best `limit` of each client. An attribute gets its client's share divided by its attributes."""
    held: dict[int, list[int]] = {}
    for r in owners.collect():  # a row for each attribute
        held.setdefault(r["owner"], []).append(r["attr"])
    share = {a: epsilon / clients / len(attrs) for attrs in held.values() for a in attrs}
    client = {a: c for c, attrs in held.items() for a in attrs}
    sums = column_sums(wide.select("tid", *(f"a{a}" for a in sorted(share))), domain, share, seed)

    def of(values: Mapping[int, float]) -> Column:
        return F.create_map(*(F.lit(x) for pair in sorted(values.items()) for x in pair))[F.col("attr")]

    q = {a: parameters(e)[1] for a, e in share.items()}
    value = (F.col("ones") - F.col("rows") * of(q)) / of({a: parameters(e)[0] - q[a] for a, e in share.items()})
    out = sums.select(of(client).alias("client"), "attr", "value", F.least(F.greatest(value, F.lit(0.0)), F.lit(float(n))).alias("noisy"))
    if limit is None:
        return out
    place = F.row_number().over(Window.partitionBy("client").orderBy(F.desc("noisy"), "attr", "value"))
    return out.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def intersections(wide: DataFrame, sets: Sequence[Sequence[tuple[Column, float, str]]], n: float, seed: int) -> DataFrame:
    """One row: e0, e1, ..., for each set of blocks (truth, epsilon, name) the sum over rows of the product of its debiased bits, clipped to [0, n]; 0 without blocks.

    A block that several sets have is one bit of a row. Bits go by their names' place in order, CUTS of them to a digest.
    A product has as many values as the bits of its few blocks have patterns, so that the sum is weighed counts of rows: whole
    numbers, which are the same however rows are dealt to tasks, as a sum of the products themselves isn't.
    """
    blocks = {name: (truth, epsilon) for some in sets for truth, epsilon, name in some}
    place = {name: k for k, name in enumerate(sorted(blocks))}
    digests = wide.select("*", *(digest(seed, "bits", b, F.col("tid")).alias(f"_d{b}") for b in range(-(-len(place) // CUTS))))
    rows = digests.select(*((cut_bit(F.col(f"_d{k // CUTS}"), k, *blocks[name]) == 1).alias(f"b{k}") for name, k in place.items()))
    used = [Counter(place[name] for _, _, name in some) for some in sets]
    asked = sorted({t for some in used for t in _subsets(sorted(some))})
    ones: dict[tuple[int, ...], int] = {}  # rows whose bits at the places are all ones
    for at in range(0, len(asked), SUMS):
        row = rows.agg(*(F.count_if(reduce(and_, (F.col(f"b{k}") for k in t), F.lit(True))).alias(f"s{i}") for i, t in enumerate(asked[at : at + SUMS]))).first()
        ones |= dict(zip(asked[at : at + SUMS], row, strict=True))
    values = {}  # of a debiased bit that is zero, and one
    for name, k in place.items():
        p, q = map(Fraction, parameters(blocks[name][1]))
        values[k] = (-q / (p - q), (1 - q) / (p - q))
    found = []
    for some in used:
        total = Fraction(0)
        for t in _subsets(sorted(some)) if some else ():
            low = {k: values[k][0] ** times for k, times in some.items()}
            total += ones[t] * reduce(mul, (values[k][1] ** times - low[k] if k in t else low[k] for k, times in some.items()))
        found.append(float(min(max(total, Fraction(0)), Fraction(n))))
    return wide.sparkSession.createDataFrame([tuple(found)], StructType([StructField(f"e{k}", DoubleType()) for k in range(len(found))]))


def _subsets(places: Sequence[int]) -> list[tuple[int, ...]]:
    return [t for size in range(len(places) + 1) for t in combinations(places, size)]


def central_estimates(supports: DataFrame, epsilon: float, candidates: int, n: float, seed: int) -> DataFrame:
    """supports (candidate, support) with estimate: Laplace noise of scale candidates / epsilon, clipped to [0, n]."""
    noisy = F.col("support") + laplace(candidates / epsilon, seed, "central", F.col("candidate"))
    return supports.withColumn("estimate", F.least(F.greatest(F.bround(noisy, 9), F.lit(0.0)), F.lit(float(n))))


def first_histogram(counts: DataFrame, owners: DataFrame, epsilon: float, seed: int, limit: int | None = None) -> DataFrame:
    """client, attr, value, noisy: Laplace noise on each public count (attr, value, n), clipped at 0, the best `limit` of each client.

    A client's epsilon is divided by its attributes. Values are rounded to 9 digits, so that every
    engine ranks them alike.
    """
    per = Window.partitionBy("owner")
    sizes = owners.withColumn("attrs", F.count(F.lit(1)).over(per))
    rows = counts.join(F.broadcast(sizes), "attr")
    noise = laplace(F.col("attrs") / F.lit(float(epsilon)), seed, F.concat(F.lit("client_"), F.col("owner").cast("string")), "round1", F.col("attr"), F.col("value"))
    out = rows.select(F.col("owner").alias("client"), "attr", "value", F.greatest(F.bround(F.col("n") + noise, 9), F.lit(0.0)).alias("noisy"))
    if limit is None:
        return out
    place = F.row_number().over(Window.partitionBy("client").orderBy(F.desc("noisy"), "attr", "value"))
    return out.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def noisy_rows(rows: DataFrame, clients: int, epsilon_n: float, seed: int) -> DataFrame:
    """client and noisy_n for a one-row table (n)."""
    if epsilon_n <= 0:
        raise ValueError("epsilon must be positive")
    each = rows.select("n", F.explode(F.sequence(F.lit(0), F.lit(clients - 1))).alias("client"))
    noise = laplace(1.0 / epsilon_n, seed, F.concat(F.lit("client_"), F.col("client").cast("string")), "noisy_n")
    return each.select("client", F.bround(F.col("n") + noise, 9).alias("noisy_n"))


def mean_rows(noisy: DataFrame) -> DataFrame:
    """The mean of the clients' row numbers, at least 1."""
    return noisy.agg(F.greatest(F.lit(1.0), F.avg("noisy_n")).alias("noisy_n"))
