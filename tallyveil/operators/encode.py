"""Public coders from raw columns to integer categories, and transforms of coded tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prf import uniform, uniform_value

#: Largest domain that is carried in an expression; a larger one is joined.
INLINE_DOMAIN = 256


#: Slices that an approximate pass cuts a column's values into.
SLICES = 64


def slice_of(x: Column, cuts: Sequence[float], first: int = 0) -> Column:
    """How many of the sorted cuts a value is above, and first: by halving, so that a value meets log2 of them and not all."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(x > cuts[middle], slice_of(x, cuts[middle + 1 :], first + middle + 1)).otherwise(slice_of(x, cuts[:middle], first))


def exact_quantiles_of(df: DataFrame, wanted: Sequence[tuple[Column, Sequence[float]]], sets: Sequence[Column] = ()) -> tuple[list[list[float]], list[list]]:
    """Exact quantiles with linear interpolation of several columns ([] without values), and the sorted different values of others.

    Three passes for all columns together. An approximate one cuts each column into slices of about
    equal weight (and collects the sets, which are public domains); rows are counted by slice; only the
    slices that hold a wanted rank have their values counted and sorted. So neither all values nor a
    whole table of their counts meet in one task, as they would in percentile().
    """
    marks = F.array(*(F.lit(i / SLICES) for i in range(1, SLICES)))
    base = df.select(*(c.cast("double").alias(f"x{k}") for k, (c, _) in enumerate(wanted)), *(c.alias(f"s{k}") for k, c in enumerate(sets)))
    aggs = [F.percentile_approx(f"x{k}", marks, F.lit(2000)).alias(f"c{k}") for k in range(len(wanted))] + [F.array_sort(F.collect_set(f"s{k}")).alias(f"v{k}") for k in range(len(sets))]
    first = base.agg(*aggs).first()
    values = [list(first[f"v{k}"]) for k in range(len(sets))]
    if not wanted:
        return [], values
    cells = []
    for k in range(len(wanted)):
        cuts = sorted(set(first[f"c{k}"] or []), key=lambda c: (math.isnan(c), c))
        cells.append(F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x"), slice_of(F.col(f"x{k}"), cuts).alias("slice")))
    cells = base.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("x is not null")
    sizes = {(r["k"], r["slice"]): r["count"] for r in cells.groupBy("k", "slice").count().collect()}
    totals = [sum(n for (j, _), n in sizes.items() if j == k) for k in range(len(wanted))]
    base_of, at = {}, [0] * len(wanted)
    for k, piece in sorted(sizes):
        base_of[k, piece] = at[k]
        at[k] += sizes[k, piece]
    ranks = [[(int(s * (n - 1)), s * (n - 1)) for s in shares] if n else [] for (_, shares), n in zip(wanted, totals, strict=True)]
    needed = [{min(r + d, n - 1) for r, _ in some for d in (0, 1)} for some, n in zip(ranks, totals, strict=True)]
    holders = [key for key in sizes if any(base_of[key] <= r < base_of[key] + sizes[key] for r in needed[key[0]])]
    if not holders:
        return [[] for _ in wanted], values
    code = F.col("k") * (SLICES + 1) + F.col("slice")
    start = F.create_map(*(F.lit(x) for k, piece in holders for x in (k * (SLICES + 1) + piece, base_of[k, piece])))
    inside = Window.partitionBy("code").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    counted = cells.withColumn("code", code).where(F.col("code").isin([k * (SLICES + 1) + piece for k, piece in holders])).groupBy("k", "code", "x").agg(F.count(F.lit(1)).alias("n"))
    ends = counted.withColumn("end", F.sum("n").over(inside) + start[F.col("code")])
    hit = F.lit(False)
    for k, some in enumerate(needed):
        if some:
            hit = hit | ((F.col("k") == k) & F.exists(F.array(*(F.lit(r) for r in sorted(some))), lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end"))))
    found = [(r["k"], r["end"] - r["n"], r["end"], r["x"]) for r in ends.where(hit).select("k", "end", "n", "x").collect()]

    def value(k: int, rank: int) -> float:
        return next(x for j, a, b, x in found if j == k and a <= rank < b)

    out = []
    for k, some in enumerate(ranks):
        pairs = [(value(k, low), value(k, min(low + 1, totals[k] - 1)), place - low) for low, place in some]
        out.append([a + (b - a) * t for a, b, t in pairs])
    return out, values


def exact_quantiles(df: DataFrame, column: Column, shares: Sequence[float]) -> list[float]:
    return exact_quantiles_of(df, [(column, shares)])[0][0]


def interior_shares(bins: int) -> list[float]:
    """Multiples of 1 / bins as an evenly spaced grid has them, to the last digit: 0.6 is 6 * 0.1, a little more than 0.6."""
    return [i * (1 / bins) for i in range(1, bins)]


def quantile_edges(df: DataFrame, column: Column, bins: int = 10, zero_aware: bool = False) -> list[float]:
    """Different interior quantiles; zero-aware drops values up to 0 first."""
    if zero_aware:
        df = df.where(column > 0)
    return sorted(set(exact_quantiles(df, column, interior_shares(bins))))


def count_edges(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are not above x."""
    return sum(((x >= F.lit(float(e))).cast("bigint") for e in edges), F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class Categories:
    """Codes by rank among the sorted different values of a column."""

    values: tuple

    @classmethod
    def fit(cls, df: DataFrame, column: Column) -> Categories:
        return cls(tuple(r[0] for r in df.select(column.alias("v")).where("v is not null").distinct().orderBy("v").collect()))

    def code(self, column: Column) -> Column:
        return F.array_position(F.array(*(F.lit(v) for v in self.values)), column) - 1


@dataclass(frozen=True)
class Deciles:
    """Codes by the number of edges not above a value.

    "none": edges are the different quantiles without the smallest and the largest value, so that a
    constant column is coded 0. "own" and "offset": zeros are 0 and everything else moves up by one;
    edges are the different interior quantiles of the values other than 0, or over 0.
    """

    edges: tuple[float, ...]
    zero: str = "none"

    @classmethod
    def fit(cls, df: DataFrame, column: Column, bins: int = 10, zero: str = "none") -> Deciles:
        return fit_coders(df, [], [(column, zero)], bins)[1][0]

    def code(self, column: Column) -> Column:
        found = count_edges(column.cast("double"), self.edges)
        return found if self.zero == "none" else F.when(column == 0, F.lit(0).cast("bigint")).otherwise(found + 1)


def fit_coders(df: DataFrame, categories: Sequence[Column], numbers: Sequence[tuple[Column, str]], bins: int = 10) -> tuple[list[Categories], list[Deciles]]:
    """Coders of several columns of a table; numbers are (column, zero) as in Deciles."""
    shares = {"none": [0.0, *interior_shares(bins), 1.0]}
    kept = {"none": lambda c: c, "own": lambda c: F.when(c != 0, c), "offset": lambda c: F.when(c > 0, c)}
    wanted = [(kept[zero](c), shares.get(zero, interior_shares(bins))) for c, zero in numbers]
    found, values = exact_quantiles_of(df, wanted, categories)
    edges = [tuple(sorted(set(e))) for e in found]
    deciles = [Deciles(e[1:-1] if zero == "none" else e, zero) for e, (_, zero) in zip(edges, numbers, strict=True)]
    return [Categories(tuple(v)) for v in values], deciles


def category_table(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """value and code of a domain too large for an expression; to be joined."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return values.withColumn(code, (F.row_number().over(Window.orderBy("value")) - 1).cast("bigint"))


def attributes(wide: DataFrame) -> list[int]:
    return [int(c[1:]) for c in wide.columns if c[:1] == "a" and c[1:].isdigit()]


def to_long(wide: DataFrame) -> DataFrame:
    """tid, attr, value: a row for each cell."""
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("attr"), F.col(f"a{a}").cast("bigint").alias("value")) for a in attributes(wide))))
    return wide.select("tid", cells.alias("c")).select("tid", "c.attr", "c.value")


def domains(wide: DataFrame) -> DataFrame:
    """attr, value: the different values of every attribute of the whole table."""
    return to_long(wide).select("attr", "value").distinct()


def domain_map(wide: DataFrame) -> dict[int, list[int]]:
    """Public domains on the driver; their size is that of the coded alphabet, not of the table."""
    out: dict[int, list[int]] = {a: [] for a in attributes(wide)}
    for r in domains(wide).orderBy("attr", "value").collect():
        out[r["attr"]].append(r["value"])
    return out


def clean_row(df: DataFrame, width: int, label: str) -> DataFrame:
    """Trimmed text cells; the label loses a trailing dot; null cells become '?'; another width is an error."""
    if len(df.columns) != width:
        raise ValueError(f"{len(df.columns)} columns instead of {width}")
    cells = [F.coalesce(F.trim(F.col(c)), F.lit("?")) for c in df.columns]
    return df.select(*((F.regexp_replace(x, r"\.$", "") if c == label else x).alias(c) for c, x in zip(df.columns, cells, strict=True)))


def split_label(df: DataFrame, label: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Features without label and weight, and the label alone."""
    return df.drop(*([label] + ([weight] if weight else []))), df.select("tid", label)


def out_of_domain(df: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """attr and violations, the rows outside the official range, for every checked column."""
    sums = [F.coalesce(F.sum((~F.col(c).between(*b)).cast("int")), F.lit(0)).alias(c) for c, b in bounds.items()]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("attr"), F.col(c).cast("bigint").alias("violations")) for c in bounds)))
    return df.agg(*sums).select(cells.alias("x")).select("x.*")


def reduce_domains(wide: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Maps every attribute's domain to max(1, round half even(size * ratio)) values, dealt by a keyed order.

    A target of full size only numbers the values anew; a ratio of 1 or more changes nothing.
    """
    if ratio >= 1:
        return wide
    out = wide
    for a, values in domain_map(wide).items():
        target = min(max(1, round(len(values) * ratio)), len(values))
        order = values if target == len(values) else sorted(values, key=lambda v: (uniform_value(seed, "domain", a, v), v))
        codes = {v: i if target == len(values) else i * target // len(values) for i, v in enumerate(order)}
        out = out.withColumn(f"a{a}", _mapped(F.col(f"a{a}"), codes))
    return out


def _mapped(column: Column, codes: dict[int, int]) -> Column:
    cells = F.create_map(*(F.lit(x).cast("bigint") for v, c in codes.items() for x in (v, c)))
    return cells[column.cast("bigint")]


def merge_groups(count: int, ratio: float, clients: int, seed: int) -> list[list[int]]:
    """Attributes dealt round robin, in a keyed order, to max(clients, round half even(count * ratio)) groups."""
    target = min(max(clients, round(count * ratio)), count)
    if target == count:
        return [[a] for a in range(count)]
    order = sorted(range(count), key=lambda a: (uniform_value(seed, "merge", a), a))
    return [order[k::target] for k in range(target)]


def tuple_ranks(wide: DataFrame, cells: Sequence[str], rank: str) -> DataFrame:
    """cells and rank: the place of every tuple that occurs among them in order, from 0.

    Tuples are ranked as in a tree: a prefix starts where its parent does, plus the tuples under the
    siblings before it. So a window never holds more than one column's domain, however many tuples occur.
    """
    levels = [wide.select(*cells).distinct().withColumn("_n", F.lit(1).cast("bigint"))]
    for k in range(len(cells) - 1, 0, -1):
        levels.append(levels[-1].groupBy(*cells[:k]).agg(F.sum("_n").alias("_n")))
    start = None
    for k, level in enumerate(reversed(levels), 1):
        parent = cells[: k - 1]
        siblings = (Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))).orderBy(cells[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("_before", F.coalesce(F.sum("_n").over(siblings), F.lit(0))).drop("_n")
        if start is not None:
            level = level.join(start, parent).withColumn("_before", F.col("_before") + F.col("_start")).drop("_start")
        start = level.withColumnRenamed("_before", "_start")
    return start.withColumnRenamed("_start", rank)


#: Different tuples of merged attributes that are ranked on the driver and sent to the tasks; more are ranked and joined in the cluster.
MOST_TUPLES = 1 << 16


def merge_features(wide: DataFrame, groups: Sequence[Sequence[int]]) -> DataFrame:
    """One column for each group of attributes: the rank of the row's values among the different tuples.

    One pass finds the tuples of all groups. They are the merged public domains, mostly few, and then rows are neither shuffled nor
    read again for each group.
    """
    width = max(map(len, groups))
    cells = [[F.col(f"a{a}").cast("bigint").alias(f"c{k}") for k, a in enumerate(g)] + [F.lit(None).cast("bigint").alias(f"c{k}") for k in range(len(g), width)] for g in groups]
    tuples = wide.select(F.explode(F.array(*(F.struct(F.lit(g).alias("g"), *c) for g, c in enumerate(cells)))).alias("t")).select("t.*").distinct()
    found = tuples.limit(MOST_TUPLES + 1).collect()
    out = wide
    for g, members in enumerate(groups):
        names = [f"a{a}" for a in members]
        if len(found) > MOST_TUPLES:
            ranks = tuple_ranks(wide, names, f"m{g}")
        else:
            some = sorted((tuple(r[1 : 1 + len(members)]) for r in found if r["g"] == g), key=lambda t: [(v is not None, v or 0) for v in t])
            ranks = F.broadcast(wide.sparkSession.createDataFrame([(*t, k) for k, t in enumerate(some)], ", ".join(f"{c} bigint" for c in (*names, f"m{g}"))))
        out = out.join(ranks, names)
    return out.select("tid", *(F.col(f"m{g}").alias(f"a{g}") for g in range(len(groups))))


def one_hot(wide: DataFrame, items: Sequence[tuple[int, int]]) -> DataFrame:
    """tid and a 0/1 column for each item."""
    return wide.select("tid", *((F.col(f"a{a}") == v).cast("int").alias(f"a{a}_{v}") for a, v in items))


#: Slices of the hashes among which the last one that a sample takes is found.
SAMPLE_SLICES = 1 << 16


def sample_rows(wide: DataFrame, n: int, seed: int | None) -> DataFrame:
    """n rows, uniformly by a keyed hash of tid; without a seed the first n by tid.

    Rows are counted by slices of the hash, and only the slice where the n-th row lies is ordered. That row bounds the sample, so
    that a scan of the sample is one of the table.
    """
    if seed is None:
        return wide.orderBy("tid").limit(n)
    u = uniform(seed, "row", F.col("tid"))
    piece = F.floor(u * SAMPLE_SLICES)
    sizes = sorted((r["piece"], r["count"]) for r in wide.select(piece.alias("piece")).groupBy("piece").count().collect())  # a row for each slice
    left = n
    for last, size in sizes:
        if size > left:
            break
        left -= size
    else:
        return wide
    if not left:
        return wide.where(piece < last)
    ordered = wide.where(piece == last).select(u.alias("u"), "tid").orderBy("u", "tid").limit(left + 1)
    over, end = ordered.orderBy(F.desc("u"), F.desc("tid")).limit(2).collect()
    if over == end:  # rows with one tid on both sides of the bound
        return wide.where(piece < last).union(wide.where(piece == last).orderBy(u, "tid").limit(left))
    return wide.where((u < F.lit(end["u"])) | ((u == F.lit(end["u"])) & (F.col("tid") <= F.lit(end["tid"]))))


def sample_share(wide: DataFrame, ratio: float, seed: int | None) -> DataFrame:
    """max(1, round half even(rows * ratio)) rows."""
    return sample_rows(wide, max(1, round(max(wide.count(), 1) * ratio)), seed)
