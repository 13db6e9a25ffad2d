"""Ranking, error and candidate metrics, and their aggregation over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Support shares that bound the bands of errors.
BANDS = (("0-1%", 0.0, 0.01), ("1-5%", 0.01, 0.05), ("5-20%", 0.05, 0.20), ("20-100%", 0.20, 1.01))
#: Two-sided 95 % points of Student's t by degrees of freedom; more use 1.96.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ranked(truth: DataFrame, estimates: DataFrame, k: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """groups, itemset, support, estimate, place (in truth), guessed (place in estimates); null where one side lacks the itemset."""
    by = Window.partitionBy(*(F.col(g) for g in groups)) if groups else Window.partitionBy(F.lit(0))
    t = truth.select(*groups, "itemset", "support").withColumn("place", F.row_number().over(by.orderBy(F.desc("support"), "itemset")))
    e = estimates.select(*groups, "itemset", "estimate").withColumn("guessed", F.row_number().over(by.orderBy(F.desc("estimate"), "itemset")))
    return t.join(e, [*groups, "itemset"], "full")


def evaluate(truth: DataFrame, estimates: DataFrame, k: int, n: float | None = None, groups: tuple[str, ...] = ()) -> DataFrame:
    """precision, recall, f1, jaccard, ncr, mae, rmse, nmae, nrmse, candidate_recall.

    truth has (itemset, support), estimates (itemset, estimate). A predicted itemset that isn't
    estimated counts as missed: the true top k doesn't shrink. Without n errors are divided by the
    largest support.
    """
    rows = ranked(truth, estimates, k, groups)
    size = F.least(F.lit(k), F.count("place"))
    error = F.col("estimate") - F.col("support")
    sums = rows.groupBy(*groups).agg(
        size.alias("top"), F.least(F.lit(k), F.count("guessed")).alias("predicted"), F.count("estimate").alias("estimated"),
        F.count_if((F.col("place") <= k) & (F.col("guessed") <= k)).alias("both"),
        F.count_if((F.col("place") <= k) & F.col("guessed").isNotNull()).alias("covered"),
        F.coalesce(F.sum(F.when((F.col("place") <= k) & (F.col("guessed") <= k), F.col("place"))), F.lit(0)).alias("places"),
        F.coalesce(F.avg(F.abs(error)), F.lit(0.0)).alias("mae"), F.sqrt(F.coalesce(F.avg(error * error), F.lit(0.0))).alias("rmse"),
        F.coalesce(F.max("support"), F.lit(1)).alias("largest"),
    )
    p, r = _ratio(F.col("both"), F.col("predicted")), _ratio(F.col("both"), F.col("top"))
    score = F.col("both") * (F.col("top") + 1) - F.col("places")
    scale = F.lit(float(n)) if n else F.greatest(F.col("largest"), F.lit(1)).cast("double")
    return sums.select(
        *groups, p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"),
        _ratio(F.col("both"), F.col("top") + F.col("predicted") - F.col("both")).alias("jaccard"),
        _ratio(score, F.col("top") * (F.col("top") + 1) / 2).alias("ncr"), "mae", "rmse",
        (F.col("mae") / scale).alias("nmae"), (F.col("rmse") / scale).alias("nrmse"), _ratio(F.col("covered"), F.col("top")).alias("candidate_recall"),
    )


def by_size(truth: DataFrame, estimates: DataFrame, k: int, n: float) -> DataFrame:
    """evaluate for each number of items that both sides have; itemset is an array."""
    t, e = (x.withColumn("size", F.size("itemset")) for x in (truth, estimates))
    t = t.join(e.select("size").distinct(), "size", "left_semi")
    e = e.join(t.select("size").distinct(), "size", "left_semi")
    return evaluate(t, e, k, n, ("size",))


def by_band(truth: DataFrame, estimates: DataFrame, n: float) -> DataFrame:
    """band, count, mae, rmse, nrmse by the true share of rows."""
    share = F.col("support") / F.lit(float(max(n, 1)))
    band = F.coalesce(*(F.when((share >= lo) & (share < hi), F.lit(name)) for name, lo, hi in BANDS))
    rows = truth.join(estimates, "itemset").withColumn("band", band).where("band is not null")
    error = F.col("estimate") - F.col("support")
    return rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.sqrt(F.avg(error * error)) / F.lit(float(max(n, 1)))).alias("nrmse"),
    )


def average_rank(value: str) -> Column:
    """Rank with ties at their mean, from 1."""
    w = Window.orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(value)) - 1) / 2.0


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: correlation of average ranks, 0 for constant columns. Meant for tables of candidates, which one task ranks."""
    r = rows.select(average_rank(a).alias("x"), average_rank(b).alias("y"))
    scale = F.stddev_pop("x") * F.stddev_pop("y")
    return r.agg(F.coalesce(F.try_divide(F.covar_pop("x", "y"), scale), F.lit(0.0)).alias("spearman"))


def recall_by_size(truth: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """size, true_top_count, recalled, recall among the true top k."""
    top = truth.orderBy(F.desc("support"), "itemset").limit(k)
    found = candidates.select("itemset").distinct().withColumn("hit", F.lit(1))
    rows = top.join(found, "itemset", "left").groupBy(F.size("itemset").alias("size"))
    return rows.agg(F.count(F.lit(1)).alias("true_top_count"), F.count("hit").alias("recalled"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def tie_recall(truth: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """Recall that takes any itemset with the cutoff's support for one of those chosen at it, as many as were chosen."""
    top = truth.orderBy(F.desc("support"), "itemset").limit(k)
    cut = top.agg(F.min("support").alias("cutoff"), F.count(F.lit(1)).alias("top"))
    slots = top.crossJoin(F.broadcast(cut)).agg(F.count_if(F.col("support") == F.col("cutoff")).alias("slots"))
    hit = predicted.select("itemset").distinct().join(truth, "itemset").crossJoin(F.broadcast(cut))
    hits = hit.agg(F.count_if(F.col("support") > F.col("cutoff")).alias("sure"), F.count_if(F.col("support") == F.col("cutoff")).alias("tied"))
    return hits.crossJoin(slots).crossJoin(cut).select(_ratio(F.col("sure") + F.least("tied", "slots"), F.col("top")).alias("tie_recall"))


def sweep_k(truth: DataFrame, estimates: DataFrame, ks: list[int]) -> DataFrame:
    """k, f1, ncr for many k from one pair of rankings."""
    rows = ranked(truth, estimates, max(ks)).select("place", "guessed", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"))
    inside = (F.col("place") <= F.col("k")) & (F.col("guessed") <= F.col("k"))
    sums = rows.groupBy("k").agg(
        F.least("k", F.count("place")).alias("top"), F.least("k", F.count("guessed")).alias("predicted"),
        F.count_if(inside).alias("both"), F.coalesce(F.sum(F.when(inside, F.col("place"))), F.lit(0)).alias("places"),
    )
    score = F.col("both") * (F.col("top") + 1) - F.col("places")
    return sums.select("k", _ratio(2 * F.col("both"), F.col("top") + F.col("predicted")).alias("f1"), _ratio(score, F.col("top") * (F.col("top") + 1) / 2).alias("ncr"))


def mode_details(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """rank, itemset, estimate, support, error, guess of a mode's candidates."""
    place = F.row_number().over(Window.orderBy(F.desc("estimate"), "itemset"))
    return estimates.join(truth, "itemset").select(place.alias("rank"), "itemset", "estimate", "support", (F.col("estimate") - F.col("support")).alias("error"), "guess")


def summarize(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """dataset, axis, value, method, seeds, and of each metric mean and sample deviation (0 for one run). A seed twice in a group is an error."""
    aggs = [F.count(F.lit(1)).alias("seeds"), F.count_distinct("seed").alias("_different")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std")]
    if "result_kind" in runs.columns:
        aggs += [F.when(F.every(F.col("result_kind").eqNullSafe("measured")), F.lit("measured")).alias("result_kind")]
    out = runs.groupBy("dataset", "axis", "value", "method").agg(*aggs)
    seeds = F.when(F.col("seeds") == F.col("_different"), F.col("seeds")).otherwise(F.raise_error(F.lit("a seed occurs twice in a group")).cast("bigint"))
    return out.withColumn("seeds", seeds).drop("_different")


def aggregate_rows(runs: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """mean, deviation and half width of the 95 % interval of each metric; nulls and NaN are left out."""
    t = F.create_map(*(F.lit(x) for kv in T95.items() for x in kv))
    aggs = []
    for m in metrics:
        x = F.when(~F.isnan(m), F.col(m))
        n = F.count(x)
        point = F.coalesce(F.try_element_at(t, (n - 1).cast("int")), F.lit(1.96))
        std = F.coalesce(F.stddev_samp(x), F.lit(0.0))
        aggs += [F.avg(x).alias(f"{m}_mean"), std.alias(f"{m}_std"), F.when(n > 1, point * std / F.sqrt(n.cast("double"))).otherwise(F.lit(0.0)).alias(f"{m}_ci95")]
    return runs.groupBy(*groups).agg(*aggs)


#: What is summarised and drawn of runs, with the unit that a plot divides by.
SHOWN = {"f1": 1.0, "ncr": 1.0, "total_seconds": 1.0, "communication_bytes": float(1 << 20), "mse": 1.0, "frequency_mse": 1.0}


def plot_series(aggregated: DataFrame) -> DataFrame:
    """dataset, axis, metric, method, value, mean, deviation: the points of each line or bar, in the plots' units.

    Only measured rows may be drawn: a table without rows, or with a row that doesn't say so, is an error.
    """
    told = aggregated.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result_kind").eqNullSafe("measured")).alias("good")).first()
    if not told["n"] or told["good"] < told["n"]:
        raise ValueError("only tables of measured rows can be drawn")
    have = [m for m in SHOWN if f"{m}_mean" in aggregated.columns]
    points = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(f"{m}_mean") / SHOWN[m]).alias("mean"), (F.col(f"{m}_std") / SHOWN[m]).alias("deviation")) for m in have)))
    return aggregated.select("dataset", "axis", "method", F.col("value").cast("double").alias("value"), points.alias("x")).select("dataset", "axis", "x.metric", "method", "value", "x.mean", "x.deviation")
