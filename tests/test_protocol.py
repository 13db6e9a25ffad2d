"""Candidates, keys, budgets, sketches, estimators and whole methods."""

import json
import math
from collections import Counter
from dataclasses import replace
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil import queries
from tallyveil.operators import binning, budget, candidates, counts, estimate, keys, metrics, randomizer, sketch, wire
from tallyveil.operators.candidates import Candidate
from tallyveil.operators.estimate import blocks_of, estimate_candidates
from tallyveil.plans import config, protocol
from tallyveil.sources import files
from tallyveil.sources.results import ResultTable
from tallyveil.streaming import incremental

ITEMSET = "itemset array<struct<attr:int,value:bigint>>"


def pool_of(spark, items):
    return spark.createDataFrame([(*i, float(c)) for i, c in items], "attr int, value bigint, noisy double")


def table(spark, rows):
    return spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(rows)], "tid long, " + ", ".join(f"a{k} long" for k in range(len(rows[0]))))


# candidates and keys


def test_candidate_scores(spark):
    found = candidates.collect_candidates(candidates.ranked_candidates(pool_of(spark, [((0, 1), 80), ((1, 1), 50)]), 100, 3, 1, 2))
    pair = next(c for c in found if len(c.itemset) == 2)
    assert pair.score == pytest.approx(0.9 * (0.9 * 50 / 80)) and pair.guess == pytest.approx(40)
    assert candidates.ranked_candidates(pool_of(spark, [((0, 1), -3)]), 100, 3, 1, 2).count() == 0
    with pytest.raises(ValueError):
        candidates.enough(found, 2.0, 15)


@pytest.mark.parametrize("seed", range(6))
def test_pruned_search_equals_full(spark, seed):
    rng = np.random.default_rng(seed)
    items = [((k % 4, k), float(rng.integers(-5, 130))) for k in range(10)] + [((0, 99), 50.0), ((1, 99), 50.0)]
    full = candidates.collect_candidates(candidates.ranked_candidates(pool_of(spark, items), 100, 12, 1, 3))
    found, info = candidates.search(items, 100.0, 12, 1, 3)
    assert [c.itemset for c in found] == [c.itemset for c in full] and info["visited"] > 0


def test_joint_first_keeps_a_single_item(spark):
    pool = pool_of(spark, [((a, 0), 90 - a) for a in range(5)])
    some = [c for c in candidates.joint_first_candidates(pool, 100, 4, 1, 2).collect()]
    assert sorted(len(r.itemset) for r in some) == [1, 2, 2, 2]
    every = candidates.joint_first_candidates(pool, 100, None, 1, 2).collect()
    assert [len(r.itemset) for r in every][-5:] == [1] * 5


CANDIDATES = [Candidate(((0, 1),), 0.9, 60.0), Candidate(((0, 1), (1, 1)), 0.7, 40.0), Candidate(((1, 1), (2, 0)), 0.5, 20.0), Candidate(((0, 1), (1, 1), (2, 0)), 0.3, 10.0)]


def test_report_keys(spark):
    single = [((0, 1),), ((1, 1),)]
    assert keys.report_keys(CANDIDATES, (0, 1), keys.SINGLE) == single
    assert keys.report_keys(CANDIDATES, (0, 1), keys.LOCAL) == [((0, 1),), ((0, 1), (1, 1)), ((1, 1),)]
    noisy = {(0, 1): 60.0, (1, 1): 50.0, (2, 0): 30.0}
    assert keys.report_keys(CANDIDATES, (0, 1), keys.MIXED, limit=2, noisy=noisy, n=100.0) == single
    assert len(keys.report_keys(CANDIDATES, (0, 1), keys.MIXED, limit=0, noisy=noisy, n=100.0)) == 3
    assert ((0, 1), (1, 1)) in keys.report_keys(CANDIDATES, (0, 1), keys.LOCAL_TOP, top=1)
    assert keys.report_keys(CANDIDATES, (0, 1), keys.LOCAL_TOP, top=0) == single
    covered = keys.report_keys(CANDIDATES, (0, 1), keys.COVER, limit=3, noisy=noisy, n=100.0)
    assert ((0, 1), (1, 1)) in covered and ((0, 1),) in covered
    local = table(spark, [[1, 1], [1, 0], [0, 1], [0, 1]])
    assert keys.report_keys(CANDIDATES, (0, 1), keys.RAW_SINGLE, limit=1, local=local) == [((1, 1),)]
    assert keys.report_keys(CANDIDATES, (0, 1), keys.RAW_PARTS, limit=1, local=local) == [((1, 1),)]
    domain = {0: [0, 1, 2], 1: [0, 1], 2: [0, 1]}
    sizes = {e: sum(len(keys.report_keys(CANDIDATES, attrs, keys.SINGLE, estimator=e, domain=domain)) for attrs in ((0,), (1, 2))) for e in ("fm_full", "fm_other")}
    assert sizes == {"fm_full": 7, "fm_other": 6}
    for wrong in (dict(mode=keys.MIXED), dict(mode=keys.LOCAL_TOP), dict(mode=keys.RAW_SINGLE), dict(mode="none")):
        with pytest.raises(ValueError):
            keys.report_keys(CANDIDATES, (0, 1), **wrong)


def test_key_tables_equal_lists(spark, sf):
    wide, noisy, best = queries._noisy_candidates(spark, sf)
    found, n = candidates.collect_candidates(best), float(wide.count())
    items = {(r["attr"], r["value"]): r["noisy"] for r in noisy.collect()}
    for mode, limit in ((keys.SINGLE, 0), (keys.LOCAL, 0), (keys.MIXED, 4)):
        rows = keys.key_table(best, queries._owners(spark), mode, noisy, n, limit).collect()
        got = sorted((r["client"], tuple((x["attr"], x["value"]) for x in r["key"])) for r in rows)
        want = sorted((c, k) for c, attrs in enumerate(queries.PARTS) for k in keys.report_keys(found, attrs, mode, limit=limit, noisy=items, n=n))
        assert got == want


# budgets


def test_budgets():
    some = [((0, 1),), ((0, 2),), ((0, 1), (1, 3))]
    assert budget.split_grouped(1.0, 1e-5, some)[some[0]] == (0.5, 5e-6)
    assert sum(e for e, _ in budget.split_weighted(1.0, 1e-5, [1, 4, 5])) == pytest.approx(1.0)
    assert budget.overlap_bound(some) == 2 and budget.group_bound(some) == 2
    a = budget.overlap_account(2048, 1e-5, {0: 2}, {0: budget.coordinate_epsilon(1.0, 1e-5, 2048)})
    log, slope = math.log(1e5), 2 * 2048 * 2 * budget.coordinate_epsilon(1.0, 1e-5, 2048) ** 2
    order = max(2.0, 1 + math.sqrt(log / slope))
    assert a["rdp_epsilon"] == pytest.approx(slope * order + log / (order - 1))
    assert budget.overlap_account(8, 1e-5, {0: 0}, {0: 1.0})["rdp_epsilon"] == 0
    p = budget.phases(1.0, 1e-5, 4, 0.5, 0.1)
    assert budget.certificate({k: 4 * v for k, v in p.items() if k[0] == "e"}, 1.0)
    for wrong in (lambda: budget.split_equal(0, 1e-5, 1), lambda: budget.split_equal(1, 2, 1), lambda: budget.split_weighted(1, 1e-5, [0])):
        with pytest.raises(ValueError):
            wrong()


# bins


def test_bins(spark):
    assert binning.mass_bins(range(6), [50, 30, 10, 5, 3, 2], 3) == [[0], [1], [2, 3, 4, 5]]
    plan = {0: binning.mass_bins(range(6), [50, 30, 10, 5, 3, 2], 3)}
    noisy = {(0, v): float(c) for v, c in enumerate([50, 30, 10, 5, 3, 2])}
    assert binning.share_in_bin((0, 2), plan, noisy) == 0.5
    assert binning.even_bins(range(5), 2) == [[0, 1, 2], [3, 4]] and binning.mass_bins(range(4), [0] * 4, 2) == [[0, 1], [2, 3]]
    alone = binning.protected_plan({0: list(range(6))}, noisy, 4, {(0, 5): 0.9, (0, 3): 0.8, (0, 1): 0.7})
    assert [5] in alone[0] and [3] in alone[0] and len(alone[0]) == 4
    binning.check_plan(alone, {0: range(6)})
    with pytest.raises(ValueError):
        binning.check_plan({0: [[0, 1], [1]]}, {0: [0, 1]})
    assert binning.binned(((0, 2),), plan) == ((0, 2),)
    assert wire.binning_message(plan) == 4 + 6 + 2 * 8 and wire.binning_message({0: [[0, 2], [1]]}) == 4 + 6 + 2 + 16 + 2 + 8


# sketches and estimators


def released(masks, m, epsilon, complement=False):
    ids, ranks = np.arange(len(masks[0])), None
    from tallyveil.functions.prf import geometric_rank_array

    ranks = geometric_rank_array(ids, np.arange(m), 7)
    return [sketch.release(0, ((k, 1),), ranks[mask].max(0) if mask.any() else np.zeros(m), epsilon, 1e-5, 1.0, 100 + k, complement) for k, mask in enumerate(masks)]


def test_sketches_do_not_depend_on_partitions(spark):
    rows = np.random.default_rng(1).integers(0, 2, (500, 2))
    wide, some = table(spark, rows), [((0, 1),), ((0, 1), (1, 0)), ((0, 7),)]
    found = [sketch.clean_sketches(wide.repartition(n), [counts.matches(s) for s in some], 32, 5) for n in (1, 5)]
    assert (found[0] == found[1]).all() and (found[0][2] == 0).all()
    small = {(r["key"], r["j"]): r["rank"] for r in sketch.sketch_table(wide, {str(k): counts.matches(s) for k, s in enumerate(some)}, 32, 5).collect()}
    assert all(small[str(k), j] == found[0][k, j] for k in range(3) for j in range(32))


def test_intersections_by_likelihood():
    users = np.arange(1000)
    a, b = users < 600, (users >= 350) & (users < 900)
    left, right = released([a, b], 2048, 200.0)
    assert abs(sketch.joint_map([left, right], 1000, 1.0, 1, 1500) - 250) <= 40
    assert abs(sketch.marginal_map(left.alpha, left.phantoms, left.floor, 1000, 1.0, 1, 1500) - 600) <= 60
    both = released([a & b], 2048, 200.0)[0]
    nested = sketch.nested_map(left, right, both, 1000, 1.0, 1, 1500)
    assert abs(nested - 250) <= 45
    hidden = released([~a, ~b], 2048, 200.0, complement=True)
    assert abs(sketch.complement_map(hidden, 1000, 1.0, 1, 1500) - 250) <= 60
    with pytest.raises(ValueError):
        sketch.joint_map(hidden, 1000, 1.0, 1, 1500)
    assert sketch.category_inverse([], 1000, 1.0) == 1000 and sketch.complement_map([], 1000, 1.0, 1, 10) == 0


def test_adaptive_search_equals_dense():
    users = np.arange(600)
    reports = released([users < 400, (users >= 120) & (users < 470), (users >= 220) & (users < 520)], 512, 50.0)
    assert sketch.joint_map(reports, 600, 1.0, 1, 1500) == sketch.joint_map(reports, 600, 1.0, 1, 1500, adaptive=False)
    sizes, asked = np.arange(0, 10_000, 3.0), []
    hill = lambda x: (asked.append(len(x)), -np.abs(x - 6204.0) - np.where(x > 6204, x / 7, 0))[1]
    assert sketch._first_max(sizes, hill) == 6204.0 and sum(asked) < 120
    assert sketch._first_max(sizes, lambda x: -x) == 0.0 and sketch._first_max(sizes, lambda x: x) == sizes[-1] and sketch._first_max(sizes[:1], lambda x: x) == 0.0


def test_bounds_and_grids():
    assert sketch.bounds([650, 550], 1050) == (150, 550)
    assert sketch.grid(0, 5, 10).tolist() == [0.0] and sketch.grid(12.5, 5, 100).tolist() == [0, 5, 10, 12.5]
    assert sketch.bounded_grid(3, 10, 5, 100).tolist() == [3, 8, 10] and sketch.bounded_grid(4, 4, 5, 10).tolist() == [4.0]
    assert sketch.log_cdf(np.array([0.0, 1.0]), 1.0).tolist() == [-np.inf, pytest.approx(math.log(0.5))]


def test_blocks_fall_back_to_items():
    owner, whole = {0: 0, 1: 0, 2: 1}, ((0, 1), (1, 1), (2, 0))
    known = {(0, ((0, 1), (1, 1))), (1, ((2, 0),))}
    assert blocks_of(whole, owner, keys.MIXED, known) == (((0, 1), (1, 1)), ((2, 0),))
    parts = {(0, ((0, 1),)), (0, ((1, 1),)), (1, ((2, 0),))}
    assert blocks_of(whole, owner, keys.MIXED, parts) == (((0, 1),), ((1, 1),), ((2, 0),))
    assert blocks_of(whole, owner, keys.MIXED, {(1, ((2, 0),))}) is None
    assert blocks_of(whole, owner, keys.SINGLE, parts - {(0, ((0, 1),))}) is None


def test_bin_recovery():
    plan = {0: [[0, 1, 2], [3]], 1: [[0, 1], [2, 3]]}
    noisy = {(0, 0): 9.0, (0, 1): 1.0, (1, 2): 8.0, (1, 3): 2.0}
    assert binning.share_in_bin((0, 0), plan, noisy) * binning.share_in_bin((1, 2), plan, noisy) == pytest.approx(0.9 * 0.8)
    one = [Candidate(((0, 0), (1, 2)), 0.5, 6.0), Candidate(((0, 1), (1, 2)), 0.4, 2.0)]
    key = ((0, 0), (1, 1))
    report = sketch.release(0, key, np.full(64, 9.0), 50.0, 1e-5, 1.0, 3)
    found = {e.itemset: e.estimate for e in estimate_candidates(one, [report], {0: 0, 1: 0}, 100.0, keys.PROTECTED, plan=plan, noisy=noisy)}
    whole = sketch.marginal_map(report.alpha, report.phantoms, report.floor, 100.0, 1.0, 5, 1500)
    assert found[one[0].itemset] == pytest.approx(whole * 0.75)


def test_dummy_joint_reports_are_ignored():
    report = sketch.release(0, ((0, 1), (1, 1)), np.full(64, 5.0), 50.0, 1e-5, 1.0, 3, used=False)
    assert estimate_candidates([Candidate(((0, 1), (1, 1)), 0.5, 6.0)], [report], {0: 0, 1: 0}, 100.0, keys.DUMMY) == []


# the local randomizer


def test_unary_encoding(spark):
    rows = spark.range(20000).select(F.col("id").alias("tid"), (F.col("id") % 4).alias("a0"))
    sums = randomizer.column_sums(rows, {0: [0, 1, 2, 3]}, 1.0, 3)
    for r in sums.select(randomizer.debiased(F.col("ones"), F.col("rows"), 1.0).alias("n")).collect():
        assert abs(r["n"] - 5000) < 600
    wide = spark.range(40000).select(F.col("id").alias("tid"), (F.col("id") < 22000).cast("int").alias("a0"), ((F.col("id") >= 10000) & (F.col("id") < 30000)).cast("int").alias("a1"))
    blocks = [(F.col("a0") == 1, 6.0, "x"), (F.col("a1") == 1, 6.0, "y")]
    both = randomizer.intersections(wide, [blocks, [], blocks[:1]], 40000, 8).first()
    assert abs(both.e0 - 12000) < 900 and both.e1 == 0 and abs(both.e2 - 22000) < 900


def test_unary_intersections_are_the_same_however_rows_are_dealt(spark):
    wide = spark.range(5000).select(F.col("id").alias("tid"), (F.col("id") % 3).alias("a0"), (F.col("id") % 5).alias("a1"))
    blocks = [(F.col("a0") == 1, 0.3, "x"), (F.col("a1") < 3, 0.7, "y"), (F.col("a0") < 2, 0.4, "z")]
    sets = [blocks, blocks[1:], [], [blocks[0], blocks[0]]]
    found = {tuple(randomizer.intersections(wide.repartition(n, "tid"), sets, 10**9, 8).first()) for n in (1, 3, 7)}
    assert len(found) == 1  # sums of products differed in their last digits
    digest = randomizer.digest(8, "bits", 0, F.col("tid"))
    rows = wide.select(*(randomizer.cut_bit(digest, k, t, e).alias(name) for k, (t, e, name) in enumerate(blocks))).collect()
    for some, x in zip(sets, found.pop(), strict=True):
        cells = [(name, *map(Fraction, randomizer.parameters(e))) for _, e, name in some]
        exact = sum(math.prod((r[name] - q) / (p - q) for name, p, q in cells) for r in rows) if some else 0
        assert x == float(min(max(exact, 0), 10**9))


# metrics


def test_metrics(spark):
    truth = spark.createDataFrame([([(0, 1)], 100), ([(0, 2)], 90), ([(1, 1)], 10)], f"{ITEMSET}, support bigint")
    found = spark.createDataFrame([([(0, 1)], 190.0)], f"{ITEMSET}, estimate double")
    row = metrics.evaluate(truth, found, 2, 200).first()
    assert (row.recall, row.precision, row.candidate_recall, row.mae, row.nmae) == (0.5, 1.0, 0.5, 90.0, 0.45)
    assert row.ncr == pytest.approx(2 / 3)
    none = metrics.evaluate(truth, found.limit(0), 2, 200).first()
    assert (none.f1, none.mae, none.ncr) == (0.0, 0.0, 0.0)
    runs = spark.createDataFrame([("d", "k", 1.0, "m", s, float(s)) for s in (1, 3)] + [("d", "k", 2.0, "m", 1, 5.0)], "dataset string, axis string, value double, method string, seed int, f1 double")
    out = {r.value: r for r in metrics.summarize(runs, ["f1"]).collect()}
    assert out[1.0].f1_std == pytest.approx(math.sqrt(2)) and out[2.0].f1_std == 0 and out[1.0].f1_mean == 2
    with pytest.raises(Exception, match="seed"):
        metrics.summarize(runs.union(runs), ["f1"]).collect()
    ties = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert metrics.spearman(ties, "a", "b").first()[0] == 0.0


def test_message_sizes():
    assert wire.text_bytes("client_0") == 10 and wire.itemset_bytes(2) == 26
    assert wire.preflight(4, [1, 2, 2], 3)["public_items"] == 5


# whole methods


@pytest.fixture(scope="module")
def owned(spark):
    return protocol.prepare(files.toy(spark), config.Config(config.Data(clients=2)))


@pytest.mark.parametrize("method", config.METHODS)
def test_methods(spark, owned, method):
    p = config.Protocol(k=4, m=64, epsilon=40.0, max_size=2, first_k=8)
    found, info = protocol.run_method(owned, p, method)
    assert len(found) >= 4 and info["candidate_count"] >= 8 and 1000 < info["noisy_n"] < 1400
    assert found == sorted(found, key=lambda e: (-e.estimate, e.itemset))
    if method in ("Second-round", "Items-only"):
        assert info["report_keys"] == (16 if method == "Items-only" else 2 * 64)
    scores = protocol.audit(owned, found, p)
    assert 0 <= scores["f1"] <= 1 and scores["mse"] == pytest.approx(scores["rmse"] ** 2)
    if method.startswith("MAP"):
        assert scores["f1"] >= 0.5


@pytest.mark.parametrize("mode", [keys.BINNED, keys.PROTECTED, keys.COVER, keys.DUMMY, keys.LOCAL_TOP, keys.RAW_SINGLE, keys.RAW_PARTS, keys.COMPLEMENT])
def test_modes(owned, mode):
    p = config.Protocol(k=4, m=64, epsilon=40.0, max_size=2, first_k=8, bins=2, top_joint=2, modes=(mode,))
    found, info = protocol.two_round(owned, p, mode)
    assert found and info["report_keys"] > 0 and info["communication_bytes"] > 0


def test_upload_limits(spark):
    rows = [(i % 2, i % 2, i // 3 % 2, i // 4 % 2) for i in range(120)]
    owned = protocol.prepare(table(spark, rows), config.Config(config.Data(clients=2)))
    counted = {}
    for limit in (None, 3, 1, 0, 99):
        p = config.Protocol(k=3, m=32, epsilon=20.0, max_size=3, upload_limit=limit)
        counted[limit] = protocol.two_round(owned, p, keys.MIXED)[1]["report_keys"]
    assert counted[1] == 2 and counted[0] == counted[99] >= counted[3] == counted[None]


def test_configuration(tmp_path):
    for wrong in (config.Config(config.Data(clients=0)), config.Config(protocol=config.Protocol(k=1)), config.Config(protocol=config.Protocol(modes=(keys.BINNED,))), config.Config(config.Data(max_rows=3, sample_ratio=0.5))):
        with pytest.raises(ValueError):
            wrong.check()
    (tmp_path / "c.json").write_text(json.dumps({"data": {"path": "x.csv", "attribute_ratios": [1, 1, 1, 1]}, "protocol": {"modes": [keys.SINGLE]}}))
    found = config.load(tmp_path / "c.json")
    assert found.data.path == str((tmp_path / "x.csv").resolve()) and found.protocol.modes == (keys.SINGLE,)
    for name, value in (("k", 1), ("epsilon", 0.0), ("m", 4), ("pruning", "some"), ("modes", ("other",)), ("phase1_ratio", 1.0), ("multiplier", math.inf), ("min_size", 5)):
        assert config.Config(protocol=replace(config.Protocol(), **{name: value})).faults()
    assert config.Config().faults() == [] and len(config.Config(config.Data(clients=0, sample_ratio=2.0)).faults()) == 2


def test_points_of_sweeps():
    """Each axis in full, its default point among them; what must be run is less, and says all axes that it is for."""
    base = config.Config()
    every = config.points(base, tables=("custom",))
    assert len(every) == 53 and {x.axis for x in every} == {a.name for a in config.SWEEPS.values()}
    assert [x.config.protocol.k for x in every if x.axis == "k"] == [5, 10, 15, 20, 25]
    found = config.cases(base)
    assert len(found) < 53 and sum(len(c.axes) for c in found) == 53
    shared = next(c for c in found if len(c.axes) > 1)
    assert {"epsilon", "k", "clients", "mechanism"} <= set(shared.axes)
    assert {x.table for x in config.points(base, [4])} == {"Bank", "DefaultCredit"} and len(config.points(base, [1], seeds=(1, 2), values=(3.0,))) == 4
    assert every[-1].methods == ("First-round", "Second-round", "MAP-M")
    assert config.at(base, "second_stage_pool", 0.5).protocol.upload_limit == 8 and config.at(base, "second_stage_pool", 0.5).protocol.report_limit == 15
    with pytest.raises(ValueError, match="exclude"):
        config.at(config.Config(config.Data(max_rows=5)), "sample_ratio", 0.5)
    with pytest.raises(ValueError, match="unknown axis"):
        config.at(base, "colour", 1)


def test_large_grid():
    found = config.grid_cases(config.Config(), seeds=(1,))
    assert {a for c in found for a in c.axes} == set(config.GRID_AXES) and len(config.GRID_AXES) == 20
    default = [c for c in found if c.table == "Retail" and {"k", "epsilon", "dataset"} <= set(c.axes)]
    assert len(default) == 1 and {"m", "clients", "budget_split", "pruning"} <= set(default[0].axes)
    assert sum("attribute_ratio" in c.axes for c in found) == 10
    dense = config.grid_cases(config.Config(), seeds=(1,), dense=True)
    assert {a for c in dense for a in c.axes} == set(config.DENSE) and sum("k" in c.axes for c in dense) == 5
    assert len(config.grid_cases(config.Config(), ["k"], (1, 2), ("A", "B"), ks=(3, 7, 3))) == 8
    for wrong in (dict(axes=["colour"]), dict(axes=["clients"], dense=True), dict(ks=(1,))):
        with pytest.raises(ValueError):
            config.grid_cases(config.Config(), **wrong)
    local = config.randomizer_cases(config.Config(), ("A", "B"), (1,))
    assert {c.table for c in local} == {"A", "B"} and {a for c in local for a in c.axes} == set(config.RANDOMIZER_AXES)
    with pytest.raises(ValueError, match="randomizer"):
        config.randomizer_cases(config.Config(), ("A",), axes=["m"])


def test_seeds_draw_different_samples(spark):
    wide = files.toy(spark, 200)
    base = config.Config(config.Data(clients=2))

    def drawn(axis, value, seed):
        owned = protocol.prepare(wide, config.at(base, axis, value, seed))
        return sorted(map(tuple, owned.wide.collect()))

    for axis, value in (("sample_ratio", 0.3), ("feature_ratio", 0.5)):
        assert drawn(axis, value, 1) == drawn(axis, value, 1) != drawn(axis, value, 2)


def test_sweeps_resume(spark, tmp_path, monkeypatch):
    wide = files.toy(spark, 300)
    base = config.Config(config.Data(clients=2), config.Protocol(k=2, m=16, epsilon=30.0, max_size=2))
    ran = []
    whole = protocol.run_cases
    monkeypatch.setattr(protocol, "run_cases", lambda wide, cases, **k: (ran.extend(cases), whole(wide, cases, **k))[1])
    run = lambda **how: protocol.sweep(wide, base, [3, 11], ["First-round"], folder=str(tmp_path), **how)
    first = run()
    assert [(r["axis"], r["value"]) for r in first] == [("clients", 2.0), ("clients", 4.0), ("clients", 8.0), ("mechanism", 1.0)]
    assert len(ran) == 3 and run() == first and len(ran) == 3  # two clients are the default of the mechanism axis too
    status = json.loads((tmp_path / "experiment03_clients" / "status.json").read_text())
    assert status == {"status": "complete", "runs": 3, "datasets": ["custom"]}
    place = tmp_path / "experiment03_clients" / "custom" / "value_2" / "seed_2026" / "First-round.json"
    place.write_text(place.read_text().replace('"signature": "', '"signature": "0'))
    with pytest.raises(ValueError, match="another configuration"):
        run()
    with pytest.raises(KeyError, match="Bank"):
        protocol.sweep({"A": wide}, base, [4])
    rows = protocol.sweep({"A": wide, "B": wide}, base, [1], ["First-round"], names=["A", "B"], values=[30.0])
    assert {r["dataset"] for r in rows} == {"A", "B"} and len(rows) == 2


def test_a_killed_sweep_goes_on_from_its_table(spark, tmp_path, monkeypatch):
    """Committed batches are kept, rows without a marker don't count, another identity is refused, and no file but the table's is written."""
    wide = files.toy(spark, 300)
    base = config.Config(config.Data(clients=2), config.Protocol(k=2, m=16, epsilon=30.0, max_size=2))
    kept = ResultTable(spark, str(tmp_path / "results"))
    whole, ran = protocol.run_cases, []

    def dies(wide, cases, **k):
        if len(ran) == 2:
            raise KeyboardInterrupt
        ran.append(cases)
        return whole(wide, cases, **k)

    run = lambda c=base: protocol.sweep(wide, c, [3, 11], ["First-round"], results=kept)
    monkeypatch.setattr(protocol, "run_cases", dies)
    with pytest.raises(KeyboardInterrupt):
        run()
    assert len(ran) == 2 and kept.committed().count() >= 2
    lost = kept.committed().first()
    kept._write([(lost["group"], "experiment03_clients/custom/value_8/seed_2026/First-round", "f" * 64, "never marked", "{}")])
    monkeypatch.setattr(protocol, "run_cases", lambda wide, cases, **k: (ran.append(cases), whole(wide, cases, **k))[1])
    first = run()
    assert [(r["axis"], r["value"]) for r in first] == [("clients", 2.0), ("clients", 4.0), ("clients", 8.0), ("mechanism", 1.0)] and len(ran) == 3
    assert run() == first and len(ran) == 3
    other = ResultTable(spark, str(tmp_path / "results"))
    assert protocol.sweep(wide, base, [3, 11], ["First-round"], results=other) == first and len(ran) == 3
    with pytest.raises(ValueError, match="another configuration"):
        run(replace(base, protocol=replace(base.protocol, m=32)))
    assert {p.name for p in tmp_path.iterdir()} == {"results"}


def test_two_hills_are_searched_in_full():
    """Scores with several hills are tried at every size; one hill takes few scores."""
    sizes, asked = np.arange(2000.0), []

    def two(x):
        asked.append(len(x))
        return np.maximum(-np.abs(x - 300) / 50, 3 - np.abs(x - 1493) / 2)

    assert sketch._first_max(sizes, two) == 1493
    asked.clear()
    assert sketch._first_max(sizes, lambda x: (asked.append(len(x)), -np.abs(x - 700))[1]) == 700 and sum(asked) < 200


def test_a_fused_sweep_is_its_cases_one_by_one(spark, monkeypatch):
    """The same rows as run_case case by case, from one histogram, one pass of sketches for each seed, one exact top and one count of supports."""
    wide = files.toy(spark, 400)
    data = config.Data(clients=2)
    case = lambda method, **p: (config.Config(data, config.Protocol(k=4, m=32, max_size=2, **p)), method)
    cases = [case("MAP-M", epsilon=30.0), case("IE-Full", epsilon=9.0), case("First-round", epsilon=30.0), case("MAP-S", epsilon=30.0, phase1_ratio=0.3), case("MAP-L", epsilon=20.0, seed=7), case("Items-only", epsilon=40.0)]
    rest = lambda rows: [{k: v for k, v in r.items() if k != "total_seconds"} for r in rows]
    want = rest(protocol.run_case(wide, c, m) for c, m in cases)
    calls = Counter()

    def counted(module, name):
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: (calls.update([name]), whole(*a, **k))[1])

    for name in ("full_histogram", "top_itemsets", "supports"):
        counted(counts, name)
    counted(sketch, "folded_sketches")
    counted(protocol, "prepare")
    assert rest(protocol.run_cases(wide, cases)) == want
    assert calls == {"prepare": 1, "full_histogram": 1, "folded_sketches": 3, "top_itemsets": 1, "supports": 1}  # two seeds, and Items-only has its own keys
    with pytest.raises(ValueError, match="unknown method"):
        protocol.run_cases(wide, [case("no such method")])


def test_estimates_by_candidate_are_those_of_reports_at_hand(spark):
    """Released tables and estimates in the tasks give what the same reports give one by one; two runs in one table don't mix."""
    rng = np.random.default_rng(5)
    wide = table(spark, rng.integers(0, 2, (500, 4)) | (rng.random((500, 1)) < 0.4))
    keys_of = [((0, 1),), ((1, 1),), ((0, 1), (1, 1)), ((2, 1),), ((3, 1),)]
    runs = [[sketch.Asked(int(k[0][0] > 1), k, e, 1e-5, *sketch.parameters(e, 1e-5, 64), 100 + at) for at, k in enumerate(keys_of)] for e in (60.0, 12.0)]
    clean = sketch.folded_sketches(wide, [counts.matches(k) for k in keys_of], 64, 3)
    twice = [(k, a) for r in runs for k, a in enumerate(r)]
    alphas = sketch.released_table(clean, twice, 1.0)
    ranks = sketch.clean_sketches(wide, [counts.matches(k) for k in keys_of], 64, 3)
    some = [Candidate(((0, 1),), 0.9, 1.0), Candidate(((0, 1), (1, 1)), 0.5, 6.0), Candidate(((0, 1), (1, 1), (2, 1)), 0.4, 2.0), Candidate(((2, 1), (3, 1)), 0.4, 2.0), Candidate(((2, 0),), 0.1, 1.0)]
    owner = {0: 0, 1: 0, 2: 1, 3: 1}
    for estimator in ("map", "map_no_frechet", "map_bounds_only", "fm_other"):
        cases = [estimate.Case(r, 500.0, estimator, estimate.Search(), run * len(keys_of)) for run, r in enumerate(runs)]
        todo = [estimate.jobs(some, r, owner, keys.MIXED, estimator) for r in runs]
        found = estimate.estimate_tables(alphas, cases, todo)
        for r, jobs, values in zip(runs, todo, found, strict=True):
            reports = [sketch.release(a.client, a.key, x, a.epsilon, a.delta, 1.0, a.seed) for a, x in zip(r, ranks, strict=True)]
            want = estimate_candidates(some, reports, owner, 500.0, keys.MIXED, estimator)
            assert estimate.ranked(jobs, values, some, keys.MIXED) == want and len(want) >= 4
    assert found[0] != found[1]


def test_only_measured_rows_are_drawn(spark):
    runs = spark.createDataFrame([("d", "k", 5.0, "m", s, 0.5 + s / 10, 2.0**20, "measured") for s in (1, 2)], "dataset string, axis string, value double, method string, seed int, f1 double, communication_bytes double, result_kind string")
    found = metrics.plot_series(metrics.summarize(runs, ["f1", "communication_bytes"]))
    assert {r["metric"]: round(r["mean"], 6) for r in found.collect()} == {"f1": 0.65, "communication_bytes": 1.0}
    planned = runs.withColumn("result_kind", F.when(F.col("seed") == 1, F.lit("planned")).otherwise(F.col("result_kind")))
    for wrong in (planned, runs.limit(0)):
        with pytest.raises(ValueError, match="measured"):
            metrics.plot_series(metrics.summarize(wrong, ["f1"]))


def test_streams_equal_batches(spark, tmp_path):
    wide = table(spark, np.random.default_rng(0).integers(0, 3, (90, 2)))
    wide.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.source(spark, wide, str(tmp_path / "in"))
    members = {"k": counts.matches(((0, 1),))}
    got = incremental.run_to_table(incremental.histogram(stream), str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, counts.histogram(wide).collect()))
    got = incremental.run_to_table(incremental.sketch(stream, members, 8, 5), str(tmp_path / "c"))
    want = sketch.sketch_table(wide, members, 8, 5)
    assert sorted(map(tuple, got.select("key", "j", "rank").collect())) == sorted(map(tuple, want.select("key", "j", "rank").collect()))


def test_a_killed_stream_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    """A run that dies after a table was written but before the batch was done, a later run with more rows, and one with nothing new."""
    wide = table(spark, np.random.default_rng(1).integers(0, 3, (120, 2)))
    wide.where("tid < 80").repartition(4).write.parquet(str(tmp_path / "in"))
    count = lambda: incremental.histogram(incremental.source(spark, wide, str(tmp_path / "in")))
    writer = type(wide.write)
    whole, tables = writer.parquet, []

    def dies(self, path, *a, **k):
        whole(self, path, *a, **k)
        tables.append(path)
        if len(tables) == 3:
            raise RuntimeError("killed")

    monkeypatch.setattr(writer, "parquet", dies)
    with pytest.raises(Exception, match="killed"):
        incremental.run_to_files(count(), str(tmp_path), "h")
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, **k: (tables.append(path), whole(self, path, *a, **k))[1])
    rows = lambda df: sorted(map(tuple, df.select("attr", "value", "n").collect()))
    assert rows(incremental.run_to_files(count(), str(tmp_path), "h")) == rows(counts.histogram(wide.where("tid < 80")))
    assert tables[2] == tables[3] and len(tables) == 5  # the third batch was done again, in its own place
    wide.where("tid >= 80").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert rows(incremental.run_to_files(count(), str(tmp_path), "h")) == rows(counts.histogram(wide))
    assert rows(incremental.run_to_files(count(), str(tmp_path), "h")) == rows(counts.histogram(wide))


def test_registry():
    import __spark_entry__ as entry

    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 100


def test_command_line(spark, tmp_path):
    from tallyveil import cli

    assert cli.main(["prepare", "--output", str(tmp_path)], spark) == 0
    common = ["--csv", str(tmp_path / "toy"), "--width", "8", "--k", "3", "--m", "16", "--epsilon", "30", "--clients", "2", "--max-size", "2"]
    assert cli.main(["run", *common, "--methods", "First-round", "FO", "--output", str(tmp_path / "r")], spark) == 0
    assert spark.read.csv(str(tmp_path / "r" / "aggregated"), header=True).count() == 2
    assert cli.main(["suite", *common, "--methods", "First-round", "--experiments", "3", "--output", str(tmp_path / "s")], spark) == 0
    assert cli.main(["crypto", *common, "--max-rows", "40", "--bits", "256", "--output", str(tmp_path / "e")], spark) == 0
    told = json.loads((tmp_path / "e" / "custom.json").read_text())
    assert told["circuit"]["top"] == told["homomorphic"]["top"] and told["circuit"]["verified"] > 0
    assert cli.main(["crypto", *common, "--methods", "circuit", "--candidates", "public", "--output", str(tmp_path / "p")], spark) == 0
    assert json.loads((tmp_path / "p" / "custom.json").read_text())["circuit"]["f1"] == 1.0
    assert cli.main(["export", "--input", str(tmp_path / "p" / "custom.json"), "--ks", "1", "3", "--output", str(tmp_path / "k.json")], spark) == 0
    exported = json.loads((tmp_path / "k.json").read_text())["rows"]
    assert [(r["method"], r["k"], r["f1"], r["ncr"]) for r in exported] == [("circuit", 1, 1.0, 1.0), ("circuit", 3, 1.0, 1.0)]
    with pytest.raises(ValueError, match="top 3 only"):
        protocol.k_sweep(str(tmp_path / "p" / "custom.json"), [4])
    assert cli.main(["plot", "--input", str(tmp_path / "s" / "aggregated"), "--output", str(tmp_path / "plot")], spark) == 0
    assert spark.read.csv(str(tmp_path / "plot"), header=True).where("metric = 'f1'").count() == 3
    (tmp_path / "c.json").write_text(json.dumps({"data": {"path": "toy", "clients": 2}, "protocol": {"k": 3, "m": 16, "epsilon": 30.0, "max_size": 2}}))
    assert cli.main(["configured", "--config", str(tmp_path / "c.json"), "--width", "8", "--output", str(tmp_path / "c")], spark) == 0
    for wrong in (["--methods", "FO", "FO"], ["--max-rows", "0"], ["--seeds", "1", "1"]):
        with pytest.raises(SystemExit):
            cli.main(["run", *common, *wrong, "--output", str(tmp_path)], spark)
