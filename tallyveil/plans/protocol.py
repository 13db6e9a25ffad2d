"""Whole methods: from a coded table to ranked itemsets and their audit."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from pathlib import Path

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.itemsets import Item, Itemset
from ..operators import binning, budget, counts, encode, keys, metrics, partition, randomizer, sketch, wire
from ..operators.candidates import Candidate, collect_candidates, enough, frequent_items, joint_first_candidates, ranked_candidates
from ..operators.estimate import Case, Estimate, Search, blocks_of, estimate_tables, jobs, ranked, sizes_table
from ..sources.results import ResultTable
from .config import METHODS, TWO_ROUND, Config, Protocol


@dataclass(frozen=True)
class Owned:
    """A coded table, its public domains and who owns which attribute."""

    wide: DataFrame
    domain: dict[int, list[int]]
    parts: tuple[tuple[int, ...], ...]

    @property
    def owner(self) -> dict[int, int]:
        return partition.owner_map(self.parts)

    def owners(self) -> DataFrame:
        return partition.owner_table(self.wide.sparkSession, self.parts)


def prepare(wide: DataFrame, config: Config) -> Owned:
    """Sample, domain reduction, feature merge and partition, in that order. Domains are those of the whole table, but for merged features."""
    d = config.data
    seed = d.transform_seed if d.transform_seed is not None else d.sampling_seed
    domain = encode.domain_map(wide)
    if d.sample_ratio is not None:
        wide = encode.sample_share(wide, d.sample_ratio, d.sampling_seed)
    elif d.max_rows is not None:
        wide = encode.sample_rows(wide, d.max_rows, d.sampling_seed)
    if d.domain_ratio is not None and d.domain_ratio < 1:
        full = wide
        wide = encode.reduce_domains(full, d.domain_ratio, seed or 0)
        domain = {a: list(range(min(max(1, round(len(v) * d.domain_ratio)), len(v)))) for a, v in domain.items()}
    if d.feature_ratio is not None:
        groups = encode.merge_groups(len(domain), d.feature_ratio, d.clients, (seed or 0) + 7919)
        if len(groups) < len(domain):
            wide = encode.merge_features(wide, groups)
        domain = encode.domain_map(wide)
    count = len(domain)
    if d.clients > count:
        raise ValueError("more clients than attributes")
    sizes = partition.sizes_equal(count, d.clients) if d.attribute_ratios is None else partition.sizes_by_ratio(count, d.attribute_ratios)
    if d.strategy == "affinity":
        scores = {(r["left"], r["right"]): r["nmi"] for r in counts.mutual_information(wide).collect()}
        return Owned(wide, domain, tuple(partition.affinity(scores, count, sizes)))
    shuffled = d.strategy == "random" or d.strategy == "auto" and d.partition_seed is not None
    return Owned(wide, domain, tuple(partition.deal(partition.order_of(count, d.partition_seed if shuffled else None), sizes)))


class Scans:
    """What runs over one coded table share: its histogram, rows, exact tops and supports don't depend on budgets, splits, estimators or seeds.

    Each is read from the table once, however many runs ask for it. The histogram and the number of rows stay tables, for a
    run only takes noisy ones of them.
    """

    def __init__(self, owned: Owned):
        self.owned, self.held = owned, []
        self._tops: dict[tuple, list] = {}
        self._supports: dict[Itemset, int] = {}

    def _kept(self, table: DataFrame) -> DataFrame:
        self.held.append(table.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    @cached_property
    def histogram(self) -> DataFrame:
        spark = self.owned.wide.sparkSession
        domain = spark.createDataFrame([(a, v) for a, vs in self.owned.domain.items() for v in vs], "attr int, value bigint")
        return self._kept(counts.full_histogram(self.owned.wide, domain))

    @cached_property
    def rows(self) -> DataFrame:
        return self._kept(self.owned.wide.agg(F.count(F.lit(1)).alias("n")))

    def top(self, p: Protocol) -> list[tuple[Itemset, int]]:
        asked = (p.k, p.max_size, p.min_size)
        if asked not in self._tops:
            self._tops[asked] = counts.top_itemsets(self.owned.wide, *asked, domain=self.owned.domain)[0]
            self._supports |= dict(self._tops[asked])
        return self._tops[asked]

    def supports(self, itemsets: Sequence[Itemset]) -> dict[Itemset, int]:
        if more := sorted({i for i in itemsets if i not in self._supports}):
            self._supports |= counts.supports(self.owned.wide, more)
        return {i: self._supports[i] for i in itemsets}

    def release(self) -> None:
        for table in self.held:
            table.unpersist()


@dataclass(frozen=True)
class FirstRound:
    noisy: dict[Item, float]
    table: DataFrame
    n: float
    pool: list[tuple[Item, float]]
    candidates: list[Candidate]


def _noisy_n(owned: Owned, epsilon_n: float, seed: int, scans: Scans | None = None) -> float:
    rows = (scans or Scans(owned)).rows
    return randomizer.mean_rows(randomizer.noisy_rows(rows, len(owned.parts), epsilon_n, seed)).first()["noisy_n"]


def _choose(spark: SparkSession, table: DataFrame, n: float, p: Protocol, check: bool = True) -> tuple[list[tuple[Item, float]], list[Candidate]]:
    pool = frequent_items(table, p.first_k or p.k)
    held = [((r["attr"], r["value"]), r["noisy"]) for r in pool.collect()]
    if not held:
        return [], []
    pool = spark.createDataFrame([(*i, c) for i, c in held], "attr int, value bigint, noisy double")
    count = math.ceil(p.multiplier * p.k) if p.pruning == "topk" else None
    make = joint_first_candidates if p.first_mode == "itemset" else ranked_candidates
    found = collect_candidates(make(pool, n, count, p.min_size, p.max_size))
    if check and p.pruning == "topk":
        enough(found, p.multiplier, p.k)
    return held, found


def first_round(owned: Owned, p: Protocol, epsilon_counts: float, epsilon_n: float, check: bool = True, scans: Scans | None = None) -> FirstRound:
    """Noisy histograms and row number, and the candidates they make. Both epsilons are one client's."""
    spark, scans = owned.wide.sparkSession, scans or Scans(owned)
    table = randomizer.first_histogram(scans.histogram, owned.owners(), epsilon_counts, p.seed, p.report_limit)
    rows = [(r["attr"], r["value"], r["noisy"]) for r in table.collect()]  # public values: the protocol's own message
    held = spark.createDataFrame(rows, "attr int, value bigint, noisy double")
    n = _noisy_n(owned, epsilon_n, p.seed, scans)
    pool, candidates = _choose(spark, held, n, p, check)
    return FirstRound({(a, v): x for a, v, x in rows}, held, n, pool, candidates)


@dataclass(frozen=True)
class Wanted:
    """A report that a client is to make: what is public of it, and which rows are its members (`what` names them)."""

    asked: sketch.Asked
    what: tuple
    members: Column


def wanted_reports(owned: Owned, first: FirstRound, p: Protocol, mode: str, epsilon: float, delta: float, plan: binning.Plan | None = None) -> list[Wanted]:
    """Every client's keys of the second round, with their budgets and noise. epsilon and delta are one client's."""
    category, complement = p.estimator in ("fm_full", "fm_other"), p.estimator in ("fm", "fm_inverse")
    out: list[Wanted] = []
    members = binning.members(plan) if plan else {}
    for client, attrs in enumerate(owned.parts):
        limit = p.k if p.upload_limit is None else p.upload_limit
        chosen = keys.report_keys(first.candidates, attrs, mode, limit=limit, top=p.top_joint, noisy=first.noisy, n=first.n, local=owned.wide, estimator=p.estimator, domain=owned.domain)
        if not chosen:
            continue
        if plan:
            chosen = sorted({binning.binned(k, plan) for k in chosen})
        mixed = mode in keys.MIXED_MODES and not category
        shares = budget.key_budgets(chosen, epsilon, delta, mixed, p.mixed_weight, 1.0 if category else p.joint_weight)
        targets = keys.target_values(first.candidates, attrs)
        for key in chosen:
            if category:
                others = tuple(sorted(targets[key[0][0]]))
                what, truth = ("category", key, others), counts.matches_category(key[0], others)
            elif plan:
                what, truth = ("bins", tuple((a, tuple(members[a, b])) for a, b in key)), counts.matches_bins(key, members)
            else:
                what, truth = ("all", key, complement), ~counts.matches(key) if complement else counts.matches(key)
            shared = f"{mode}_bin_{p.bins}" if plan else _shared(mode, key)
            seed = sketch.report_seed(p.seed, client, p.estimator, shared, key)
            used = not (mode == keys.DUMMY and len(key) > 1)
            asked = sketch.Asked(client, key, *shares[key], *sketch.parameters(*shares[key], p.m, p.gamma), seed, complement, used)
            out.append(Wanted(asked, what, truth))
    return out


def released(owned: Owned, wanted: Sequence[Wanted], m: int, seed: int, gamma: float) -> DataFrame:
    """report (place in wanted) and alpha: all reports from one pass over the rows; rows that several reports are about are sketched once."""
    members: dict[tuple, Column] = {}
    for w in wanted:
        members.setdefault(w.what, w.members)
    place = {what: k for k, what in enumerate(members)}
    clean = sketch.folded_sketches(owned.wide, list(members.values()), m, seed, gamma)
    return sketch.released_table(clean, [(place[w.what], w.asked) for w in wanted], gamma)


def _shared(mode: str, key: Itemset) -> str:
    """The mode whose noise a key uses, so that modes differ by their keys and not by chance."""
    if len(key) == 1 and mode in (keys.LOCAL_TOP, keys.MIXED, keys.BINNED, keys.PROTECTED, keys.COVER):
        return keys.SINGLE
    return keys.MIXED if mode in (keys.COVER, keys.DUMMY) else mode


@dataclass(frozen=True)
class Run:
    """A two-round method after its first round."""

    p: Protocol
    mode: str
    first: FirstRound
    plan: binning.Plan | None
    wanted: list[Wanted]


def open_run(owned: Owned, p: Protocol, mode: str, scans: Scans) -> Run:
    shares = budget.phases(p.epsilon, p.delta, len(owned.parts), p.phase1_ratio, p.noisy_n_ratio)
    first = first_round(owned, p, shares["epsilon_counts"], shares["epsilon_n"], scans=scans)
    plan = None
    if mode in (keys.BINNED, keys.PROTECTED):
        scores: dict[Item, float] = {}
        for c in first.candidates:
            for i in c.itemset:
                scores[i] = max(c.score, scores.get(i, 0.0))
        plan = binning.protected_plan(owned.domain, first.noisy, p.bins, scores) if mode == keys.PROTECTED else binning.quantile_plan(owned.domain, first.noisy, p.bins)
    return Run(p, mode, first, plan, wanted_reports(owned, first, p, mode, shares["epsilon_reports"], shares["delta_reports"], plan))


def close_runs(owned: Owned, runs: Sequence[Run]) -> list[tuple[list[Estimate], dict]]:
    """The second round and the estimates of all runs: one pass over the rows for all that share ranks, and one estimation by candidate."""
    out: dict[int, tuple[list[Estimate], dict]] = {}
    groups: dict[tuple, list[int]] = {}
    for k, run in enumerate(runs):
        groups.setdefault((run.p.m, run.p.seed, run.p.gamma), []).append(k)
    for shared, some in groups.items():
        cases, todo, wanted = [], [], []
        for run in (runs[k] for k in some):
            asked = [w.asked for w in run.wanted]
            cases.append(Case(asked, run.first.n, run.p.estimator, Search(run.p.gamma, run.p.step, run.p.points), len(wanted)))
            todo.append(jobs(run.first.candidates, asked, owned.owner, run.mode, run.p.estimator, run.plan))
            wanted += run.wanted
        alphas = released(owned, wanted, *shared).persist(StorageLevel.MEMORY_AND_DISK) if wanted else None
        values = estimate_tables(alphas, cases, todo) if wanted else [[] for _ in some]
        if wanted:
            alphas.unpersist()
        for k, jobs_of, found in zip(some, todo, values, strict=True):
            run, asked = runs[k], [w.asked for w in runs[k].wanted]
            best = ranked(jobs_of if wanted else [], found, run.first.candidates, run.mode, run.plan, run.first.noisy)
            told = {"noisy_n": run.first.n, "candidate_count": len(run.first.candidates), "report_keys": len(asked)}
            out[k] = best, told | account(owned, asked, run.p) | {"communication_bytes": communication(owned, run.first, asked, run.p, run.plan)}
    return [out[k] for k in range(len(runs))]


def two_round(owned: Owned, p: Protocol, mode: str, scans: Scans | None = None) -> tuple[list[Estimate], dict]:
    """Histogram round, then sketches and estimates."""
    return close_runs(owned, [open_run(owned, p, mode, scans or Scans(owned))])[0]


def account(owned: Owned, reports: Sequence[sketch.Asked], p: Protocol) -> dict:
    by: dict[int, list[sketch.Asked]] = {}
    for r in reports:
        by.setdefault(r.client, []).append(r)
    limits = {c: budget.group_bound([r.key for r in some]) for c, some in by.items()}
    coordinates = {c: max(budget.coordinate_epsilon(r.epsilon, r.delta, p.m) for r in some) for c, some in by.items()}
    return {"alpha_rdp_epsilon": budget.overlap_account(p.m, p.delta, limits, coordinates)["rdp_epsilon"], "formal_end_to_end_dp": False}


def communication(owned: Owned, first: FirstRound, reports: Sequence[sketch.Asked], p: Protocol, plan: binning.Plan | None = None) -> int:
    clients = len(owned.parts)
    up1 = sum(wire.text_bytes(f"client_{c}") + 3 * wire.F64 + wire.U32 for c in range(clients)) + len(first.noisy) * (wire.U32 + wire.I64 + wire.F64)
    down = clients * (wire.U32 + sum(wire.itemset_bytes(len(c.itemset)) for c in first.candidates))
    up2 = sum(wire.text_bytes(f"client_{c}") + wire.U32 for c in {r.client for r in reports}) + sum(wire.report_bytes(r.key, p.m) for r in reports)
    return up1 + down + up2 + (sum(wire.binning_message(plan, attrs) for attrs in owned.parts) if plan else 0)


def randomized(owned: Owned, p: Protocol) -> tuple[list[Estimate], dict]:
    """Two rounds of unary encoding in every row."""
    clients = len(owned.parts)
    epsilon_n = p.epsilon * p.phase1_ratio * p.noisy_n_ratio
    n = _noisy_n(owned, epsilon_n / clients, p.seed)
    table = randomizer.first_round(owned.wide, owned.domain, owned.owners(), p.epsilon * p.phase1_ratio - epsilon_n, clients, n, p.seed, p.report_limit)
    rows = [(r["attr"], r["value"], r["noisy"]) for r in table.collect()]
    held = owned.wide.sparkSession.createDataFrame(rows, "attr int, value bigint, noisy double")
    _, candidates = _choose(owned.wide.sparkSession, held, n, p, False)
    noisy, limit = {(a, v): x for a, v, x in rows}, p.k if p.upload_limit is None else p.upload_limit
    share: dict[tuple[int, Itemset], float] = {}
    for client, attrs in enumerate(owned.parts):
        chosen = keys.report_keys(candidates, attrs, keys.MIXED, limit=limit, noisy=noisy, n=n)
        share |= {(client, k): p.epsilon * (1 - p.phase1_ratio) / clients / len(chosen) for k in chosen}
    usable = [(c, b) for c in candidates if (b := blocks_of(c.itemset, owned.owner, keys.MIXED, set(share))) is not None]
    sets = [[(counts.matches(b), share[owned.owner[b[0][0]], b], f"{owned.owner[b[0][0]]}:{b}") for b in blocks] for _, blocks in usable]
    row = randomizer.intersections(owned.wide, sets, n, p.seed).first()
    found = [Estimate(c.itemset, row[f"e{k}"], c.guess, b) for k, (c, b) in enumerate(usable)]
    total = owned.wide.count()
    size = wire.randomizer_bytes(total * len(rows), total * len(share), clients, [c.itemset for c in candidates], len(rows))
    return sorted(found, key=lambda e: (-e.estimate, e.itemset)), {"noisy_n": n, "candidate_count": len(candidates), "report_keys": len(share), "communication_bytes": size}


def one_round(owned: Owned, p: Protocol, method: str, scans: Scans | None = None) -> tuple[list[Estimate], dict]:
    """Either noisy histograms alone, or sketches of all public local itemsets without asking anything before."""
    clients, spark = len(owned.parts), owned.wide.sparkSession
    if method == "First-round":
        first = first_round(owned, p, p.epsilon * 0.9 / clients, p.epsilon * 0.1 / clients, False, scans)
        found = sorted((Estimate(c.itemset, c.guess, c.guess) for c in first.candidates), key=lambda e: (-e.estimate, e.itemset))
        return found, {"noisy_n": first.n, "candidate_count": len(first.candidates), "report_keys": 0}
    n = _noisy_n(owned, p.epsilon * 0.05 / clients, p.seed, scans)
    wide_open = [Candidate(k, 0.0, 0.0) for attrs in owned.parts for k in keys.public_keys(owned.domain, attrs, 1 if method == "Items-only" else 3)]
    asked = FirstRound({}, owned.wide.limit(0), 1.0, [], wide_open)
    all_keys = replace(p, upload_limit=0, mixed_weight=4.0, estimator="map")
    wanted = wanted_reports(owned, asked, all_keys, keys.MIXED, p.epsilon * 0.95 / clients, p.delta / clients)
    reports, search = [w.asked for w in wanted], Search(p.gamma, p.step, p.points)
    alphas = released(owned, wanted, p.m, p.seed, p.gamma).persist(StorageLevel.MEMORY_AND_DISK)
    single = [Case([replace(r, used=len(r.key) == 1) for r in reports], n, "map", search)]
    noisy = [(*reports[r["report"]].key[0], r["size"]) for r in sizes_table(alphas, single).collect()]  # a size for each public value
    _, candidates = _choose(spark, spark.createDataFrame(sorted(noisy), "attr int, value bigint, noisy double"), n, p, False)
    owner = owned.owner
    needed = {(c, tuple(i for i in x.itemset if owner[i[0]] == c)) for x in candidates for c in range(clients)} | {(owner[i[0]], (i,)) for x in candidates for i in x.itemset}
    used = [replace(r, used=(r.client, r.key) in needed) for r in reports]
    todo = jobs(candidates, used, owner, keys.MIXED, "map")
    found = ranked(todo, estimate_tables(alphas, [Case(used, n, "map", search)], [todo])[0], candidates, keys.MIXED)
    alphas.unpersist()
    return found, {"noisy_n": n, "candidate_count": len(candidates), "report_keys": len(reports), **account(owned, reports, p)}


def central(owned: Owned, p: Protocol) -> list[Estimate]:
    """Histogram round, then Laplace noise on every candidate's exact support."""
    shares = budget.phases(p.epsilon, p.delta, len(owned.parts), p.phase1_ratio, p.noisy_n_ratio)
    first = first_round(owned, p, shares["epsilon_counts"], shares["epsilon_n"])
    table = counts.support_table(owned.wide, [c.itemset for c in first.candidates])
    noisy = randomizer.central_estimates(table, p.epsilon * (1 - p.phase1_ratio), len(first.candidates), first.n, p.seed)
    value = {r["candidate"]: r["estimate"] for r in noisy.collect()}
    found = [Estimate(c.itemset, value[k], c.guess, (c.itemset,)) for k, c in enumerate(first.candidates)]
    return sorted(found, key=lambda e: (-e.estimate, e.itemset))


def run_method(owned: Owned, p: Protocol, method: str, scans: Scans | None = None) -> tuple[list[Estimate], dict]:
    if method in TWO_ROUND:
        estimator, mode = TWO_ROUND[method]
        return two_round(owned, replace(p, estimator=estimator, modes=(mode,)), mode, scans)
    if method == "FO":
        return randomized(owned, p)
    if method in ("First-round", "Second-round", "Items-only"):
        return one_round(owned, p, method, scans)
    raise ValueError(f"unknown method {method}")


def audit(owned: Owned, found: Sequence[Estimate], p: Protocol, scans: Scans | None = None) -> dict[str, float]:
    """Metrics against the exact top k of all legal itemsets, not of the candidates alone."""
    spark, scans = owned.wide.sparkSession, scans or Scans(owned)
    rows, top = scans.rows.first()["n"], scans.top(p)
    truth = dict(top) | scans.supports([e.itemset for e in found])
    kind = "itemset array<struct<attr:int,value:bigint>>"
    t = spark.createDataFrame([(list(i), n) for i, n in truth.items()], f"{kind}, support bigint")
    e = spark.createDataFrame([(list(x.itemset), float(x.estimate)) for x in found], f"{kind}, estimate double")
    out = metrics.evaluate(t, e, p.k, rows).first().asDict()
    return out | {"mse": out["rmse"] ** 2, "frequency_mse": out["rmse"] ** 2 / rows**2}


def run_cases(wide: DataFrame, cases: Sequence[tuple[Config, str]], *, dataset: str = "custom") -> list[dict]:
    """Audited runs (configuration and method) over one table, as flat rows in their order.

    Cases with the same settings of their data share one coded table and its scans: one histogram, one pass for the sketches
    of all two-round methods that share m, seed and gamma, whatever their budgets, splits and estimators, one
    estimation of all their candidates, one exact top for each k and sizes, and one count of everything that was found. The
    other methods read rows of their own. total_seconds is an equal share of what its group's methods took.
    """
    groups: dict[object, list[int]] = {}
    for k, (c, method) in enumerate(cases):
        c.check()
        if method not in METHODS:
            raise ValueError(f"unknown method {method}")
        groups.setdefault(c.data, []).append(k)
    out: dict[int, dict] = {}
    for some in groups.values():
        owned = prepare(wide, cases[some[0]][0])
        owned = replace(owned, wide=owned.wide.persist(StorageLevel.MEMORY_AND_DISK))
        scans = Scans(owned)
        try:
            began = time.perf_counter()
            fused = [k for k in some if cases[k][1] in TWO_ROUND]
            runs = []
            for k in fused:
                (estimator, mode), p = TWO_ROUND[cases[k][1]], cases[k][0].protocol
                runs.append(open_run(owned, replace(p, estimator=estimator, modes=(mode,)), mode, scans))
            found = dict(zip(fused, close_runs(owned, runs), strict=True))
            found |= {k: run_method(owned, cases[k][0].protocol, cases[k][1], scans) for k in some if k not in found}
            seconds = (time.perf_counter() - began) / len(some)
            for p in {(c.k, c.max_size, c.min_size): c for c in (cases[k][0].protocol for k in some)}.values():
                scans.top(p)
            scans.supports(sorted({e.itemset for best, _ in found.values() for e in best}))
            for k in some:
                (best, info), p = found[k], cases[k][0].protocol
                out[k] = {
                    "dataset": dataset, "axis": "default", "value": 1.0, "seed": p.seed, "method": cases[k][1], "k": p.k, "epsilon": float(p.epsilon),
                    "clients": len(owned.parts), "total_seconds": seconds, "result_kind": "measured", "evaluation_scope": "global_exact",
                    **audit(owned, best, p, scans), **{x: v for x, v in info.items() if not isinstance(v, (dict, bool))},
                }
        finally:
            scans.release()
            owned.wide.unpersist()
    return [out[k] for k in range(len(cases))]


def run_case(wide: DataFrame, config: Config, method: str, *, dataset: str = "custom", axis: str = "default", value: float = 1.0) -> dict:
    """One audited run as a flat row."""
    return run_cases(wide, [(config, method)], dataset=dataset)[0] | {"axis": axis, "value": float(value)}


def sweep(tables: DataFrame | Mapping[str, DataFrame], base: Config, numbers: Sequence[int], methods: Sequence[str] | None = None, seeds: Sequence[int] = (2026,), folder: str | None = None, dataset: str = "custom", names: Sequence[str] | None = None, values: Sequence[float] | None = None, results: ResultTable | None = None) -> list[dict]:
    """Runs every point of the numbered sweeps and returns their rows.

    tables is one table, called dataset, or several by name; of those an axis takes names, or its own.
    A configuration that several axes share is run once and counts for each of them; those that share their data are run
    together (run_cases). With a folder, each
    row is kept under its axis, table, value, seed and method: one that was run before with the same
    identity is read back, and one of another identity there is an error. status.json says of each axis
    that it is complete, and with how many rows. A result table does the same on a shared folder, a batch for each group
    of runs that share their data: a run that was killed goes on after the last batch.
    """
    from ..sources.files import reuse, store, write_json
    from .config import identity, points

    if isinstance(tables, DataFrame):
        tables, names = {dataset: tables}, [dataset]
    todo = points(base, numbers, seeds, names, values, methods)
    if missing := {x.table for x in todo} - set(tables):
        raise KeyError(f"tables that the sweeps need and that aren't given: {sorted(missing)}")
    points_of = [(x, m, identity(x.config, m, x.axis, x.value, x.table)) for x in todo for m in x.methods]
    place = lambda x, m: f"{folder}/experiment{x.number:02d}_{x.axis}/{x.table}/value_{x.value:g}/seed_{x.seed}/{m}.json"
    known = [reuse(place(x, m), who) if folder else None for x, m, who in points_of]
    spot = lambda x, m: f"experiment{x.number:02d}_{x.axis}/{x.table}/value_{x.value:g}/seed_{x.seed}/{m}"
    if results is not None:
        held = results.reuse({spot(x, m): who for x, m, who in points_of})
        known = [row if row is not None else held.get(spot(x, m)) for row, (x, m, _) in zip(known, points_of, strict=True)]
    missing_of: dict[tuple[str, object], dict[tuple[Config, str], None]] = {}
    for (x, m, _), row in zip(points_of, known, strict=True):
        if row is None:
            missing_of.setdefault((x.table, x.config.data), {})[x.config, m] = None
    for (table, _), cases in missing_of.items():  # what shares its data is run together, and kept before the next
        ran = dict(zip(cases, run_cases(tables[table], list(cases), dataset=table), strict=True))
        new = [k for k, (x, m, _) in enumerate(points_of) if known[k] is None and x.table == table and (x.config, m) in ran]
        for k in new:
            x, m, who = points_of[k]
            known[k] = ran[x.config, m] | {"axis": x.axis, "value": x.value}
            if folder:
                store(place(x, m), who, known[k])
        if results is not None:
            results.commit([(f"experiment{x.number:02d}_{x.axis}", spot(x, m), who, known[k]) for k in new for x, m, who in [points_of[k]]])
    rows, written = list(known), {}
    for x, _, _ in points_of:
        home = f"experiment{x.number:02d}_{x.axis}"
        written[home] = written.get(home, 0) + 1
    for home, n in written.items() if folder else ():
        write_json(f"{folder}/{home}/status.json", {"status": "complete", "runs": n, "datasets": sorted({x.table for x in todo if home.endswith(x.axis)})})
    return rows


def k_sweep(path: str, ks: Sequence[int]) -> list[dict]:
    """f1 and ncr for several k from one stored run of counting under encryption, which isn't run again.

    The run must say that all its supports were verified, and must hold as many true itemsets as the
    largest k asks for.
    """
    from ..sources.files import digest

    held, rows = json.loads(Path(path).read_text()), []
    for method, told in held.items():
        supports = {tuple(map(tuple, s)): n for s, n in told["supports"]}
        truth = [tuple(map(tuple, s)) for s in told["truth"]]
        if told["publication_eligible"] or told["verified"] != len(supports):
            raise ValueError(f"{path}: {method} isn't a verified run")
        if max(ks) > len(truth):
            raise ValueError(f"{path}: {method} holds the top {len(truth)} only")
        ranked = sorted(supports, key=lambda s: (-supports[s], s))
        for k in ks:
            best, exact = set(ranked[:k]), {s: k - place for place, s in enumerate(truth[:k])}
            rows.append({
                "dataset": Path(path).stem, "method": method, "k": k, "f1": 2 * len(best & set(exact)) / (len(best) + len(exact)), "ncr": sum(exact.get(s, 0) for s in best) / sum(exact.values()),
                "candidate_count": len(supports), "source_sha256": digest(path), "time_reused_from_run": True, "publication_eligible": False,
            })
    return rows


def as_table(spark: SparkSession, found: Sequence[Estimate]) -> DataFrame:
    """rank, itemset (text), estimate, guess."""
    from ..functions.itemsets import text

    rows = [(k + 1, text(e.itemset), float(np.round(e.estimate, 6)), float(np.round(e.guess, 6))) for k, e in enumerate(found)]
    return spark.createDataFrame(rows, "rank int, itemset string, estimate double, guess double")
