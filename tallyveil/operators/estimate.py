"""From second-round reports to candidate estimates."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.itemsets import Item, Itemset
from .binning import Plan, binned, share_in_bin
from .candidates import Candidate
from .keys import COMPLEMENT, PROTECTED, RAW_PARTS, RAW_SINGLE, SINGLE
from .sketch import Asked, Report, bounds, category_inverse, complement_inverse, joint_map, marginal_map, nested_map


@dataclass(frozen=True)
class Estimate:
    itemset: Itemset
    estimate: float
    guess: float
    blocks: tuple[Itemset, ...] = ()


@dataclass(frozen=True)
class Search:
    """How sizes are searched."""

    gamma: float = 1.0
    step: int = 5
    points: int = 1500


def blocks_of(itemset: Itemset, owner: Mapping[int, int], mode: str, known: set[tuple[int, Itemset]], plan: Plan | None = None) -> tuple[Itemset, ...] | None:
    """The keys that a candidate is estimated from: its part of each owner, or that part's items where the part wasn't reported; None where an item is missing too."""
    if plan is None and mode in (SINGLE, COMPLEMENT, RAW_SINGLE, RAW_PARTS):
        singles = tuple((i,) for i in itemset)
        return singles if all((owner[k[0][0]], k) in known for k in singles) else None
    shown = (lambda k: binned(k, plan)) if plan is not None else (lambda k: k)
    parts: dict[int, list[Item]] = defaultdict(list)
    for i in itemset:
        parts[owner[i[0]]].append(i)
    out: list[Itemset] = []
    for client in sorted(parts):
        whole = shown(tuple(sorted(parts[client])))
        if (client, whole) in known:
            out.append(whole)
            continue
        singles = [shown((i,)) for i in sorted(parts[client])]
        if len(singles) == 1 or any((client, s) not in known for s in singles):
            return None
        out += singles
    return tuple(out)


def _candidate_shares(candidates: Sequence[Candidate], plan: Plan) -> dict[Itemset, float]:
    """A candidate's part of the guesses of all candidates of its bins; equal parts where there are none."""
    groups: dict[Itemset, list[Candidate]] = defaultdict(list)
    for c in candidates:
        groups[binned(c.itemset, plan)].append(c)
    out = {}
    for some in groups.values():
        total = sum(max(c.guess, 0.0) for c in some)
        out |= {c.itemset: max(c.guess, 0.0) / total if total > 0 else 1.0 / len(some) for c in some}
    return out


@dataclass(frozen=True)
class Job:
    """How one candidate is estimated: from which reports, by place, in the order of its blocks."""

    candidate: Candidate
    blocks: tuple[Itemset, ...]
    reports: tuple[int, ...]


LIKELIHOOD, CATEGORY, INVERSE = ("map", "map_no_frechet", "map_bounds_only"), ("fm_full", "fm_other"), ("fm", "fm_inverse")


def jobs(candidates: Sequence[Candidate], asked: Sequence[Asked | Report], owner: Mapping[int, int], mode: str, estimator: str, plan: Plan | None = None) -> list[Job]:
    """A job for every candidate that the used reports allow."""
    if estimator not in (*LIKELIHOOD, *CATEGORY, *INVERSE):
        raise ValueError(f"unknown estimator {estimator}")
    place = {(r.client, r.key): k for k, r in enumerate(asked) if r.used}
    known, out = set(place), []
    if estimator in CATEGORY:
        values: dict[int, list[tuple[tuple[int, Itemset], int]]] = defaultdict(list)
        for (client, key), k in sorted(place.items(), key=lambda x: (x[0][1][0][0], x[0][0], x[0][1])):
            if len(key) == 1 and client == owner[key[0][0]]:
                values[key[0][0]].append(((client, key), k))
    for c in candidates:
        if estimator in CATEGORY:
            others = [(key, k) for a, v in sorted(c.itemset) for (_, key), k in values[a] if key[0][1] != v]
            out.append(Job(c, tuple(key for key, _ in others), tuple(k for _, k in others)))
            continue
        blocks = blocks_of(c.itemset, owner, mode, known, plan)
        if blocks is not None:
            out.append(Job(c, blocks, tuple(place[owner[b[0][0]], b] for b in blocks)))
    return out


def pairs(asked: Sequence[Asked | Report]) -> dict[int, tuple[int, int]]:
    """Reports of two items of which the same client reported each alone: their places, and those of the two."""
    place = {(r.client, r.key): k for k, r in enumerate(asked) if r.used}
    sides = {k: tuple(place.get((client, (i,))) for i in key) for (client, key), k in place.items() if len(key) == 2}
    return {k: found for k, found in sides.items() if None not in found}


def intersection(held: Sequence[Report], sizes: Sequence[float], estimator: str, n: float, search: Search) -> float:
    """The intersection of the reported sets by an estimator; sizes are theirs, for the likelihoods."""
    if estimator in CATEGORY:
        return category_inverse(held, n, search.gamma)
    if estimator in INVERSE:
        return complement_inverse(held, n, search.gamma)
    if estimator == "map_bounds_only":
        return sum(bounds(sizes, n)) / 2.0
    return joint_map(held, n, search.gamma, search.step, search.points, sizes=sizes, lower_bound=estimator != "map_no_frechet")


def ranked(todo: Sequence[Job], values: Sequence[float], candidates: Sequence[Candidate], mode: str, plan: Plan | None = None, noisy: Mapping[Item, float] | None = None) -> list[Estimate]:
    """Estimates of the jobs' candidates, best first, ties by the itemset; of bins, the candidate's part of its bin's."""
    shares = _candidate_shares(candidates, plan) if plan is not None and mode == PROTECTED else {}

    def part(c: Candidate) -> float:
        if plan is None:
            return 1.0
        return shares.get(c.itemset, 0.0) if mode == PROTECTED else float(np.prod([share_in_bin(i, plan, noisy or {}) for i in c.itemset]))

    found = [Estimate(j.candidate.itemset, x * part(j.candidate), j.candidate.guess, j.blocks) for j, x in zip(todo, values, strict=True)]
    return sorted(found, key=lambda e: (-e.estimate, e.itemset))


def estimate_candidates(candidates: Sequence[Candidate], reports: Sequence[Report], owner: Mapping[int, int], n: float, mode: str, estimator: str = "map", search: Search = Search(), plan: Plan | None = None, noisy: Mapping[Item, float] | None = None) -> list[Estimate]:
    """Estimates of all candidates that the reports allow, of a few reports whose ranks are at hand: `estimate_tables` one by one."""
    at = (n, search.gamma, search.step, search.points)
    todo = jobs(candidates, reports, owner, mode, estimator, plan)
    sizes = [marginal_map(r.alpha, r.phantoms, r.floor, *at) for r in reports] if estimator in LIKELIHOOD else []
    refined = list(sizes)
    for k, (a, b) in pairs(reports).items() if estimator == "map" else ():
        refined[k] = nested_map(reports[a], reports[b], reports[k], *at, sizes=(sizes[a], sizes[b]))
    values = [intersection([reports[k] for k in j.reports], [refined[k] for k in j.reports] if sizes else [], estimator, n, search) for j in todo]
    return ranked(todo, values, candidates, mode, plan, noisy)


# The same by candidate in the cluster


@dataclass(frozen=True)
class Case:
    """What the reports of one run say in public, and how they are searched. Its reports are those from `first` on in the table of all runs."""

    asked: Sequence[Asked]
    n: float
    estimator: str
    search: Search
    first: int = 0


def _grouped(rows: DataFrame, group: str, one: Callable, out: str) -> DataFrame:
    """out and value: `one` of the rows of each group (group, position, run, report, alpha, size), in order of position, group after group in a task."""
    ordered = rows.select(group, "position", "run", "report", "alpha", "size").repartition(group).sortWithinPartitions(group, "position")

    def run(batches) -> Iterator:
        import pyarrow as pa

        def values():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        keys, found = [], []
        for key, some in groupby(values(), itemgetter(0)):
            keys.append(key)
            found.append(float(one(list(some))))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(found, pa.float64())], [out, "value"])

    return ordered.mapInArrow(run, f"{out} int, value double")


def sizes_table(alphas: DataFrame, cases: Sequence[Case]) -> DataFrame:
    """report and size for a table (report, alpha) of the runs' reports: the marginal likelihood's best, by report."""
    of = {c.first + k: (a.phantoms, a.floor, c.n, c.search) for c in cases if c.estimator in LIKELIHOOD for k, a in enumerate(c.asked) if a.used}
    shared = alphas.sparkSession.sparkContext.broadcast(of)  # a few numbers for each report

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            some = [(k, x) for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) if k in shared.value]
            sizes = [marginal_map(np.frombuffer(x, "<f8"), p, f, n, at.gamma, at.step, at.points) for k, x in some for p, f, n, at in [shared.value[k]]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array(sizes, pa.float64())], ["report", "size"])

    return alphas.select("report", "alpha").mapInArrow(run, "report int, size double")


def estimate_tables(alphas: DataFrame, cases: Sequence[Case], todo: Sequence[Sequence[Job]]) -> list[list[float]]:
    """Each job's intersection, for the jobs of every run; reports' ranks stay in the table alphas (report, alpha).

    Reports are sized on their own, those of two items are refined by their parts' (a group of three reports), and
    each candidate meets its reports by a join: a group of as many rows as it has blocks. So work is dealt by report
    and by candidate, over all runs at once, and what comes back is a number for each candidate.
    """
    spark = alphas.sparkSession
    sized = alphas.join(sizes_table(alphas, cases), "report", "left").persist(StorageLevel.MEMORY_AND_DISK)
    shared = spark.sparkContext.broadcast([(c.n, c.estimator, c.search, [(a.client, a.key, a.epsilon, a.delta, a.phantoms, a.floor, a.complement) for a in c.asked], c.first) for c in cases])

    def held(rows: list[tuple]) -> tuple[list[Report], tuple]:
        n, estimator, search, asked, first = shared.value[rows[0][2]]
        out = []
        for _, _, _, report, alpha, _ in rows:
            client, key, epsilon, delta, phantoms, floor, complement = asked[report - first]
            out.append(Report(client, key, np.frombuffer(alpha, "<f8"), epsilon, delta, phantoms, floor, complement))
        return out, (n, estimator, search)

    def refined(rows: list[tuple]) -> float:
        (left, right, both), (n, _, search) = held(rows)
        return nested_map(left, right, both, n, search.gamma, search.step, search.points, sizes=(rows[0][5], rows[1][5]))

    def joint(rows: list[tuple]) -> float:
        reports, (n, estimator, search) = held(rows)
        return intersection(reports, [r[5] for r in rows], estimator, n, search)

    kinds = "place int, position int, run int, report int"
    three = [(c.first + k, at, run, c.first + r) for run, c in enumerate(cases) if c.estimator == "map" for k, (a, b) in pairs(c.asked).items() for at, r in enumerate((a, b, k))]
    better = _grouped(spark.createDataFrame(three, kinds).join(sized, "report"), "place", refined, "report")
    sized = sized.join(better, "report", "left").select("report", "alpha", F.coalesce("value", "size").alias("size")).persist(StorageLevel.MEMORY_AND_DISK)
    numbered = [(run, at, j) for run, some in enumerate(todo) for at, j in enumerate(some)]
    needed = [(k, at, run, cases[run].first + r) for k, (run, _, j) in enumerate(numbered) for at, r in enumerate(j.reports)]
    found = {r["place"]: r["value"] for r in _grouped(spark.createDataFrame(needed, kinds).join(sized, "report"), "place", joint, "place").collect()}
    sized.unpersist()
    out: list[list[float]] = [[] for _ in todo]
    for k, (run, _, j) in enumerate(numbered):
        c = cases[run]
        out[run].append(found[k] if j.reports else intersection([], [], c.estimator, c.n, c.search))
    return out
