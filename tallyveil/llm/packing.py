"""Bulk-synchronous best-fit packing of documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .store import fresh, materialise
from .textscan import groups, slices


def cut(length: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all of capacity but the first, which may be shorter."""
    first = length % capacity
    return [first] * (first > 0) + [capacity] * (length // capacity)


def tokenize(docs: DataFrame, encoder, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document.

    A null text counts as empty and is one piece of the end id; a text of any length is encoded whole and
    only then cut; repeated rows and null ids each get their pieces; other columns are left out, whatever
    their names; an empty table gives none.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        words, tail = encoder(), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            texts, keys = [x or "" for x in batch.column(1).to_pylist()], batch.column(0)
            for a, b in groups(texts):
                of, rows = [], []
                for k, ids in enumerate(words.encode(texts[a:b])):
                    ids, at = ids + tail, 0
                    for piece, size in enumerate(cut(len(ids) // 4, capacity)):
                        of.append(a + k)
                        rows.append((piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                        at += size
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


#: What a row of the rounds' table is: sequences with room left, documents without a place, documents
#: that have one, and gaps and documents that found no match in their own part of the table.
GAP, DOC, PLACED, FREE_GAP, FREE_DOC = range(5)
RUNS = ["kind", "value", "first", "n", "seq", "per", "offset", "part", "at"]
SCHEMA = "kind int, value int, first long, n long, seq long, per int, offset int, part int, at long"
#: Runs that a part of the range-sorted table has, about. Every round sweeps the parts, then between them, however many there are.
PART_RUNS = 256
#: Ends that ranges of values are chosen from.
QUANTILES = 63
#: Windows of sizes: the k-th has those of which k but not k + 1 fill a sequence, the last all smaller ones.
WINDOWS = 8


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], RUNS)


def _runs(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def fill(gap: int, seq: int, n: int, size: int, first: int, left: int, capacity: int, most: int | None = None) -> tuple[list[tuple], int, int]:
    """Puts documents of a run (`left` of them, from rank `first`) into n sequences with the same gap: rows, sequences and documents used.

    Each sequence takes as many as fit, `most` at most, which is what best fit does one by one, since a
    gap that has just shrunk and still holds the size is the tightest.
    """
    per = min(gap // size, most or gap)
    whole = min(n, left // per)
    rest = left - whole * per if whole < n else 0
    rest = rest if rest < per else 0
    out = []
    for first, seq, sequences, docs in ((first, seq, whole, per), (first + whole * per, seq + whole, int(rest > 0), rest)):
        if sequences:
            out.append((PLACED, size, first, sequences * docs, seq, docs, capacity - gap, 0, 0))
            if gap > docs * size:
                out.append((GAP, gap - docs * size, seq, sequences, 0, 0, 0, 0, 0))
    return out, whole + (rest > 0), whole * per + rest


def sweep(gaps: list[tuple], docs: list[tuple], capacity: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """A successor sweep over runs (value, first, n): placements, gaps that are left (shrunk ones among them), documents that are.

    Values are gone through from the highest, gaps before documents of their size. The gaps that were
    seen and aren't taken are held with the smallest on top: it is the successor of the document that
    comes next, which takes it. A gap that has been taken waits for the next sweep; documents of one
    size share the gaps of one size by rank.
    """
    held, placed, left, after = [], [], [], []
    for value, kind, first, n in sorted([(-v, GAP, f, n) for v, f, n in gaps] + [(-v, DOC, f, n) for v, f, n in docs]):
        if kind == GAP:
            held.append([-value, first, n])
            continue
        while n and held:
            gap, seq, m = held[-1]
            rows, sequences, used = fill(gap, seq, m, -value, first, n, capacity)
            placed += [r for r in rows if r[0] == PLACED]
            after += [r[1:4] for r in rows if r[0] == GAP]
            first, n = first + used, n - used
            held[-1][1:] = seq + sequences, m - sequences
            if m == sequences:
                held.pop()
        if n:
            left.append((-value, first, n))
    return placed, [tuple(x) for x in held] + after, left


def match(runs, low: int, capacity: int, part: int) -> Iterator[tuple]:
    """Sweeps over the runs of a part above `low`, each after the gaps were updated, until no gap holds a document.

    What finds no match in this part says how many of its kind are free before it: documents from the
    largest, and gaps from the smallest, which a document of a lower part wants first. A gap that has
    shrunk out of the part's range may be too small for such a document: it waits for the next round.
    """
    gaps, docs = [], []
    for kind, value, first, n, *_ in runs:
        if value <= low:
            yield (kind, value, first, n, 0, 0, 0, 0, 0)
        else:
            (gaps if kind == GAP else docs).append((value, first, n))
    least = min((value for value, _, _ in gaps + docs), default=0)
    placed = True
    while placed and docs:
        placed, gaps, docs = sweep(gaps, docs, capacity)
        yield from placed
    for value, first, n in gaps:
        if value < least:
            yield (GAP, value, first, n, 0, 0, 0, 0, 0)
    gaps = [x for x in gaps if x[0] >= least]
    for kind, some in ((FREE_DOC, sorted(docs, key=lambda x: (-x[0], x[1]))), (FREE_GAP, sorted(gaps))):
        free = 0
        for value, first, n in some:
            yield (kind, value, first, n, 0, 0, 0, part, free)
            free += n


def open_sequences(runs, low: int, k: int, capacity: int, part: int, base: int) -> Iterator[tuple]:
    """Deals the documents over `low`, from the largest, k by k to new sequences, numbered from base in each part.

    No gap holds any of them, and k of them always fit: so best fit would do the same.
    """
    seq, room, held = base + (part << 40), capacity, 0
    for kind, value, first, n, *_ in runs:
        if kind != DOC or value <= low:
            yield (kind, value, first, n, 0, 0, 0, 0, 0)
            continue
        if held:  # the last sequence has documents of another size
            some = min(n, k - held)
            yield (PLACED, value, first, some, seq, some, capacity - room, 0, 0)
            first, n, held, room = first + some, n - some, held + some, room - some * value
            if held == k:
                if room:
                    yield (GAP, room, seq, 1, 0, 0, 0, 0, 0)
                seq, room, held = seq + 1, capacity, 0
        if n // k:
            rows, sequences, docs = fill(capacity, seq, n // k, value, first, n // k * k, capacity, k)
            yield from rows
            first, n, seq = first + docs, n - docs, seq + sequences
        if n:
            yield (PLACED, value, first, n, seq, n, 0, 0, 0)
            room, held = capacity - n * value, n
    if held and room:
        yield (GAP, room, seq, 1, 0, 0, 0, 0, 0)


def assign(free: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (part, free gaps, free documents), parts of high values first: which gaps go to which documents.

    (documents' part, first document, gaps' part, first gap, how many). A part's documents take the free
    gaps of the nearest part before it, as those are the smallest that are large enough.
    """
    held: list[list[int]] = []
    out = []
    for part, gaps, docs in free:
        at = 0
        while at < docs and held:
            where, first, n = held[-1]
            some = min(n, docs - at)
            out.append((part, at, where, first, some))
            at += some
            held[-1][1:] = first + some, n - some
            if n == some:
                held.pop()
        if gaps:
            held.append([part, 0, gaps])
    return out


def _dealt(runs, dealt: list[tuple]) -> Iterator[tuple]:
    """Free runs cut by what assign dealt: part is then the number of the deal (-1 for none), at the place in it."""
    sides = {FREE_DOC: defaultdict(list), FREE_GAP: defaultdict(list)}
    for number, (docs_part, docs_at, gaps_part, gaps_at, n) in enumerate(dealt):
        sides[FREE_DOC][docs_part].append((docs_at, n, number))
        sides[FREE_GAP][gaps_part].append((gaps_at, n, number))
    for kind, value, first, n, _, _, _, part, at in runs:
        if kind not in sides:
            yield (kind, value, first, n, 0, 0, 0, -1, 0)
            continue
        while n:
            inside = next(((a, m, number) for a, m, number in sides[kind][part] if a <= at < a + m), None)
            if inside is None:
                some = min([n, *(a - at for a, _, _ in sides[kind][part] if a > at)])
                yield (DOC if kind == FREE_DOC else GAP, value, first, some, 0, 0, 0, -1, 0)
            else:
                some = min(n, inside[0] + inside[1] - at)
                yield (kind, value, first, some, 0, 0, 0, inside[2], at - inside[0])
            first, n, at = first + some, n - some, at + some


def _joined(runs, capacity: int) -> Iterator[tuple]:
    """Runs of deals, sorted by deal and place, gaps and documents merged by rank: one document for each gap."""
    waiting: dict[int, list[list[int]]] = {FREE_GAP: [], FREE_DOC: []}
    for kind, value, first, n, *_ in runs:
        waiting[kind].append([value, first, n])
        gaps, docs = waiting[FREE_GAP], waiting[FREE_DOC]
        while gaps and docs:
            (gap, seq, m), (size, rank, left) = gaps[0], docs[0]
            some = min(m, left)
            yield from fill(gap, seq, some, size, rank, some, capacity, 1)[0]
            for side, one in ((gaps, gaps[0]), (docs, docs[0])):
                one[1:] = one[1] + some, one[2] - some
                if not one[2]:
                    side.pop(0)


def rounds(docs: DataFrame, capacity: int, most: int = 10_000) -> list[DataFrame]:
    """Places documents, a table (length, n), into sequences; returns the tables that hold the placements.

    Both documents and gaps are runs of equal values, sorted together in ranges of values. Sizes are taken window by
    window from the largest. A round is a number of successor sweeps in every part of the table (match),
    then one between parts: the driver gets how many gaps and documents each part has left, assigns them
    by rank, and they meet by what they were dealt. Then the gaps are updated, and the round repeats
    until no gap holds a document of the window. What is left opens sequences: k for each in the k-th
    window, and in the last as many as its tokens need at least. Every round places a document or opens
    a sequence for one, and a gap of a window is taken k times at most, so that rounds are few (some
    twenty tables for a capacity of 2048) and don't grow with the documents. Each round's table is written; a
    lost executor costs a reread.
    """
    spark, written = docs.sparkSession, []
    lows = [capacity // (k + 1) for k in range(1, WINDOWS)] + [0]
    gap, doc = F.col("kind").isin(GAP, FREE_GAP), F.col("kind").isin(DOC, FREE_DOC)
    over = [doc & (F.col("value") > low) for low in lows]
    totals = [
        F.count_if(F.col("kind") != PLACED).alias("runs"), F.max(F.when(gap, F.col("value"))).alias("largest"), F.percentile_approx(F.when(F.col("kind") != PLACED, F.col("value")), [k / (QUANTILES + 1) for k in range(1, QUANTILES + 1)], 1000).alias("quantiles"), F.count_if(doc).alias("docs"), F.sum(F.when(doc, F.col("value") * F.col("n"))).alias("tokens"),
        *(F.min(F.when(x, F.col("value"))).alias(f"smallest{k}") for k, x in enumerate(over)),
    ]

    def write(table: DataFrame, name: str) -> tuple[DataFrame, dict]:
        """The table as it is read again, and its totals, which are counted as it is written."""
        seen = Observation()
        written.append(materialise(table.observe(seen, *totals), name))
        return written[-1], seen.get

    def stepped(state: DataFrame, step, told: dict) -> tuple[DataFrame, dict]:
        """One pass of step over each part: ranges of values with about as many runs, the largest first, and in them runs in order.

        The ranges' ends are quantiles of the table as it was written, so that a part is the same rows however many tasks there are.
        """
        parts = min(-(-told["runs"] // PART_RUNS), QUANTILES + 1)
        ends = sorted({told["quantiles"][k * (QUANTILES + 1) // parts - 1] for k in range(1, parts)})
        of = sum((F.when(F.col("value") < x, 1).otherwise(0) for x in ends), F.lit(0))
        sorted_runs = state.withColumn("part", of.cast("int")).select(RUNS).repartition(len(ends) + 1, "part").sortWithinPartitions("part", F.desc("value"), "kind", "first")

        def run(batches) -> Iterator:
            for part, runs in groupby(_runs(batches), itemgetter(RUNS.index("part"))):
                yield _batch(list(step(runs, part)))

        return write(sorted_runs.mapInArrow(run, SCHEMA), "round")

    def between(swept: DataFrame, told: dict) -> tuple[DataFrame, dict]:
        """What the parts have left meets by rank; where no part has gaps for documents of a lower one, nothing changes."""
        left = lambda kind, name: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(name)
        free = swept.where(F.col("kind") >= FREE_GAP).groupBy("part").agg(left(FREE_GAP, "gaps"), left(FREE_DOC, "docs"))
        dealt = assign(sorted(tuple(r) for r in free.collect()))  # a row for each part
        if not dealt:
            return swept, told
        cut = swept.where(F.col("kind") != PLACED).mapInArrow(lambda batches: iter([_batch(list(_dealt(_runs(batches), dealt)))]), SCHEMA)
        met = cut.where("part >= 0").repartition("part").sortWithinPartitions("part", "at")
        met = met.mapInArrow(lambda batches: iter([_batch(list(_joined(_runs(batches), capacity)))]), SCHEMA)
        return write(met.union(cut.where("part < 0")), "met")

    start = docs.select(F.lit(DOC).alias("kind"), F.col("length").cast("int").alias("value"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), *(F.lit(0).cast(t).alias(c) for c, t in zip(RUNS[4:], ("long", "int", "int", "int", "long"), strict=True)))
    state, told = write(start.coalesce(1), "runs")
    for k, low in enumerate(lows, 1):
        while (smallest := told[f"smallest{k - 1}"]) is not None:
            if len(written) > most:
                raise RuntimeError("the rounds don't come to an end")
            base = len(written) << 48
            if (told["largest"] or 0) >= smallest:
                swept, told = between(*stepped(state, lambda runs, part: match(runs, low, capacity, part), told))
                kind = F.when(F.col("kind") == FREE_GAP, GAP).when(F.col("kind") == FREE_DOC, DOC).otherwise(F.col("kind"))
                state = swept.where(F.col("kind") != PLACED).withColumn("kind", kind)
            elif low:
                opened, told = stepped(state, lambda runs, part: open_sequences(runs, low, k, capacity, part, base), told)
                state = opened.where(F.col("kind") != PLACED)
            else:
                n = -(-told["tokens"] // capacity)
                state = state.union(spark.createDataFrame([(GAP, capacity, base, n, 0, 0, 0, 0, 0)], SCHEMA))
                told = told | {"largest": capacity, "runs": told["runs"] + 1}
        if not told["docs"]:
            break
    return written


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), of 1 to capacity tokens each.

    The pieces are range-sorted by length, document and piece and written once with their partition
    and their rank among the pieces of their length there; a length that a third of all rows have is
    spread over several partitions. Counts by partition and length go to the driver: a row for each
    partition and length, at most partitions + capacity of them, since the order is by length. `rounds`
    places the runs of equal lengths; the placements, whose number is bounded by capacity alone, go to
    every task, which looks up its pieces' ranks.

    Pieces of one document needn't share a sequence, ties in length go by document and piece, repeated
    rows and null ids each get a place, other columns are handed on (those called sequence_id or offset
    are replaced), and an empty table gives an empty result. A length of less than 1 or more than
    capacity is an error.
    """
    pieces = pieces.drop("sequence_id", "offset")
    part_name, rank_name = fresh(pieces.columns, "_part", "_rank")

    def ranked(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            sizes = batch.column("length").to_numpy()
            if not len(sizes):
                continue
            run = np.flatnonzero(np.diff(sizes, prepend=-1))
            ranks = np.arange(len(sizes)) - np.repeat(run, np.diff(np.append(run, len(sizes))))
            if sizes[0] == last:
                ranks[: run[1] if len(run) > 1 else len(sizes)] += seen
            last, seen = sizes[-1], int(ranks[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(ranks)], [*batch.schema.names, part_name, rank_name])

    pieces = materialise(pieces, "cut")  # else the range sort's sampling would tokenize everything once more
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    order = [F.col("length"), F.xxhash64("doc_id", "piece"), F.col("doc_id"), F.col("piece")]
    ordered = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(ordered.mapInArrow(ranked, f"{schema}, `{part_name}` int, `{rank_name}` long"), "pieces")
    counts: dict[int, int] = defaultdict(int)
    base: dict[tuple[int, int], int] = {}
    for r in sorted(rows.groupBy(F.col(part_name).alias("part"), "length").count().collect()):
        base[r["part"], r["length"]] = counts[r["length"]]
        counts[r["length"]] += r["count"]
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("pieces must have 1 to capacity tokens")
    runs = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    found = [r for one in rounds(runs, capacity) for r in one.where("kind = 2").select("value", "first", "n", "seq", "per", "offset").collect()]
    placements = np.array([(r["value"], r["first"], r["first"] + r["n"], r["seq"], r["per"], r["offset"]) for r in found], np.int64).reshape(-1, 6)
    placements = placements[np.lexsort((placements[:, 1], placements[:, 0]))]
    # Places of all runs on one line, so that one search finds the placement of a (length, rank).
    ahead = {size: at for size, at in zip(sorted(counts), np.concatenate(([0], np.cumsum([counts[s] for s in sorted(counts)])))[:-1].tolist(), strict=True)} if counts else {}
    line = placements[:, 1] + np.array([ahead[s] for s in placements[:, 0].tolist()], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((line, placements, base, ahead))

    def placed(batches) -> Iterator:
        import pyarrow as pa

        line, placements, base, ahead = shared.value
        for batch in batches:
            sizes, parts, ranks = (batch.column(c).to_numpy() for c in ("length", part_name, rank_name))
            if not len(sizes):
                continue
            run = np.flatnonzero((np.diff(sizes, prepend=-1) != 0) | (np.diff(parts, prepend=-1) != 0))
            shift = np.array([base[p, s] + ahead[s] for p, s in zip(parts[run].tolist(), sizes[run].tolist(), strict=True)], np.int64)
            at = ranks + np.repeat(shift, np.diff(np.append(run, len(sizes))))
            k = np.searchsorted(line, at, "right") - 1
            past, per = at - line[k], placements[k, 4]
            keep = [c for c in batch.schema.names if c not in (part_name, rank_name)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(placements[k, 3] + past // per), pa.array(placements[k, 5] + past % per * sizes)],
                [*keep, "sequence_id", "offset"],
            )

    return rows.mapInArrow(placed, f"{schema}, sequence_id long, offset long")
