"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact counts decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, fresh, materialise
from .textscan import BASE, PUNCTUATION, Scan, as_bytes, groups, mix, slices

WORDS = 5
THRESHOLD = 0.8
#: Trees of the forest, and mins of a signature in each (8 at most: 16 bits of each fill two words).
TREES, LONGEST = 20, 8
#: Mins by which matched prefixes are shortened at once, and the share of the links that must be found.
STEP, RECALL = 2, 0.9999
#: Classes and shingles that a cell has, about; a unit of work is a cell or two.
CELL_CLASSES, CELL_SHINGLES = 512, 1_000_000
#: Members up to which a node brings only these to the units of its cells, and not the whole cells.
SMALL = 64
#: Most bits of a filter that is broadcast (64 MB).
FILTER_BITS = 1 << 29
#: Shingles that are counted at once in a unit.
COLUMNS = 4096


def meeting(similarity, depth: int, trees: int = TREES):
    """The chance that two sets share the first `depth` mins in some tree: each tree's are equal with chance similarity ** depth."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix at which sets at the threshold, and so all that are more similar, meet with the target recall."""
    for d in range(longest, 0, -1):
        if meeting(threshold, d, trees) >= recall:
            return d
    raise ValueError("too few trees for this recall")


def levels(threshold: float, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL, step: int = STEP) -> list[int]:
    """Prefix lengths that are tried, from the longest to the one that suits even sets at the threshold."""
    floor = prefix_length(threshold, trees, longest, recall)
    return [*range(longest, floor, -step), floor]


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of every `words` words in a row; of all words where there are fewer, but not none.

    Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z.
    """
    s = Scan(texts, PUNCTUATION, fold=True)
    hashes = s.word_hashes()
    found, at = s.windows(hashes, words)
    cut = np.searchsorted(s.text_of[at], np.arange(len(texts) + 1))
    out = [np.unique(found[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    for k in np.flatnonzero((s.n_words > 0) & (s.n_words < words)).tolist():
        total = int(s.n_words[k])
        for h in hashes[s.first_word[k] : s.first_word[k] + total].tolist():
            total = (total * BASE + h) % (1 << 64)
        out[k] = mix(np.array([total], np.uint64))
    return out


def class_of(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits that tell sets of shingles apart: sums of two mixes of their members. None for an empty set."""
    seeds = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)
    return [b"".join(int(mix(x ^ seed).sum(dtype=np.uint64)).to_bytes(8, "big") for seed in seeds) if len(x) else None for x in sets]


def _signatures(sets: list[np.ndarray], trees: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each nonempty set and tree two words: 16 bits of each of the tree's mins, the first in the highest bits."""
    if not 1 <= longest <= 8:
        raise ValueError("a tree has 1 to 8 mins")
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    seeds = mix(np.arange(1, 2 * trees * longest + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    turn, factor = (seeds[::2] >> np.uint64(32)).astype(np.uint32), seeds[1::2].astype(np.uint32) | np.uint32(1)
    words = np.zeros((2, len(sets), trees), np.uint64)
    for tree in range(trees):
        for k in range(longest):
            least = np.minimum.reduceat((flat ^ turn[tree * longest + k]) * factor[tree * longest + k], starts)
            words[k // 4, :, tree] |= (least & np.uint32(0xFFFF)).astype(np.uint64) << np.uint64(48 - 16 * (k % 4))
    return words[0], words[1]


def _masks(depth: int) -> tuple[int, int]:
    """Bits of a signature's two words that hold the first `depth` mins."""
    first, second = min(depth, 4), max(depth - 4, 0)
    return ((1 << 16 * first) - 1) << (64 - 16 * first), ((1 << 16 * second) - 1) << (64 - 16 * second)


def _signed(docs: DataFrame, doc_id: str, text: str, trees: int, longest: int, words: int) -> DataFrame:
    """doc_id, text_hash, cls (null without shingles), size and the trees' signatures of every row."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            texts = as_bytes(batch.column(2))
            for a, b in groups(texts):
                sets = shingles(texts[a:b], words)
                some = [k for k, x in enumerate(sets) if len(x)]
                sides: list[list] = [[None] * (b - a), [None] * (b - a)]
                if some:
                    for side, words_of in zip(sides, _signatures([sets[k] for k in some], trees, longest), strict=True):
                        for k, row in zip(some, words_of.view(np.int64).tolist(), strict=True):
                            side[k] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(class_of(sets), pa.binary()), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in sides)],
                    ["doc_id", "text_hash", "cls", "size", "hi", "lo"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text_hash long, cls binary, size long, hi array<long>, lo array<long>")


def _maybe(rows: DataFrame, key: list[Column], wanted: DataFrame, of: list[Column]) -> DataFrame:
    """The rows whose key may be among wanted's: most others are left out before they are shuffled.

    Each wanted key sets one bit of a filter, and rows look up theirs. The filter is broadcast; its size
    is bounded by FILTER_BITS, whatever is wanted: beyond that it lets more rows through.
    """
    page = 1 << 15  # bits of a bitmap of the engine
    bits = min(max(16 * wanted.count(), page), FILTER_BITS)

    def place(columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1

    pages = wanted.select(place(of).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    with_place = rows.withColumn("_p", place(key))
    found = with_place.join(F.broadcast(pages), F.bitmap_bucket_number("_p") == F.col("_page"))
    return found.where(F.call_function("getbit", byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _with_shingles(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """The rows of wanted (rep_id, rep_hash, cls, ...) with their shingles, found again in the text of that id and hash.

    How many texts are wanted grows with the corpus, so they are never broadcast, at any size. A text
    that is there many times is one row: its repeats follow one another.
    """
    more = [c for c in wanted.columns if c not in ("rep_id", "rep_hash")]
    at = more.index("cls") + 1

    def run(batches) -> Iterator:
        import pyarrow as pa

        last = None
        for batch in slices(batches):
            texts, cls = as_bytes(batch.column(0)), batch.column(at).to_pylist()
            new = [k for k, c in enumerate(cls) if c != (cls[k - 1] if k else last)]
            last = cls[-1]
            for a, b in groups([texts[k] for k in new]):
                sets = shingles([texts[k] for k in new[a:b]], words)
                rows = pa.array(new[a:b], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), pa.array([x.tobytes() for x in sets], pa.binary())], [*more, "shingles"])

    rows = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_hash"), F.col(text).cast("string").alias("_text"))
    rows = _maybe(rows, [F.col("_doc"), F.col("_hash")], wanted, [F.col("rep_id"), F.col("rep_hash")])
    joined = rows.join(wanted.hint("merge"), F.col("_doc").eqNullSafe(F.col("rep_id")) & (F.col("_hash") == F.col("rep_hash"))).select("_text", *more)
    schema = ", ".join(f"{wanted.schema[c].name} {wanted.schema[c].dataType.simpleString()}" for c in more)
    return joined.mapInArrow(run, f"{schema}, shingles binary")


def _matched(batches, floor: int, longest: int) -> Iterator:
    """Goes over a sorted part of the tries: keeps the entries that share `floor` mins or more with a neighbour, with how many.

    An entry's longest match in its tree is with the one before or after it. The first and the last
    entry of a part may match in another part: they stay.
    """
    import pyarrow as pa

    def with_depth(rows, depth: np.ndarray):
        at = np.flatnonzero(depth >= floor)
        rows = rows.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(depth[at].astype(np.int32))], [*rows.schema.names, "depth"])

    last, before = None, longest
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        tree, hi, lo = (rows.column(k).to_numpy() for k in range(3))
        x, y = (np.bitwise_xor(w[1:], w[:-1]).view(np.uint64) for w in (hi, lo))
        near = sum((x >> np.uint64(48 - 16 * k) == 0).astype(np.int64) for k in range(4))
        near += (x == 0) * sum((y >> np.uint64(48 - 16 * k) == 0).astype(np.int64) for k in range(4))
        near = np.where(tree[1:] == tree[:-1], np.minimum(near, longest), 0)
        depth = np.maximum(np.concatenate(([before], near)), np.concatenate((near, [0])))
        yield with_depth(rows.slice(0, rows.num_rows - 1), depth[:-1])
        last, before = rows.slice(rows.num_rows - 1), int(near[-1]) if len(near) else before
    if last is not None:
        yield with_depth(last, np.array([longest]))


def components(edges: DataFrame, name: str, rows: int) -> DataFrame:
    """v and label, the smallest vertex of its component, for the vertices of edges (a, b).

    Every round points each vertex at its smallest neighbour, follows the pointers to their ends, and
    contracts the edges to those: only edges between different ends go on, so that vertices at least
    halve in a round. Pointers are followed eight at a time before a table is written. rows is the most
    edges there may be. The tables that a round leaves are written to the shared folder and deleted at
    the end.
    """
    spark, scratch = edges.sparkSession, []
    edges = materialise(edges.select("a", "b").where("a != b").distinct(), f"{name}-edges", rows, scratch)
    rounds: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        ends = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("end"))
        moved = True
        while moved:
            ends = materialise(ends, f"{name}-ends", rows, scratch).select("v", "end")
            for _ in range(3):
                further = ends.select(F.col("v").alias("end"), F.col("end").alias("next"))
                ends = ends.join(further, "end").select("v", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved"))
            ends = materialise(ends, f"{name}-ends", rows, scratch)
            moved = bool(ends.where("moved").limit(1).count())
            ends = ends.select("v", "end")
        rounds.append(ends)
        edges = edges.join(ends.toDF("a", "x"), "a").select("x", "b").distinct().join(ends.toDF("b", "y"), "b")
        edges = materialise(edges.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{name}-edges", rows, scratch)
    if not rounds:
        label = edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    else:
        label = rounds[0].toDF("v", "label")
        for ends in rounds[1:]:  # an end of one round is a vertex of the next, if it still has edges
            label = label.join(ends.toDF("label", "end"), "label", "left").select("v", F.coalesce("end", "label").alias("label"))
    label = materialise(label, f"{name}-labels", rows)
    discard(spark, scratch)
    return label


def _similarity(sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of every two sets: exact counts of common shingles by matrix products."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    members, who = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(members, kind="stable")
    members, who = members[order], who[order]
    new = np.concatenate(([True], members[1:] != members[:-1]))
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1  # a shingle of one set alone is in no intersection
    keep = shared[number]
    who, number = who[keep], (np.cumsum(shared) - 1)[number[keep]]
    common = np.zeros((m, m), np.float64)
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(number, (first, first + COLUMNS))
        part = np.zeros((m, COLUMNS), np.float32)
        part[who[a:b], number[a:b] - first] = 1
        common += part @ part.T
    return common / (sizes[:, None] + sizes[None, :] - common)


def _meet(hi: np.ndarray, lo: np.ndarray, depth: int) -> np.ndarray:
    """Which sets share their first `depth` mins in some tree."""
    first, second = (np.uint64(x) for x in _masks(depth))
    a, b = hi & first, lo & second
    out = np.zeros((len(hi), len(hi)), bool)
    for tree in range(hi.shape[1]):
        out |= (a[:, tree, None] == a[None, :, tree]) & (b[:, tree, None] == b[None, :, tree])
    return out


def _local(linked: np.ndarray) -> np.ndarray:
    """The smallest place in each place's component."""
    label = np.arange(len(linked))
    while True:
        near = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        near = near[near]
        if (near == label).all():
            return label
        label = near


def _pairs(held: list[tuple], cross: bool, depth: int, before: int | None) -> np.ndarray:
    """Which classes of a unit, rows (cls, cell, hi, lo, ...), are to be compared in this round: a symmetric matrix.

    A pair counts in the one unit of its two cells, and in the round in which its matched prefix is
    first short enough.
    """
    hi, lo = (np.array([x[k] for x in held], np.int64).view(np.uint64) for k in (2, 3))
    due = _meet(hi, lo, depth)
    if before is not None:
        due &= ~_meet(hi, lo, before)
    if cross:
        side = np.array([x[1] for x in held])
        due &= side[:, None] != side[None, :]
    np.fill_diagonal(due, False)
    return due


def _by_unit(rows: DataFrame, names: list[str], kinds: list[str], solve) -> DataFrame:
    """Rows (i, j, cls, ...) sorted by unit go to solve(unit, distinct classes), and what it returns comes out."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        types = {"binary": pa.binary(), "long": pa.int64(), "array<double>": pa.list_(pa.float64())}
        key, held, out = None, [], []

        def batch_of(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def done() -> None:
            if len(held) > 1:
                out.extend(solve(key, sorted({x[0]: x for x in held}.values(), key=lambda x: x[0])))

        for batch in slices(batches):
            for i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (i, j) != key:
                    done()
                    key, held = (i, j), []
                held.append(tuple(row))
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        done()
        if out:
            yield batch_of(out)

    return rows.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def _due(rows: DataFrame, depth: int, before: int) -> DataFrame:
    """Of rows (i, j, cls, cell, hi, lo) those of classes that have a pair to compare, without the signatures."""

    def solve(unit: tuple, held: list[tuple]) -> list[tuple]:
        return [(*unit, *held[k][:2]) for k in np.flatnonzero(_pairs(held, unit[0] != unit[1], depth, before).any(1)).tolist()]

    return _by_unit(rows, ["i", "j", "cls", "cell"], ["long", "long", "binary", "long"], solve)


def _links(rows: DataFrame, depth: int, before: int | None, tried: list[int], threshold: float) -> DataFrame:
    """From rows (i, j, cls, cell, hi, lo, n_copies, shingles): cls, links (documents of linked classes), hub, pairs, lost.

    hub is a class that it is connected to, pairs the number of linked classes, and lost says, for each
    prefix length of `tried`, how many more links of such similarity are to be expected for those found.
    """

    def solve(unit: tuple, held: list[tuple]) -> list[tuple]:
        due = _pairs(held, unit[0] != unit[1], depth, before)
        some = np.flatnonzero(due.any(1))
        if not len(some):
            return []
        due, held = due[np.ix_(some, some)], [held[k] for k in some.tolist()]
        similarity = _similarity([np.frombuffer(x[5], np.uint64) for x in held])
        linked = due & (similarity >= threshold - 1e-9)
        links, hub = linked @ np.array([x[4] for x in held], np.int64), _local(linked)
        trees = len(held[0][2])
        lost = np.stack([np.where(linked, 1 / meeting(similarity, d, trees).clip(1e-9) - 1, 0.0).sum(1) for d in tried], 1)
        pairs = linked.sum(1)
        return [(held[k][0], int(links[k]), held[hub[k]][0], int(pairs[k]), lost[k].tolist()) for k in np.flatnonzero(pairs).tolist()]

    return _by_unit(rows, ["cls", "links", "hub", "pairs", "lost"], ["binary", "long", "binary", "long", "array<double>"], solve)


def _node(depth: int) -> Column:
    """A number for an entry's node of the trie: its tree and first `depth` mins."""
    signed = [x - (1 << 64) if x >> 63 else x for x in _masks(depth)]
    return F.xxhash64("tree", *(F.col(c).bitwiseAND(F.lit(x)) for c, x in zip(("hi", "lo"), signed, strict=True)))


def _work(trie: DataFrame, depth: int, before: int | None, most: int, scratch: list[str]) -> DataFrame:
    """i, j, cls, cell: the classes of each unit of work, for the nodes that prefixes of length `depth` make.

    Nodes that shortening from `before` has not widened are done. A class is at home in the largest of
    its nodes, and gathers round the largest home of any class that it shares a node with; those of one
    centre are dealt to cells of bounded size, which part the classes. Two cells (or one with itself)
    are a unit if a node has members in both, so that every two classes that share a node meet in one
    unit. What gathers round a centre lies within two steps of it: in a chain of documents of which only
    neighbours are similar, units are of neighbours and their number grows with the chain. Large nodes
    bring their whole cells, small ones only their own members.
    """
    entries = trie.where(F.col("depth") >= depth).select(_node(depth).alias("node"), (_node(before) if before else F.lit(None)).alias("child"), "cls", "size")
    nodes = entries.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("a"), F.max("child").alias("b")).where("n > 1")
    nodes = (nodes.where("a != b") if before else nodes).select("node", "n")
    members = materialise(entries.join(nodes, "node").select("node", "n", "cls", "size"), "members", scratch=scratch)
    homes = members.groupBy("cls").agg(F.max(F.struct("n", "node")).alias("home"))
    tops = members.select("node", "cls").join(homes, "cls").groupBy("node").agg(F.max("home").alias("top"))
    centres = members.join(materialise(tops, "tops", scratch=scratch), "node").groupBy("cls").agg(F.max("top").alias("top"), F.first("size").alias("size"))
    centres = centres.select("cls", F.col("top.node").alias("centre"), "size")
    cells = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_CLASSES), F.ceil(F.sum("size") / CELL_SHINGLES))
    sizes = materialise(centres.groupBy("centre").agg(cells.alias("cells")), "centres", most, scratch)  # so that the join with it may split a large one
    cell = F.xxhash64("centre", F.pmod(F.xxhash64("cls"), "cells"))
    cells = materialise(centres.join(sizes, "centre").select("cls", cell.alias("cell")), "cells", most, scratch)
    placed = members.select("node", "n", "cls").join(cells, "cls")
    met = placed.groupBy("node", "n", "cell").agg(F.count(F.lit(1)).alias("here"))
    met = materialise(met, "met", scratch=scratch)
    other = met.select("node", F.col("cell").alias("other"), F.col("here").alias("there"))
    apart = (F.col("cell") != F.col("other")) | (F.col("there") > 1)
    unit = (F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"))
    small = placed.where(F.col("n") <= SMALL).join(other, "node").where(apart).select(*unit, "cls", "cell")
    large = met.where(F.col("n") > SMALL).join(other, "node").where(apart & (F.col("cell") <= F.col("other"))).select(*unit).distinct()
    large = large.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("cell")).join(cells, "cell").select("i", "j", "cls", "cell")
    return materialise(small.union(large).distinct(), "units", scratch=scratch)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, doc_id: str = "doc_id", text: str = "text", trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, class_id, class_key, n_links, copy_id, n_copies.

    Documents with the same set of shingles are copies and form one class of copies (copy_id its
    smallest doc_id, n_copies its rows); only classes are compared. n_links counts the other rows whose
    similarity is at least the threshold, copies among them. class_id is the smallest doc_id of all
    documents that links connect; class_key tells classes apart even where different texts share an id,
    and is null for a text without words. Such a text has no shingles and no links and is its own
    class, as are null texts; a text of fewer words than a shingle has one shingle of them all; a very
    long text is compared whole. Repeated rows are copies; null ids sort last; extra columns are
    ignored, whatever their names; an empty table gives none.

    A class's signature in each tree is a path of a trie: signatures are range-sorted, and the matched
    prefix of one is what it shares with its neighbours. Candidates share a node. The first round takes
    nodes at the longest prefixes; their pairs are verified by exact counts; and prefixes are shortened
    until the links found, each weighed by the chance that it was found, say that the target recall is
    reached, or at the latest where even pairs at the threshold reach it. A link's worth of doubt is
    added, so that few links decide nothing.
    """
    spark, scratch = docs.sparkSession, []
    tried = levels(threshold, trees, recall=recall)
    signed = materialise(_signed(docs, doc_id, text, trees, LONGEST, words), "signed")
    some = signed.where("cls is not null")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    classes = some.groupBy("cls").agg(rep, F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("hi").alias("hi"), F.first("lo").alias("lo"))
    classes = classes.select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "n_copies", "size", "hi", "lo")
    classes = materialise(classes, "classes", scratch=scratch)

    entries = classes.select("cls", "size", F.posexplode(F.arrays_zip("hi", "lo")).alias("tree", "x")).select("tree", "x.hi", "x.lo", "cls", "size")
    order = ["tree", "hi", "lo", "cls"]
    floor = tried[-1]
    trie = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    trie = materialise(trie.mapInArrow(lambda batches: _matched(batches, floor, LONGEST), "tree int, hi long, lo long, cls binary, size long, depth int"), "trie", scratch=scratch)
    matched = trie.select("cls").distinct()
    full = classes.join(matched, "cls").select("rep_id", "rep_hash", "cls", "n_copies", "hi", "lo")
    full = materialise(_with_shingles(docs, full, doc_id, text, words), "shingles", scratch=scratch)
    most = full.select("cls").count()  # of the classes with candidates: bounds the small tables below

    found, pairs, lost = None, 0.0, [0.0] * len(tried)
    for k, depth in enumerate(tried):
        before = tried[k - 1] if k else None
        units = _work(trie, depth, before, most, scratch)
        if before is not None:  # most pairs were compared before, as the signatures say: only what is left is sent shingles
            signs = full.select("cls", "hi", "lo")
            units = materialise(_due(units.join(signs, "cls").select("i", "j", "cls", "cell", "hi", "lo"), depth, before), "due", scratch=scratch)
        work = units.join(full, "cls").select("i", "j", "cls", "cell", "hi", "lo", "n_copies", "shingles")
        links = materialise(_links(work, depth, before, tried, threshold), "links", scratch=scratch)
        found = links if found is None else found.union(links)
        told = links.agg(F.coalesce(F.sum("pairs"), F.lit(0)), *(F.coalesce(F.sum(F.col("lost")[i]), F.lit(0.0)) for i in range(len(tried)))).first()
        pairs, lost = pairs + told[0], [x + y for x, y in zip(lost, told[1:], strict=True)]
        if lost[k] + 2 * (1 / meeting(threshold, depth, trees) - 1) <= (1 - recall) * pairs:
            break

    links = found.groupBy(F.col("cls").alias("_c")).agg(F.sum("links").alias("links"))
    label = components(found.where("cls != hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")), "classes", max(1, found.count()))
    joined = classes.join(label, F.col("cls") == F.col("v")).select("cls", "label", "rep_id")
    first = materialise(joined.groupBy("label").agg(F.min("rep_id").alias("class_id")), "first", most, scratch)
    linked = joined.join(first, "label").select(F.col("cls").alias("_v"), "class_id", "label")
    info = classes.select("cls", "rep_id", "n_copies").join(links, F.col("cls") == F.col("_c"), "left").join(linked, F.col("cls") == F.col("_v"), "left")
    info = info.select(
        F.col("cls").alias("_cls"), F.coalesce("class_id", "rep_id").alias("class_id"), F.coalesce("label", "cls").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
        F.col("rep_id").alias("copy_id"), "n_copies",
    )
    info = materialise(info, "info")
    discard(spark, scratch)
    out = some.select("doc_id", "text_hash", "cls").join(info, F.col("cls") == F.col("_cls"))
    out = out.select("doc_id", "text_hash", "class_id", "class_key", "n_links", "copy_id", "n_copies")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = signed.where("cls is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(None).cast("binary"), none, F.col("doc_id").alias("copy_id"), one)
    return out.union(alone)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that stand for their class: of each class one row of the smallest id stays, with all its columns.

    Of equal texts without words one stays too; a null text and an empty one are different texts.
    """
    found = materialise(jaccard_join(docs, doc_id=doc_id, text=text, **how), "joined")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("x")
    classes = found.where("class_key is not null").groupBy("class_key").agg(best)
    wordless = found.where("class_key is null").groupBy("text_hash").agg(best)
    stay = classes.select("x.doc_id", "x.text_hash").union(wordless.select("x.doc_id", "x.text_hash"))
    counted = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows")).toDF("d", "h", "rows")
    stay = stay.join(counted, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_hash").eqNullSafe(F.col("h")))
    d, h = fresh(docs.columns, "_d", "_h")
    stay = materialise(stay.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), (F.col("rows") > 1).alias("many")), "stay")

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some.select(d, h), docs[doc_id].eqNullSafe(some[d]) & (F.xxhash64(docs[text]) == some[h]), "left_semi")

    rows, repeated = of(stay.where("not many")), stay.where("many")
    # Only rows that are there more than once, which is rare, are compared with one another as a whole.
    return rows.union(of(repeated).dropDuplicates([doc_id, text])) if repeated.limit(1).count() else rows
