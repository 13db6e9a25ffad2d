"""Conversation prefix trie: range-sorted turn arrays, common prefixes of neighbours, a stack sweep, stitched borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialise

#: Turns that a conversation may take from its base, and conversations of one base.
SHARED, FAMILY = 9, 5
#: Bytes of ids that one row hands on where a node's own members lie in several partitions.
CHUNK = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_arrays(turns: DataFrame) -> DataFrame:
    """conv_id, keys, sizes: each conversation's turns in order, as 16 bytes of a digest of role and text, and bytes of text.

    Turns go by number (null first), then role, then text; null roles and texts count as empty; repeated rows stay. Rows
    without conv_id belong to no conversation. A conversation is one row of 20 bytes a turn, however long its texts.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role before it keeps role and text apart.
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    key = F.unhex(F.substring(F.sha2(said, 256), 1, 32))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"), F.octet_length(text).alias("bytes")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.select("conv_id", F.struct(place.alias("at"), "key", "bytes").alias("one"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return lists.select("conv_id", F.transform("all", lambda x: x["key"]).alias("keys"), F.transform("all", lambda x: x["bytes"]).alias("sizes"))


def rebuilt(arrays: DataFrame) -> DataFrame:
    """conv_id, keys, sizes, where a conversation c starts with the first h turns of c - c % 5 and goes on with its own after h.

    h is crc32 of c's decimal digits modulo 9; % takes the sign of c, as in SQL.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    base = arrays.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), *(F.slice(c, 1, SHARED - 1).alias(f"base_{c}") for c in ("keys", "sizes")))
    rows = arrays.withColumn("h", h).join(base, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base"), "left")

    def mixed(name: str) -> Column:
        first = F.coalesce(F.slice(f"base_{name}", F.lit(1), F.col("h")), F.slice(name, 1, 0))
        return F.concat(first, F.slice(name, F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0)))).alias(name)

    return rows.select("conv_id", mixed("keys"), mixed("sizes"))


class Node:
    """An open node and what its finished children sum up to."""

    __slots__ = ("size", "smallest", "members", "children", "leaves", "saved", "ends", "ends_key", "ref", "waiting", "left")

    def __init__(self, size: int):
        self.size, self.smallest, self.left, self.ends, self.ends_key, self.ref = size, None, False, EMPTY, None, None
        self.members = self.children = self.leaves = self.saved = 0
        self.waiting: list[list] = []

    def add(self, smallest: int | None, members: int, children: int, leaves: int, saved: int) -> None:
        if smallest is not None and (self.smallest is None or smallest < self.smallest):
            self.smallest = smallest
        self.members += members
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def totals(self) -> tuple[int, int]:
        """Childless nodes of the finished node's subtree, and the tokens that it saves."""
        return self.leaves if self.children else 1, self.saved + (self.members - 1) * self.size

    def row(self, depth: int) -> list:
        """The finished node's row; its parent's id comes later."""
        leaves, saved = self.totals()
        return [FINISHED, None, depth, self.smallest, None, self.members, self.children, leaves, saved, self.ends, self.ends_key, None, None]


#: Kinds of rows that a part gives: a finished node; the id of one that others wait for under (part, ref); a piece of the
#: ids of a node's own members; a node of the part's spines, that is of its first array (side 0) or of its last beyond what
#: both share (side 1), with what its finished children sum up to.
FINISHED, KNOWN, IDS, SPINE = 0, 1, 2, 3
_FIELDS = "kind int, ref bigint, depth int, conv_id bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends string, ends_key binary, seq bigint, bytes binary"
#: Finished children that wait for the id of their open parent; more are handed on with a reference to it.
FAN = 4096


def _paths(stack: list[Node], last: list[bytes], keys: list[bytes], sizes: list[int], pop) -> int:
    """Turns the stack of nodes over array `last` into that over `keys`; returns how much they share. pop closes the top."""
    shared, most = 0, min(len(last), len(keys))
    while shared < most and last[shared] == keys[shared]:
        shared += 1
    while len(stack) > shared + 1:
        pop()
    stack.extend(map(Node, sizes[shared:]))
    return shared


def sweep_part(rows: Iterator[tuple[int, list, list]], chunk: int = CHUNK, fan: int = FAN) -> Iterator[list]:
    """The rows of one part: arrays in order, of equal ones the smaller conversation first.

    A node on the part's spines may go on in another part: it isn't finished, but handed on. So a part hands on as many nodes
    as two arrays are long. Only members of the first and of the last array can have equal ones elsewhere: their ids, and those
    of any array with very many, go on in pieces of about `chunk` bytes, to be hashed in order.
    """
    stack: list[Node] = []
    first: list[Node] = []
    first_keys: list[bytes] = []
    last: list[bytes] = []
    out: list[list] = []
    ids: list[str] = []
    refs = held = seq = 0

    def refer(node: Node) -> int:
        nonlocal refs
        if node.ref is None:
            refs += 1
            node.ref = refs
        return node.ref

    def hand_on(node: Node) -> None:
        """Finished children go on with a reference to their parent."""
        for r in node.waiting:
            r[1] = refer(node)
        out.extend(node.waiting)
        node.waiting = []

    def piece() -> None:
        nonlocal ids, held, seq
        stack[-1].ends_key = stack[-1].ends_key or hashlib.sha256(b"".join(last)).digest()
        stack[-1].ends = None
        out.append([IDS, None, None, None, None, None, None, None, None, None, stack[-1].ends_key, seq, ",".join(ids).encode()])
        seq += 1
        ids, held = [], 0

    def end_run(at_border: bool) -> None:
        """The array at the top has had its last member."""
        nonlocal ids, held
        if ids and (at_border or stack[-1].ends_key):
            piece()
        elif ids:
            stack[-1].ends = hashlib.sha256(",".join(ids).encode()).hexdigest()
            ids, held = [], 0

    def pop() -> None:
        node = stack.pop()
        if node.left:
            hand_on(node)
            return
        for r in node.waiting:
            r[4] = node.smallest
        out.extend(node.waiting)
        if node.ref is not None:
            out.append([KNOWN, node.ref, None, node.smallest, *[None] * 9])
        row = node.row(len(stack))
        parent = stack[-1]
        parent.add(node.smallest, node.members, 1, row[7], row[8])
        parent.waiting.append(row)
        if parent.left or len(parent.waiting) > fan:
            hand_on(parent)

    for conv, keys, sizes in rows:
        if not stack:
            stack.append(Node(0))
            stack.extend(map(Node, sizes))
            first, first_keys = stack[:], keys
            for node in first:
                node.left = True
        elif keys != last:
            end_run(last == first_keys)
            _paths(stack, last, keys, sizes, pop)
        last = keys
        stack[-1].add(conv, 1, 0, 0, 0)
        ids.append(str(conv))
        held += len(ids[-1]) + 1
        if held >= chunk:
            piece()
        if len(out) >= 2000:
            yield from out
            out.clear()
    if stack:
        end_run(True)
        for side, nodes, keys in ((0, first, first_keys), (1, [n for n in stack if not n.left], last)):
            at = len(stack) - len(nodes) if side else 0
            for d, node in enumerate(nodes, at):
                hand_on(node)
                out.append([SPINE, refer(node), d, node.smallest, node.size, node.members, node.children, node.leaves, node.saved, node.ends, node.ends_key, side, keys[d - 1] if d else b""])
    yield from out


def stitch(spines: Iterator[tuple[int, int, list]]) -> Iterator[tuple[int, list]]:
    """Finished nodes of all spines, and their ids for those that wait: the same sweep over the spines of parts in order.

    spines are (part, side, nodes), a node being a SPINE row; a right side starts below what it shares with its left one. As many
    nodes as all spines have are held at most: parts times the length of two arrays.
    """
    stack: list[Node] = []
    last: list[bytes] = []
    left: list[bytes] = []
    known: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, list]] = []

    def pop() -> None:
        node = stack.pop()
        for r in node.waiting:
            r[4] = node.smallest
            out.append((0, r))
        out.extend((part, [KNOWN, ref, None, node.smallest, *[None] * 9]) for part, ref in known.pop(id(node), []))
        row = node.row(len(stack))
        if stack:
            stack[-1].add(node.smallest, node.members, 1, row[7], row[8])
            stack[-1].waiting.append(row)
        else:
            out.append((0, row))

    for part, side, nodes in spines:
        start = nodes[0][2]
        keys = (left[: start - 1] if side else []) + [n[12] for n in nodes if n[2]]
        if not stack:
            stack.append(Node(0))
        _paths(stack, last, keys, [0] * (start - 1 if side else 0) + [n[4] for n in nodes if n[2]], pop)
        last = keys
        left = left if side else keys
        for n in nodes:
            node = stack[n[2]]
            node.add(n[3], n[5], n[6], n[7], n[8])
            if n[10] is not None or n[9] != EMPTY:
                node.ends, node.ends_key = n[9], n[10]
            known.setdefault(id(node), []).append((part, n[1]))
        yield from out
        out.clear()
    while stack:
        pop()
    yield from out


def _batches(rows: Iterator[list], part=None) -> Iterator:
    """Arrow batches of rows; `part` is the part of all of them, or they are (part, row)."""
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.int64(), pa.binary()]
    names = ["part", *(f.split()[0] for f in _FIELDS.split(", "))]

    def made(some: list):
        parts = [part] * len(some) if part is not None else [p for p, _ in some]
        columns = zip(*(some if part is not None else [r for _, r in some]), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= 4000 or (row[0] == IDS):
            yield made(held)
            held = []
    if held:
        yield made(held)


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of arrays (conv_id, keys, sizes), the empty one among them.

    Rows are conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Arrays are range-sorted by
    their keys, then conv_id, so that equal ones, however many, lie in as many parts as they need; conv_ids are unique. Neighbours'
    common prefixes drive a stack in each part (`sweep_part`), and the stacks left open at the borders are stitched in one
    small task (`stitch`). No arrays give no node.
    """
    spark, scratch = arrays.sparkSession, []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = arrays.select("conv_id", "keys", "sizes").repartitionByRange(parts, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    schema = "part int, " + _FIELDS

    def sweep(batches) -> Iterator:
        from pyspark import TaskContext

        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    some = batch.slice(at, 1000)
                    yield from zip(*(some.column(c).to_pylist() for c in range(3)), strict=True)

        yield from _batches(sweep_part(rows()), TaskContext.get().partitionId())

    swept = materialise(ordered.mapInArrow(sweep, schema), "swept", scratch=scratch)
    spines = swept.where(F.col("kind") == SPINE).repartition(1).sortWithinPartitions("part", "seq", "depth")

    def join_up(batches) -> Iterator:
        def groups():
            held, of = [], None
            for batch in batches:
                for r in batch.to_pylist():
                    part, *values = r.values()
                    if of is not None and of != (part, values[11]):
                        yield *of, held
                        held = []
                    of = part, values[11]
                    held.append(values)
            if held:
                yield *of, held

        yield from _batches(stitch(groups()))

    stitched = materialise(spines.mapInArrow(join_up, schema), "stitched", rows=1, scratch=scratch)

    def hashed(batches) -> Iterator:
        """Streams the pieces of a key in order through its digest."""
        import pyarrow as pa

        key, digest, out = None, None, []
        for batch in batches:
            for k in range(batch.num_rows):
                this = batch.column(0)[k].as_py()
                if this != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = this, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(batch.column(1)[k].as_py())
        if key is not None:
            out.append((key, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["ends_key", "digest"])

    pieces = swept.where(F.col("kind") == IDS).repartition("ends_key").sortWithinPartitions("ends_key", "part", "seq")
    digests = pieces.select("ends_key", "bytes").mapInArrow(hashed, "ends_key binary, digest string")

    both = swept.where(F.col("kind").isin(FINISHED, KNOWN)).unionByName(stitched)
    ids = both.where(F.col("kind") == KNOWN).select("part", "ref", F.col("conv_id").alias("found"))
    nodes = both.where(F.col("kind") == FINISHED)
    referred = nodes.where(F.col("ref").isNotNull()).join(ids, ["part", "ref"]).withColumn("parent", F.col("found")).select(nodes.columns)
    nodes = nodes.where(F.col("ref").isNull()).unionByName(referred)
    ended = nodes.where(F.col("ends_key").isNotNull()).join(digests, "ends_key").withColumn("ends", F.col("digest")).select(nodes.columns)
    nodes = nodes.where(F.col("ends_key").isNull()).unionByName(ended)
    out = nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    out = materialise(out, "trie")
    discard(spark, scratch)
    return out
