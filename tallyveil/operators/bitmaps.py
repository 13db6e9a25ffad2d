"""Packed bitmaps of items, block by block of rows, and supports by prefix intersections in the tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.itemsets import Item

#: Rows of a block, and supports that a task sums up before it hands them on.
BLOCK, HELD = 1 << 16, 1 << 18
#: Bitmaps that one step intersects with a prefix.
AT_ONCE = 256


def blocks(wide: DataFrame, items: Sequence[Item], block: int = BLOCK) -> DataFrame:
    """n, bits: a row for each block of rows (at most `block`, n of them), with the bitmap of every item one after the other; each padded to whole 64-bit words.

    An item costs a bit a row, so the table is far smaller than the coded one. It is kept, for every level reads it.
    """
    used = sorted({a for a, _ in items})
    rows = wide.select(*(F.col(f"a{a}").cast("bigint").alias(f"a{a}") for a in used))

    def run(batches) -> Iterator:
        import pyarrow as pa

        def packed(values: list[np.ndarray]):
            n = len(values[0])
            out = np.zeros((len(items), -(-n // 64) * 8), np.uint8)
            for k, (a, v) in enumerate(items):
                bits = np.packbits(values[used.index(a)] == v)
                out[k, : len(bits)] = bits
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["n", "bits"])

        held, rows_held = [np.zeros(0, np.int64) for _ in used], 0
        for batch in batches:
            held = [np.concatenate((x, batch.column(c).to_numpy(zero_copy_only=False))) for c, x in enumerate(held)]
            rows_held += batch.num_rows
            at = 0
            while rows_held - at >= block:
                yield packed([x[at : at + block] for x in held])
                at += block
            held, rows_held = [x[at:] for x in held], rows_held - at
        if rows_held:
            yield packed(held)

    return rows.mapInArrow(run, "n int, bits binary").persist(StorageLevel.MEMORY_AND_DISK)


def _extensions(prefix: tuple[int, ...], attrs: Sequence[int], frequent: set[tuple[int, ...]] | None) -> list[int]:
    """Items after a prefix, of other attributes, all of whose sets with the prefix less one item are frequent."""
    taken = {attrs[i] for i in prefix}
    later = range(prefix[-1] + 1 if prefix else 0, len(attrs))
    out = [j for j in later if attrs[j] not in taken]
    if frequent is not None:
        out = [j for j in out if all((*prefix[:d], *prefix[d + 1 :], j) in frequent for d in range(len(prefix)))]
    return out


def _descend(bits: np.ndarray, prefixes: Iterable[tuple[int, ...]], size: int, attrs: Sequence[int], frequent: set[tuple[int, ...]] | None) -> Iterator[tuple[tuple[int, ...], list[int], np.ndarray]]:
    """Depth-first: (prefix of size - 1 items, items after it, rows that have both) in one block.

    Prefixes come in order, so a stack of intersections gives each from the one before; those that no row of the block has go no deeper.
    """
    full = np.full(bits.shape[1], ~np.uint64(0))
    stack, path = [full], ()
    for p in prefixes:
        shared = 0
        while shared < min(len(path), len(p)) and path[shared] == p[shared]:
            shared += 1
        del stack[shared + 1 :]
        for i in p[shared:]:
            stack.append(stack[-1] & bits[i])
        path = p
        todo = [(p, stack[-1])]
        while todo:
            prefix, rows = todo.pop()
            if prefix and not rows.any():
                continue
            after = _extensions(prefix, attrs, frequent if len(prefix) > 1 else None)
            if not after:
                continue
            if len(prefix) == size - 1:
                for at in range(0, len(after), AT_ONCE):
                    some = after[at : at + AT_ONCE]
                    yield prefix, some, np.bitwise_count(rows & bits[some]).sum(1, dtype=np.int64)
            else:
                todo += [((*prefix, j), rows & bits[j]) for j in after]


def level_supports(packed: DataFrame, items: Sequence[Item], prefixes: Sequence[tuple[int, ...]], size: int) -> DataFrame:
    """members array<int> (places in items) and n: supports of the sets of `size` items that start with a prefix, zero left out.

    `prefixes` are the frequent sets of the level before (or only the empty one, when levels below `size` need no answer): all of
    them reach the floor, so that there are about as many as the answer is long, and they go to every task. What is tried is
    made in the tasks, and never is a list.
    """
    attrs = [a for a, _ in items]
    starts = sorted(prefixes)
    frequent = set(starts) if starts and len(starts[0]) > 1 and len(starts[0]) == size - 1 else None
    shared = packed.sparkSession.sparkContext.broadcast((starts, frequent))

    def run(batches) -> Iterator:
        import pyarrow as pa

        starts, frequent = shared.value
        sums: dict[tuple[int, ...], int] = {}

        def out():
            found = pa.RecordBatch.from_arrays([pa.array([list(s) for s in sums], pa.list_(pa.int32())), pa.array(list(sums.values()), pa.int64())], ["members", "n"])
            sums.clear()
            return found

        for batch in batches:
            for k in range(batch.num_rows):
                bits = np.frombuffer(batch.column(0)[k].as_py(), np.uint64).reshape(len(attrs), -1)
                for prefix, after, counts in _descend(bits, starts, size, attrs, frequent):
                    for j, n in zip(after, counts.tolist(), strict=True):
                        if n:
                            s = (*prefix, j)
                            sums[s] = sums.get(s, 0) + n
                    if len(sums) >= HELD:
                        yield out()
        yield out()

    return packed.select("bits").mapInArrow(run, "members array<int>, n bigint").groupBy("members").agg(F.sum("n").alias("n"))


def tried(items: Sequence[Item], prefixes: Sequence[tuple[int, ...]], size: int) -> int:
    """How many sets level_supports tries at most: counted, not made."""
    attrs = [a for a, _ in items]
    if list(prefixes) == [()]:  # all sets of items of different attributes
        sums = [1] + [0] * size
        for held in Counter(attrs).values():
            for d in range(size, 0, -1):
                sums[d] += sums[d - 1] * held
        return sums[size]
    frequent = set(prefixes) if prefixes and len(prefixes[0]) > 1 else None
    return sum(len(_extensions(p, attrs, frequent)) for p in prefixes)
