"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyveil.llm import queries, turntrie

EMPTY = hashlib.sha256(b"").hexdigest()


def brute(convs):
    """Nodes of a dictionary of conversations, each a list of (what, size)."""
    members, ends, size = defaultdict(list), defaultdict(list), {(): 0}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            path = tuple(k for k, _ in turns[:d])
            members[path].append(c)
            size[path] = turns[d - 1][1] if d else 0
        ends[path].append(c)
    out = []
    for path, some in members.items():
        below = [q for q in members if q[: len(path)] == path]
        kids = [q for q in below if len(q) == len(path) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * size[q] for q in below)
        parent = min(members[path[:-1]]) if path else None
        told = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        out.append((min(some), len(path), parent, len(some), len(kids), leaves, saved, told))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=repr)


def in_parts(arrays, cuts, chunk, fan):
    """The same rows from sweeps of parts and a stitch, without Spark around them."""
    given = sorted(arrays, key=lambda a: (a[1], a[0]))
    edges = [0, *sorted(cuts), len(given)]
    swept = [(p, r) for p, (a, b) in enumerate(zip(edges, edges[1:])) for r in turntrie.sweep_part(iter(given[a:b]), chunk, fan)]
    spines = defaultdict(list)
    for p, r in swept:
        if r[0] == turntrie.SPINE:
            spines[p, r[11]].append(r)
    both = [x for x in swept if x[1][0] != turntrie.SPINE] + list(turntrie.stitch(iter([(*k, v) for k, v in sorted(spines.items())])))
    known = {(p, r[1]): r[3] for p, r in both if r[0] == turntrie.KNOWN}
    pieces = defaultdict(list)
    for p, r in both:
        if r[0] == turntrie.IDS:
            pieces[r[10]].append((p, r[11], r[12]))
    told = {k: hashlib.sha256(b",".join(x for *_, x in sorted(v))).hexdigest() for k, v in pieces.items()}
    out = []
    for p, r in both:
        if r[0] == turntrie.FINISHED:
            parent = known[p, r[1]] if r[1] is not None else r[4]
            out.append((r[3], r[2], parent, r[5], r[6], r[7], r[8], told[r[10]] if r[10] else r[9]))
    assert max((len(v) for v in spines.values()), default=0) <= 1 + max((len(a[1]) for a in arrays), default=0)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(60))
def test_parts_are_stitched(seed):
    """Any cut into parts, empty ones too, any size of a piece and of a fan gives the same nodes."""
    rng = random.Random(seed)
    n, letters = rng.choice([1, 5, 40, 120]), rng.choice([1, 2, 6])
    convs = {rng.randrange(-50, 5000): [(b"abcdef"[k : k + 1], len("abcdef") - k) for k in (rng.randrange(letters) for _ in range(rng.randrange(0, rng.choice([1, 4, 9]))))] for _ in range(n)}
    arrays = [(c, [k for k, _ in t], [s for _, s in t]) for c, t in convs.items()]
    cuts = [rng.randrange(len(arrays) + 1) for _ in range(rng.choice([0, 1, 3, 12]))]
    assert in_parts(arrays, cuts, rng.choice([1, 8, 1 << 20]), rng.choice([0, 1, 3, 4096])) == brute(convs)


def test_no_arrays():
    assert list(turntrie.sweep_part(iter([]))) == [] and list(turntrie.stitch(iter([]))) == []


def rebuilt(rows):
    """The contract's rule, with Python's numbers; % as in SQL."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = [(x, len(x[1].encode())) for x in own.get(base, [])[:h] + turns[h:]]
    return out


def test_rows(spark):
    """Nulls everywhere, ties and repeated rows, hot copies over all parts, a long conversation, clashing columns."""
    rng = random.Random(5)
    rows = [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, ""])) for c in [*range(0, 90), -7, -5, -3] for k in range(rng.randrange(1, 12))]
    rows += [(1000 + 5 * c, k, "user", "same") for c in range(400) for k in range(3)]
    rows += [(77, None, "user", "first"), (77, None, "user", "first"), (77, 1, None, "z"), (77, 1, "", "y"), (None, 1, "user", "lost"), (4000, None, None, None)]
    rows += [(4100, k, "user", "x" * (k % 50)) for k in range(1500)]
    table = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "conv_id long, turn int, role string, text string, part int, depth int, keys string")
    got = rows_of(turntrie.prefix_trie(turntrie.rebuilt(turntrie.turn_arrays(table))))
    long = 4100
    want = rebuilt(rows)
    short = {c: t for c, t in want.items() if c != long}
    assert [r for r in got if r[1] > 12 and r[0] == long] and len([r for r in got if r[0] == long]) >= 1490
    assert rows_of(turntrie.prefix_trie(turntrie.rebuilt(turntrie.turn_arrays(table.where(f"conv_id <> {long} or conv_id is null"))))) == brute(short)
    assert max(r[3] for r in got) == len(want)
    assert turntrie.prefix_trie(turntrie.rebuilt(turntrie.turn_arrays(table.where("false")))).count() == 0


def test_query_over_whole_conversations(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert rows_of(queries.op13_turn_trie(spark, sf)) == brute(rebuilt(rows))
