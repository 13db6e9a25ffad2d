"""Exact counting, coding and partitioning against brute force and the fixtures' examples."""

import itertools
import math
import random
import time
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil.functions import itemsets, prf
from tallyveil.operators import bitmaps, circuits, counts, encode, partition, sketch
from tallyveil.sources import files


def table(spark, rows):
    return spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(rows)], "tid long, " + ", ".join(f"a{k} long" for k in range(len(rows[0]))))


def brute(rows, max_size, min_size=1, domain=None):
    out = Counter()
    for r in rows:
        for size in range(min_size, max_size + 1):
            for attrs in itertools.combinations(range(len(r)), size):
                out[tuple((a, int(r[a])) for a in attrs)] += 1
    return out


@pytest.mark.parametrize(("seed", "k", "min_size"), [(0, 1, 1), (1, 5, 1), (2, 15, 1), (3, 200, 1), (4, 15, 2), (5, 40, 3)])
def test_top_itemsets(spark, seed, k, min_size):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 3, (60, 5)) * (rng.random((60, 5)) < 0.7)
    every = brute(rows, 4, min_size)
    want = sorted(every.items(), key=lambda x: (-x[1], x[0]))[:k]
    found, info = counts.top_itemsets(table(spark, rows), k, 4, min_size)
    assert found == want
    if len(found) == k:
        assert info["cutoff_tie_count"] >= sum(n == want[-1][1] for _, n in want)


def test_top_itemsets_over_many_items(spark):
    rng = np.random.default_rng(9)
    rows = rng.integers(0, 40, (300, 4))
    want = sorted(brute(rows, 2).items(), key=lambda x: (-x[1], x[0]))[:150]
    assert counts.top_itemsets(table(spark, rows), 150, 2)[0] == want


def test_top_itemsets_does_not_depend_on_partitions(spark):
    rows = np.random.default_rng(3).integers(0, 3, (200, 4))
    wide = table(spark, rows)
    assert len({str(counts.top_itemsets(wide.repartition(n), 20, 3)[0]) for n in (1, 4, 16)}) == 1


def test_allowed_items(spark):
    rows = np.random.default_rng(4).integers(0, 3, (80, 3))
    allowed = {(0, 1), (1, 2), (2, 0)}
    want = sorted(((s, n) for s, n in brute(rows, 3).items() if set(s) <= allowed), key=lambda x: (-x[1], x[0]))[:10]
    assert counts.top_itemsets(table(spark, rows), 10, 3, allowed=allowed)[0][: len(want)] == want


def test_universe_and_its_size(spark):
    domain = {0: [0, 1], 1: [0, 1], 2: [0, 1]}
    assert len(counts.universe(domain, 4, 100)) == counts.universe_size([2, 2, 2], 4) == 26
    with pytest.raises(ValueError):
        counts.universe(domain, 4, 25)


@pytest.mark.parametrize("n", [1, 2, 7, 200, 1001])
def test_exact_quantiles(spark, n):
    values = np.random.default_rng(n).integers(0, 90, n) / 4.0
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    shares = [i / 10 for i in range(1, 10)]
    assert np.allclose(encode.exact_quantiles(df, F.col("x"), shares), np.quantile(values, shares))


def test_coders(spark):
    df = spark.createDataFrame([(float(v), s) for v, s in zip([0, 0, 1, 2, 3, 4, -1, 9], "bcabcaaa", strict=True)], "x double, s string")
    assert [r[0] for r in df.select(encode.Categories.fit(df, F.col("s")).code(F.col("s"))).collect()] == [1, 2, 0, 1, 2, 0, 0, 0]
    x = np.array([0, 0, 1, 2, 3, 4, -1, 9.0])
    edges = np.unique(np.quantile(x[x != 0], np.linspace(0, 1, 11)[1:-1]))
    want = np.where(x == 0, 0, 1 + np.searchsorted(edges, x, side="right"))
    assert [r[0] for r in df.select(encode.Deciles.fit(df, F.col("x"), zero="own").code(F.col("x"))).collect()] == want.tolist()
    same = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert {r[0] for r in same.select(encode.Deciles.fit(same, F.col("x")).code(F.col("x"))).collect()} == {0}
    inner = np.unique(np.quantile(x, np.linspace(0, 1, 11)))[1:-1]
    assert [r[0] for r in df.select(encode.Deciles.fit(df, F.col("x")).code(F.col("x"))).collect()] == np.searchsorted(inner, x, side="right").tolist()
    with pytest.raises(ValueError):
        encode.clean_row(df, 3, "s")


def test_reduction_and_merging(spark):
    rows = np.random.default_rng(2).integers(0, 6, (100, 4))
    wide = table(spark, rows)
    small = encode.domain_map(encode.reduce_domains(wide, 0.5, 3))
    assert all(v == [0, 1, 2] for v in small.values())
    assert encode.reduce_domains(wide, 1.0, 3) is wide
    groups = encode.merge_groups(4, 0.5, 2, 1)
    assert sorted(a for g in groups for a in g) == [0, 1, 2, 3] and len(groups) == 2
    merged = {r.tid: r for r in encode.merge_features(wide, groups).collect()}
    for k, g in enumerate(groups):
        tuples = sorted({tuple(int(r[a]) for a in g) for r in rows})
        assert all(merged[i][f"a{k}"] == tuples.index(tuple(int(r[a]) for a in g)) for i, r in enumerate(rows))


def test_samples(spark):
    wide = table(spark, [[0, 0]] * 50 + [[1, 1]] * 50)
    some = encode.sample_rows(wide, 20, 5)
    assert some.count() == 20 and 3 <= some.where("a0 = 1").count() <= 17
    assert [r.tid for r in encode.sample_rows(wide, 4, None).orderBy("tid").collect()] == [0, 1, 2, 3]
    assert encode.sample_share(wide, 0.125, 5).count() == 12  # 12.5, half to even


def test_partitions():
    assert partition.sizes_by_ratio(16, (2, 1, 1, 1)) == [7, 3, 3, 3]
    assert partition.sizes_equal(8, 3) == [3, 3, 2]
    assert min(partition.sizes_by_ratio(8, (100, 1, 1, 1))) == 1
    assert sorted(partition.order_of(8, 4)) == list(range(8)) and partition.order_of(8, 4) == partition.order_of(8, 4)


def test_affinity(spark):
    rows = [(v % 2, v % 2, v // 2 % 2, v // 2 % 2, v % 3, v % 5) for v in range(20)]
    scores = {(r["left"], r["right"]): r["nmi"] for r in counts.mutual_information(table(spark, rows)).collect()}
    assert scores[0, 1] == pytest.approx(1.0) and scores[0, 2] == pytest.approx(0.0, abs=1e-9)
    groups = partition.affinity(scores, 6, [3, 2, 1])
    assert [len(g) for g in groups] == [3, 2, 1] and sorted(a for g in groups for a in g) == list(range(6))


def test_itemsets(spark):
    assert itemsets.canonical([(2, 1), (0, 3), (2, 1)]) == ((0, 3), (2, 1))
    with pytest.raises(ValueError):
        itemsets.canonical([(2, 1), (2, 3)])
    assert itemsets.text(((0, 1), (3, itemsets.OTHER))) == "{a0=1, a3=OTHER}"


def test_keyed_randomness(spark):
    u = [r[0] for r in spark.range(4000).select(prf.uniform("t", F.col("id"))).collect()]
    assert u[7] == prf.uniform_value("t", 7) and abs(np.mean(u) - 0.5) < 0.02
    lap = [r[0] for r in spark.range(4000).select(prf.laplace(2.0, "t", F.col("id"))).collect()]
    assert abs(np.mean(np.abs(lap)) - 2.0) < 0.15 and lap[3] == pytest.approx(prf.laplace_value(2.0, "t", 3))
    with prf.wrapping(spark):
        df = spark.range(50).select(prf.geometric_rank(F.col("id"), F.lit(5), 2026).alias("r"))
    assert [r[0] for r in df.collect()] == prf.geometric_rank_array(np.arange(50), np.array([5]), 2026)[:, 0].tolist()
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_circuits():
    rng = random.Random(1)
    for _ in range(50):
        q, t = ([rng.randrange(2) for _ in range(6)] for _ in range(2))
        assert circuits.subset_circuit(q, t) == int(all(b for a, b in zip(q, t, strict=True) if a))
        a, b = rng.randrange(64), rng.randrange(64)
        bits = lambda n: [n >> s & 1 for s in range(5, -1, -1)]
        assert circuits.less_circuit(bits(a), bits(b)) == int(a < b)
        assert circuits.add_circuit(bits(a), 1) == bits((a + 1) % 64)


def test_circuits_are_evaluated_on_packed_rows(spark):
    """Gates on bitmaps count what counting rows counts, for blocks of any size, and what the circuit of one row says."""
    rng = np.random.default_rng(8)
    rows = rng.integers(0, 2, (700, 4))
    wide, items = table(spark, rows).repartition(3), [(a, v) for a in range(4) for v in range(2)]
    some = [((0, 1),), ((0, 1), (2, 0)), ((0, 0), (1, 1), (3, 1)), ((0, 0), (0, 1))]
    for block in (1, 7, 64, 1 << 16):
        found = {some[r.candidate]: r.support for r in circuits.circuit_supports(wide, items, some, block).collect()}
        assert found == {s: sum(circuits.subset_circuit([i in s for i in items], [int(r[a] == v) for a, v in items]) for r in rows) for s in some}
    with pytest.raises(ValueError, match="isn't public"):
        circuits.circuit_supports(wide, items, [((9, 9),)])


def test_homomorphic_encryption(spark):
    public, private = circuits.key_pair(256)
    total = public.add(public.encrypt(20), public.encrypt(22))
    assert private.decrypt(total) == 42 and private.decrypt(public.times(total, -1)) == public.n - 42
    compare = circuits.Comparison(public, private, 100, 64)
    for x, y in [(3, 2), (2, 2), (1, 2), (100, 0)]:
        assert private.decrypt(compare.greater_all([public.encrypt(x)], [y])[0]) == int(x > y)
    with pytest.raises(ValueError):
        circuits.Comparison(public, private, 100, 250)


def test_encrypted_mining_and_tampering(spark):
    wide = table(spark, [[0, 0, 0], [0, 0, 1], [0, 1, 1], [0, 1, 1]])
    some = counts.universe({0: [0], 1: [0, 1], 2: [0, 1]}, 2, 100)
    supports, info = circuits.encrypted_mining(wide, some, {0: 0, 1: 1, 2: 1}, 1, bits=256)
    assert supports == counts.supports(wide, some) and info["smallest_class"] >= 2
    assert all(c["passed"] and c["required"] == 6 for c in info["checks"]) and len(info["checks"]) == 2
    assert all(o["verification_rows"] == 6 and o["smallest_class"] >= 2 for o in info["owners"])
    border = circuits.Border.of(0, 2)
    good, bad, rows = border.frequent, border.infrequent, [set(r) for r in border.rows for _ in range(3)]
    assert border.item_counts() == Counter(x for r in rows for x in r)
    sets = {frozenset(s) for g in good for n in (1, 2) for s in itertools.combinations(sorted(g), n)}
    assert circuits.check_answer(good, bad, sets)["passed"]
    assert not circuits.check_answer(good, bad, sets - {next(iter(good))})["passed"]
    assert not circuits.check_answer(good, bad, sets | bad)["passed"]
    assert all(sum(g <= r for r in rows) > 2 for g in good) and all(sum(b <= r for r in rows) <= 2 for b in bad)
    assert not circuits.publishable({}) and not circuits.publishable({"a": True, "b": False})


def test_a_tampered_answer_is_refused(spark):
    """Rows go to the cloud disguised; a changed sum, a changed comparison, a dropped itemset and an invented one are all found."""
    wide = table(spark, [[0, 0, 0], [0, 0, 1], [0, 1, 1], [0, 1, 1]])
    public, private = circuits.key_pair(256)
    domain = {0: [0], 1: [0, 1], 2: [0, 1]}
    owners = [circuits.prepare_owner(wide, who, attrs, domain, b"secret", public, 1) for who, attrs in ((0, [0]), (1, [1, 2]))]
    rows = [o.records.collect() for o in owners]
    assert not any("item" in x or "check" in x for some in rows for r in some for x in r.labels)
    aligned = [{bytes(r.htid) for r in some} for some in rows]
    assert len(aligned[0] & aligned[1]) == 4 and [len(x) for x in aligned] == [o.info["verification_rows"] + o.info["fictitious_rows"] + 4 for o in owners]
    flags = Counter(private.decrypt(int(r.cipher)) for r in rows[1])
    assert flags == {1: 4 + owners[1].info["verification_rows"], 0: owners[1].info["fictitious_rows"]}
    label = {item: x for o in owners for x, item in o.names.items()}
    real = {tuple(sorted(label[f"item:{a}:{v}"] for a, v in s)): s for s in (((0, 0), (2, 1)), ((1, 1), (2, 1)), ((1, 0),))}
    asked = sorted(set(real) | owners[0].asked | owners[1].asked)
    compare = circuits.Comparison(public, private, 100, 64)
    whose = {x: k for k, o in enumerate(owners) for x in o.names}
    sent = [spark.createDataFrame(some, "owner int, htid binary, labels array<string>, cipher string") for some in rows]
    replies = circuits.cloud_mine(sent, asked, whose, compare, public.encrypt(1))
    supports, _ = circuits.open_replies(replies, owners, private, 1)
    assert supports == counts.supports(wide, list(real.values()))
    at = next(k for k, r in enumerate(replies) if r.labels in real)
    more = replace(replies[at], support=public.add(replies[at].support, public.encrypt(5)), frequent=public.encrypt(0))
    dropped = [r for r in replies if frozenset(r.labels) not in owners[1].frequent]
    invented = [replace(r, support=public.encrypt(9), frequent=public.encrypt(1)) if frozenset(r.labels) in owners[0].infrequent else r for r in replies]
    for wrong in ([*replies[:at], more, *replies[at + 1 :]], dropped, invented):
        with pytest.raises(RuntimeError):
            circuits.open_replies(wrong, owners, private, 1)


def test_many_flags_and_comparisons_at_once(spark):
    """As one by one, at a fraction of the time; the engine's keyed hash is that of the library."""
    public, private = circuits.key_pair(256)
    messages = [0, 1, public.n - 1, *range(2, 9)]
    ciphers = public.encrypt_all(messages)
    assert list(map(private.decrypt, ciphers)) == messages and len(set(public.encrypt_all([1] * 50))) == 50 and public.encrypt_all([]) == []
    with pytest.raises(ValueError):
        public.encrypt_all([public.n])
    compare = circuits.Comparison(public, private, 100, 64)
    pairs = [(3, 2), (2, 2), (1, 2), (100, 0), (0, 100)] * 4
    assert list(map(private.decrypt, compare.greater_all(public.encrypt_all([x for x, _ in pairs]), [y for _, y in pairs]))) == [int(x > y) for x, y in pairs]
    assert compare.calls == len(pairs) and compare.greater_all([], []) == []
    began = time.perf_counter()
    for _ in range(2000):
        public.encrypt(1)
    single, began = time.perf_counter() - began, time.perf_counter()
    public.encrypt_all([1] * 2000)
    assert time.perf_counter() - began < single / 3
    ids = spark.createDataFrame([("real:1",), ("check:0:é",), ("",)], "id string")
    for secret in (b"secret", bytes(range(100))):
        assert all(bytes(r.h) == circuits.hashed_tid(secret, r.id) for r in ids.withColumn("h", circuits.hashed_column(secret, F.col("id"))).collect())


def test_owners_refuse_items_that_are_not_public(spark):
    wide = table(spark, [[0, 0], [0, 1], [1, 1]])
    public, _ = circuits.key_pair(256)
    with pytest.raises(Exception, match="isn't public"):
        circuits.prepare_owner(wide, 0, [0], {0: [0]}, b"secret", public, 1).records.collect()


def test_circuits_guard_their_payload(spark):
    wide = table(spark, [[0, 0, 0], [0, 0, 1], [0, 1, 1], [0, 1, 1]])
    domain, owner = {0: [0], 1: [0, 1], 2: [0, 1]}, {0: 0, 1: 1, 2: 1}
    some = counts.universe(domain, 2, 100)
    supports, info = circuits.circuit_mining(wide, some, owner, domain, 2)
    assert supports == counts.supports(wide, some) and info["below"] == sum(n < 2 for n in supports.values()) and info["above"] == sum(n > 2 for n in supports.values())
    told = circuits.agreement(wide, supports, 3, 2, domain)
    assert (told["verified"], told["f1"], told["ncr"], told["truth"][0]) == (len(some), 1.0, 1.0, [[0, 0]])
    with pytest.raises(RuntimeError, match="wrong"):
        circuits.agreement(wide, supports | {some[0]: 1}, 3, 2, domain)
    with pytest.raises(ValueError, match="over the limit"):
        circuits.circuit_mining(wide, some, owner, domain, 2, most_gib=1e-6)
    assert circuits.payload_bytes(10, 3, 2) == ((10 + 2) * 3 + 2 * 6 + 4) * 2536


def test_circuits_take_rows_block_by_block(spark):
    """More rows than the limit holds at once are counted in full; the limit is refused only where one row is too many."""
    wide = table(spark, [[0, 0, 0], [0, 0, 1], [0, 1, 1], [0, 1, 1]])
    domain, owner = {0: [0], 1: [0, 1], 2: [0, 1]}, {0: 0, 1: 1, 2: 1}
    some = counts.universe(domain, 2, 100)
    whole = circuits.payload_bytes(4, 5, len(some))
    for less, blocks in ((0, 1), (5, 2), (15, 4)):
        limit = whole - less * circuits.CIPHER_BYTES
        supports, info = circuits.circuit_mining(wide, some, owner, domain, 2, most_gib=limit / (1 << 30))
        assert supports == counts.supports(wide, some)
        assert (info["blocks"], info["payload_bytes"]) == (blocks, whole) and info["block_bytes"] <= limit
    with pytest.raises(ValueError, match="over the limit"):
        circuits.circuit_mining(wide, some, owner, domain, 2, most_gib=(whole - 16 * circuits.CIPHER_BYTES) / (1 << 30))


def test_primes():
    small = [n for n in range(3, 4000, 2) if all(n % d for d in range(3, int(n**0.5) + 1, 2))]
    assert [n for n in range(3, 4000, 2) if not any(circuits._witness(b, n) for b in range(2, min(n - 1, 40)))] == small
    assert circuits._prime(64).bit_length() == 64


def test_padding(spark):
    f = spark.createDataFrame([(c, n) for c, n in zip("abcdefg", (9, 7, 7, 5, 3, 2, 1), strict=True)], "item string, frequency long")
    padded = circuits.padding_table(f, 3)
    by = {r["item"]: r for r in padded.collect()}
    assert {by[c]["class"] for c in "abc"} == {0} and {by[c]["class"] for c in "defg"} == {1}
    full = Counter({c: by[c].frequency for c in by})
    for r in circuits.padding_rows(padded).collect():
        full.update(r["items"])
    assert min(Counter(full.values()).values()) >= 3


def test_intersections_have_a_limit(spark):
    long = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "tid long, label string")
    found = {tuple(r["labels"]): r["support"] for r in circuits.tid_intersections(long, 2, 10).collect()}
    assert found == {("a",): 2, ("b",): 1, ("a", "b"): 1}
    with pytest.raises(Exception, match="limit"):
        circuits.tid_intersections(long, 2, 2).collect()


def test_files(spark, tmp_path):
    wide = table(spark, [[1, 2], [3, 4], [1, 2]])
    files.write_coded(wide.coalesce(1), str(tmp_path / "t"))
    back = files.read_coded(spark, str(tmp_path / "t"), 2)
    assert sorted((r.a0, r.a1) for r in back.collect()) == [(1, 2), (1, 2), (3, 4)]
    assert [(r.tid, r.a0) for r in back.orderBy("tid").collect()] == [(0, 1), (1, 3), (2, 1)]
    (tmp_path / "long.csv").write_text("0,1\n" + "".join(f"{k},{k % 7}\n" for k in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        many = files.read_coded(spark, str(tmp_path / "long.csv"), 2)
        assert many.rdd.getNumPartitions() > 5 and many.where("tid <> a0").count() == 0 and many.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception):  # noqa: B017
        files.read_coded(spark, str(tmp_path / "long.csv"), 3).collect()
    who = {"a": 1}
    assert files.reuse(tmp_path / "r.json", who) is None
    files.store(tmp_path / "r.json", who, {"f1": 0.5})
    assert files.reuse(tmp_path / "r.json", who) == {"f1": 0.5}
    with pytest.raises(ValueError):
        files.reuse(tmp_path / "r.json", {"a": 2})
    with pytest.raises(ValueError):
        files.write_json(tmp_path / "x.json", {"v": math.nan})
    assert files.table_digest(wide).first() == files.table_digest(wide.repartition(3)).first()
    toy = files.toy(spark)
    assert toy.count() == 1200 and len(toy.columns) == 9
    made = files.generate(spark, 2000, 4, 3, 2, 1.0, 0.0, 1)
    assert made.where("a0 <> a1").count() == 0 and made.where("a0 <> a2").count() > 0


def test_suite(spark, tmp_path):
    assert len(files.suite()) == 16
    done = files.write_suite(spark, str(tmp_path), ["domain_4"]).first()
    assert done.rows == 50_000 and files.read_coded(spark, str(tmp_path / "domain_4"), 24).count() == 50_000
    report = counts.group_report(files.generate(spark, 3000, 8, 4, 4, 0.9, 0.0, 5), [a // 4 for a in range(8)]).first()
    assert report.within_nmi > 0.3 > 0.05 > report.across_nmi and report.entropy_bits > 1.9


def test_bitmaps_by_blocks(spark):
    """Blocks of any size, prefixes in any number: the same supports as counting rows; what is tried is counted without being made."""
    rng = np.random.default_rng(12)
    rows = rng.integers(0, 3, (333, 4))
    items = [(a, v) for a in range(4) for v in range(3)]
    want = brute(rows, 4)
    for block in (1, 50, 1 << 16):
        packed = bitmaps.blocks(table(spark, rows).repartition(3), items, block)
        for size in (2, 3):
            singles = bitmaps.level_supports(packed, items, [()], size).collect()
            assert {tuple(sorted(items[k] for k in r.members)): r.n for r in singles} == {s: n for s, n in want.items() if len(s) == size}
        some = [(0, 4), (0, 5), (3, 6)]
        found = bitmaps.level_supports(packed, items, some, 3).collect()
        assert {tuple(r.members) for r in found} == {(*p, j) for p in some for j in range(p[-1] + 1, 12) if items[j][0] not in {items[i][0] for i in p} and {(p[0], j), (p[1], j)} <= set(some)}
        packed.unpersist()
    assert bitmaps.tried(items, [()], 3) == sum(len(s) == 3 for s in itertools.chain.from_iterable(itertools.combinations(items, r) for r in (3,)) if len({a for a, _ in s}) == 3)
    assert bitmaps.tried(items, [(0,), (3,)], 2) == 9 + 6
    assert bitmaps.level_supports(bitmaps.blocks(table(spark, rows).limit(0), items), items, [()], 2).count() == 0


def test_top_itemsets_of_an_empty_table(spark):
    assert counts.top_itemsets(table(spark, [[0, 1]]).limit(0), 3, 2, domain={0: [0], 1: [1]})[0] == [(((0, 0),), 0), (((1, 1),), 0)]


def test_sketches_of_many_partitions_shuffle_few_rows(spark):
    """500 partitions: at most keys x sqrt(partitions) x 2 rows are shuffled, and the arrays are those of one partition."""
    wide = spark.range(0, 4000, 1, 500).select(F.col("id").alias("tid"), (F.col("id") % 3).alias("a0"))
    members = [F.col("a0") == 1, F.col("a0") == 2, F.lit(False)]
    one = sketch.clean_sketches(wide.coalesce(1), members, 64, 5)
    sc = spark.sparkContext
    sc.setJobGroup("fold", "fold")
    assert np.array_equal(sketch.clean_sketches(wide, members, 64, 5), one) and not one[2].any() and one[0].max() > 5
    sc.setLocalProperty("spark.jobGroup.id", None)
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("fold") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s) is not None}
    assert 0 < sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) <= 3 * 500**0.5 * 2
