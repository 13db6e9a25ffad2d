"""Text operators against brute force, round trips and held-out labels."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveil.llm import chat, decontam, jaccard, lines, packing, quality, queries, rules, sharding, substrings, textscan, tokens, wavelet

BLANKS = " \t\n\x0b\x0c\r"
ODD = [None, "", " ", "\n\n", "a", "É à\n" * 40, "x" * 5000, "İstanbul 'S it's ßÀ", "日本語 の 文 é́ a\x1cb", "<|endoftext|> y <|startoftext|>", "x,. y.., z!!? 12 3a", "a  b \n\n c\td "]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t or ""))


def docs_of(spark, texts, extra=False):
    rows = [(k, t, "e", 7) if extra else (k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep string, n_lines int" if extra else "doc_id long, text string")


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return {r.doc_id: r.text for r in corpus.collect()}


# tokens


@pytest.mark.parametrize(("make", "file"), [(tokens.ByteBpe, "byte_bpe_50k.json"), (tokens.WordBpe, "word_bpe_49k.json")])
def test_ids_are_the_library_s(make, file, texts):
    coder = make(queries.tokenizer_file(file))
    some = [t or "" for t in [*ODD, *list(texts.values())[:120]]]
    for t, ids in zip(some, coder.encode(some), strict=True):
        assert ids == np.array(coder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:60]


def test_word_ids_of_awkward_texts():
    """Runs of marks, digits, contractions and white space of all kinds, at random."""
    coder, rng = tokens.WordBpe(queries.tokenizer_file("word_bpe_49k.json")), random.Random(4)
    pieces = ["a", "B", "é", "Ü", "ß", "ª", "µ", "1", "23", ",", ".", "..", ",.", "'s", "'", "'LL", "_", "-", "!!", "«", "×", "²", " ", "  ", "\n", "\t", "\xa0", "\x85", "word", "Don't", "$%"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        assert coder.encode([t])[0] == np.array(coder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


# packing


def best_fit(sizes, capacity):
    """Sequences of sequential best-fit decreasing."""
    gaps, opened = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, s)
        if at < len(gaps):
            g = gaps.pop(at)
        else:
            g, opened = capacity, opened + 1
        if g > s:
            bisect.insort(gaps, g - s)
    return opened


def packed(spark, sizes, capacity):
    """Sequences of the rounds, whose placements are checked; and the number of tables that they wrote."""
    table = spark.createDataFrame(list(Counter(sizes).items()), "length int, n long")
    tables = packing.rounds(table, capacity)
    held, seen = defaultdict(list), defaultdict(set)
    for one in tables:
        for r in one.where("kind = 2").collect():
            assert not seen[r.value] & set(range(r.first, r.first + r.n))
            seen[r.value] |= set(range(r.first, r.first + r.n))
            for k in range(r.n):
                held[r.seq + k // r.per].append((r.offset + r.value * (k % r.per), r.value))
    assert {s: len(x) for s, x in seen.items()} == Counter(sizes) and all(max(x) == len(x) - 1 for x in seen.values())
    for some in held.values():
        at = 0
        for offset, size in sorted(some):
            assert offset == at
            at += size
        assert at <= capacity
    return len(held), len(tables)


@pytest.mark.parametrize("seed", range(6))
def test_rounds_pack_as_best_fit(spark, monkeypatch, seed):
    """Few rounds, about as many sequences as one document after the other, and the same whatever parts the table has."""
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(40, 200))
    sizes = rng.integers(1, int(rng.integers(2, capacity + 2)), int(rng.integers(50, 1500))).tolist()
    want = best_fit(sizes, capacity)
    found, tables = packed(spark, sizes, capacity)
    assert found <= max(want + 1, 1.01 * want) and tables < 60
    for runs in (16, 1 << 20)[: 2 * (seed < 3)]:
        monkeypatch.setattr(packing, "PART_RUNS", runs)
        found, _ = packed(spark, sizes, capacity)
        assert found <= max(want + 2, 1.03 * want)


def test_parts_deal_free_gaps_by_rank():
    assert packing.assign([(0, 5, 0), (1, 2, 1), (2, 0, 6), (3, 4, 9)]) == [(1, 0, 0, 0, 1), (2, 0, 1, 0, 2), (2, 2, 0, 1, 4)]
    assert packing.assign([(0, 0, 3), (1, 4, 0)]) == []


def test_packing_keeps_clashing_columns(spark):
    rows = [(k if k % 3 else None, 0, 1 + k % 7, 5, "6", "7", 8) for k in range(40)] + [(1, 0, 2, 5, "6", "7", 8)] * 3
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, _part int, _rank string, sequence_id string, offset int")
    out = packing.pack(df, 8)
    assert set(out.columns) == set(df.columns) and out.count() == 43 and {(r["_part"], r["_rank"]) for r in out.collect()} == {(5, "6")}
    held = defaultdict(list)
    for r in out.collect():
        held[r.sequence_id].append((r.offset, r.length))
    for some in held.values():
        assert [a for a, _ in sorted(some)] == [sum(n for _, n in sorted(some)[:k]) for k in range(len(some))] and sum(n for _, n in some) <= 8
    for wrong in (0, 9):
        with pytest.raises(ValueError, match="1 to capacity"):
            packing.pack(spark.createDataFrame([(1, 0, wrong)], "doc_id long, piece int, length long"), 8)


def test_rounds_of_the_corpus(spark, texts):
    """The corpus, and a million times as many documents of its lengths, in as many rounds: no more sequences than best fit."""
    coder = tokens.ByteBpe(queries.tokenizer_file("byte_bpe_50k.json"))
    sizes = [x for t in texts.values() for x in packing.cut(len(coder.encode([t or ""])[0]) // 4 + 1, 2048)]
    found, tables = packed(spark, sizes, 2048)
    assert found <= best_fit(sizes, 2048) + 1
    many = packing.rounds(spark.createDataFrame([(s, n * 10**6) for s, n in Counter(sizes).items()], "length int, n long"), 2048)
    assert len(many) <= 2 * tables and sum(r.rows for one in many for r in one.where("kind = 2").groupBy().agg(F.count(F.lit(1)).alias("rows")).collect()) < 6000


def test_packing_places_every_piece(spark, texts):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(5, ODD[5])] + [(100 + k, "hot words here") for k in range(300)] + list(texts.items())[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    coder = tokens.ByteBpe(queries.tokenizer_file("byte_bpe_50k.json"))
    file = queries.tokenizer_file("byte_bpe_50k.json")
    found = packing.pack(packing.tokenize(docs, lambda: tokens.byte_bpe(file), 0, 256), 256).collect()
    ids = defaultdict(list)
    for k, t in rows:
        ids[k].append(coder.encode([t or ""])[0] + bytes(4))
    assert sum(r.length for r in found) == sum(len(x) // 4 for some in ids.values() for x in some)
    held = defaultdict(list)
    for r in found:
        assert any(zlib.crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for x in ids[r.doc_id])
        assert r.piece == 0 or r.length == 256
        held[r.sequence_id].append((r.offset, r.length))
    for some in held.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(packing.tokenize(docs.limit(0), lambda: tokens.byte_bpe(file), 0, 256), 256).count() == 0


# decontamination


def hits_of(docs, items, n=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    out = []
    for d, t in docs:
        w, inside, ids = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    inside |= set(range(k, k + size))
                    ids |= windows[tuple(w[k : k + size])]
        out.append((d, len(w), len(inside), sorted(str(x) for x in ids if x is not None), bool(inside)))
    return sorted(out)


def test_decontamination(spark):
    big = " ".join(f"w{i}" for i in range(5000)) + " alpha beta gamma ÀÉ é " + " ".join(f"w{i}" for i in range(3000))
    docs = [(1, None), (2, ""), (3, "Alpha beta, GAMMA Éa"), (4, big), (5, "x alpha beta gamma Éa alpha beta gamma Éa")] + [(5, "x alpha beta gamma Éa alpha beta gamma Éa"), (5, "other"), (6, "alpha beta gamma éa"), (7, "one")]
    items = [(1, "alpha beta gamma Éa"), (2, " ".join(f"w{i}" for i in range(2045, 2056))), (3, ""), (4, None), (5, "ONE"), (6, "gamma ÀÉ É"), (7, "gamma ÀÉ É")]
    d, i = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_words int"), spark.createDataFrame(items, "item_id long, text string")
    read = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in df.collect())
    assert read(decontam.decontaminate(d, i)) == hits_of(docs, items)
    assert [r[2:] for r in read(decontam.decontaminate(d, i.limit(0)))] == [(0, [], False)] * len(docs)
    assert decontam.decontaminate(d.limit(0), i).count() == 0
    clean = {(r.doc_id, r.text) for r in decontam.clean_documents(d, i).collect()}
    assert clean == {x for x, h in zip(docs, [hits_of([x], items)[0] for x in docs], strict=True) if not h[4]}


def test_clean_documents_of_any_columns(spark):
    rows = [(1, "alpha beta gamma", 1, 1), (2, "other words", 1, 1), (None, None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _d int, _h int")
    items = spark.createDataFrame([(1, "Beta")], "item_id long, text string")
    found = decontam.clean_documents(df, items)
    assert found.columns == df.columns and {r.doc_id for r in found.collect()} == {2, None}


def test_decontamination_with_a_full_filter(spark, corpus, sf, monkeypatch):
    """A filter that nearly every place passes, and joins that shuffle, give the same answers."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    read = lambda: sorted((r.doc_id, r.n_hit, r.item_ids) for r in decontam.decontaminate(corpus, items).collect())
    first = read()
    monkeypatch.setattr(decontam, "BITS", 64)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert read() == first and any(n for _, n, _ in first)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# line dedup


def lines_of(docs, least):
    have = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            have[low(x.strip(BLANKS))].add((i, t))
    out = []
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if not low(x.strip(BLANKS)) or len(have[low(x.strip(BLANKS))]) < least]
        out.append((i is None, i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(spark):
    docs = [(None, None), (1, ""), (2, "A\n a \nb"), (3, "a\t\nB\r"), (4, "a"), (4, "a"), (None, "c\na"), (None, "x\na"), (8, "É\né"), (9, "É\nÃ")] + [(100 + i, f"hot\nhot\nx{i}") for i in range(300)]
    df = spark.createDataFrame([(*x, 3, b"k") for x in docs], "doc_id long, text string, n_lines int, keep binary").repartition(6)
    for least in (2, 3, 10):
        found = sorted(((r.doc_id is None, *r) for r in lines.dedup_lines(df, least, digest=True).collect()), key=str)
        assert found == lines_of(docs, least)
    whole = lines.dedup_lines(df, 10)
    assert whole.columns == df.columns and {(r.doc_id, r.text) for r in whole.collect() if r.doc_id and r.doc_id >= 100} == {(100 + i, f"x{i}") for i in range(300)}
    first = [r.text for r in lines.dedup_lines(df, 2, keep_first=True).where("doc_id >= 100").orderBy("doc_id").collect()]
    assert first[0] == "hot\nx0" and first[1] == "x1"
    assert lines.dedup_lines(df.limit(0), 2).count() == 0


def test_line_stream_in_batches(monkeypatch):
    """Any batches give the same rows, a key's documents are counted over them, and little is held back."""
    import pyarrow as pa
    import pyspark

    class Task:
        partitionId = staticmethod(lambda: 7)

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Task))
    rng = random.Random(2)
    for _ in range(60):
        rows = sorted((rng.randrange(4), rng.randrange(2), rng.choice([-1, 1, 2, 3, 4, 5]), rng.randrange(2), k) for k in range(rng.randrange(0, 40)))
        rows = [(a, b, None if i < 0 else i, t, k, 9) for a, b, i, t, k in rows]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["h1", "h2", "_doc", "_text", "pos", "n_lines"])
        size, least = rng.randrange(1, 12), rng.randrange(1, 6)
        out = [r for x in lines._streamed([whole.slice(k, size) for k in range(0, len(rows), size)], least) for r in x.to_pylist()]
        have = defaultdict(set)
        for a, b, i, t, _, _ in rows:
            have[a, b].add((i, t))
        real = [r for r in out if r["pos"] >= 0]
        assert [(r["h1"], r["h2"], r["_doc"], r["_text"], r["pos"]) for r in real] == [r[:5] for r in rows]
        assert [r["hot"] for r in real] == [len(have[r[:2]]) >= least for r in rows]
        assert [r["first"] for r in real] == [k == 0 or rows[k - 1][:2] != r[:2] for k, r in enumerate(rows)]
        assert {(r["h1"], r["h2"]): r["documents"] for r in out if r["pos"] < 0} == {k: len(have[k]) for k in ({rows[0][:2], rows[-1][:2]} if rows else ())}


# n-gram Jaccard join


def links_of(docs):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset() for w in (words(t) for _, t in docs)]
    parent, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, least[find(k)], links[k]) for k, (i, _) in enumerate(docs))


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_CLASSES", 20)
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    docs = [(k, " ".join([*base[: k % 9 * 3], f"x{k % 41}", *base[k % 9 * 3 + 1 :]])) for k in range(400)]
    docs += [(1000, ""), (1001, None), (1002, "a b"), (1003, "A, b"), (1003, "A, b"), (1004, " ".join(base[:60])), (1005, "q" * 9000)]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, size int")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(df).collect()) == links_of(docs)
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == {c for _, c, _ in links_of(docs)}
    assert jaccard.jaccard_join(df.limit(0)).count() == 0


def test_jaccard_join_finds_links_near_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85: with 20 trees of 4 mins hardly one in 20,000 is missed."""
    rng = random.Random(1)
    rows = []
    for k in range(150):
        base = [f"v{rng.randrange(10**6)}" for _ in range(100)]
        changed = base[:]
        for at in (20, 60):
            changed[at] = f"z{k}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed))]
    found = {r.doc_id: r.n_links for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found.values()) == sum(x[2] for x in links_of(rows)) == 300


def test_prefixes_are_shortened_to_the_recall():
    d = jaccard.prefix_length(0.8, 20, 8, 0.9999)
    miss = lambda d: (1 - 0.8**d) ** 20
    assert miss(d) <= 1e-4 < miss(d + 1)


def test_levels_end_where_the_threshold_is_safe():
    assert jaccard.levels(0.8) == [8, 6, 4] and jaccard.levels(0.8, step=1) == [8, 7, 6, 5, 4] and jaccard.levels(0.99) == [8]
    assert jaccard.meeting(0.8, jaccard.levels(0.8)[-1]) >= jaccard.RECALL
    with pytest.raises(ValueError, match="too few trees"):
        jaccard.levels(0.2)


def test_a_chain_makes_linear_work(spark, monkeypatch):
    """Documents of which only neighbours are similar, in one component: twice as many make about twice the work."""
    rng = random.Random(4)
    work = []
    whole = jaccard._work

    def counted(*args):
        out = whole(*args)
        work[-1] += out.count()
        return out

    monkeypatch.setattr(jaccard, "_work", counted)
    for n in (150, 300):
        work.append(0)
        stream = [f"c{rng.randrange(10**6)}" for _ in range(10 * n + 130)]
        rows = [(k, " ".join(stream[10 * k : 10 * k + 120])) for k in range(n)]
        found = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sum(r.n_links for r in found) == sum(x[2] for x in links_of(rows)) == 2 * (n - 1) and {r.class_id for r in found} == {0}
    assert work[1] < 2.6 * work[0] and work[1] < 60 * 300


def test_prefixes_stop_early_where_links_are_close(spark, monkeypatch):
    """Many links of high similarity say that the longest prefixes have found them: shorter ones aren't tried, and none is lost."""
    rng = random.Random(6)
    tried = []
    whole = jaccard._work
    monkeypatch.setattr(jaccard, "_work", lambda trie, depth, *more: (tried.append(depth), whole(trie, depth, *more))[1])
    base = [f"n{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(k, " ".join([*base[:-1], f"end{k}"])) for k in range(60)]
    found = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert tried == [8] and {r.n_links for r in found} == {59}


def test_the_filter_lets_every_wanted_row_through(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("id a", "hash(id) h", "'t' text").union(spark.sql("select cast(null as long), 5, 'n'"))
    wanted = rows.where("a % 97 = 0 or a is null").select(F.col("a").alias("x"), F.col("h").alias("y"))
    for bits in (jaccard.FILTER_BITS, 40_000):
        monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
        found = jaccard._maybe(rows, [F.col("a"), F.col("h")], wanted, [F.col("x"), F.col("y")])
        assert found.columns == rows.columns and found.where("a % 97 = 0 or a is null").count() == wanted.count()
        assert wanted.count() <= found.count() < 4000


def test_tries_keep_what_matches():
    """Every entry that shares a prefix with another one stays, with at least the length of the longest one it shares."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    mins = rng.integers(0, 3, (400, 8))
    words = np.zeros((2, 400), np.uint64)
    for k in range(8):
        words[k // 4] |= mins[:, k].astype(np.uint64) << np.uint64(48 - 16 * (k % 4))
    tree = rng.integers(0, 2, 400)
    order = np.lexsort((words[1], words[0], tree))
    tree, mins, words = tree[order].astype(np.int32), mins[order], words[:, order].view(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(tree), pa.array(words[0]), pa.array(words[1]), pa.array(range(400))], ["tree", "hi", "lo", "cls"])
    kept = {}
    for out in jaccard._matched([batch.slice(a, 37) for a in range(0, 400, 37)], 3, 8):
        kept |= dict(zip(out.column(3).to_pylist(), out.column(4).to_pylist(), strict=True))
    for i in range(400):
        same = [int((np.cumprod(mins[i] == mins[j]).sum())) for j in range(400) if j != i and tree[j] == tree[i]]
        assert kept.get(i, 0) == (8 if i in (0, 399) else max(same) if max(same) >= 3 else 0)


def test_equal_wordless_texts_and_odd_columns(spark):
    rows = [(3, "", 1, 1), (2, "", 1, 1), (5, None, 1, 1), (4, None, 1, 1), (6, "?!", 1, 1), (6, "?!", 1, 1), (7, "one word", 1, 1), (None, "one word", 1, 1), (None, "other", 1, 1), (None, "third", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _d int, _h int")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, "null" if r.text is None else r.text) for r in kept.collect()) == [(0, "other"), (0, "third"), (2, ""), (4, "null"), (6, "?!"), (7, "one word")]


# substrings


def test_chunks_do_not_depend_on_neighbours(texts):
    some = [(t or "").encode() for t in [*ODD, *list(texts.values())[:60]]]
    together = substrings.chunk(some)
    for t, cuts in zip(some, together, strict=True):
        assert (substrings.chunk([t])[0] == cuts).all() and cuts[0] == 0 and cuts[-1] == len(t)
        assert (np.diff(cuts)[1:-1] > substrings.REACH).all()


def test_passages_against_brute_force(spark):
    """Chunks cut byte by byte and compared by their bytes give the same passages."""
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "d", "épsilon", "zeta", "eta", "\n", "iota,", "kappa"]
    some = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    shared = [some(70), some(55), some(30)]
    texts = [" ".join(some(rng.randrange(0, 60)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randrange(1, 5))) for _ in range(40)] + ["", None, "x" * 900, shared[0], shared[0], some(900)]
    cover, reach = substrings.COVER, substrings.REACH
    gear = [int(x) >> 32 for x in textscan.BYTE]

    def chunks(t):
        pad = bytes(cover + 2 * reach)
        buf, hashes = pad + t + pad, []
        for i in range(len(buf)):
            h = sum(gear[buf[i - k]] << 2 * k for k in range(cover) if i >= k) & 0xFFFFFFFF
            hashes.append((h ^ h >> 15) * 0x9E3779B1 & 0xFFFFFFFF)
        first = len(pad)
        cuts = [i + 1 - first for i in range(first, first + len(t) - 1) if hashes[i] > max(hashes[i - reach : i]) and hashes[i] >= max(hashes[i + 1 : i + reach + 1])]
        ends = [0, *cuts, len(t)] if t else [0]
        spans = list(zip(ends, ends[1:]))
        said = [t[a:b] for a, b in spans]
        if len(spans) > 1:  # a short first or last chunk counts with its neighbour
            if spans[0][1] <= reach:
                said[0] = t[: ends[2]]
            if spans[-1][1] - spans[-1][0] <= reach:
                said[-1] = t[ends[-3] :]
        return spans, said

    raw = [(t or "").encode() for t in texts]
    cut = [chunks(t) for t in raw]
    owners = defaultdict(dict)
    for d, (_, said) in enumerate(cut):
        for x in said:
            owners[x].setdefault(texts[d], d)
    where = {x: min(d for d, (_, said) in enumerate(cut) if x in said) for x in owners}
    rows = {x: len({d for d, (_, said) in enumerate(cut) if x in said}) for x in owners}
    want = set()
    for d, (spans, said) in enumerate(cut):
        starts = {m.start() for m in re.finditer(rb"(?<![^ \t-\r])[^ \t-\r]", raw[d])}
        count = [sum(a <= i < b for i in starts) for a, b in spans]
        k = 0
        while k < len(spans):
            j = k
            while j < len(spans) and rows[said[j]] > 1:
                j += 1
            if sum(count[k:j]) >= substrings.LEAST_WORDS:
                i = k
                while i < j:
                    e = i
                    while e < j and where[said[e]] == where[said[i]]:
                        e += 1
                    want.add((d, spans[i][0], spans[e - 1][1], sum(count[i:e]), where[said[i]], where[said[i]] == d))
                    i = e
            k = max(j, k + 1)
    found = {tuple(r) for r in substrings.repeated_passages(docs_of(spark, texts)).select("doc_id", "start", "end", "n_words", "first_doc_id", "is_first").collect()}
    assert found == want and len(want) > 20


def test_repeated_passages(spark, texts):
    rng = random.Random(5)
    pool = [w for t in texts.values() for w in (t or "").split()]
    make = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    rows = []
    for k in range(200):
        passage = make(55)
        rows += [(10 * k, make(rng.randrange(5, 80)) + " " + passage + " " + make(rng.randrange(5, 80))), (10 * k + 1, make(rng.randrange(5, 80)) + " " + passage), (10 * k + 5, make(150))]
    df = spark.createDataFrame([*((*r, 0) for r in rows), (9999, None, 0), (9998, "", 0)], "doc_id long, text string, start int")
    found = substrings.repeated_passages(df)
    ids = {r.doc_id for r in found.collect()}
    assert ids == {i for i, _ in rows if i % 10 in (0, 1)}
    by = {i: t for i, t in rows}
    for r in found.collect():
        passage = by[r.doc_id].encode()[r.start : r.end]
        other = r.first_doc_id if not r.is_first else r.doc_id + 1
        assert passage in by[other].encode()
    again = substrings.repeated_passages(substrings.remove_passages(df, found))
    assert again.count() == 0
    assert substrings.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("letters", ["abcdefgh", "жщюяфцчш", "漢字仮名交文書"])
def test_a_passage_after_a_hot_line_keeps_one_copy(spark, letters):
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n))
    hot, passage = make(60), make(60)
    by = {1: make(30) + " " + hot, 5: make(30) + " " + hot + " " + passage, 9: make(30) + " " + hot + " " + passage}
    df = spark.createDataFrame(list(by.items()), "doc_id long, text string")
    found = substrings.repeated_passages(df)
    rows = found.collect()
    assert {(r.doc_id, r.first_doc_id) for r in rows} == {(1, 1), (5, 1), (5, 5), (9, 1), (9, 5)}
    for r in rows:
        assert r.is_first == (r.doc_id == r.first_doc_id)
        assert by[r.doc_id].encode()[r.start : r.end] in by[r.first_doc_id].encode()
    left = {r.doc_id: r.text for r in substrings.remove_passages(df, found).collect()}
    for words in (hot, passage):
        core = " ".join(words.split()[20:40])
        assert [k for k, t in left.items() if core in t] == [1 if words is hot else 5]


# token files


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    v = np.minimum(rng.geometric(0.001, 5000), 49407)
    ids, lengths, m = wavelet.decode_shard(wavelet.encode_shard([3, None], [2000, 3000], v, 16))
    assert ids == [3, None] and lengths.tolist() == [2000, 3000] and (m.values() == v).all()
    for i in range(0, 5000, 97):
        assert m.access(i) == v[i]
    for x in set(v[:40].tolist()):
        places = np.flatnonzero(v == x)
        assert m.count(x) == len(places) and m.count(x, 100, 3000) == ((places >= 100) & (places < 3000)).sum()
        assert [m.occurrence(x, k) for k in range(len(places))] == places.tolist()
    assert m.count(50000) == 0 and wavelet.WaveletMatrix.build(v[:0], 16).values().size == 0


def test_lookups_read_a_few_blocks(tmp_path):
    """A lookup reads the head, the directories and a block a plane, wherever it is, and says what the values say."""
    rng = np.random.default_rng(3)
    v = np.minimum(rng.zipf(1.3, 3_000_000), 50_000).astype(np.uint32)
    data = wavelet.encode_shard([1], [len(v)], v, 16)
    (tmp_path / "a.wm").write_bytes(data)
    for path in (str(tmp_path / "a.wm"), f"file://{tmp_path}/a.wm"):
        assert wavelet.open_file(path).ids() == [1] and wavelet.open_file(path).matrix.access(77) == v[77]
    read = []
    found = wavelet.TokenFile(lambda at, size: (read.append(size), data[at : at + size])[1])
    assert found.matrix.access(2_345_678) == v[2_345_678] and sum(read) < len(data) / 2
    directories, n = found.matrix, len(read)
    assert directories.access(2_345_679) == v[2_345_679] and len(read) <= n + 16
    for i in rng.integers(0, len(v), 30).tolist():
        assert directories.access(i) == v[i]
    for x in (1, 2, 77, 50_000):
        places = np.flatnonzero(v == x)
        assert directories.count(x) == len(places) and directories.count(x, 1000, 2_000_001) == ((places >= 1000) & (places < 2_000_001)).sum()
        for k in (0, len(places) // 2, len(places) - 1):
            assert directories.occurrence(x, k) == places[k]
    assert np.array_equal(directories.values(), v)
    with pytest.raises(ValueError):
        wavelet.TokenFile(lambda at, size: b"x" * size)


def test_token_files_round_trip(spark, texts, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 3000)
    rows = [(k, t) for k, t in enumerate([*ODD, *list(texts.values())[:60]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    file = queries.tokenizer_file("word_bpe_49k.json")
    manifest = wavelet.write_tokens(docs, lambda: tokens.word_bpe(file), wavelet.token_folder(spark), 16, 2)
    back = {r.doc_id: r for r in wavelet.read_tokens(manifest).collect()}
    coder, at = tokens.WordBpe(file), 0
    for k, t in rows:
        ids = coder.encode([t or ""])[0] + np.array([2], "<u4").tobytes()
        assert (back[k].start, back[k].n_tokens, bytes(back[k].ids)) == (at, len(ids) // 4, ids)
        at += len(ids) // 4
    assert wavelet.read_tokens(wavelet.write_tokens(docs.limit(0), lambda: tokens.word_bpe(file), wavelet.token_folder(spark), 16, 2)).count() == 0


# sharding


def test_rendezvous_law(spark):
    rows = [(k, f"t{k % 7}") for k in range(4000)] + [(None, "n")] * 3 + [(7, "t0")] * 500
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int").repartition(7)
    out = sharding.shard_rows(df, "doc_id", [1.0] * 8, grown=1.0).collect()
    assert len(out) == len(rows)
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert len({r.shard for r in out if r.doc_id == 7}) == 1 and len({r.shard for r in out if r.doc_id is None}) == 1
    moved = sum(r.grown_shard == 8 for r in out if r.doc_id != 7) / 4000
    assert 0.08 < moved < 0.14
    sizes = Counter(r.shard for r in out if r.doc_id is not None and r.doc_id != 7)
    assert min(sizes.values()) > 400 and max(sizes.values()) < 600
    heavy = Counter(r.shard for r in sharding.shard_rows(df.where("doc_id > 10"), "doc_id", [3.0, 1.0, 0.0]).collect())
    assert 2.5 < heavy[0] / heavy[1] < 3.6 and 2 not in heavy
    assert sharding.shard_rows(df.limit(0), "doc_id", [1.0]).count() == 0


def test_sharding_query_sizes(spark, sf, texts):
    for r in queries.op5_shard(spark, sf).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")


# chat


def test_chat_round_trip(spark):
    tricky = ["\\### Assistant: </turn> ok", "### ", "#### x", "\\", "\\\\</turn>\n", "<\\/turn>", "##\\# ", "a\nb", "", None, "é 日本 😀", "x" * 3000]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(tricky)]
    rows += [(2, 0, "user", "q"), (3, 0, "assistant", "a"), (3, 1, "user", "tail"), (None, 0, "assistant", "n"), (4, 0, "ro:le\\: x", "y"), (4, None, None, "first"), (5, 0, "assistant", "same"), (5, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, body int")
    made = chat.format_conversations(df)
    examples = chat.expand(made)
    back = {r.conv_id: r for r in chat.read_back(made, examples).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, ro or "", x or "") for i, t, ro, x in rows if i == c))
        assert [(t.role, t.text) for t in back[c].turns] == [(ro, x) for _, _, ro, x in turns]
        assert list(back[c].loss) == [x for _, _, ro, x in turns if ro == "assistant"]
    bodies = {r.conv_id: bytes(r.body) for r in made.collect()}
    assert {r.conv_id: r.chars for r in made.collect()} == {c: len(b.decode()) for c, b in bodies.items()}
    for e in chat.render(made, examples).collect():
        assert bodies[e.conv_id].startswith(e.text)
    shown = defaultdict(list)
    for e in sorted(examples.collect(), key=lambda e: (e.conv_id is None, e.conv_id or 0, e.example)):
        shown[e.conv_id].append(e)
        if e.target is not None:
            assert bodies[e.conv_id][e.loss_end : e.size] == chat.END.encode()
            assert bodies[e.conv_id][: e.loss_start].endswith(b"### assistant: ")
        else:
            assert e.loss_start == e.loss_end == e.size
        assert e.chars == len(bodies[e.conv_id][: e.size].decode())
    assert len(shown[2]) == 1 and len(shown[3]) == 2 and len(shown[1]) == 6
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("side", ["loss_start", "loss_end"])
def test_a_shifted_mask_shows(spark, side):
    """The loss is read through the masks: one that is off by a character gives another text."""
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "abc"), (1, 2, "user", "r"), (1, 3, "assistant", "de")], "conv_id long, turn long, role string, text string")
    made, examples = chat.write(df)
    assert chat.read_back(made, examples).first().loss == ["abc", "de"]
    shifted = examples.withColumn(side, F.when(F.col("target") == 3, F.col(side) - 1).otherwise(F.col(side)))
    assert chat.read_back(made, shifted).first().loss == (["abc", " de"] if side == "loss_start" else ["abc", "d"])


def test_chat_odd_tables(spark):
    """Extra columns of clashing names, a very long text, one conversation with very many turns, repeated rows, nulls everywhere."""
    long = "é### x </turn> \\\\ " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "z"), (None, None, None, None), (None, None, None, None)]
    rows += [(2, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(3000)]
    df = spark.createDataFrame([(*r, b"x", 5, "s") for r in rows], "conv_id long, turn long, role string, text string, body binary, chars int, turns string")
    back = {r.conv_id: r for r in chat.read_back(*chat.write(df)).collect()}
    assert [t.text for t in back[1].turns] == [long, long + "z"] and back[1].loss == [long + "z"]
    assert [(t.role, t.text) for t in back[None].turns] == [("", "")] * 2 and back[None].loss == []
    assert back[2].loss == [f"t{k}" for k in range(1, 3000, 2)]


# rules


def measured(t):
    w = re.findall("[^ \t-\r]+", t)
    inside, places = [0] * len(w), defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    for some in places.values():
        if len(some) > 1:
            for i in some:
                inside[i : i + 8] = [1] * 8
    ls = [x for x in t.split("\n") if x.strip(BLANKS)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls), len(ls) - len(set(ls)), sum(inside), sum(a == b for a, b in zip(w, w[1:], strict=False)), len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t)))


def test_rules(spark, texts):
    some = [*ODD, "a b c d e f g h a b c d e f g h", "l\nl \nl\nm", "S # * $ | <>", *list(texts.values())[:100]]
    df = docs_of(spark, some, extra=True)
    book = rules.ledger(df)
    for r in book.collect():
        assert tuple(r[k] for k in rules.MEASURES) == measured(some[r.doc_id] or "")
        n = dict(zip(rules.MEASURES, measured(some[r.doc_id] or ""), strict=True))
        assert bool(r.failed & 3) == (n["n_words"] < 20 or 100 * n["n_repeat_words"] > 30 * n["n_words"])
    table = {r.rule: r for r in rules.ablations(book, "v1").collect()}
    bits = [r.failed for r in book.collect()]
    for name, bit in rules.BIT.items():
        assert (table[name].n_failed, table[name].n_only, table[name].n_kept) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(b == 0 for b in bits))
    assert rules.ledger(df.limit(0)).count() == 0


# quality


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:1500], y[:1500], trees=40)
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95

    def walk(row):  # one node at a time
        total = model.base
        for t in range(len(model.feature)):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.cut[t, node])
            total += model.leaf[t, node - model.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [walk(r) for r in x[:50]])
    assert np.allclose(quality.fit(x[:0], y[:0]).score(x[:3]), 0.5)


def test_trees_split_as_brute_force(seed=4):
    """Every node of two boosted trees has the feature and cut of most gain among all of them, tried one by one; leaves and gradients by hand."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(300, 3)), 1).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0.1) ^ (rng.random(300) < 0.1)).astype(float)
    model = quality.fit(x, y, trees=2, depth=3, rate=0.3, bins=256, ridge=1.0, least=10)
    total = np.full(len(y), model.base)
    assert model.base == pytest.approx(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for t in range(2):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        rows = {0: np.ones(len(y), bool)}
        for node in range(7):
            inside, best = rows[node], (1e-9, None)
            value = lambda some: grad[some].sum() ** 2 / (hess[some].sum() + 1.0)
            for f in range(3):
                for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 257)[1:-1]).astype(np.float32)):
                    left, right = inside & (x[:, f] <= cut), inside & (x[:, f] > cut)
                    if min(left.sum(), right.sum()) >= 10:
                        best = max(best, (value(left) + value(right) - value(inside), (f, cut)), key=lambda b: b[0])
            f, cut = model.feature[t, node], model.cut[t, node]
            left, right = inside & (x[:, f] <= cut), inside & (x[:, f] > cut)
            if best[1] is None:
                assert np.isinf(cut)
            else:
                assert value(left) + value(right) - value(inside) == pytest.approx(best[0], rel=1e-9)
            rows[2 * node + 1], rows[2 * node + 2] = left, right
        for k in range(8):
            some = rows[7 + k]
            assert model.leaf[t, k] == pytest.approx(-0.3 * grad[some].sum() / (hess[some].sum() + 1.0))
            total[some] += model.leaf[t, k]


def test_one_row_an_id_is_learned_from(spark, monkeypatch):
    """Ids that are there many times, with other texts or labels, give one row each, the same in any order; the bound holds."""
    texts = [f"some words {k} " * (k % 7 + 1) for k in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, f"copy {j}") for j in range(500)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, 0), (3, 1), (5, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for some in (docs, docs.repartition(5), docs.orderBy(F.desc("text"))):
        quality.train(some, labels)
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert all(len(y) == len(ids) for _, y in seen)
    assert all(np.array_equal(seen[0][0], x) and np.array_equal(seen[0][1], y) for x, y in seen)
    quality.train(docs, labels, most=10)
    assert len(seen[-1][1]) <= 10


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in found)
    right = {q: [r.predicted == q for r in found if r.quality == q] for q in (0, 1)}
    assert all(sum(v) / len(v) > 0.9 for v in right.values())


def test_quality_edges(spark):
    docs = docs_of(spark, ODD, extra=True)
    labels = spark.createDataFrame([(1, None), (2, 5), (None, 1), (999, 1)], "doc_id long, quality int")
    out = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0
    assert quality.accepted(docs, quality.train(docs, labels), 0.0).count() == len(ODD)


def test_statistics_are_per_text():
    some = [(t or "").encode() for t in ODD]
    together = quality.statistics(some)
    for k, t in enumerate(some):
        assert np.allclose(quality.statistics([t])[0], together[k])


def test_scan_groups():
    some = [b"a" * n for n in (3, 700, 0, 5, 2000, 1)]
    assert [i for a, b in textscan.groups(some, 600) for i in range(a, b)] == list(range(6))
