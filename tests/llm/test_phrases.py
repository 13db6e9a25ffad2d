"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyveil.llm import phrases


def brute(rows, least, top):
    """Counts, cuts, covers and ranks as the docstring says, with Python's own numbers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, low = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        many, found = {p: a for p, a in counts.items() if a >= least}, []
        for p, a in many.items():
            if len(p) < 2:
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in many.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 80 * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def rows_of(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize(("seed", "shard"), [(0, 300), (1, 1 << 20)])
def test_like_brute_force(spark, seed, shard):
    """Few words, many repeats, a hot language and a hot phrase, odd texts, clashing columns; shards of any size."""
    rng = random.Random(seed)
    words = ["a", "B", "the", "é", "日本", "x\x1cy", "\x00", "New", "york", "ab", "b", "a-b", "z" * 200]
    rows = []
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n", "!?"]) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text))
    rows += [("en", None), ("en", ""), (None, "  \t .,;"), ("de", "...")] + [("en", "New York City hall")] * 60 + [("fr", "a a a a a a")] * 20
    rows += [("en", " ".join(rng.choice(words[:6]) for _ in range(3000)))]
    table = spark.createDataFrame([(k % 5, t, g, 1, "p", 2) for k, (g, t) in enumerate(rows)], "doc_id int, text string, lang string, shard int, phrase string, words int")
    got = rows_of(phrases.collocations(table.repartition(5), least=7, top=40, shard=shard))
    assert got == brute(rows, 7, 40)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], "doc_id int, text string, lang string")).count() == 0


def test_scan_in_several_automata(monkeypatch):
    """Overlapping and nested phrases; the guards keep parts of words out; the bound of an automaton loses nothing."""
    text = " a a a \n ab a b a b \n a "
    some = ["a", "a a", "b a", "a b", "a b a", "ab", "b", "a a a", "c"]
    want = [sum(1 for i in range(len(text)) if text.startswith(f" {p} ", i)) for p in some]
    assert phrases.scan(text, some).tolist() == want
    monkeypatch.setattr(phrases, "PATTERN_CHARS", 1)
    assert phrases.scan(text, some).tolist() == want
    assert phrases.scan("", []).tolist() == []


def test_cells_go_through_their_packing():
    cells = np.unique(np.random.default_rng(2).integers(0, phrases.SLICE_CELLS, 5000))
    assert np.array_equal(phrases._unpack(phrases._pack(cells)), cells)


def test_phrases_of_one_hash_are_told_apart():
    """Where two phrases share a hash, the number of matches gives it away and the texts themselves are taken."""
    text = b" a b \n c d "
    windows = phrases._Windows("en", text)
    windows.hashes = [np.zeros(len(h), np.uint64) + np.uint64(5) for h in windows.hashes]
    heavy = phrases._Heavy(np.array([5], np.uint64))
    few, occurrences = phrases._patterns(windows, text, heavy, 1)
    assert occurrences == 6 and phrases.scan(text.decode(), few).sum() < 6
    assert phrases._every_pattern(windows, text, heavy, 1) == ["a", "a b", "b", "c", "c d", "d"]
