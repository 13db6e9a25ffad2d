"""Phrase collocations: sketch upper bounds, automata over shards, exact counts, thresholds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, materialise
from .textscan import BASE, Scan, mix

#: Words of the longest phrase, and the share (in per cent) of a phrase's count from which a longer one covers it.
LONGEST, COVERED = 4, 80
#: Bytes of text in a shard; a shard of one longer piece is larger.
SHARD_BYTES = 3 << 20
#: Cells of a slice of the sketch, and occurrences that a slice is made for on average.
SLICE_CELLS, SLICE_LOAD = 1 << 22, 1 << 23
#: Characters of the patterns that one automaton holds; a shard with more is scanned once for each automaton.
PATTERN_CHARS = 3 << 20
#: Bytes of texts without punctuation: letters are lower-cased, piece ends are newlines, tabs are spaces.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256)
)
_NO_LANG = "und"
_SPACE = np.zeros(256, bool)
_SPACE[32] = True


def shards(docs: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """shard, lang, text, words: pieces of documents of one language, put together to texts of about `most` bytes.

    text is UTF-8: words with one space before and after each, and newlines, as words of their own, between pieces.
    Phrases never cross pieces, so a long document may lie in several shards.
    """
    langs = F.coalesce(F.col("lang").cast("string"), F.lit(_NO_LANG))
    rows = docs.select(langs.alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        words: dict[str, int] = {}
        made = 0

        def cut(lang: str):
            nonlocal made
            text = b" " + b" \n ".join(held.pop(lang)) + b" "
            made += 1
            values = [[first + made - 1], [lang], [text], [words.pop(lang)]]
            del size[lang]
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["shard", "lang", "text", "words"])

        for batch in batches:
            for k in range(batch.num_rows):
                lang, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for piece in text.translate(_FOLD).split(b"\n"):
                    found = piece.split(b" ")
                    if len(found) > 1 or found[0]:
                        found = [w for w in found if w]
                        if not found:
                            continue
                        one = b" ".join(found)
                        held.setdefault(lang, []).append(one)
                        size[lang] = size.get(lang, 0) + len(one) + 3
                        words[lang] = words.get(lang, 0) + len(found)
                        if size[lang] >= most:
                            yield cut(lang)
                if sum(size.values()) > 2 * most:  # many languages side by side
                    yield cut(max(size, key=size.get))
        for lang in list(held):
            yield cut(lang)

    return rows.mapInArrow(run, "shard bigint, lang string, text binary, words bigint")


class _Windows:
    """The phrases of a shard: for each number of words their places and hashes."""

    def __init__(self, lang: str, text: bytes):
        scan = Scan([text], _SPACE)
        hashes = scan.word_hashes()
        self.starts, self.ends = scan.word_starts, scan.word_ends
        stop = scan.buf[self.starts] == 10 if len(self.starts) else np.zeros(0, bool)
        stop &= self.ends - self.starts == 1
        stops = np.concatenate(([0], np.cumsum(stop)))
        salt = zlib.crc32(lang.encode()) << 32
        self.first, self.hashes, self.size = [], [], []
        total = hashes
        for n in range(1, LONGEST + 1):  # a phrase's hash is that of the words before its last one, moved on, and the last one's
            if n > 1:
                total = total[:-1] * np.uint64(BASE) + hashes[n - 1 :]
            at = np.flatnonzero(stops[n:] == stops[:-n])
            self.first.append(at)
            self.hashes.append(mix(total[at] ^ np.uint64(salt | n)))
            self.size.append(np.full(len(at), n, np.int8))

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate(self.hashes), np.concatenate(self.first), np.concatenate(self.size)


def _places(hashes: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Slice of the sketch and cell in it."""
    return (hashes >> np.uint64(32)) % np.uint64(slices), hashes & np.uint64(SLICE_CELLS - 1)


def _pack(cells: np.ndarray) -> bytes:
    """Sorted cells of a slice as two bytes each, after how many there are for each of the higher bits."""
    return np.bincount(cells >> 16, minlength=SLICE_CELLS >> 16).astype("<u4").tobytes() + cells.astype("<u2").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    many = SLICE_CELLS >> 16
    counts = np.frombuffer(packed, "<u4", many)
    return np.repeat(np.arange(many, dtype=np.int64) << 16, counts) + np.frombuffer(packed, "<u2", offset=4 * many)


def _reports(texts: DataFrame, slices: int) -> DataFrame:
    """slice, shard, once, more, counts: the cells that a shard's phrases fall in, once or so many times."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                shard, lang, text = (batch.column(c)[k].as_py() for c in range(3))
                hashes, _, _ = _Windows(lang, text).all()
                part, cell = _places(hashes, slices)
                keys, counts = np.unique(part << np.uint64(32) | cell, return_counts=True)
                edges = np.searchsorted(keys, np.arange(slices + 1, dtype=np.uint64) << np.uint64(32))
                cells = (keys & np.uint64(SLICE_CELLS - 1)).astype(np.int64)
                out = []
                for s in range(slices):
                    some, n = cells[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]
                    if len(some):
                        out.append((s, shard, _pack(some[n == 1]), _pack(some[n > 1]), n[n > 1].astype("<u4").tobytes()))
                for at in range(0, len(out), 64):
                    columns = list(zip(*out[at : at + 64], strict=True))
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["slice", "shard", "once", "more", "counts"])

    return texts.select("shard", "lang", "text").mapInArrow(run, "slice int, shard bigint, once binary, more binary, counts binary")


def _answers(reports: DataFrame, least: int) -> DataFrame:
    """slice, shard, cells: of a shard's cells of a slice those that all shards together fill at least so often."""

    def run(table):
        import pyarrow as pa

        total = np.zeros(SLICE_CELLS, np.int64)
        for k in range(table.num_rows):
            total[_unpack(table["once"][k].as_py())] += 1
            total[_unpack(table["more"][k].as_py())] += np.frombuffer(table["counts"][k].as_py(), "<u4")
        heavy, out = total >= least, []
        for k in range(table.num_rows):
            cells = np.concatenate((_unpack(table["once"][k].as_py()), _unpack(table["more"][k].as_py())))
            out.append(_pack(np.sort(cells[heavy[cells]])))
        return pa.table({"slice": table["slice"], "shard": table["shard"], "cells": pa.array(out, pa.binary())})

    return reports.groupBy("slice").applyInArrow(run, "slice int, shard bigint, cells binary")


class _Heavy:
    """Cells of the sketch in which phrases may reach the bound: a filter of two places a cell.

    A cell that passes by chance is no harm: its phrases are counted, and stay under the bound, as their bound is under it.
    """

    PLACES = 1 << 23

    def __init__(self, cells: np.ndarray):
        self.bits = np.zeros(self.PLACES, bool)
        for at in self._at(cells):
            self.bits[at] = True

    def _at(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mix(cells)
        return x & np.uint64(self.PLACES - 1), x >> np.uint64(32) & np.uint64(self.PLACES - 1)

    def has(self, cells: np.ndarray) -> np.ndarray:
        first, second = self._at(cells)
        return self.bits[first] & self.bits[second]


def _patterns(windows: _Windows, text: bytes, heavy: _Heavy, slices: int) -> tuple[list[str], int]:
    """The distinct phrases of a shard whose cells are heavy, and how often they occur together."""
    hashes, first, size = windows.all()
    part, cell = _places(hashes, slices)
    kept = heavy.has(part << np.uint64(32) | cell)
    hashes, first, size = hashes[kept], first[kept], size[kept]
    order = np.argsort(hashes)
    one = order[np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order[:1]]))]
    starts, ends = windows.starts[first[one]], windows.ends[first[one] + size[one] - 1]
    return [text[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], len(hashes)


def _every_pattern(windows: _Windows, text: bytes, heavy: _Heavy, slices: int) -> list[str]:
    """The same from the texts of all occurrences: for a shard where two phrases share a hash."""
    hashes, first, size = windows.all()
    part, cell = _places(hashes, slices)
    kept = np.flatnonzero(heavy.has(part << np.uint64(32) | cell))
    return sorted({text[windows.starts[first[i]] : windows.ends[first[i] + size[i] - 1]].decode() for i in kept})


def scan(text: str, phrases: list[str]) -> np.ndarray:
    """How often each phrase occurs between spaces, overlaps included: automata over guarded phrases, one after the other."""
    import ahocorasick

    counts, at = np.zeros(len(phrases), np.int64), 0
    while at < len(phrases):
        automaton, held, first = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0, at
        while at < len(phrases) and held < PATTERN_CHARS:
            automaton.add_word(f" {phrases[at]} ", at)
            held += len(phrases[at]) + 2
            at += 1
        automaton.make_automaton()
        found = np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64)
        counts[first:at] = np.bincount(found - first, minlength=at - first)
    return counts


def _counted(texts: DataFrame, answers: DataFrame, slices: int) -> DataFrame:
    """lang, phrase, words, n: counts by shard of the phrases in heavy cells."""
    replies = answers.where(F.octet_length("cells") > 4 * (SLICE_CELLS >> 16))
    replies = replies.groupBy(F.col("shard").alias("of")).agg(F.collect_list(F.struct("slice", "cells")).alias("heavy"))
    rows = texts.join(replies, texts["shard"] == replies["of"]).select("lang", "text", "heavy.slice", "heavy.cells")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                lang, text, parts, cells = (batch.column(c)[k].as_py() for c in range(4))
                heavy = _Heavy(np.concatenate([_unpack(c).astype(np.uint64) | np.uint64(s << 32) for s, c in zip(parts, cells, strict=True)]))
                windows = _Windows(lang, text)
                phrases, occurrences = _patterns(windows, text, heavy, slices)
                said = text.decode()
                counts = scan(said, phrases)
                if counts.sum() != occurrences:
                    phrases = _every_pattern(windows, text, heavy, slices)
                    counts = scan(said, phrases)
                for at in range(0, len(phrases), 20_000):
                    some = phrases[at : at + 20_000]
                    columns = [pa.array([lang] * len(some)), pa.array(some), pa.array([p.count(" ") + 1 for p in some], pa.int32()), pa.array(counts[at : at + 20_000])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n"])

    return rows.mapInArrow(run, "lang string, phrase string, words int, n bigint")


def frequent_phrases(texts: DataFrame, least: int, scratch: list[str]) -> DataFrame:
    """lang, phrase, words, f: phrases of 1 to 4 words that occur at least `least` times in their language, with exact counts.

    Every shard reports, for slices of a sketch whose size follows the number of words, the cells its phrases fall in. A
    slice adds up its cells, which gives upper bounds, and answers each shard with those of its cells that reach
    the bound. The shard's phrases in such cells compile into automata that scan the shard. So a sketch, a set of
    candidates and an automaton never hold more than a slice or a shard, whatever the corpus, and nothing is broadcast.
    """
    occurrences = LONGEST * (texts.agg(F.sum("words")).first()[0] or 0)
    slices = max(1, -(-occurrences // SLICE_LOAD))
    answers = materialise(_answers(_reports(texts, slices), least), "answers", scratch=scratch)
    total = _counted(texts, answers, slices).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    return materialise(total.where(F.col("f") >= least), "phrases", scratch=scratch)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, shard: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` collocations of two to four words.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and these into words at spaces and tabs.
    A phrase's count a is that of all its occurrences in pieces, overlaps and repeated rows included, and is at least `least`.
    Cut after its first k words it scores floor(2000000 * a / (l + r)), where l and r count its parts; the cut
    that scores least counts, of ties the first. A phrase that lies in a longer one with at least 80 per cent of its
    count goes. Ranks follow score and count, both descending, then the phrase's bytes; n counts a language's words.
    A null text has no words, a null language is `und`; empty tables and languages without phrases give no rows; other columns are
    ignored, whatever their names. Whole texts of any length are counted.
    """
    scratch: list[str] = []
    texts = materialise(shards(docs, shard), "shards", scratch=scratch)
    found = frequent_phrases(texts, least, scratch)
    counts = found.select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    wide = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), words.alias("w"))

    def part(first, size):
        return F.array_join(F.slice("w", first, size), " ")

    k = F.col("k")
    cuts = wide.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), k).alias("left"), part(k + 1, F.col("words") - k).alias("right"))
    cuts = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    # Decimals: the products may pass 64 bits, the quotient cannot pass a million.
    cuts = cuts.withColumn("score", F.expr("cast(2000000 as decimal(7)) * cast(a as decimal(19)) div (cast(l as decimal(19)) + cast(r as decimal(19)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")

    size = F.col("size")
    inner = wide.where("words > 2").select("lang", "w", "words", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - size + 1)).alias("at"))
    cover = inner.select("lang", part(F.col("at"), size).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.expr(f"cast(100 as decimal(3)) * cast(longer as decimal(19)) >= cast({COVERED} as decimal(3)) * cast(a as decimal(19))")
    kept = scored.join(cover, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~covered)

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = texts.groupBy("lang").agg(F.sum("words").alias("n"))
    out = ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = materialise(out, "collocations")
    discard(docs.sparkSession, scratch)
    return out
