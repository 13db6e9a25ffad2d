"""Exact SentencePiece BPE by backtracking over longest matches, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fresh
from .textscan import slices

SPACE = "▁"
#: Units of text up to this length are remembered, up to so many of them twice: the older half is
#: forgotten, but for what was met again.
SHORT, MOST_UNITS = 48, 1 << 17
#: Pairs of pieces of which it is remembered whether they stay side by side.
MOST_PAIRS = 1 << 20
#: Characters from which a unit's tables are packed.
LONG = 4096
#: No shorter piece; -1 is a place where no piece of several characters starts.
NONE = -2


def _packed(i: int) -> bytes:
    return i.to_bytes(4, "little")


def _units(pieces: list[str]) -> re.Pattern:
    """What texts fall apart into without changing a piece: between two characters that are neighbours in no piece nothing is ever joined.

    A unit is space marks, then characters that letters don't go on to in any piece, then letters (and characters that they
    do go on to). Characters that are in no longer piece stand apart. If a piece goes on from another character to a space mark,
    a text is one unit.
    """
    pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    if any(x[1] == SPACE != x[0] for x in pairs):
        return re.compile("(?s).+")
    joined = {c for p in pieces for c in p if c != SPACE}
    letters = {c for c in joined if c.isalpha()}
    while more := {y for x, y in pairs if x in letters and y not in letters}:
        letters |= more
    of = lambda some: "[" + "".join(map(re.escape, sorted(some))) + "]"
    a, p = (of(x) if x else "(?!)" for x in (letters, joined - letters))
    alone = "[^" + "".join(map(re.escape, sorted(joined | {SPACE}))) + "]"
    return re.compile(f"{SPACE}*{p}*{a}+|{SPACE}*{p}+|{SPACE}+|{alone}+")


class PieceBpe:
    """A BPE model of the sentencepiece library.

    The library joins the neighbours whose joint piece scores highest, the leftmost first, until nothing
    joins. A sequence of pieces is its result exactly if every two neighbours, joined up anew from their
    characters, never join across their border (and each piece is its own result): the first join across
    a border would happen in the two pieces alone as well. Such a sequence is unique, also for
    every prefix of a text. So the encoder takes the longest piece at a place that fits the one before,
    goes to shorter ones where the rest can't be reached, and marks a place that failed for good.
    A character that no piece stands for is a piece of its own, written as its UTF-8 bytes.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        if any(lib.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        apart = {i for i in ids if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)}
        self.ids = {lib.id_to_piece(i): i for i in ids if i not in apart}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = [_packed(lib.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        self.bos, self.eos = _packed(lib.bos_id()), _packed(lib.eos_id())
        #: Pieces that come out of their own characters; no other can be in a result. Characters are added as they are met.
        self.pieces = [p for p in self.ids if len(p) == 1 or self._joined(p) == [p]]
        self.number = {p: k for k, p in enumerate(self.pieces)}
        self.sizes = [len(p) for p in self.pieces]
        self.out = [_packed(self.ids[p]) for p in self.pieces]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, p in enumerate(self.pieces):
            if len(p) > 1:  # a single character is looked up where nothing longer starts
                self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        #: For each piece the next shorter one that starts it, at last a single character; NONE after that.
        self.shorter = [NONE] * len(self.pieces)
        for k, p in enumerate(self.pieces[:]):
            if len(p) > 1:
                start = next(n for n in range(len(p) - 1, 0, -1) if n == 1 or p[:n] in self.number)
                self.shorter[k] = self._character(p[0]) if start == 1 else self.number[p[:start]]
        self.cut = _units([p for p in self.ids if len(p) > 1])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _character(self, c: str) -> int:
        """The number of a single character, which is its piece or else its bytes."""
        k = self.number.get(c)
        if k is None:
            k = self.number[c] = len(self.pieces)
            self.pieces.append(c)
            self.sizes.append(1)
            self.shorter.append(NONE)
            self.out.append(b"".join(self.bytes[b] for b in c.encode()))
        return k

    def _fits(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay as they are."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        a = self.pieces[left]
        found = self.pairs[left << 24 | right] = self._joined(a + self.pieces[right], len(a)) is not None
        return found

    def _joined(self, text: str, border: int = -1) -> list[str] | None:
        """The pieces that joining makes of a short text; None as soon as it joins across the border."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            if border >= 0 and sum(map(len, parts[: at + 1])) == border:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def unit_ids(self, unit: str) -> bytes:
        """The ids of a unit of text."""
        sizes, shorter, pairs, numbers, n = self.sizes, self.shorter, self.pairs, self.number, len(unit)
        longest = [-1] * n if n < LONG else array("i", [-1]) * n
        for end, k in self.automaton.iter(unit):  # of one place, the longest match comes last
            longest[end - sizes[k] + 1] = k
        failed: bytearray | None = None  # a bit for each place that can't be reached
        taken = [] if n < LONG else array("i")
        at, last, k = 0, -1, longest[0]
        while at < n:
            if k == -1:
                k = numbers.get(unit[at], -1)
                if k < 0:
                    k = self._character(unit[at])
            while k >= 0:
                end = at + sizes[k]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = pairs.get(last << 24 | k)
                    if fits or (fits is None and self._fits(last, k)):
                        break
                k = shorter[k]
            if k >= 0:
                taken.append(k)
                at, last, k = end, k, longest[end] if end < n else -1
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                k = taken.pop()
                at -= sizes[k]
                k, last = shorter[k], taken[-1] if taken else -1
        out = self.out
        return b"".join([out[k] for k in taken])

    def encode(self, text: str, ends: bool = True) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers, between the begin and end ids if `ends`."""
        out, known = [self.bos] if ends else [], self.known
        for unit in self.cut.findall(self.library.normalize(text)):
            ids = known.get(unit)
            if ids is None:
                ids = self.older.get(unit) or self.unit_ids(unit)
                if len(unit) <= SHORT:
                    if len(known) >= MOST_UNITS:
                        self.older, known = known, {}
                        self.known = known
                    known[unit] = ids
            out.append(ids)
        if ends:
            out.append(self.eos)
        return b"".join(out)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids)


@lru_cache(4)
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def _with(rows: DataFrame, source: str, name: str, kind: str, make: Callable[[list], list]) -> DataFrame:
    """rows and a column more, made of the values of another, a few rows at a time; a column that has its name already gives way."""
    given = rows.drop(*(c for c in rows.columns if c.lower() == name.lower()))
    at = fresh(given.columns, "source")[0]
    taken = given.withColumn(at, rows[source])

    def run(batches) -> Iterator:
        import pyarrow as pa

        for some in slices(batches, 256):
            new = pa.array(make(some.column(some.num_columns - 1).to_pylist()), pa.large_binary() if kind == "binary" else pa.large_string())
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], new.cast(pa.binary() if kind == "binary" else pa.string())], [*some.schema.names[:-1], name])

    schema = given.schema.simpleString()[len("struct<") : -1]
    return taken.mapInArrow(run, given.schema.add(name, kind) if schema else f"{name} {kind}")


def encode_texts(docs: DataFrame, model: Callable[[], PieceBpe], text: str = "text", ends: bool = True) -> DataFrame:
    """docs and ids: each text's ids as little-endian unsigned 32-bit integers, what the library gives without sampling.

    A null text counts as empty, of which only the begin and end ids come. Whole texts are encoded, however long: a unit
    without spaces takes some eight bytes and a bit a character. Each row is on its own: ties, repeated rows and rows of one id
    stay as they are, an empty table gives an empty result, other columns pass, and one named ids is replaced.
    """

    def make(texts: list[str | None]) -> list[bytes]:
        coder = model()
        return [coder.encode(t or "", ends) for t in texts]

    return _with(docs, text, "ids", "binary", make)


def decode_ids(rows: DataFrame, model: Callable[[], PieceBpe], ids: str = "ids") -> DataFrame:
    """rows and decoded: the texts that the library's decode gives for the ids; null and empty ids give an empty text."""

    def make(packed: list[bytes | None]) -> list[str]:
        return model().decode([np.frombuffer(x or b"", "<u4").tolist() for x in packed])

    return _with(rows, ids, "decoded", "string", make)


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
