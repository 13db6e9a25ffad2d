"""Vectorised scanning of UTF-8 texts: words, their hashes, and counts per text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes that one scan takes, so that its arrays stay in a cache; a longer text is scanned alone.
SCAN_BYTES = 1 << 19


def _table(separators: set[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


#: Separators of words: ASCII white space, or all of ASCII but letters and digits.
SPACES = _table({0x20, *range(0x09, 0x0E)})
PUNCTUATION = _table(set(range(128)) - {*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"})
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(BASE), run(INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(19, (n + 1).bit_length()))
    return up[:n], down[:n]


def groups(texts: list[bytes], most: int = SCAN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, or of one longer text."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield first, i
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


class Scan:
    """A few texts, joined by spaces, and their words."""

    def __init__(self, texts: list[bytes], separators: np.ndarray, fold: bool = False):
        self.texts = texts
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.ends = self.starts + sizes
        if fold:
            self.buf = FOLD[self.buf]
        self.separator = separators[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], self.separator)).view(np.int8)))
        self.word_starts, self.word_ends = edge[::2], edge[1::2]
        self.first_word = np.searchsorted(self.word_starts, self.starts)
        self.n_words = np.diff(np.append(self.first_word, len(self.word_starts)))
        self.text_of = np.repeat(np.arange(len(texts)), self.n_words)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of byte flags by text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.ends] - total[self.starts]

    def per_text_words(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)))
        return total[self.first_word + self.n_words] - total[self.first_word]

    def word_hashes(self) -> np.ndarray:
        if not len(self.word_starts):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.buf))
        cut = np.empty(2 * len(self.word_starts), np.int64)
        cut[::2], cut[1::2] = self.word_starts, self.word_ends
        return mix(np.add.reduceat(BYTE[self.buf] * up, cut)[::2] * down[self.word_starts])

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every n words in a row within a text, and the number of each window's first word."""
        if len(hashes) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text_of[: len(hashes) - n + 1] == self.text_of[n - 1 :])
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for k in range(n):
            total = total * np.uint64(BASE) + hashes[k : len(hashes) - n + 1 + k]
        return mix(total)[at], at


def slices(batches, rows: int = 512) -> Iterator:
    """The batches in pieces of a few rows, so that only those are Python objects at a time; what a batch took is then given back."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
