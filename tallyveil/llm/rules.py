"""A ledger of quality rules: every rule is evaluated once and its failures are kept as bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import SPACES, Scan, as_bytes, groups, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_same_as_last", "n_letters", "n_upper")
#: Name and condition of failure; a rule's bit is its place here. Rules are only ever appended.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_or_long_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    ("words_in_a_row", "100 * n_same_as_last > 20 * n_words"),
    ("capitals", "100 * n_upper > 50 * n_letters"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that count.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(BIT),
}
WINDOW = 8


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


SYMBOLS = _flags(b"#*$%&|<>")
UPPER = _flags(bytes(range(ord("A"), ord("Z") + 1)))
LETTER = UPPER | _flags(bytes(range(ord("a"), ord("z") + 1)))
FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that are equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    s = Scan(texts, SPACES)
    h = s.word_hashes()
    found, at = s.windows(h, WINDOW)
    keys = found + s.text_of[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    inside = np.zeros(len(h) + 1, np.int64)
    if len(twice):
        hit = at[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
        inside[: len(h)] += np.bincount(hit, minlength=len(h))
        inside -= np.bincount(hit + WINDOW, minlength=len(h) + 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (s.text_of[1:] == s.text_of[:-1])
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 2)
    return {
        "n_words": s.n_words,
        "word_chars": s.per_text(FIRST_BYTE[s.buf] & ~s.separator),
        "n_symbols": s.per_text(SYMBOLS[s.buf]),
        "n_lines": lines[:, 0],
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": s.per_text_words((np.cumsum(inside)[:-1] > 0).astype(np.int64)),
        "n_same_as_last": s.per_text_words(same.astype(np.int64)),
        "n_letters": s.per_text(LETTER[s.buf]),
        "n_upper": s.per_text(UPPER[s.buf]),
    }


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, the measurements, and failed, the bits of all failed rules.

    Words are runs of characters other than ASCII white space; n_repeat_words counts words inside any
    window of 8 words that is found twice or more in the text. A null text counts as empty: no words,
    no lines, and so too few words. A very long text is measured whole. Repeated rows and null ids each
    keep a row; extra columns are ignored, whatever their names; an empty table gives none. The id
    itself may not be called failed or as a measurement is.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            texts, ids = as_bytes(batch.column(1)), batch.column(0)
            for a, b in groups(texts):
                found = measure(texts[a:b])
                yield pa.RecordBatch.from_arrays([ids[a:b], *(pa.array(found[k].astype(np.int64)) for k in MEASURES)], [doc_id, *MEASURES])

    source = docs.select(doc_id, F.col(text).cast("string").alias("_text"))
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in MEASURES)
    measured = source.mapInArrow(run, schema)
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def kept(policy: str, failed: Column | None = None) -> Column:
    """Whether a policy keeps a document of the ledger."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_only (failed by no other rule: kept without it), n_kept, n_all.

    The ledger is first counted by its bits, of which there are 2 ** len(RULES) at most.
    """
    counts = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for name in POLICIES[policy])))
    each = counts.select("bits", "n", rules.alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum("n").alias("n_all"),
    )
