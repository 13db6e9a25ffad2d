"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh, materialise

#: Runs of ASCII separators between words, in lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words at a window's start that are looked up before anything is made of the window, and bits of the filter they are looked up in.
ANCHOR, BITS = 3, 1 << 20


def words(text: Column) -> Column:
    """The words of a text, only A-Z lower-cased, in a form that is good for comparing.

    The text's UTF-8 bytes are taken as Latin-1 characters and lower-cased, which is far quicker than
    translate. Besides A-Z that moves the first bytes C0-DE of longer characters to E0-FE, the same way
    for every text; how many bytes from 80 to BF follow still tells such characters apart, so that two
    words are equal after it exactly if they are equal after A-Z are lower-cased. Texts are split between words, as
    extracting all matches of a pattern copies the text once for each word.
    """
    latin = F.decode(F.coalesce(text, F.lit("")).cast("binary"), "ISO-8859-1")
    return F.array_remove(F.split(F.lower(latin), BETWEEN), "")


def item_windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """Distinct (window, n, item_id): every n words in a row of an item; an item of fewer, but not none, is one window."""
    w = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    w = w.select("item_id", "w", size.alias("n"), starts.alias("at"))
    return w.select(F.concat_ws(" ", F.slice("w", F.col("at"), F.col("n"))).alias("window"), "n", "item_id").distinct()


def _anchor(hashes: Column, at: Column | int, size: int) -> Column:
    """A number for `size` words, given their hashes, from place `at` on."""
    return F.pmod(F.xxhash64(*(F.get(hashes, at + F.lit(k)) for k in range(size))), F.lit(BITS))


def _filters(windows: DataFrame) -> dict[int, tuple[list[int], Column]]:
    """For each number of words that windows start with: the windows' lengths, and bits that their first words set.

    A filter has BITS bits, however many windows there are, and is a constant of the plan. With very many windows
    more places pass, and are then compared.
    """
    w = F.split("window", " ")
    rows = windows.select("n", F.least("n", F.lit(ANCHOR)).alias("size"), F.transform(w, lambda x: F.xxhash64(x)).alias("h"))
    bit = F.coalesce(*(F.when(F.col("size") == a, _anchor(F.col("h"), F.lit(0), a)) for a in range(1, ANCHOR + 1)))
    rows = rows.select("n", "size", F.shiftright(bit, 6).alias("at"), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("bit"))
    set_bits = rows.groupBy("size", "at").agg(F.bit_or(F.call_function("shiftleft", "one", "bit")).alias("bits"), F.collect_set("n").alias("n"))
    found: dict[int, tuple[set[int], list[int]]] = {}
    for r in set_bits.collect():  # ANCHOR * BITS / 64 rows at most
        lengths, bits = found.setdefault(r["size"], (set(), [0] * (BITS // 64)))
        lengths.update(r["n"])
        bits[r["at"]] = r["bits"]
    return {a: (sorted(n), F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")) for a, (n, bits) in sorted(found.items())}


def _passes(size: int, bits: Column) -> Callable[[Column], Column]:
    """Whether the filter has the words at a place of an array of words' numbers h."""

    def test(at: Column) -> Column:
        bit = _anchor(F.col("h"), at, size)
        return F.call_function("getbit", F.get(bits, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1

    return test


def _windows_at(lengths: list[int]) -> Callable[[Column], Column]:
    """The windows of these lengths that start at a place of an array of words w."""

    def made(at: Column) -> Column:
        each = (F.when(at + n <= F.size("w"), F.struct(at.alias("pos"), F.lit(n).alias("n"), F.concat_ws(" ", F.slice("w", at + 1, F.lit(n))).alias("window"))) for n in lengths)
        return F.array_compact(F.array(*each))

    return made


def scan(docs: DataFrame, windows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n_words, pos, n, window: a row for every place that may start a window, and one with pos null for every document.

    Each word becomes a number; the numbers of the first words at a place are looked up in a filter, and only of the places
    that pass are the words put together, to be compared with the windows. Texts are read once, and a text's arrays hold some
    bytes for each of its words.
    """
    filters = _filters(windows)
    kind = "array<struct<pos:int,n:int,window:string>>"
    w = docs.select(*keys, words(F.col(text)).alias("w"))
    rows = w.select(*keys, F.size("w").cast("long").alias("n_words"), "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    found = [F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("window")))]
    for size, (lengths, bits) in filters.items():
        places = F.filter(F.sequence(F.lit(0), F.size("w") - size), _passes(size, bits))
        some = F.flatten(F.transform(places, _windows_at(lengths))).cast(kind)
        found.append(F.when(F.size("w") >= size, some).otherwise(F.array().cast(kind)))
    return rows.select(*keys, "n_words", F.explode(F.concat(*found)).alias("x")).select(*keys, "n_words", "x.pos", "x.n", "x.window")


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_words, n_hit, spans, item_ids, contaminated.

    n_words counts words, n_hit those inside any occurrence of an item's window, spans are the
    runs [first, last] of such words (by number, from 0), item_ids the items with occurring windows,
    sorted as strings. Null and empty texts have no words and no hits; items without words have no
    windows; an item with a null id makes hits but isn't listed. Repeated rows, and rows that share an
    id but not a text, each keep their own answer, as rows are told apart by id and text. Extra columns
    of either table are ignored. Without items nothing is contaminated.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_text"), F.col(text).alias("_t"))
    keys = ["doc_id", "_text"]
    windows = materialise(item_windows(items, item_id, item_text, n), "items")
    known = windows.select("n", "window").distinct()
    found = materialise(scan(base, known, keys, "_t"), "windows")
    # The words themselves are compared: a join of what passed the filter, broadcast only if the engine sees that the windows are few.
    hits = found.where("pos is not null").select(*keys, "pos", "n", "window").join(known, ["n", "window"], "left_semi").distinct()
    by_pos = Window.partitionBy(*keys).orderBy("pos", "n")
    end = F.col("pos") + F.col("n")
    seen = F.max(end).over(by_pos.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("seen", F.coalesce(seen, F.lit(0))).withColumn("new", F.greatest(end - F.greatest("pos", "seen"), F.lit(0)))
    marked = marked.withColumn("run", F.sum((F.col("pos") > F.col("seen")).cast("int")).over(by_pos))
    runs = marked.groupBy(*keys, "run").agg(F.sum("new").alias("new"), F.min("pos").alias("first"), (F.max(end) - 1).alias("last"))
    spans = runs.groupBy(*keys).agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    named = hits.select(*keys, "window").distinct().join(windows.where("item_id is not null").select("window", "item_id"), "window")
    ids = named.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    answers = spans.join(ids.withColumnsRenamed({k: f"{k}2" for k in keys}), F.col("doc_id").eqNullSafe(F.col("doc_id2")) & F.col("_text").eqNullSafe(F.col("_text2")), "left")
    answers = answers.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_text1"), "n_hit", "spans", "item_ids")
    counted = found.where("pos is null").select(*keys, "n_words")
    out = counted.join(answers, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_text1")), "left")
    return out.select(
        "doc_id",
        F.col("_text").alias("text_hash"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated; columns may have any names."""
    bad = decontaminate(docs, items, n, doc_id, text, **names).where("contaminated")
    d, h = fresh(docs.columns, "_d", "_h")
    bad = materialise(bad.select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct(), "contaminated")
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(h)), "left_anti")
