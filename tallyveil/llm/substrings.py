"""Substring dedup: content-defined chunks of a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .textscan import BYTE, SPACES, as_bytes, groups, slices

#: Bytes that the rolling hash covers, and bytes at either side among which a cut's hash is the largest.
COVER, REACH = 16, 24
#: Words that neighbouring repeated chunks must have together to be reported: what is sure to lie in
#: whole chunks of a passage of 50 words is less than the passage.
LEAST_WORDS = 15
#: In hex, what a cut leaves of a character at the start or the end of a piece.
HALF = "^(?:[89AB].){1,3}|(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$"
GEAR = (BYTE >> np.uint64(32)).astype(np.uint32)


def chunk(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the places of its cuts, from 0 to its length.

    A place is a cut if the gear hash of the 16 bytes up to it is larger than those of the 24 places
    before and not smaller than those of the 24 after. So chunks have more than 24 bytes (but a text's first and
    last), about 50 on average, and cuts depend on at most 40 bytes to the left and 24 to the right: a
    repeated passage is cut alike wherever it stands. A run of one byte has no cuts and is one chunk.
    """
    pad = bytes(COVER + 2 * REACH)
    buf = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + len(pad)) - sizes
    gear, hashes = GEAR[buf], np.zeros(len(buf), np.uint32)
    for k in range(COVER):  # the rolling hash moves up two bits at every byte, so a byte is gone after 16
        hashes[k:] += gear[: len(gear) - k] << np.uint32(2 * k)
    hashes ^= hashes >> np.uint32(15)
    hashes *= np.uint32(0x9E3779B1)
    wide = hashes.copy()  # the largest of a place and those before it, over ever more places
    have = 1
    while have < REACH:
        step = min(have, REACH - have)
        wide[step:] = np.maximum(wide[step:], wide[:-step].copy())
        have += step
    cut = np.zeros(len(buf), bool)
    cut[REACH : len(buf) - REACH] = (hashes[REACH:-REACH] > wide[REACH - 1 : -REACH - 1]) & (hashes[REACH:-REACH] >= wide[2 * REACH :])
    places = np.flatnonzero(cut) + 1
    first, last = np.searchsorted(places, starts, "right"), np.searchsorted(places, starts + sizes, "left")
    return [np.concatenate(([0], places[a:b] - s, [n])) if n else np.zeros(1, np.int64) for a, b, s, n in zip(first.tolist(), last.tolist(), starts.tolist(), sizes.tolist(), strict=True)]


def _chunked(batches) -> Iterator:
    """doc_id, _row, and of each chunk the two halves of its 128-bit digest, its length and the number of words that start in it."""
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in slices(batches):
        texts = as_bytes(batch.column(2))
        for a, b in groups(texts):
            lists: tuple[list, ...] = ([], [], [], [])
            for text, cuts in zip(texts[a:b], chunk(texts[a:b]), strict=True):
                ends = cuts.tolist()
                view = memoryview(text)
                spans = list(zip(ends, ends[1:], strict=False))
                if len(spans) > 1:  # a short first or last chunk says little: it counts together with its neighbour
                    if spans[0][1] <= REACH:
                        spans[0] = (0, ends[2])
                    if spans[-1][1] - spans[-1][0] <= REACH:
                        spans[-1] = (ends[-3], ends[-1])
                codes = np.frombuffer(b"".join(digest(view[x:y]) for x, y in spans), np.int64).reshape(-1, 2)
                space = SPACES[np.frombuffer(text, np.uint8)]
                word = ~space & np.concatenate(([True], space))[: len(space)]
                counts = np.add.reduceat(word, cuts[:-1], dtype=np.int32) if len(text) else np.zeros(0, np.int32)
                for held, values in zip(lists, (codes[:, 0], codes[:, 1], np.diff(cuts).astype(np.int32), counts), strict=True):
                    held.append(values)
            columns = [pa.array(x, pa.list_(k)) for x, k in zip(lists, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *columns], ["doc_id", "_row", "digests", "halves", "sizes", "words"])


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each repeated passage of each document: doc_id, start, end, n_words, first_doc_id, is_first.

    start and end are bytes of the UTF-8 text. A run is a longest one of neighbouring chunks that other
    documents have too, with at least least_words words together. It is given as one passage for each
    stretch of chunks with the same first document, the smallest id that has them, so a passage may have
    fewer words; is_first says that this is the document itself, and then the passage stays when
    repeats are removed. Repeats within one document alone don't count. Documents are told
    apart by id and text, so that a repeated row is one document, whose passages come with each row; a
    null id is last; null and empty texts have no passages; a very long text is chunked whole; extra
    columns are ignored, whatever their names; an empty table gives none.

    Chunks count as equal if their digests of 128 bits are. Texts are chunked once; a row with its chunks' digests is written for each document. Digests are
    counted with partial sums; those of several documents are written and joined back to the chunks,
    where Spark splits a digest that very many documents have.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("_row"), F.col(text).cast("string").alias("_text"))
    chunks = materialise(rows.mapInArrow(_chunked, f"doc_id {kind}, _row long, digests array<long>, halves array<long>, sizes array<int>, words array<int>"), "chunks")
    both = F.arrays_zip(F.col("digests").alias("digest"), F.col("halves").alias("half"))
    digests = chunks.select("doc_id", "_row", F.explode(F.array_distinct(both)).alias("x")).select("doc_id", "_row", "x.*")
    counted = digests.groupBy("digest", "half").agg(F.min("doc_id").alias("first"), F.min("_row").alias("a"), F.max("_row").alias("b"))
    repeated = materialise(counted.where("a != b").select("digest", "half", "first"), "repeated")
    places = chunks.select("_row", F.posexplode(both).alias("place", "x")).select("_row", "place", "x.*").join(repeated, ["digest", "half"])
    places = places.groupBy("_row").agg(F.collect_set(F.struct("place", "first")).alias("places"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            ids, sizes, words, found = (batch.column(k).to_pylist() for k in range(4))
            out = []
            for doc, size, word, hits in zip(ids, sizes, words, found, strict=True):
                first = {x["place"]: x["first"] for x in hits}
                at = sorted(first)
                ends = np.cumsum(size).tolist()
                begin = 0
                for k in range(1, len(at) + 1):
                    if k == len(at) or at[k] != at[k - 1] + 1:
                        run, total = at[begin:k], sum(word[i] for i in at[begin:k])
                        if total >= least_words:
                            for owner, part in groupby(run, first.get):
                                some = list(part)
                                out.append((doc, ends[some[0]] - size[some[0]], ends[some[-1]], sum(word[i] for i in some), owner, owner == doc))
                        begin = k
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), batch.schema.field(0).type, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "end", "n_words", "first_doc_id", "is_first"])

    joined = chunks.join(places, "_row").select("doc_id", "sizes", "words", "places")
    return joined.mapInArrow(run, f"doc_id {kind}, start long, end long, n_words long, first_doc_id {kind}, is_first boolean")


def remove_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the passages that aren't first here. Ids must be different: spans are found again by id alone. A cut may leave half a character, which is dropped. A column of docs may not be called _d or _gone."""
    gone = passages.where("not is_first").groupBy(F.col("doc_id").alias("_d")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_gone"))
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("_d")), "left")
    raw = F.col(text).cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("_gone", lambda x: x["end"]))
    ends = F.concat(F.transform("_gone", lambda x: x["start"]), F.array(F.octet_length(raw).cast("long")))
    kept = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda x: F.unhex(F.regexp_replace(F.hex(F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))), HALF, "")).cast("string"))
    return joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, ""))).drop("_d", "_gone")
