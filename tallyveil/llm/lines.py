"""Line dedup by range-sorted line hashes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

BLANKS = " \t\n\x0b\x0c\r"
KEY, DOCUMENT = ["h1", "h2"], ["_doc", "_text"]


def line_key(line: Column) -> Column:
    """Equal for lines that are equal without ASCII white space at their ends and with A-Z lower-cased.

    Lower-casing the UTF-8 bytes as Latin-1 characters is quick; it moves the first bytes of longer
    characters too, but the same way everywhere and never onto one another (see decontam.words).
    """
    return F.lower(F.decode(F.btrim(line, F.lit(BLANKS)).cast("binary"), "ISO-8859-1"))


def _doc_changes(ids, text: np.ndarray) -> np.ndarray:
    """Whether a row's document is another than that of the row before; the first row is left False."""
    import pyarrow.compute as pc

    out = np.zeros(len(ids), bool)
    if len(ids) > 1:
        x, y = ids.slice(1), ids.slice(0, len(ids) - 1)
        same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
        out[1:] = ~same.astype(bool) | (text[1:] != text[:-1])
    return out


def _streamed(batches, least: int) -> Iterator:
    """Goes over a sorted partition, batch by batch, and adds: part; hot, whether `least` documents or more have
    the row's key here; first, whether the row is its key's first here; documents, null.

    Only the rows of a key that fewer documents have had so far are held back. The partition's first and
    last key get a row each with pos -1 and their number of documents here.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held, begun, ends = None, None, []  # rows held back; the key that was begun: key, documents, last one; counts of edges

    def passed_on(table, hot: np.ndarray, first: np.ndarray) -> Iterator:
        n = table.num_rows
        columns = (("part", pa.array(np.full(n, part, np.int32))), ("hot", pa.array(hot)), ("first", pa.array(first)), ("documents", pa.nulls(n, pa.int64())))
        for name, values in columns:
            table = table.append_column(name, values)
        yield from table.to_batches(max_chunksize=65536)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        a, b, text = (table.column(c).to_numpy() for c in (*KEY, "_text"))
        ids, n = table.column("_doc").combine_chunks(), table.num_rows
        new_key = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        new_doc = new_key | _doc_changes(ids, text)
        goes_on = begun is not None and begun[0] == (a[0], b[0])
        if goes_on:
            new_key[0], new_doc[0] = False, begun[2] != (ids[0].as_py(), text[0])
        run = np.flatnonzero(np.concatenate(([True], new_key[1:])))
        documents = np.add.reduceat(new_doc.astype(np.int64), run)
        if goes_on:
            documents[0] += begun[1]
        if not ends:
            ends.append([(a[0], b[0]), 0])
        if ends[0][0] == (a[0], b[0]):
            ends[0][1] = int(documents[0])
        last = ((a[-1], b[-1]), int(documents[-1]))
        hot = documents >= least
        settled = n if hot[-1] else int(run[-1])
        if settled:
            yield from passed_on(table.slice(0, settled), np.repeat(hot, np.diff(np.append(run, n)))[:settled], new_key[:settled])
        held = table.slice(settled) if settled < n else None
        begun = (last[0], last[1], (ids[-1].as_py(), text[-1])) if held is None else None
    if held is not None:
        first = np.zeros(held.num_rows, bool)
        first[0] = True
        yield from passed_on(held, np.zeros(held.num_rows, bool), first)
    if ends:
        ends = dict([ends[0], last])
        rows = [(*key, None, 0, -1, 0, part, False, False, n) for key, n in ends.items()]
        schema = batch.schema
        kinds = [*schema.types, pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x.item() if hasattr(x, "item") else x for x in c], k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*schema.names, "part", "hot", "first", "documents"])


def _bitmaps(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        keep = []
        for n, dropped in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            bits = np.ones(n, bool)
            bits[dropped] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        counts = [len(set(x)) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(keep, pa.binary())], [*DOCUMENT, "n_lines", "n_dropped", "keep"])


def mark_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every different document that loses lines: _doc, _text (hash of the text), n_lines, n_dropped, keep.

    Texts are split at newlines; a line's key is the line without ASCII white space at its ends, A-Z
    lower-cased. A key of min_chars characters or more that min_documents different documents have
    loses its lines: all of them, or with keep_first all but the first, by id, text hash and place.
    keep is a compressed bitmap of the lines that stay (zlib over packed bits); texts aren't returned.

    Hashes of keys (96 bits) are range-partitioned with the document as further key and sorted by
    place too, so that a key that a third of all lines have is dealt over as many partitions as it
    fills, and each partition is then streamed. Only a partition's first and last key can have rows
    elsewhere: two rows for each partition are summed and handed back.
    """
    base = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"), F.split(F.coalesce(text, F.lit("")), "\n", -1).alias("lines"))
    lines = base.select(*DOCUMENT, F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    lines = lines.where(F.char_length(F.btrim("line", F.lit(BLANKS))) >= max(1, min_chars)).withColumn("key", line_key(F.col("line")))
    hashes = lines.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), *DOCUMENT, "pos", "n_lines")
    hashes = materialise(hashes, "hashes")  # else the range sort's sampling would split all texts once more
    ordered = hashes.repartitionByRange(*KEY, *DOCUMENT).sortWithinPartitions(*KEY, *DOCUMENT, "pos")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"h1 long, h2 int, _doc {kind}, _text long, pos int, n_lines int, part int, hot boolean, first boolean, documents long"
    rows = materialise(ordered.mapInArrow(lambda batches: _streamed(batches, min_documents), schema), "lines")
    edges = rows.where("pos < 0").groupBy(*KEY).agg(F.sum("documents").alias("total"), F.min("part").alias("begins"))
    marked = rows.where("pos >= 0").join(F.broadcast(edges), KEY, "left")  # two rows for each partition at most
    drop = F.when(F.col("total").isNotNull(), F.col("total") >= min_documents).otherwise(F.col("hot"))
    if keep_first:
        drop = drop & ~(F.col("first") & (F.col("part") == F.coalesce("begins", "part")))
    gone = marked.where(drop).groupBy(*DOCUMENT).agg(F.max("n_lines").alias("n_lines"), F.collect_list("pos").alias("dropped"))
    return gone.mapInArrow(_bitmaps, f"_doc {kind}, _text long, n_lines int, n_dropped long, keep binary")


def _words(batches) -> Iterator:
    """keep as 64-bit words, the first line in the highest bit, for functions of the engine."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for packed in batch.column(2).to_pylist():
            raw = zlib.decompress(packed)
            out.append(np.frombuffer(raw + bytes(-len(raw) % 8), ">i8").tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["_d", "_t", "keep"])


def _applied(docs: DataFrame, marks: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row (all columns of docs), and of its lines n_lines, n_dropped, and kept, the text that stays (null for a null text).

    Texts only go through functions of the engine: none is sent to Python.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    marks = marks.select("_doc", "_text", "keep").mapInArrow(_words, f"_d {kind}, _t long, keep array<long>")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    base = docs.select(row.alias("row"), F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("_body"))
    joined = base.join(marks, F.col("_doc").eqNullSafe(F.col("_d")) & (F.xxhash64("_body") == F.col("_t")), "left")
    split = joined.select("row", "_body", "keep", F.split(F.coalesce("_body", F.lit("")), "\n", -1).alias("lines"))
    stay = F.expr("filter(lines, (x, i) -> (shiftrightunsigned(get(keep, cast(i div 64 as int)), 63 - i % 64) & 1) = 1)")
    split = split.select("row", "_body", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("keep").isNotNull(), stay).alias("stay"))
    return split.select(
        "row", "n_lines",
        F.when(F.col("stay").isNotNull(), F.col("n_lines") - F.size("stay")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("stay").isNotNull(), F.array_join("stay", "\n")).otherwise(F.col("_body")).alias("kept"),
    )


def dedup_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Applies mark_lines: docs with the text that stays; with digest doc_id, n_lines, n_dropped, kept_sha256 instead.

    One row for each row of docs. A null or empty text is one empty line, which stays. Documents are
    told apart by id and text, so that repeated rows count as one document and each lose the same
    lines; a null id is an id; other columns are handed on as they are; an empty table gives an empty
    result.
    """
    marks = mark_lines(docs, min_documents, min_chars, keep_first, doc_id, text)
    if digest:
        out = _applied(docs.select(doc_id, text), marks, doc_id, text)
        return out.select(f"row.`{doc_id}`", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
    columns = [F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    return _applied(docs, marks, doc_id, text).select(*columns)
