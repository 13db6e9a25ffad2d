"""Token files: one wavelet matrix per shard, with token access, counting and lookup of occurrences."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, new_path
from .textscan import groups, slices

MAGIC = b"TVWM2\n"
#: Bits between two counts of the rank directory.
STEP = 512
#: Places that values are dealt back to at once.
STRETCH = 1 << 16
#: Bytes of a plane that are compressed together; a multiple of STEP bits.
BLOCK_BYTES = 1 << 16
#: Tokens that a shard holds before it is closed (32 MB of planes of 16 bits); a longer document is a shard of its own.
SHARD_TOKENS = 1 << 24
#: Files that a task reads, while that doesn't need more tasks than MOST_TASKS.
FILES_PER_TASK, MOST_TASKS = 1, 20_000


class Plane:
    """A bit string with rank and select: its bytes, and how many ones there are in each STEP bits."""

    def __init__(self, packed: np.ndarray, size: int):
        words = np.zeros(-(-max(size, 1) // STEP) * STEP // 8, np.uint8)
        words[: len(packed)] = packed
        self._set(size, np.bitwise_count(words.view(np.uint64)).reshape(-1, STEP // 64).sum(1, dtype=np.int64))
        self.packed = packed

    def _set(self, size: int, per: np.ndarray) -> None:
        self.size, self.per = size, per
        self.before = np.concatenate(([0], np.cumsum(per, dtype=np.int64)))
        self.zeros = size - int(self.before[-1])

    def _bytes(self, first: int, last: int) -> np.ndarray:
        return self.packed[first:last]

    def bit(self, i: int) -> int:
        return int(self._bytes(i >> 3, (i >> 3) + 1)[0]) >> (7 - (i & 7)) & 1

    def rank1(self, i: int) -> int:
        """Ones before place i."""
        block = i // STEP
        if not i % STEP:
            return int(self.before[block])
        held = self._bytes(block * STEP // 8, (i + 7) >> 3)
        whole = held[: (i >> 3) - block * STEP // 8]
        part = int(held[-1]) >> (8 - (i & 7)) if i & 7 else 0
        return int(self.before[block]) + int(np.bitwise_count(whole).sum()) + part.bit_count()

    def rank0(self, i: int) -> int:
        return i - self.rank1(i)

    def select(self, one: bool, k: int) -> int:
        """Place of the k-th (from 0) one or zero."""
        ones = self.before if one else np.arange(len(self.before)) * STEP - self.before
        block = int(np.searchsorted(ones, k, "right")) - 1
        bits = np.unpackbits(self._bytes(block * STEP // 8, (block + 1) * STEP // 8))[: self.size - block * STEP]
        return block * STEP + int(np.flatnonzero(bits == one)[k - int(ones[block])])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self._bytes(0, -(-self.size // 8)), count=self.size).view(bool)


class StoredPlane(Plane):
    """A plane of a file: the counts are read as a whole, the bits block by block where they are asked for."""

    def __init__(self, size: int, counts: bytes, blocks: list[tuple[int, int]], fetch):
        self._set(size, np.frombuffer(counts, "<u2").astype(np.int64))
        self.blocks, self.fetch = blocks, fetch

    def _bytes(self, first: int, last: int) -> np.ndarray:
        last = min(last, -(-self.size // 8))
        held = [np.frombuffer(self.fetch(*self.blocks[k]), np.uint8) for k in range(first // BLOCK_BYTES, -(-last // BLOCK_BYTES))]
        start = first // BLOCK_BYTES * BLOCK_BYTES
        return (held[0] if len(held) == 1 else np.concatenate(held or [np.zeros(0, np.uint8)]))[first - start : last - start]


class WaveletMatrix:
    """Bit planes from the highest bit; each plane's zeros, in order, come before its ones in the next."""

    def __init__(self, planes: list[Plane], size: int):
        self.planes, self.size = planes, size

    @classmethod
    def build(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        now, planes = values.astype(np.uint16 if width <= 16 else np.uint32), []
        for shift in range(width - 1, -1, -1):
            bit = (now & now.dtype.type(1 << shift)) != 0
            planes.append(Plane(np.packbits(bit), len(now)))
            now = np.concatenate((now.compress(~bit), now.compress(bit)))
        return cls(planes, len(values))

    def values(self) -> np.ndarray:
        """All values, from the lowest plane up: what a plane's zeros and ones became is dealt back to their places, a stretch at a time that fits a cache."""
        width = len(self.planes)
        now = np.zeros(self.size, np.uint16 if width <= 16 else np.uint32)
        for shift, plane in enumerate(reversed(self.planes)):
            bit, back = plane.bits(), np.empty_like(now)
            now[plane.zeros :] |= now.dtype.type(1 << shift)
            zero, one = 0, plane.zeros
            for at in range(0, self.size, STRETCH):
                some, part = bit[at : at + STRETCH], back[at : at + STRETCH]
                ones, zeros = np.flatnonzero(some), np.flatnonzero(~some)
                part[zeros], part[ones] = now[zero : zero + len(zeros)], now[one : one + len(ones)]
                zero, one = zero + len(zeros), one + len(ones)
            now = back
        return now

    def access(self, i: int) -> int:
        out = 0
        for plane in self.planes:
            b = plane.bit(i)
            i = plane.zeros + plane.rank1(i) if b else plane.rank0(i)
            out = out << 1 | b
        return out

    def _range(self, value: int, first: int, last: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        for k, plane in enumerate(self.planes):
            if value >> (len(self.planes) - 1 - k) & 1:
                first, last = plane.zeros + plane.rank1(first), plane.zeros + plane.rank1(last)
            else:
                first, last = plane.rank0(first), plane.rank0(last)
        return first, last

    def count(self, value: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of value in places first to last (not included)."""
        a, b = self._range(value, first, self.size if last is None else last)
        return b - a

    def occurrence(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of value."""
        a, b = self._range(value, 0, self.size)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for shift, plane in enumerate(reversed(self.planes)):
            one = bool(value >> shift & 1)
            i = plane.select(one, i - plane.zeros if one else i)
        return i


def encode_shard(doc_ids: list, lengths: list[int], values: np.ndarray, width: int) -> bytes:
    """A file: magic, length of the head, head as JSON, then the parts that it names, each compressed with zstandard.

    Parts are the documents' lengths and ids, and for each plane its rank directory (ones in each STEP bits) and its bits in blocks
    of BLOCK_BYTES, so that a lookup reads the directories and a block a plane.
    """
    import zstandard

    z, body, at = zstandard.ZstdCompressor(level=1), [], 0

    def put(data: bytes) -> tuple[int, int]:
        nonlocal at
        body.append(z.compress(data))
        at += len(body[-1])
        return at - len(body[-1]), len(body[-1])

    head: dict = {"tokens": len(values), "width": width, "lengths": put(np.array(lengths, "<i8").tobytes()), "ids": put(json.dumps(doc_ids).encode()), "planes": []}
    for p in WaveletMatrix.build(values, width).planes:
        raw = p.packed.tobytes()
        head["planes"].append({"counts": put(p.per.astype("<u2").tobytes()), "blocks": [put(raw[k : k + BLOCK_BYTES]) for k in range(0, len(raw), BLOCK_BYTES)]})
    said = json.dumps(head).encode()
    return MAGIC + struct.pack("<I", len(said)) + said + b"".join(body)


class TokenFile:
    """A token file that is read in pieces: `read(first, size)` gives bytes of it. A few blocks are kept."""

    def __init__(self, read, keep: int = 64):
        import zstandard

        start = read(0, len(MAGIC) + 4)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack("<I", start[len(MAGIC) :])[0]
        base = len(start) + n
        self.head, unzip = json.loads(read(len(start), n)), zstandard.ZstdDecompressor()
        self.fetch = lru_cache(keep)(lambda at, size: unzip.decompress(read(base + at, size)))

    def ids(self) -> list:
        return json.loads(self.fetch(*self.head["ids"]))

    def lengths(self) -> np.ndarray:
        return np.frombuffer(self.fetch(*self.head["lengths"]), "<i8")

    @cached_property
    def matrix(self) -> WaveletMatrix:
        size = self.head["tokens"]
        return WaveletMatrix([StoredPlane(size, self.fetch(*p["counts"]), [tuple(x) for x in p["blocks"]], self.fetch) for p in self.head["planes"]], size)


def decode_shard(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Document ids, their numbers of tokens, and the matrix, of a file that is at hand as a whole."""
    found = TokenFile(lambda at, size: data[at : at + size], 1)
    return found.ids(), found.lengths(), found.matrix


def open_file(path: str) -> TokenFile:
    """A token file for lookups, read where it lies: its head, its directories, and then a block a plane and lookup."""
    files, name = _open(path)
    f = files.open_input_file(name)
    return TokenFile(lambda at, size: f.read_at(size, at))


def _open(path: str):
    """File system and path of a URI; a bare path or file:/x is local."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_tokens(docs: DataFrame, encoder, folder: str, width: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all documents in ascending order of doc_id; returns a row for each file.

    encoder() gives an object whose encode() turns texts into packed unsigned 32-bit ids; end_id is
    appended to each document. Null texts count as empty, null ids come first, documents with the
    same id are ordered by a hash of their texts, repeated rows all stay; extra columns are ignored,
    whatever their names. Ids are whole numbers or strings. A very long text is encoded whole, and is a
    file of its own where it has more than SHARD_TOKENS ids. An empty table makes no file and gives an
    empty manifest.
    Files are written under a name of their task's try and then moved, so that a task may run twice.
    The manifest (part, shard, path, docs, tokens, start) is written too; start counts the ids of all
    files before.
    """

    most = SHARD_TOKENS

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, attempt, shard = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        words, out, ids, held, tail = encoder(), [], [], [], np.array([end_id], "<u4").tobytes()

        def close() -> None:
            nonlocal shard
            lengths = [len(x) // 4 for x in held]
            name = f"{base}/part-{part:06d}-{shard:06d}.wm"
            with files.open_output_stream(f"{name}.{attempt}") as f:
                f.write(encode_shard(ids, lengths, np.frombuffer(b"".join(held), "<u4"), width))
            files.move(f"{name}.{attempt}", name)
            out.append((part, shard, f"{folder}/{name.rsplit('/', 1)[1]}", len(ids), sum(lengths)))
            shard += 1
            ids.clear()
            held.clear()

        size = 0
        for batch in slices(batches):
            texts, keys = [x or "" for x in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for a, b in groups([t for t in texts], 1 << 18):
                for key, x in zip(keys[a:b], words.encode(texts[a:b]), strict=True):
                    if held and size + len(x) // 4 >= most:
                        close()
                        size = 0
                    ids.append(key)
                    held.append(x + tail)
                    size += len(x) // 4 + 1
        if held:
            close()
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "shard", "path", "docs", "tokens"])

    rows = docs.select(doc_id, F.col(text).cast("string").alias("_text"))
    order = [F.col(doc_id), F.xxhash64("_text")]  # rows of one id, or without one, may lie in several tasks
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = materialise(ordered.mapInArrow(run, "part int, shard int, path string, docs long, tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("_n"))  # a row for each task
    parts = parts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return manifest.join(F.broadcast(parts), "part").withColumn("start", start.cast("long")).drop("_base")


def read_tokens(manifest: DataFrame, id_type: str = "long", digest: bool = False) -> DataFrame:
    """Reads the files back: a row per document with doc_id, start, n_tokens and ids (packed as in write_tokens).

    With digest, ids_crc32 comes in place of ids.
    """
    last = "ids_crc32 long" if digest else "ids binary"

    def run(batches) -> Iterator:
        import pyarrow as pa

        kind = pa.int64() if id_type in ("long", "bigint", "int") else pa.string()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, name = _open(path)
                with files.open_input_stream(name) as f:
                    keys, lengths, matrix = decode_shard(f.read())
                raw, ends = matrix.values().astype("<u4").tobytes(), np.cumsum(lengths)
                starts = ends - lengths
                ids = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                what = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(starts + start), pa.array(lengths), what], ["doc_id", "start", "n_tokens", last.split()[0]])

    # By number, as a few paths are so small that they would be put together in one task otherwise.
    tasks = max(1, min(-(-manifest.count() // FILES_PER_TASK), MOST_TASKS))
    files = manifest.select("path", "start").repartition(tasks)
    return files.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, {last}")


def token_folder(spark) -> str:
    return new_path(spark, "tokens")
