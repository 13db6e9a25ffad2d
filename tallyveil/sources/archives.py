"""Delimited text in ZIP and tar archives, as a data source whose partitions are groups of members."""

from __future__ import annotations

import csv
import glob
import gzip
import io
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a row of the source has: where it comes from, its fields, and its text where it hasn't as many as it should.
SCHEMA = "archive string, member string, line bigint, fields array<string>, bad string"
MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")
#: Bytes of unpacked members that one partition reads, about.
PARTITION_BYTES = 64 << 20


def local_path(path: str) -> str:
    """The path that executors open. Archives are read at places of their own, which needs a file system that is mounted everywhere."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: archives must lie in a folder that driver and executors have mounted")
    return path


@dataclass
class Members(InputPartition):
    """Some members of one archive: (name, first byte, size); a compressed tar is one partition, as it can only be read from its start."""

    archive: str
    members: list[tuple[str, int, int]] | None

    def __init__(self, archive: str, members: list[tuple[str, int, int]] | None):
        self.archive, self.members = archive, members


def _listed(archive: str) -> list[tuple[str, int, int]] | None:
    """The archive's files, from a ZIP's directory or a tar's headers."""
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            return [(i.filename, 0, i.file_size) for i in z.infolist() if not i.is_dir()]
    with open(archive, "rb") as f:
        if f.read(2) == b"\x1f\x8b":
            return None
    try:
        with tarfile.open(archive, "r:") as t:
            return [(m.name, m.offset_data, m.size) for m in t if m.isfile()]
    except tarfile.TarError as e:
        raise ValueError(f"{archive}: no whole ZIP or tar archive: {e}") from e


def _contents(part: Members) -> Iterator[tuple[str, bytes]]:
    """The members' bytes, one after the other; a member that is cut short or damaged is an error."""
    try:
        if part.members is None:
            with tarfile.open(part.archive, "r|gz") as t:
                for m in t:
                    if m.isfile():
                        yield m.name, t.extractfile(m).read()
        elif zipfile.is_zipfile(part.archive):
            with zipfile.ZipFile(part.archive) as z:
                for name, _, _ in part.members:
                    yield name, z.read(name)  # its checksum is compared
        else:
            with open(part.archive, "rb") as f:
                for name, at, size in part.members:
                    f.seek(at)
                    data = f.read(size)
                    if len(data) < size:
                        raise EOFError(f"{name} has {len(data)} of {size} bytes")
                    yield name, data
    except (EOFError, tarfile.TarError, zipfile.BadZipFile, gzip.BadGzipFile, OSError) as e:
        raise ValueError(f"{part.archive}: truncated or damaged: {e}") from e


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        self.separator, self.width = options.get("separator", ","), int(options.get("width", 0))
        self.mode, self.skip = options.get("mode", "FAILFAST").upper(), int(options.get("skip", 0))
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")

    def partitions(self) -> Sequence[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path))
        if not found:
            raise ValueError(f"{self.path}: no archive")
        out = []
        for archive in found:
            members = _listed(archive)
            if members is None:
                out.append(Members(archive, None))
                continue
            some, held = [], 0
            for m in members:
                if some and held + m[2] > self.most:
                    out.append(Members(archive, some))
                    some, held = [], 0
                some.append(m)
                held += m[2]
            if some:
                out.append(Members(archive, some))
        return out

    def read(self, partition: Members) -> Iterator[tuple]:
        for name, data in _contents(partition):
            if name.endswith(".gz"):
                data = gzip.decompress(data)
            lines = io.StringIO(data.decode("utf-8"), newline="")
            rows = (x.split() for x in lines) if self.separator == "whitespace" else csv.reader(lines, delimiter=self.separator, skipinitialspace=True)
            for line, fields in enumerate(rows):
                if line < self.skip or not fields:
                    continue
                whole = not self.width or len(fields) == self.width
                if not whole and self.mode == "FAILFAST":
                    raise ValueError(f"{partition.archive}, {name}, line {line}: {len(fields)} fields in place of {self.width}")
                if whole or self.mode == "PERMISSIVE":
                    yield os.path.basename(partition.archive), name, line, fields, None if whole else ",".join(fields)


class Archives(DataSource):
    """Options: path (a file, a pattern or a folder), separator (a character, or whitespace), width (fields of a row, 0 for any), mode, skip (lines of a heading), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], separator: str = ",", mode: str = "FAILFAST", skip: int = 0, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The rows of delimited text in all members of ZIP, tar and tar.gz archives, with typed columns (name, type).

    Members are dealt to tasks by size. A row with another number of fields, or a field that isn't of its type, is bad: an
    error (FAILFAST), left out (DROPMALFORMED), or kept with nulls and its text in a column _bad (PERMISSIVE). An archive that is
    cut short or damaged is an error in every mode. An empty field is null.
    """
    spark.dataSource.register(Archives)
    options = {"path": path, "separator": separator, "width": str(len(columns)), "mode": mode, "skip": str(skip), "partitionBytes": str(partition_bytes)}
    rows = spark.read.format("archives").options(**options).load()
    text = [F.nullif(F.get("fields", F.lit(k)), F.lit("")) for k in range(len(columns))]
    if mode.upper() == "FAILFAST":
        return rows.select(*(x.cast(kind).alias(name) for x, (name, kind) in zip(text, columns, strict=True)))
    typed = [x.try_cast(kind) for x, (_, kind) in zip(text, columns, strict=True)]
    wrong = F.lit(False)
    for x, t in zip(text, typed, strict=True):
        wrong = wrong | (x.isNotNull() & t.isNull())
    bad = F.when(F.col("bad").isNotNull(), F.col("bad")).when(wrong, F.array_join("fields", ","))
    made = rows.select(*(F.when(F.col("bad").isNull(), t).alias(name) for t, (name, _) in zip(typed, columns, strict=True)), bad.alias("_bad"))
    return made.where("_bad is null").drop("_bad") if mode.upper() == "DROPMALFORMED" else made


def write_archives(table: DataFrame, folder: str, rows: int = 10_000) -> None:
    """A ZIP for each task that has rows, of CSV members of so many rows each, without headings; null is an empty field.

    A task writes under a name of its own and renames the whole file, under its partition's number: a task that is tried again replaces its own file.
    """
    home = local_path(folder)

    def run(batches) -> Iterator:
        from pyspark import TaskContext

        number, members, held, z = TaskContext.get().partitionId(), 0, [], None
        draft = os.path.join(home, f".{number}-{uuid.uuid4().hex}")

        def put():
            nonlocal members, held
            text = io.StringIO()
            csv.writer(text, lineterminator="\n").writerows(held)
            z.writestr(f"part-{number:05d}/{members:05d}.csv", text.getvalue())
            members, held = members + 1, []

        for batch in batches:
            if z is None and batch.num_rows:
                os.makedirs(home, exist_ok=True)
                z = zipfile.ZipFile(draft, "w", zipfile.ZIP_DEFLATED)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) >= rows:
                    put()
        if z is not None:
            if held:
                put()
            z.close()
            os.replace(draft, os.path.join(home, f"part-{number:05d}.zip"))
        yield from ()

    table.mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()
