"""Coded tables as files, and generated ones."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prf import uniform
from ..operators.encode import attributes


def read_coded(spark: SparkSession, path: str, width: int) -> DataFrame:
    """tid and a0, a1, ... of CSV files with the heading 0, 1, ..., width - 1; anything else is an error.

    A row's identity is its position: over the files by path, from 0, whatever pieces they are read
    in, so that every owner's columns stay aligned. Pieces are counted (a row for each piece of a file)
    and a row's place in its piece is added to what the pieces before it hold.
    """
    schema = T.StructType([T.StructField(str(k), T.LongType()) for k in range(width)])
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")
    cells = [F.col(f"`{k}`").alias(f"a{k}") for k in range(width)]
    placed = rows.select(*cells, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    pieces = placed.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = placed.join(F.broadcast(pieces), ["_path", "_start"])
    return joined.select((F.col("_base") + F.col("_id") - F.col("_first")).alias("tid"), *(f"a{k}" for k in range(width)))


def write_coded(wide: DataFrame, path: str) -> None:
    wide.select(*(F.col(f"a{a}").alias(str(a)) for a in attributes(wide))).write.mode("overwrite").csv(path, header=True)


def read_text_table(spark: SparkSession, paths: str | Sequence[str], separator: str = ",") -> DataFrame:
    """Files without a heading, gzip among them, as text columns c0, c1, ...; several paths are one table."""
    rows = spark.read.csv(list(paths) if not isinstance(paths, str) else paths, sep=separator, ignoreLeadingWhiteSpace=True)
    return rows.toDF(*(f"c{k}" for k in range(len(rows.columns))))


def zipf(size: int, exponent: float) -> list[float]:
    weights = [(v + 1.0) ** -exponent if exponent > 0 else 1.0 for v in range(size)]
    return [w / sum(weights) for w in weights]


def generate(spark: SparkSession, rows: int, columns: int, domain: int, group: int, correlation: float, exponent: float, seed: int, interleaved: bool = False) -> DataFrame:
    """Latent-group data: a column has its group's latent value with the given chance, else a value of its own from the same Zipf law."""
    if columns % group or not 0 <= correlation <= 1:
        raise ValueError("columns must fill groups, and the correlation be in [0, 1]")
    edges, total = [], 0.0
    for p in zipf(domain, exponent)[:-1]:
        total += p
        edges.append(total)

    def draw(*parts):
        u = uniform(seed, *parts, F.col("tid"))
        return sum(((u >= e).cast("bigint") for e in edges), F.lit(0).cast("bigint"))

    cells = [
        F.when(uniform(seed, "use", a, F.col("tid")) < correlation, draw("latent", a // group)).otherwise(draw("own", a)) for a in range(columns)
    ]
    order = [g * group + k for k in range(group) for g in range(columns // group)] if interleaved else range(columns)
    return spark.range(rows).withColumnRenamed("id", "tid").select("tid", *(cells[a].alias(f"a{k}") for k, a in enumerate(order)))


def suite() -> dict[str, dict]:
    """The generated tables of the sweeps, by name; 50,000 rows, 24 columns in groups of 4."""
    base = {"rows": 50_000, "columns": 24, "domain": 8, "group": 4, "correlation": 0.75, "exponent": 0.0}
    out = {name: base | {"correlation": c, "seed": 3101} for name, c in (("independent_uniform", 0.0), ("weakcorr_uniform", 0.25), ("mediumcorr_uniform", 0.5), ("correlated_uniform", 0.75), ("highcorr_uniform", 0.9))}
    out |= {f"correlated_zipf_{layout}": base | {"exponent": 1.2, "seed": 3201, "interleaved": layout == "interleaved"} for layout in ("grouped", "interleaved")}
    out["highcorr_zipf_grouped"] = base | {"correlation": 0.9, "exponent": 1.5, "seed": 3202}
    out |= {f"tail_zipf_{e:g}".replace(".", "_"): base | {"exponent": e, "seed": 3301} for e in (0.0, 0.6, 1.2, 1.8)}
    return out | {f"domain_{d}": base | {"domain": d, "exponent": 1.2, "seed": 3401} for d in (4, 8, 16, 32)}


def write_suite(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> DataFrame:
    """Writes the suite's tables as coded CSV; returns name, rows and digest of each."""
    rows = []
    for name in names or suite():
        wide = generate(spark, **suite()[name])
        write_coded(wide, f"{folder}/{name}")
        found = table_digest(wide.drop("tid")).first()
        rows.append((name, found["rows"], found["digest"]))
    return spark.createDataFrame(rows, "name string, rows bigint, digest string")


def toy(spark: SparkSession, rows: int = 1200, seed: int = 2026) -> DataFrame:
    """Eight bits: four latent ones twice, each copy flipped with chance 0.08."""
    cells = []
    for a in range(8):
        latent = (uniform(seed, "latent", a // 2, F.col("tid")) < 0.5).cast("bigint")
        cells.append(latent.bitwiseXOR((uniform(seed, "flip", a, F.col("tid")) < 0.08).cast("bigint")).alias(f"a{a}"))
    return spark.range(rows).withColumnRenamed("id", "tid").select("tid", *cells)


def digest(path: str) -> str:
    """SHA-256 of a file, or of all files of a folder by name."""
    files = sorted(p for p in Path(path).rglob("*") if p.is_file()) if Path(path).is_dir() else [Path(path)]
    h = hashlib.sha256()
    for p in files:
        h.update(p.read_bytes())
    return h.hexdigest()


def table_digest(df: DataFrame) -> DataFrame:
    """One row: rows, and the sum over rows of 52 bits of the SHA-256 of their cells as text, which no order changes."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns))
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest"))


def write_json(path: str | Path, value: Mapping) -> None:
    """Written aside and renamed; NaN is an error."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    aside = path.with_suffix(".part")
    aside.write_text(json.dumps(value, indent=1, sort_keys=True, allow_nan=False))
    os.replace(aside, path)


def signature(identity: Mapping) -> str:
    return hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()


def reuse(path: str | Path, identity: Mapping) -> dict | None:
    """The stored row of the same identity, None where there is none; another identity at that place is an error."""
    path = Path(path)
    if not path.exists():
        return None
    held = json.loads(path.read_text())
    if held["signature"] != signature(identity):
        raise ValueError(f"{path} holds a result of another configuration")
    return held["row"]


def store(path: str | Path, identity: Mapping, row: Mapping) -> None:
    write_json(path, {"signature": signature(identity), "row": dict(row)})
