"""Keyed randomness that depends on tags alone, never on partitioning, and 64-bit mixing."""

from __future__ import annotations

import hashlib
import math
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The increment and factors of the splitmix64 generator.
GOLDEN, FACTOR1, FACTOR2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tag(*parts: Column | str | int) -> Column:
    """The parts joined by a vertical bar, as text."""
    return F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def seed_hex(*parts: Column | str | int) -> Column:
    """The first 16 hex digits of the SHA-256 of the tag: a stable 64-bit seed."""
    return F.substring(F.sha2(tag(*parts), 256), 1, 16)


def stable_seed(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:8], "big")


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) from the first 13 hex digits of the tag's SHA-256."""
    digits = F.conv(F.substring(F.sha2(tag(*parts), 256), 1, 13), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def uniform_value(*parts: object) -> float:
    digits = int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)
    return (digits + 0.5) / (1 << 52)


def laplace(scale: Column | float, *parts: Column | str | int) -> Column:
    """Laplace noise by the inverse of its distribution function."""
    u = uniform(*parts) - F.lit(0.5)
    return -(scale if isinstance(scale, Column) else F.lit(scale)) * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))


def laplace_value(scale: float, *parts: object) -> float:
    u = uniform_value(*parts) - 0.5
    return -scale * math.copysign(1.0, u) * math.log(1.0 - 2.0 * abs(u))


@contextmanager
def wrapping(spark: SparkSession):
    """Arithmetic that wraps as in hardware. The mode is taken when an expression is analysed, so a frame built inside keeps it."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def splitmix64(x: Column) -> Column:
    """To be used inside `wrapping`."""
    x = x + F.lit(_signed(GOLDEN))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 30)) * F.lit(_signed(FACTOR1))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 27)) * F.lit(_signed(FACTOR2))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def splitmix64_array(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FACTOR1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(FACTOR2)
    return x ^ (x >> np.uint64(31))


def geometric_rank(row: Column, coordinate: Column, seed: int, gamma: float = 1.0) -> Column:
    """The shared geometric rank of an aligned row at a sketch coordinate; inside `wrapping`."""
    mixed = splitmix64(row.cast("long").bitwiseXOR(splitmix64(coordinate.cast("long") + F.lit(_signed(seed % (1 << 64))))))
    u = (F.shiftrightunsigned(mixed, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    rank = F.ceil(-F.log1p(-u) / F.lit(math.log1p(gamma)))
    return F.least(F.greatest(rank, F.lit(1)), F.lit(65535)).cast("int")


def geometric_rank_array(rows: np.ndarray, coordinates: np.ndarray, seed: int, gamma: float = 1.0) -> np.ndarray:
    """Ranks of every row (first axis) at every coordinate, as geometric_rank."""
    keys = splitmix64_array(coordinates.astype(np.uint64) + np.uint64(seed % (1 << 64)))
    mixed = splitmix64_array(rows.astype(np.uint64)[:, None] ^ keys[None, :])
    u = ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return np.clip(np.ceil(-np.log1p(-u) / math.log1p(gamma)), 1, 65535).astype(np.uint16)
