"""Gapless numbers without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise


def dense_slots(rows: DataFrame, groups: list[str], order: list[Column], slot: str) -> DataFrame:
    """Numbers the rows of every group from 0 without gaps.

    The rows are written once with the number of the partition that made them, so that a lost
    executor cannot change them later. A group is then counted by partition (groups x partitions
    rows), and a row's number is its rank in its own partition plus what earlier partitions hold: a
    group with a third of all rows is still spread over as many tasks as it came from.
    """
    kept = materialise(rows.withColumn("_part", F.spark_partition_id()), slot)
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = kept.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"))
    base = base.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*groups, "_part").orderBy(*order)
    joined = kept.join(base, [*groups, "_part"])
    return joined.withColumn(slot, (F.row_number().over(own) - 1 + F.col("_base")).cast("long")).drop("_part", "_base")
