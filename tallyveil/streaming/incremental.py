"""Histograms and sketches of rows that arrive: both are sums or maxima, so the order of arrival doesn't matter."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prf import geometric_rank, wrapping
from ..operators.encode import to_long


def source(spark: SparkSession, like: DataFrame, pattern: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files that match a pattern, with the schema of a table that is there already."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def histogram(wide: DataFrame) -> DataFrame:
    """attr, value, n of all rows so far. The state is a row for each public value."""
    return to_long(wide).groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"))


def windowed_histogram(rows: DataFrame, time: str, late: str, length: str, value: Column) -> DataFrame:
    """start, value, n by time windows; rows that are later than `late` are dropped with their window's state."""
    w = F.window(time, length)
    held = rows.withWatermark(time, late).groupBy(w.alias("w"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return held.select(F.col("w.start").alias("start"), "value", "n")


def sketch(wide: DataFrame, members: Mapping[str, Column], m: int, seed: int, gamma: float = 1.0) -> DataFrame:
    """key, j, rank: the largest rank of a key's members so far. The state is a row for each key and coordinate."""
    flags = F.array(*(F.struct(F.lit(k).alias("key"), c.alias("member")) for k, c in members.items()))
    with wrapping(wide.sparkSession):
        cells = wide.select("tid", F.explode(flags).alias("x")).where("x.member").select("tid", "x.key", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
        return cells.select("key", "j", geometric_rank(F.col("tid"), F.col("j"), seed, gamma).alias("rank")).groupBy("key", "j").agg(F.max("rank").alias("rank"))


def run_to_files(stream: DataFrame, folder: str, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there, keeps its state and its tables under folder/name, and returns what they say.

    Each batch's table is written as a whole under the batch's number. A run that was killed, or comes later with more rows, goes
    on from the state, and a batch that is done again replaces its own table: nothing is lost or doubled. In mode complete the
    last table holds all; in mode append all tables together do. The folder must be one that all executors share.
    """
    spark, home = stream.sparkSession, f"{folder.rstrip('/')}/{name}"

    def put(table: DataFrame, batch: int) -> None:
        table.write.mode("overwrite").parquet(f"{home}/tables/batch={batch}")

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").foreachBatch(put).trigger(availableNow=True).start()
    running.awaitTermination()
    try:
        tables = spark.read.schema(f"{_fields(stream)}, batch bigint").parquet(f"{home}/tables")
    except AnalysisException:  # not one row has ever come
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        last = tables.agg(F.max("batch")).first()[0]
        tables = tables.where(F.col("batch") == F.lit(last))
    return tables.drop("batch")


def _fields(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)


def run_to_table(stream: DataFrame, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream once, under a name of its own."""
    return run_to_files(stream, checkpoint, f"stream_{uuid.uuid4().hex[:8]}", mode)
