"""Results of long sweeps as a table on the shared folder: committed in batches, read back under their identity."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import signature


class ResultTable:
    """Rows by place, each with the signature of the configuration that made it.

    A batch is written as rows first and as a marker after that, both by Spark, so that nothing lies on the driver's disk. Only
    rows whose batch has its marker count: a run that is killed in between leaves rows that nobody sees, and makes them again. A
    place that was committed is never run again with the same identity, and another identity there is refused.
    """

    ROWS = "group string, place string, signature string, batch string, row string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], self.ROWS).write.mode("ignore").partitionBy("group").parquet(f"{self.path}/rows")
        spark.createDataFrame([], "batch string").write.mode("ignore").parquet(f"{self.path}/batches")

    def committed(self) -> DataFrame:
        """group, place, signature, batch, row (JSON); of a place that two runs committed side by side, the first batch by name."""
        batches = self.spark.read.schema("batch string").parquet(f"{self.path}/batches")
        rows = self.spark.read.schema(self.ROWS).parquet(f"{self.path}/rows").join(batches, "batch", "left_semi")
        first = F.min_by(F.struct("group", "signature", "batch", "row"), "batch").alias("x")
        return rows.groupBy("place").agg(first).select("x.group", "place", "x.signature", "x.batch", "x.row")

    def reuse(self, identities: Mapping[str, Mapping]) -> dict[str, dict]:
        """The committed rows of these places (identity by place). A place that holds another identity is an error."""
        wanted = self.spark.createDataFrame([(p, signature(i)) for p, i in identities.items()], "place string, wanted string")
        found = self.committed().join(wanted, "place").collect()  # a row for each place that was asked for
        if wrong := sorted(r["place"] for r in found if r["signature"] != r["wanted"]):
            raise ValueError(f"{wrong[0]} holds a result of another configuration")
        return {r["place"]: json.loads(r["row"]) for r in found}

    def commit(self, rows: Sequence[tuple[str, str, Mapping, Mapping]]) -> str:
        """Writes rows (group, place, identity, row) as one batch, and then its marker."""
        batch = uuid.uuid4().hex
        held = [(group, place, signature(identity), batch, json.dumps(dict(row))) for group, place, identity, row in rows]
        self._write(held)
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return batch

    def _write(self, held: list[tuple]) -> None:
        self.spark.createDataFrame(held, self.ROWS).coalesce(1).write.mode("append").partitionBy("group").parquet(f"{self.path}/rows")
