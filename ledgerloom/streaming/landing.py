"""A landing folder as a stream: each micro-batch of page rows runs through the engine. An extension, no parity claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import GENERIC, Profile
from ..plans import engine

PAGE_ROWS = "doc_id string, page_no int, table_no int, row_no int, cells array<string>, top double, bottom double, page_height double, kind string, confs array<double>"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, profile: Profile = GENERIC) -> StreamingQuery:
    """Documents arrive whole, one JSON-lines file each; checks and typed cells are appended, a batch at most once each."""

    def handle(batch: DataFrame, epoch: int) -> None:
        result = engine.run(batch, profile)
        try:
            # by epoch, so that a repeated batch overwrites its own output
            result.checks.write.mode("overwrite").parquet(f"{out}/checks/epoch={epoch}")
            result.cells.drop("flags").write.mode("overwrite").parquet(f"{out}/cells/epoch={epoch}")
        finally:
            result.close()  # a long stream keeps nothing of its batches

    rows = spark.readStream.schema(PAGE_ROWS).json(folder)
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
