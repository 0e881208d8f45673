"""An extension: copies' edits as a stream of rows, planned against the master batch by batch with the batch operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import pull


def pull_stream(edits: DataFrame, master_path: str, columns: Mapping[str, str], out: str, checkpoint: str, policies: Mapping[str, str] | None = None) -> StreamingQuery:
    """Plan each batch of edits (sheet, sheet_row, resident_id, cells) and append the changes, with their batch, to ``out``.

    A batch that is planned again after a failure overwrites its own partition, so changes arrive once.
    """

    def each(batch: DataFrame, number: int) -> None:
        master = batch.sparkSession.read.parquet(master_path)
        pull.pull_changes(master, batch, columns, policies).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return edits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edits(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
