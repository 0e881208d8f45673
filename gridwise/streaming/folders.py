"""An extension: a folder of copies pulled as a stream. What each id took last is kept, so that batches add up to one pull.

An id is taken from the sheet and row that had it first; later edits of that row go through, rows of other sheets with the id
don't. Within a batch the least sheet and row come first; of repeated rows the least by all their cells.

What ids are taken from is a table beside the results, a partition a batch, and a batch is joined with it. Each batch reads the
master anyway, so a state store would save no order of work, and its operators call Python once for each id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import values as V
from ..operators import pull
from ..sources import sinks, working

# The state store of streams with values of arbitrary state; streams of this module don't need it.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def taken(batch: DataFrame, before: DataFrame | None, key: str = "resident_id") -> DataFrame:
    """The rows of a batch that their ids are taken from, one an id; ``before``: _id, sheet and sheet_row of earlier batches.

    Rows without an id are left out.
    """
    rows = batch.withColumn("_id", V.identity(F.col(key))).filter("_id <> ''")
    if before is not None:
        known = before.select("_id", F.struct("sheet", "sheet_row").alias("_from"))
        rows = rows.join(known, "_id", "left").filter(F.col("_from").isNull() | (F.struct("sheet", "sheet_row") == F.col("_from")))
    return pull.first_wins(rows.select(*batch.columns), key)


def _earlier(spark, path: str, number: int) -> DataFrame | None:
    """What batches before ``number`` have written."""
    at, fs = sinks._fs(spark, path)
    return spark.read.parquet(path).filter(F.col("batch") < number).drop("batch") if number and fs.exists(at) else None


def pull_folder_stream(edits: DataFrame, master_path: str, columns: Mapping[str, str], out: str, checkpoint: str, policies: Mapping[str, str] | None = None, default: str = "conflict", key: str = "resident_id", order: str = "src_row") -> StreamingQuery:
    """:func:`pull.pull_folder` over a stream of rows: ``out``/changes, ``out``/new and ``out``/taken, a partition a batch.

    Residents that earlier batches added count as known, and row numbers go on where these ended. A batch that runs again after
    a failure overwrites its own partitions only and doesn't see them, so results arrive once.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _earlier(spark, f"{out}/taken", number)
        rows = working.table(taken(batch, before, key), "batch")  # read several times
        first = rows.select(V.identity(F.col(key)).alias("_id"), "sheet", "sheet_row")
        first = first if before is None else first.join(before.select("_id"), "_id", "left_anti")
        first.write.mode("overwrite").parquet(f"{out}/taken/batch={number}")
        target = spark.read.parquet(master_path)
        added = _earlier(spark, f"{out}/new", number)
        if added is not None:
            target = target.unionByName(added.select(*[c for c in target.columns if c in added.columns]), allowMissingColumns=True)
        changes, new = pull.pull_folder(target, rows, columns, policies, default, key, order)
        changes.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        new.write.mode("overwrite").parquet(f"{out}/new/batch={number}")

    return edits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
