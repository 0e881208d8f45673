"""Where plans go: a table rewritten beside the old one and swapped in, rows appended with a check, named reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import fill, live
from ..operators.ledger import Ledger


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def swap(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside ``path``, then take its place; ``df`` may read from ``path``. The old table stays as .old until the next swap."""
    spark = df.sparkSession
    df.write.mode("overwrite").format(fmt).save(f"{path}.new")
    at, fs = _fs(spark, path)
    old, new = _fs(spark, f"{path}.old")[0], _fs(spark, f"{path}.new")[0]
    if fs.exists(old):
        fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    if not fs.rename(new, at):
        raise OSError(f"{path}.new could not take the place of {path}")


def append(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Append whole rows; an error if fewer arrived. Rows are counted as they are written, and again in the new files only."""
    spark = df.sparkSession
    at, fs = _fs(spark, path)
    before = set(spark.read.format(fmt).load(path).inputFiles()) if fs.exists(at) else set()
    sent = Observation()
    df.observe(sent, F.count(F.lit(1)).alias("n")).write.mode("append").format(fmt).save(path)
    expected = sent.get["n"]
    found = spark.read.format(fmt).load(path)
    new = sorted(set(found.inputFiles()) - before)
    arrived = spark.read.schema(found.schema).format(fmt).load(new).count() if new else 0
    if arrived != expected:
        raise OSError(f"{expected} rows were to be appended, {arrived} arrived")
    return expected


def report(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Each table in a folder of its name; counts that don't apply are N/A only when such a table is shown."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def publish(df: DataFrame, path: str) -> str:
    """Write ``df`` as a new version under ``path`` and make it the current one: for stores whose renames aren't atomic.

    Readers see the old version whole until the pointer, one small file, is put in its place. Old versions stay.
    """
    spark = df.sparkSession
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    at, fs = _fs(spark, f"{path}/current")
    out = fs.create(at, True)
    out.write(bytearray(version.rpartition("/")[2].encode()))
    out.close()
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version that :func:`publish` made current."""
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/current').first()[0]}")


def report_with_latest(tables: Mapping[str, DataFrame], folder: str) -> None:
    """A report kept under the time it was made, and named as the latest one."""
    at = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%fZ")
    report(tables, f"{folder}/{at}")
    any_ = next(iter(tables.values()))
    publish(any_.sparkSession.createDataFrame([(at,)], "at string"), f"{folder}/latest")


def latest_report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{current(spark, f'{folder}/latest').first()[0]}/{name}")


def capture(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Tables as JSON lines, for fixtures of tests."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def _begin(ledger: Ledger, run_id: str, workflow: str, fingerprint: str = "") -> None:
    """A run is applied once."""
    if not ledger.read("runs").filter(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} was applied already")
    ledger.claim(run_id)
    ledger.record(run_id, 1, workflow, "running", fingerprint=fingerprint)


def _end(ledger: Ledger, run_id: str, workflow: str, act: Callable[[], None], fingerprint: str = "") -> None:
    try:
        act()
    except Exception:
        ledger.record(run_id, 2, workflow, "failed", fingerprint=fingerprint)
        raise
    ledger.record(run_id, 2, workflow, "succeeded", fingerprint=fingerprint)


def apply_plan(ledger: Ledger, run_id: str, target: DataFrame, changes: DataFrame, path: str, key: str, fingerprint: str, fresh: str, by_sheet: bool | None = None, store: Callable[[DataFrame, str], object] = swap, workflow: str = "apply") -> None:
    """Store snapshots and conflicts of a plan, then write its changes.

    Refused are a stale plan, a run that was applied before, and a plan with cells that the target doesn't have. ``by_sheet``
    as in :func:`fill.apply`: False for a plan that pulls edits of copies to the master.
    """
    if fingerprint != fresh:
        raise ValueError("the data changed after the plan was made")
    if lost := fill.unapplied(target, changes, key, by_sheet).count():
        raise ValueError(f"{lost} planned cells have no row or column in the target")
    _begin(ledger, run_id, workflow, fingerprint)
    at = ledger.clock()
    by = fill._by_sheet(target, by_sheet)
    keys = [*by, "identity", "column"]
    writes = fill.winners(changes, by)
    shown = changes.filter("will_write").withColumn("identity", V.identity(F.col("identity"))).groupBy(*keys).agg(F.min_by("existing", fill._ranked(changes)).alias("existing"), F.min("sheet").alias("_sheet"))
    writes = writes.join(shown, keys)
    sheet = F.col("sheet") if by else F.lit("")
    number = F.xxhash64(*keys)
    ledger.append("snapshots", writes.select(F.lit(run_id).alias("run_id"), number.alias("snapshot_id"), F.lit("cell_update").alias("operation"), sheet.alias("sheet"), "identity", "column", F.col("existing").alias("before"), F.col("incoming").alias("after"), at.alias("at")))
    ledger.append("conflicts", changes.filter("action = 'conflict'").select(F.lit(run_id).alias("run_id"), "sheet", "identity", "column", "existing", "incoming", F.lit("open").alias("status"), F.lit(1).cast("long").alias("seq"), at.alias("at")))
    ledger.append("log", changes.select(F.lit(run_id).alias("run_id"), F.xxhash64("sheet", "identity", "column").alias("entry_id"), F.col("action").alias("type"), "identity", "column", F.col("reason").alias("message"), at.alias("at")))
    ledger.append("log", fill.losers(changes, by).select(F.lit(run_id).alias("run_id"), F.xxhash64("sheet", "identity", "column").alias("entry_id"), F.lit("skip").alias("type"), "identity", "column", F.lit("an earlier row writes this cell").alias("message"), at.alias("at")))
    _end(ledger, run_id, workflow, lambda: store(fill.apply(target, changes, key, by_sheet), path), fingerprint)


def apply_rows(ledger: Ledger, run_id: str, target: DataFrame, plan: DataFrame, path: str, key: str, order: str, store: Callable[[DataFrame, str], object] = swap, workflow: str = "rows") -> None:
    """Store snapshots of a plan of whole rows (of :func:`live.appends`, ``deletes`` or one side of ``moves``), then write it.

    Rows with the action append or move are added where the plan has ``cells``; with delete or move they go where it has ``row``.
    """
    _begin(ledger, run_id, workflow)
    at, adds = ledger.clock(), "cells" in plan.columns
    acting = plan.filter(F.col("action").isin("append", "delete", "move"))
    ledger.append("snapshots", acting.select(F.lit(run_id).alias("run_id"), F.xxhash64("identity").alias("snapshot_id"), F.lit("row_append" if adds else "row_delete").alias("operation"), F.lit("").alias("sheet"), "identity", F.col("cells" if adds else "row").alias("cells"), at.alias("at")))
    ledger.append("log", plan.select(F.lit(run_id).alias("run_id"), F.xxhash64("identity").alias("entry_id"), F.col("action").alias("type"), "identity", F.col("reason").alias("message"), at.alias("at")))
    _end(ledger, run_id, workflow, lambda: store(live.appended(target, plan, order, "identity") if adds else live.deleted(target, plan, key), path))


def apply_conflicts(ledger: Ledger, run_id: str, target: DataFrame, chosen: DataFrame, path: str, key: str, order: str, store: Callable[[DataFrame, str], object] = swap) -> DataFrame:
    """Write conflicts (run_id, sheet, identity, column, existing, incoming) that were decided for, and resolve them in the ledger.

    What became of each comes back; those whose cell was edited since stay open.
    """
    _begin(ledger, run_id, "conflicts")
    plan = live.conflicts(target, chosen, key, order)
    at = ledger.clock()
    ledger.append("log", plan.select(F.lit(run_id).alias("run_id"), F.xxhash64("sheet", "identity", "column").alias("entry_id"), F.col("action").alias("type"), "identity", "column", F.col("reason").alias("message"), at.alias("at")))
    writes = plan.filter("will_write")
    ledger.append("snapshots", writes.select(F.lit(run_id).alias("run_id"), F.xxhash64("identity", "column").alias("snapshot_id"), F.lit("cell_update").alias("operation"), F.lit("").alias("sheet"), "identity", "column", F.col("existing").alias("before"), F.col("incoming").alias("after"), at.alias("at")))
    settled = writes.select("sheet", "identity", "column", "incoming").join(chosen.select("run_id", "sheet", "identity", "column", F.col("existing").alias("was")), ["sheet", "identity", "column"])
    ledger.append("conflicts", settled.select("run_id", "sheet", "identity", "column", F.col("was").alias("existing"), "incoming", F.lit("resolved").alias("status"), F.lit(2).cast("long").alias("seq"), at.alias("at")))
    done = ledger.read("log").filter(F.col("run_id") == run_id)
    _end(ledger, run_id, "conflicts", lambda: store(fill.apply(target, plan, key, False), path))
    return done


def undo(ledger: Ledger, run_id: str, target: DataFrame, path: str, key: str, order: str, store: Callable[[DataFrame, str], object] = swap) -> DataFrame:
    """Take back what a run did, where the target still holds it; the run's log says what became of each snapshot.

    Cells get their values back (nulls, too), appended rows go, deleted rows return. Only what is really taken back counts as
    reverted. Each kind of snapshot has its own planner; ``workflows.undo`` asks first what kind of run it was.
    """
    snaps = ledger.open_snapshots(run_id)
    cells = snaps.filter("operation = 'cell_update'").select("snapshot_id", "sheet", "identity", "column", "before", "after")
    by = ["sheet"] if "sheet" in target.columns and not cells.filter("sheet <> ''").isEmpty() else []
    plan = live.revert_cells(target, cells.drop("sheet"), key, order)
    added, gone = (snaps.filter(F.col("operation") == x).select("snapshot_id", "identity", "cells") for x in ("row_append", "row_delete"))
    plans = [plan.select("snapshot_id", "identity", "column", "action", "reason"), *(f(target, x, key, order).select("snapshot_id", "identity", F.lit("").alias("column"), "action", "reason") for f, x in ((live.revert_appends, added), (live.restore_rows, gone)))]
    every = reduce(DataFrame.unionByName, plans)
    columns = [F.lit(f"undo {run_id}").alias("run_id"), F.col("snapshot_id").alias("entry_id"), F.col("action").alias("type"), "identity", "column", F.col("reason").alias("message"), ledger.clock().alias("at")]
    ledger.append("log", every.select(*columns))
    done = ledger.read("log").filter(F.col("run_id") == f"undo {run_id}")
    acted = done.filter("type in ('restore', 'delete', 'append')").select(F.col("entry_id").alias("snapshot_id"), "type")
    old = cells.join(acted.filter("type = 'restore'").select("snapshot_id"), "snapshot_id")
    out = fill.apply(target, old.select(*by, "identity", "column", F.col("before").alias("incoming"), F.lit(True).alias("will_write")), key, bool(by))
    out = live.deleted(out, acted.filter("type = 'delete'").join(added, "snapshot_id").select("identity", F.lit("delete").alias("action")), key)
    back = acted.filter("type = 'append'").join(gone, "snapshot_id").select("identity", "cells", F.lit("append").alias("action"))
    if not back.isEmpty():
        out = live.appended(out, back, order, "identity")
    store(out, path)
    ledger.append("reverts", acted.select(F.lit(run_id).alias("run_id"), "snapshot_id", ledger.clock().alias("at")))
    return done
