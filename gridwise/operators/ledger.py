"""The ledger: runs, log, snapshots and conflicts as append-only event tables, and the queries over them.

Events are Parquet folders; the state of a run, snapshot or conflict is what its latest event says. A snapshot is stored
before its target changes, so an interrupted run can always be undone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A run's states, and those that end it.
STATES = ("queued", "running", "succeeded", "failed", "interrupted")
ENDED = ("succeeded", "failed", "interrupted")

SCHEMAS = {
    "runs": "run_id string, seq bigint, workflow string, status string, dry boolean, fingerprint string, at timestamp",
    "log": "run_id string, entry_id bigint, type string, identity string, column string, message string, at timestamp",
    "snapshots": "run_id string, snapshot_id bigint, operation string, sheet string, identity string, column string, before string, after string, cells map<string,string>, at timestamp",
    "reverts": "run_id string, snapshot_id bigint, at timestamp",
    "settings": "name string, value string, seq bigint, at timestamp",
    "conflicts": "run_id string, sheet string, identity string, column string, existing string, incoming string, status string, seq bigint, at timestamp",
}


@dataclass
class Ledger:
    """The event tables under ``path``. ``clock`` gives the time that events carry; a literal makes runs that can be compared."""

    spark: SparkSession
    path: str
    clock: Callable[[], Column] = F.current_timestamp

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}") if self._has(table) else self.spark.createDataFrame([], SCHEMAS[table])

    def append(self, table: str, rows: DataFrame) -> None:
        names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[table]).schema]
        rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in names]).to(self.spark.createDataFrame([], SCHEMAS[table]).schema).write.mode("append").parquet(f"{self.path}/{table}")

    def _has(self, table: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def record(self, run_id: str, seq: int, workflow: str, status: str, dry: bool = False, fingerprint: str = "") -> None:
        if status not in STATES:
            raise ValueError(f"no such state: {status}")
        row = self.spark.createDataFrame([(run_id, seq, workflow, status, dry, fingerprint)], "run_id string, seq bigint, workflow string, status string, dry boolean, fingerprint string")
        self.append("runs", row.withColumn("at", self.clock()))

    def claim(self, run_id: str) -> None:
        """Take a run for this caller: a file of its name is made, which only one of several callers can do."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/{hashlib.sha256(run_id.encode()).hexdigest()}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            out = fs.create(where, False)
        except Exception as e:
            if fs.exists(where):
                raise ValueError(f"run {run_id} was applied already") from e
            raise
        out.write(bytearray(run_id.encode()))
        out.close()

    def interrupt(self) -> None:
        """After a restart, runs that hadn't ended are interrupted."""
        open_ = latest(self.read("runs"), "run_id").filter(~F.col("status").isin(*ENDED))
        self.append("runs", open_.withColumns({"status": F.lit("interrupted"), "seq": F.col("seq") + 1, "at": self.clock()}))

    def open_snapshots(self, run_id: str) -> DataFrame:
        """Snapshots of a run that no revert names."""
        mine = self.read("snapshots").filter(F.col("run_id") == run_id)
        return mine.join(self.read("reverts").select("run_id", "snapshot_id"), ["run_id", "snapshot_id"], "left_anti")


    def put(self, name: str, value: str | None) -> None:
        """Set one setting; a null takes it away."""
        seq = (self.read("settings").filter(F.col("name") == name).agg(F.max("seq")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(name, value, seq)], "name string, value string, seq bigint")
        self.append("settings", row.withColumn("at", self.clock()))

    def settings(self) -> DataFrame:
        return latest(self.read("settings"), "name").filter("value is not null").select("name", "value")

    def seed(self, values: dict[str, str]) -> bool:
        """Settings of a new project; nothing is done where there are some already."""
        if not values or not self.read("settings").isEmpty():
            return False
        rows = [(k, v, 1) for k, v in values.items()]
        self.append("settings", self.spark.createDataFrame(rows, "name string, value string, seq bigint").withColumn("at", self.clock()))
        return True

    def resolve(self, conflicts: DataFrame, status: str = "resolved") -> None:
        """A new state for conflicts (run_id, sheet, identity, column), whatever they were."""
        known = latest(self.read("conflicts"), "run_id", "sheet", "identity", "column")
        chosen = known.join(conflicts.select("run_id", "sheet", "identity", "column").distinct(), ["run_id", "sheet", "identity", "column"], "left_semi")
        self.append("conflicts", chosen.withColumns({"status": F.lit(status), "seq": F.col("seq") + 1, "at": self.clock()}))

    def open_conflicts(self) -> DataFrame:
        return latest(self.read("conflicts"), "run_id", "sheet", "identity", "column").filter("status = 'open'")


def without_runs(table: DataFrame, gone: DataFrame, detach: bool = False) -> DataFrame:
    """A table after runs were deleted: their rows go too, or (``detach``) stay without a run."""
    ids = gone.select(F.col("run_id").alias("_gone")).distinct()
    if not detach:
        return table.join(ids, F.col("run_id") == F.col("_gone"), "left_anti")
    return table.join(ids, F.col("run_id") == F.col("_gone"), "left").withColumn("run_id", F.when(F.col("_gone").isNull(), F.col("run_id"))).drop("_gone")


def with_children(parents: DataFrame, children: DataFrame, key: str, parent_key: str, fields: list[str], name: str = "children") -> DataFrame:
    """Parents with their children as an ordered list of ``fields``: one join, not a lookup for each parent."""
    lists = children.groupBy(F.col(parent_key).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = parents.join(lists, F.col(key) == F.col("_parent"), "left").drop("_parent")
    return out.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def next_position(rows: DataFrame, column: str = "sort_order") -> DataFrame:
    """One row: the place after the last one (0 if there is none)."""
    return rows.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).cast("long").alias("next"))


def first_of_each(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """At most ``most`` rows of each group; tasks send on no more than that of each."""
    from pyspark.sql.window import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def latest(events: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The last event of each key."""
    rank = F.struct(order, *[c for c in events.columns if c != order and c not in keys])
    return events.groupBy(*keys).agg(F.max(rank).alias("r")).select(*keys, "r.*").select(*events.columns)


def type_counts(log: DataFrame, run: str = "run_id", kind: str = "entry_type") -> DataFrame:
    return log.groupBy(run, kind).agg(F.count("*").alias("n"))


def page(log: DataFrame, order: list, limit: int = 500, offset: int = 0, most: int = 5000) -> DataFrame:
    """One page of a log: at most ``most`` rows."""
    return log.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), most))


def snapshot_counts(snapshots: DataFrame, reverts: DataFrame) -> DataFrame:
    """run_id, n, cells, rows, remaining: snapshots of each run, and those not yet reverted."""
    done = reverts.select("run_id", "snapshot_id").distinct().withColumn("done", F.lit(1))
    return snapshots.join(done, ["run_id", "snapshot_id"], "left").groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("operation") == "cell_update").alias("cells"), F.count_if(F.col("operation") != "cell_update").alias("rows"), F.count_if(F.col("done").isNull()).alias("remaining")
    )


def runs_with_counts(runs: DataFrame, log: DataFrame, run: str = "run_id", kind: str = "entry_type", kinds: tuple[str, ...] = ("write", "conflict", "skip", "error")) -> DataFrame:
    """Each run with how many log entries of each type it has, by one conditional aggregate."""
    counts = log.groupBy(run).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_entries"))
    out = runs.join(counts, run, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts.columns if c != run})


def conflicts_of(conflicts: DataFrame, runs: DataFrame, columns: list[str]) -> DataFrame:
    """Conflicts with their runs' columns."""
    return conflicts.join(runs.select("run_id", *columns), "run_id")


def upsert_conflicts(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("sheet", "identity", "column")) -> DataFrame:
    """Open conflicts after a run: known ones take the new values and are open again, new ones are added, others stay."""
    a, b = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o")), new.select(*keys, F.struct("existing", "incoming").alias("n"))
    both = a.join(b, list(keys), "full")
    fresh = F.col("n").isNotNull()
    state = F.when(F.col("o").isNull(), "added").when(fresh, "updated").otherwise("kept")
    return both.select(*keys, F.when(fresh, F.col("n.existing")).otherwise(F.col("o.existing")).alias("existing"), F.when(fresh, F.col("n.incoming")).otherwise(F.col("o.incoming")).alias("incoming"), F.when(fresh, "open").otherwise(F.col("o.status")).alias("status"), state.alias("change"))
