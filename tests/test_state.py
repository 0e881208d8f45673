"""State over time: a stream that remembers what it took, undo by kind of run, typed snapshots, a ledger with a given clock."""

import pytest
from pyspark.sql import functions as F

from gridwise.functions import values as V
from gridwise.operators import live
from gridwise.operators.ledger import Ledger
from gridwise.plans import workflows
from gridwise.sources import sinks
from gridwise.streaming import changes, folders

SCHEMA = "sheet string, sheet_row int, resident_id string, phone string"


def test_later_batches_respect_what_was_taken(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([(2, "1", "old"), (7, "2", "")], "src_row int, resident_id string, phone string").write.parquet(f"{at}/master")
    batches = [
        [("B", 2, "1", "first"), ("B", 3, "9", "new"), ("C", 2, "9", "later sheet"), ("B", 5, " ", "no id"), ("B", 6, None, "no id")],
        [("A", 2, "1", "another sheet"), ("B", 2, "1", "same row again"), ("B", 3, "9", "edited"), ("A", 4, "8", "new too"), ("A", 4, "8", "new again")],
        [],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{at}/in")
        stream = changes.edits(spark, f"{at}/in", SCHEMA)
        folders.pull_folder_stream(stream, f"{at}/master", {"phone": "phone"}, f"{at}/out", f"{at}/check", {"phone": "overwrite"}).awaitTermination(120)
    plan = spark.read.parquet(f"{at}/out/changes")
    got = sorted((r["batch"], r["identity"], r["existing"], r["incoming"]) for r in plan.collect())
    assert got == [(0, "1", "old", "first"), (1, "1", "old", "same row again"), (1, "9", "new", "edited")]
    new = sorted((r["batch"], r["src_row"], r["resident_id"], r["phone"]) for r in spark.read.parquet(f"{at}/out/new").collect())
    assert new == [(0, 8, "9", "new"), (1, 9, "8", "new again")]
    assert spark.conf.get(folders.ROCKS[0]) != folders.ROCKS[1]  # the session keeps its own store


def test_a_batch_is_taken_without_python(spark):
    batch = spark.createDataFrame([("B", 3, "1", "b"), ("B", 2, "1", "z"), ("B", 2, "1", None), ("A", 9, " 2", "edited"), ("A", 8, "2", "other row"), (None, None, "3", "n"), ("C", 1, "3", "c"), ("C", 2, " ", "no id")], SCHEMA)
    before = spark.createDataFrame([("2", "A", 9), ("4", "A", 1), ("3", None, None)], "_id string, sheet string, sheet_row int")
    got = folders.taken(batch, before)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["('A', 9, ' 2', 'edited')", "('B', 2, '1', None)", "(None, None, '3', 'n')"]
    assert len(folders.taken(batch, None).collect()) == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_a_run_is_undone_by_its_kind(spark, tmp_path):
    path, ledger = f"file://{tmp_path}/t", Ledger(spark, f"file://{tmp_path}/ledger")
    kinds = "src_row int, resident_id string, price double, tags array<string>, note string"
    rows = [(2, "1", 1.25, ["a", None], None), (3, "2", None, None, ""), (4, "3", 1e300, [], "x")]
    spark.createDataFrame(rows, kinds).write.parquet(path)
    before = spark.read.parquet(path)
    plan = live.deletes(before, spark.createDataFrame([(1, "1"), (2, "2")], "proposal_id int, identity string"))
    sinks.apply_rows(ledger, "d", before, plan, path, "resident_id", "src_row", workflow="guarded_deletes")
    ledger.record("a", 1, "audit", "succeeded")
    with pytest.raises(ValueError, match="no such run"):
        workflows.undo(ledger, "x", before, path, "resident_id", "src_row")
    with pytest.raises(ValueError, match="can't be taken back"):
        workflows.undo(ledger, "a", before, path, "resident_id", "src_row")
    ledger.record("w", 1, "guarded_writes", "succeeded")
    ledger.append("snapshots", spark.createDataFrame([("w", 1, "row_append", "1")], "run_id string, snapshot_id bigint, operation string, identity string"))
    with pytest.raises(ValueError, match="another kind"):
        workflows.undo(ledger, "w", before, path, "resident_id", "src_row")
    workflows.undo(ledger, "d", spark.read.parquet(path), path, "resident_id", "src_row")
    back = sorted((tuple(r) for r in spark.read.parquet(path).drop("src_row").collect()), key=lambda r: r[0])
    assert back == [("1", 1.25, ["a", None], None), ("2", None, None, ""), ("3", 1e300, [], "x")]


def test_cells_of_all_types_come_back(spark):
    df = spark.sql("""select cast(null as int) a, 0.1D b, cast(1.50 as decimal(10,2)) c, X'00ff' d, date '2024-02-29' e, timestamp '2024-01-01 01:02:03.000456' f, true g, map('k', null, 'l', 1) h,
      named_struct('x', cast(null as string), 'y', array(1, null)) i, ' ' j, cast(-0.0 as double) k, cast(null as array<int>) l""")
    kinds = {c: df.schema[c].dataType for c in df.columns}
    texts = df.select(*[V.encoded(F.col(c), k).alias(c) for c, k in kinds.items()])
    assert all(k == "string" for _, k in texts.dtypes)
    assert texts.select(*[V.decoded(F.col(c), k).alias(c) for c, k in kinds.items()]).first() == df.first()
    assert spark.sql("select 'x' a").select(V.decoded(F.col("a"), kinds["a"]), V.decoded(F.col("a"), kinds["e"])).first() == (None, None)


def test_a_ledger_with_a_given_clock_writes_the_same_twice(spark, tmp_path):
    seen = []
    for name in ("p", "q"):
        ledger = Ledger(spark, f"file://{tmp_path}/{name}", clock=lambda: F.lit("2024-05-06 07:08:09").cast("timestamp"))
        target = spark.createDataFrame([(2, "1", "5")], "src_row int, resident_id string, phone string")
        plan = live.deletes(target, spark.createDataFrame([(1, "1")], "proposal_id int, identity string"))
        sinks.apply_rows(ledger, "r", target, plan, f"file://{tmp_path}/t-{name}", "resident_id", "src_row")
        ledger.put("theme", "dark")
        seen.append({t: sorted(map(str, ledger.read(t).collect())) for t in ("runs", "log", "snapshots", "settings")})
    assert seen[0] == seen[1] and "2024, 5, 6, 7, 8, 9" in seen[0]["runs"][0]
