"""Planners on small sheets: what the rules decide in their corners, round trips and idempotence."""

import itertools

import pytest
from pyspark.sql import functions as F

from gridwise.operators import address_ids, export, fill, guard, keyed, live, pull, schema_ops, zones
from gridwise.operators import headers as H
from gridwise.operators.ledger import Ledger, upsert_conflicts
from gridwise.plans import workflows
from gridwise.sources import grids, sinks

from .test_values import model_key

SHEET = "sheet string, sheet_row int, resident_id string, phone string, damage string"


def cells(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def model_decide(target, source, policy, protected):
    rule = "never" if protected else policy if policy in guard.POLICIES else "conflict"
    if source in (None, ""):
        return "skip"
    if rule == "never":
        return "skip"
    if model_key(target) == model_key(source):
        return "equal"
    if target in (None, ""):
        return "conflict" if rule == "conflict" else "fill"
    return "overwrite" if rule == "overwrite" else "conflict"


def test_guard_truth_table(spark):
    some = [None, "", "  ", "x", "y", "1.0", "1", "TRUE"]
    cases = list(itertools.product(some, some, [*guard.POLICIES, "odd", None], [True, False]))
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, s string, p string, x boolean")
    got = df.withColumn("v", guard.decide(F.col("t"), F.col("s"), F.col("p"), F.col("x"))).orderBy("k").collect()
    assert [r["v"]["action"] for r in got] == [model_decide(*c) for c in cases]
    assert all(r["v"]["will_write"] == (r["v"]["action"] in ("fill", "overwrite")) for r in got)


def test_headers():
    fields = [H.Field("Phone", ("Cell", "Mobile")), H.Field("resident_id", identity=True), H.Field("Notes", sensitive=True)]
    got = H.bind(["Resident ID", "Cell", "Notes"], ["resident_id", "mobile", "x"], fields)
    assert got.columns == {"Cell": "mobile", "Resident ID": "resident_id"}
    assert got.policies == {"mobile": "fill_blank", "resident_id": "never"}
    assert (got.protected, got.unmatched) == (["resident_id"], ["Notes"])
    assert H.find(["b", "a"], ["a", "b"]) == 0
    assert H.find(["Lon gitude"], ["x"], lambda h: "gitude" in h) == 0
    assert H.find(["x", "y"], ["z"], fallback=1) == 1
    assert [H.column_letter(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert H.unique(["a", "", "a", "b"]) == ["a", "c1", "c2", "b"]
    assert H.add_columns(["a"], ["b", "a", "b"]) == (["a", "b"], {"b": 2})
    assert H.policy_table([["note"], ["Policy", "Column"], ["fill", "A"], ["never", "(x)"]]) == {"A": "fill"}
    assert H.mapping_lines("A -> B\nC|D\nbad") == {"A": "B", "C": "D"}
    with pytest.raises(ValueError):
        H.merge_policies({}, {}, ["id"])


def test_fill_first_wins_duplicate_targets_and_new_columns(spark):
    target = spark.createDataFrame([("A", 2, "1", "", "x"), ("A", 3, "1", "", ""), ("A", 4, None, "", ""), ("B", 2, "9", "", "")], SHEET)
    source = spark.createDataFrame([(2, "1", "555", "Y", "n"), (3, "1", "666", "Z", "m")], "src_row int, resident_id string, phone string, damage string, note string")
    plan = fill.plan(target, source, "resident_id", "resident_id", {"phone": "phone", "damage": "damage", "note": "note"}, "src_row")
    assert cells(plan, "sheet_row", "column", "incoming", "action") == [(2, "damage", "Y", "conflict"), (2, "note", "n", "fill"), (2, "phone", "555", "fill"), (3, "damage", "Y", "fill"), (3, "note", "n", "fill"), (3, "phone", "555", "fill")]
    last = fill.plan(target, source, "resident_id", "resident_id", {"phone": "phone"}, "src_row", keep="last")
    assert {r["incoming"] for r in last.collect()} == {"666"}
    assert fill.to_add(target, ["phone", "note"]) == ["note"]
    assert fill.unmatched(source, target.filter("resident_id = '9'"), "resident_id", "resident_id").count() == 2


def test_plan_of_applied_plan_is_empty(spark):
    target = spark.createDataFrame([("A", 2, "1", "", "x"), ("A", 3, "2", "7", "")], SHEET)
    source = spark.createDataFrame([(2, "1", "555", "Y"), (3, "2", "666", "Z")], "src_row int, resident_id string, phone string, damage string")
    args = ("resident_id", "resident_id", {"phone": "phone", "damage": "damage"}, "src_row", {"phone": "overwrite"})
    plan = fill.plan(target, source, *args)
    done = fill.apply(target, plan, "resident_id")
    assert fill.plan(done, source, *args).filter("will_write").count() == 0
    assert cells(done, "resident_id", "phone", "damage") == [("1", "555", "x"), ("2", "666", "Z")]


def test_mode_ties(spark):
    rows = [("A", 2, "B"), ("A", 3, "A"), ("B", 2, "x"), ("B", 3, "10"), ("B", 4, "9"), ("C", 2, ""), ("D", 2, "q"), ("D", 3, "r"), ("D", 4, "r")]
    df = spark.createDataFrame(rows, "sheet string, sheet_row int, zone string")
    assert cells(keyed.mode(df, "zone", "sheet_row"), "sheet", "zone", "n") == [("A", "B", 1), ("B", "9", 1), ("D", "r", 2)]


def test_new_residents(spark):
    m = spark.createDataFrame([(2, "1", "Ann Lee", "P1", "a@x"), (3, "2", "Bob", "P2", "")], "src_row int, resident_id string, resident_name string, apn string, email string")
    rows = [("S", 2, "n1", "ann  lee", "p-1", ""), ("S", 3, "n2", "Zed", "P9", "A@X"), ("S", 4, "n3", "New", "P3", "n@x"), ("S", 5, "n4", "new", "P3", ""), ("S", 6, "n5", "bob", "P7", ""), ("S", 7, "n6", "", "", "N@X"), ("S", 8, "n6", "", "", ""), ("S", 9, "1", "x", "", "")]
    s = spark.createDataFrame(rows, "sheet string, sheet_row int, resident_id string, resident_name string, apn string, email string")
    got = cells(pull.new_residents(m, s), "resident_id", "risk", "matched_id", "missing")
    assert got == [("n1", "likely", "1", ""), ("n2", "likely", "1", ""), ("n3", "none", "", ""), ("n4", "likely", "n3", ""), ("n5", "possible", "2", ""), ("n6", "likely", "n3", "resident_name")]


def ring(*points):
    return [[float(x), float(y)] for x, y in (*points, points[0])]


def test_points_in_polygons(spark):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10))
    shapes = [(0, "donut", [[square, ring((4, 4), (6, 4), (6, 6), (4, 6))]]), (1, "two", [[square], [ring((100, 100), (110, 100), (110, 110), (100, 110))]]), (2, "triangle", [[ring((20, 0), (30, 0), (20, 10))]]), (3, "ell", [[ring((40, 0), (50, 0), (50, 2), (42, 2), (42, 10), (40, 10))]]), (4, "none", None), (5, "empty", [])]
    z = spark.createDataFrame(shapes, f"ordinal int, zone string, geometry {zones.GEOMETRY}")
    points = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 105.0, 105.0), (4, 50.0, 50.0), (5, 0.0, 0.0), (6, 10.0, 5.0), (7, 5.0, 10.0), (8, 0.0, 5.0), (9, 22.0, 3.0), (10, 29.0, 9.0), (11, 41.0, 9.0), (12, 45.0, 5.0), (13, None, 1.0)]
    p = spark.createDataFrame(points, "k int, lon double, lat double")
    got = cells(zones.hits(p, z).select("k", F.col("z.zone").alias("zone")), "k", "zone")
    assert got == [(1, "donut"), (1, "two"), (2, "two"), (3, "two"), (5, "donut"), (5, "two"), (8, "donut"), (8, "two"), (9, "triangle"), (11, "ell")]
    assert cells(zones.first_hit(p, z, "k").select("k", "n_zones", F.col("z.zone").alias("zone")), "k", "n_zones", "zone")[0] == (1, 2, "donut")


def test_geojson(spark):
    f = ['{"geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}, "properties": {"ZoneName": "Z"}}', '{"geometry": null, "properties": {}}', '{"geometry": {"type": "Point", "coordinates": [0,0]}}']
    df = spark.createDataFrame(list(enumerate(f)), "ordinal int, feature string")
    got = zones.from_geojson(df).collect()
    assert [(r["ordinal"], r["properties"]["ZoneName"]) for r in got] == [(0, "Z")]


def test_reconcile_outcomes(spark):
    z = spark.createDataFrame([(0, "A", "Ann", [[ring((0, 0), (10, 0), (10, 10), (0, 10))]])], f"ordinal int, zone string, contact_name string, geometry {zones.GEOMETRY}")
    m = spark.createDataFrame([(2, "1", "A", 1.0, 1.0, "Ann"), (3, "2", "", 1.0, 1.0, ""), (4, "3", "B", 1.0, 1.0, ""), (5, "4", "A", 99.0, 1.0, ""), (6, "5", "A", None, 1.0, ""), (7, "", "", None, None, "")], "src_row int, resident_id string, zone string, lon double, lat double, nc string")
    rec = zones.reconcile(m, z, {"zone": "zone", "contact_name": "nc"})
    assert cells(rec, "master_row", "outcome", "contact_updates") == [(2, "match", 0), (3, "fill", 1), (4, "conflict", 1), (5, "unassigned", 0), (6, "missing_coords", 0)]
    assert cells(zones.enrichment(rec), "identity", "column", "incoming") == [("2", "contact_name", "Ann"), ("2", "zone", "A"), ("3", "contact_name", "Ann")]
    assert cells(zones.detail(rec, 2), "master_row") == [(3,), (4,)]


def test_apply_and_undo_restore_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/master"
    rows = [("M", 2, "1", "", "x"), ("M", 3, "2", "7", ""), ("M", 4, "3", "8", "z")]
    spark.createDataFrame(rows, SHEET).write.parquet(path)
    before = spark.read.parquet(path)
    kept = cells(before, "resident_id", "phone", "damage")
    source = spark.createDataFrame([(2, "1", "555", "Y"), (3, "2", "666", "Z")], "src_row int, resident_id string, phone string, damage string")
    plan = fill.plan(before, source, "resident_id", "resident_id", {"phone": "phone", "damage": "damage"}, "src_row", {"phone": "overwrite"})
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    with pytest.raises(ValueError):
        sinks.apply_plan(ledger, "r0", before, plan, path, "resident_id", "a", "b")
    sinks.apply_plan(ledger, "r1", before, plan, path, "resident_id", "a", "a")
    after = spark.read.parquet(path)
    assert cells(after, "resident_id", "phone", "damage") == [("1", "555", "x"), ("2", "666", "Z"), ("3", "8", "z")]
    assert ledger.open_snapshots("r1").count() == 3
    sinks.undo(ledger, "r1", after, path, "resident_id", "sheet_row")
    assert cells(spark.read.parquet(path), "resident_id", "phone", "damage") == kept
    assert ledger.open_snapshots("r1").count() == 0
    ledger.record("r2", 1, "x", "running")
    ledger.interrupt()
    assert {(r["run_id"], r["status"]) for r in ledger.read("runs").filter("seq = 2").collect()} == {("r1", "succeeded"), ("r2", "interrupted")}


def test_undo_order_of_checks(spark):
    target = spark.createDataFrame([("M", 2, "1", "b", ""), ("M", 3, "2", "a", ""), ("M", 4, "3", "c", ""), ("M", 5, "4", "", ""), ("M", 6, "4", "", "")], SHEET)
    snaps = spark.createDataFrame([(k, str(i), c, "a", "b") for k, (i, c) in enumerate([(1, "phone"), (2, "phone"), (3, "phone"), (4, "phone"), (5, "phone"), (1, "gone")])], "snapshot_id int, identity string, column string, before string, after string")
    assert [r["action"] for r in live.revert_cells(target, snaps, order="sheet_row").orderBy("snapshot_id").collect()] == ["restore", "skip", "conflict", "conflict", "skip", "conflict"]


def test_conflict_upsert_keeps_and_reopens(spark):
    old = spark.createDataFrame([("s", "1", "c", "a", "b", "resolved"), ("s", "2", "c", "a", "b", "open")], "sheet string, identity string, column string, existing string, incoming string, status string")
    new = spark.createDataFrame([("s", "1", "c", "a", "z"), ("s", "3", "c", "q", "w")], "sheet string, identity string, column string, existing string, incoming string")
    assert cells(upsert_conflicts(old, new), "identity", "incoming", "status", "change") == [("1", "z", "open", "updated"), ("2", "b", "open", "kept"), ("3", "w", "open", "added")]


def test_schema_operations(spark):
    df = spark.createDataFrame([("A", "x", "")], "sheet string, a string, b string")
    assert schema_ops.add_columns(df, ["c", "a"])[1] == [("c", "added", 4), ("a", "exists", 2)]
    assert [schema_ops.rename_status(["a", "b"], *x) for x in (("a", "c"), ("z", "c"), ("a", "b"), ("a", "a"))] == ["renamed", "missing", "exists", "identical"]
    with pytest.raises(ValueError):
        schema_ops.delete_columns(df, ["sheet", "a", "b"])
    with pytest.raises(ValueError):
        schema_ops.rename_status(["a"], "", "b")


def test_address_ids(spark):
    df = spark.createDataFrame([(1, "k1", ""), (2, "k1", "id9"), (3, "k2", ""), (4, "", "")], "o int, key string, address_id string")
    got = address_ids.backfill(df, "key", "address_id", "o")
    ids = {r["o"]: r["address_id"] for r in got.collect()}
    assert (ids[1], ids[2], ids[4]) == ("id9", "id9", "") and len(ids[3]) == 36
    with pytest.raises(ValueError):
        address_ids.backfill(df.unionByName(spark.createDataFrame([(5, "k2", "id9")], df.schema)), "key", "address_id", "o")


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "Z1", "Bo; ann"), (2, "Z1", "ANN;Cy"), (3, "", "x"), (4, "Z2", "")], "o int, zone string, contact string")
    found = export.manifest(df, "zone", "contact", "o")
    assert cells(found, "zone", "n_rows", "contacts", "file_name") == [("Z1", 2, "Bo, ann, Cy", "Z1 - Bo, ann, Cy"), ("Z2", 1, "", "Z2")]
    wanted = spark.createDataFrame([("Z1",), ("Z9",)], "zone string")
    assert cells(export.with_requested(found, wanted), "zone", "status") == [("Z1", "ok"), ("Z9", "No rows")]
    export.write(df.filter("zone <> ''"), "zone", f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3


def test_folder_of_sheets_keeps_errors_apart(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Resident ID,Cell,Cell,\n1,"a\nb",,z\n007,,,\n')
    (tmp_path / "A.csv").write_text("Resident ID,Cell\n5,x\n")
    (tmp_path / "c.csv").write_text("")
    whole, states, found = grids.read_folder(spark, f"file://{tmp_path}")
    assert [(r["sheet"], r["ordinal"], r["error"] == "") for r in states.orderBy("ordinal").collect()] == [("A", 0, True), ("b", 1, True), ("c", 2, False)]
    assert cells(whole, "sheet", "sheet_row", "Resident ID") == [("A", 2, "5"), ("b", 2, "1"), ("b", 3, "007")]
    assert found["b"] == ["Resident ID", "Cell", "Cell", ""]
    named = grids.rename_to_fields(whole, [H.Field("resident_id"), H.Field("phone", ("Cell",))])
    assert {"resident_id", "phone"} <= set(named.columns)


def test_workflows(spark):
    assert workflows.readiness("push_master", {})[0].state == "error"
    with pytest.raises(ValueError):
        workflows.plan("audit")
    sheets = spark.createDataFrame([("A", 2, "1", "", "x")], SHEET)
    assert workflows.plan("delete_impact", sheets=sheets, columns=["damage"]).first()["non_blank"] == 1


def test_stream_of_edits(spark, tmp_path):
    from gridwise.streaming import changes

    spark.createDataFrame([(2, "1", "")], "src_row int, resident_id string, phone string").write.parquet(f"file://{tmp_path}/master")
    schema = "sheet string, sheet_row int, resident_id string, phone string"
    spark.createDataFrame([("A", 2, "1", "555")], schema).write.parquet(f"file://{tmp_path}/in")
    stream = changes.edits(spark, f"file://{tmp_path}/in", schema)
    changes.pull_stream(stream, f"file://{tmp_path}/master", {"phone": "phone"}, f"file://{tmp_path}/out", f"file://{tmp_path}/check", {"phone": "fill_blank"}).awaitTermination(120)
    assert cells(spark.read.parquet(f"file://{tmp_path}/out"), "identity", "incoming", "action") == [("1", "555", "fill")]


def test_config_round_trip(tmp_path):
    from gridwise.plans.config import Config

    c = Config([H.Field("Phone", ("Cell",)), H.Field("id", identity=True)], {"push": {"a": "b"}}, {"push": {"b": "never"}}, ["Notes"])
    c.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == c
    assert [f.name for f in c.find("CELL")] == ["Phone"] and c.counts() == {"fields": 2, "identity": 1, "sensitive": 0, "aliases": 1}


def test_fill_reads_dates_where_a_name_says_date(spark):
    target = spark.createDataFrame([("A", 2, "1", "", "")], "sheet string, sheet_row int, resident_id string, sale_date string, note string")
    source = spark.createDataFrame([(2, "1", "45000", "45000")], "src_row int, resident_id string, sold string, note string")
    plan = fill.plan(target, source, "resident_id", "resident_id", {"sold": "sale_date", "note": "note"}, "src_row", dates=True)
    assert cells(plan, "column", "incoming") == [("note", "45000"), ("sale_date", "2023-03-15")]


def test_unmatched_verdicts_and_numbers(spark):
    m = spark.createDataFrame([(2, "R-1", "Ann"), (9, "R2", "Bob")], "src_row int, resident_id string, resident_name string")
    s = spark.createDataFrame([("A", 2, "r1", "x"), ("A", 3, "q", "bob"), ("B", 2, "z", ""), ("B", 3, "R2", "Bob")], "sheet string, sheet_row int, resident_id string, resident_name string")
    assert cells(pull.verdicts(m, s), "identity", "verdict", "matched_id") == [("q", "name under another id", "R2"), ("r1", "id in another spelling", "R-1"), ("z", "not on the master", "")]
    _, new = pull.pull_folder(m, s, {"resident_name": "resident_name"})
    assert cells(new, "src_row", "resident_id") == [(10, "r1"), (11, "q"), (12, "z")]


def test_a_pull_is_applied_and_undone_once(spark, tmp_path):
    """Through the ledger: nulls come back, padded ids are found, a run is applied once, lost cells are an error."""
    path = f"file://{tmp_path}/master"
    kinds = "src_row int, resident_id string, phone string, damage string"
    spark.createDataFrame([(2, " 1 ", None, "x"), (3, "2", "7", ""), (4, "3", "8", "z")], kinds).write.parquet(path)
    before = spark.read.parquet(path)
    sheets = spark.createDataFrame([("A", 2, "1", "555", ""), ("B", 2, "1", "556", ""), ("B", 3, "2", "666", "Z"), ("B", 4, "9", "1", "")], SHEET)
    plan = pull.pull_changes(before, sheets, {"phone": "phone", "damage": "damage"}, {"phone": "overwrite"}, "fill_blank")
    plan = spark.createDataFrame(plan.collect(), plan.schema)  # as approved: it doesn't follow the table
    assert plan.filter("will_write").count() == 4
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    sinks.apply_plan(ledger, "r1", before, plan, path, "resident_id", "a", "a", by_sheet=False)
    after = spark.read.parquet(path)
    assert cells(after, "src_row", "phone", "damage") == [(2, "555", "x"), (3, "666", "Z"), (4, "8", "z")]
    with pytest.raises(ValueError, match="already"):
        sinks.apply_plan(ledger, "r1", after, plan, path, "resident_id", "a", "a", by_sheet=False)
    lost = plan.withColumn("identity", F.when(F.col("identity") == "2", "77").otherwise(F.col("identity")))
    with pytest.raises(ValueError, match="no row or column"):
        sinks.apply_plan(ledger, "r2", after, lost, path, "resident_id", "a", "a", by_sheet=False)
    assert ledger.read("log").filter("type = 'skip' and message like 'an earlier row%'").count() == 1
    sinks.undo(ledger, "r1", after, path, "resident_id", "src_row")
    assert cells(spark.read.parquet(path), "src_row", "phone", "damage") == [(2, None, "x"), (3, "7", ""), (4, "8", "z")]
    assert ledger.open_snapshots("r1").count() == 0


def test_undo_counts_only_what_it_takes_back(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    spark.createDataFrame([("M", 2, "1", "", ""), ("M", 3, "2", "", "")], SHEET).write.parquet(path)
    source = spark.createDataFrame([(2, "1", "5"), (3, "2", "6")], "src_row int, resident_id string, phone string")
    before = spark.read.parquet(path)
    plan = fill.plan(before, source, "resident_id", "resident_id", {"phone": "phone"}, "src_row")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    sinks.apply_plan(ledger, "r", before, plan, path, "resident_id", "", "", store=sinks.publish)
    edited = sinks.current(spark, path).withColumn("phone", F.when(F.col("resident_id") == "2", "edited").otherwise(F.col("phone")))
    sinks.undo(ledger, "r", edited, path, "resident_id", "sheet_row", store=sinks.publish)
    assert cells(sinks.current(spark, path), "resident_id", "phone") == [("1", ""), ("2", "edited")]
    assert ledger.open_snapshots("r").count() == 1


def test_rows_are_moved_and_moved_back(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    shape = "sheet string, sheet_row int, resident_id string, zone string, phone string"
    spark.createDataFrame([("A", 2, "1", "A", "5"), ("A", 3, "2", "A", "6")], shape).write.parquet(a)
    spark.createDataFrame([("B", 2, "9", "B", "7")], shape).write.parquet(b)
    source, destination = spark.read.parquet(a), spark.read.parquet(b)
    ids = spark.createDataFrame([(1, "2"), (2, "2"), (3, "")], "proposal_id int, identity string")
    plan = live.moves(source, destination, ids, {"zone": "B", "sheet": "B"})
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    rows = live.deletes(source, plan.filter("action = 'move'").select("proposal_id", "identity"), order="sheet_row")
    sinks.apply_rows(ledger, "m-to", destination, plan, b, "resident_id", "sheet_row")
    sinks.apply_rows(ledger, "m-from", source, rows, a, "resident_id", "sheet_row")
    assert cells(spark.read.parquet(a), "resident_id", "sheet_row") == [("1", 2)]
    assert cells(spark.read.parquet(b), "sheet", "resident_id", "zone", "sheet_row", "phone") == [("B", "2", "B", 3, "6"), ("B", "9", "B", 2, "7")]
    sinks.undo(ledger, "m-to", spark.read.parquet(b), b, "resident_id", "sheet_row")
    sinks.undo(ledger, "m-from", spark.read.parquet(a), a, "resident_id", "sheet_row")
    assert cells(spark.read.parquet(a), "resident_id", "phone") == [("1", "5"), ("2", "6")]
    assert cells(spark.read.parquet(b), "resident_id") == [("9",)]
    assert ledger.open_snapshots("m-to").count() == ledger.open_snapshots("m-from").count() == 0


def test_conflicts_are_applied_and_resolved(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    path = f"file://{tmp_path}/master"
    spark.createDataFrame([(2, "1", "5"), (3, "2", "6")], "src_row int, resident_id string, phone string").write.parquet(path)
    logged = spark.createDataFrame([("r", "s", "1", "phone", "5", "55", "open", 1), ("r", "s", "2", "phone", "old", "66", "open", 1), ("r", "s", "3", "phone", "", "77", "open", 1)], "run_id string, sheet string, identity string, column string, existing string, incoming string, status string, seq bigint")
    ledger.append("conflicts", logged)
    done = sinks.apply_conflicts(ledger, "c1", spark.read.parquet(path), ledger.open_conflicts(), path, "resident_id", "src_row")
    assert cells(done, "identity", "type") == [("1", "overwrite"), ("2", "conflict"), ("3", "skip")]
    assert cells(spark.read.parquet(path), "resident_id", "phone") == [("1", "55"), ("2", "6")]
    assert cells(ledger.open_conflicts(), "identity") == [("2",), ("3",)]
    ledger.resolve(ledger.open_conflicts().filter("identity = '3'"), "dismissed")
    assert cells(ledger.open_conflicts(), "identity") == [("2",)]
    sinks.undo(ledger, "c1", spark.read.parquet(path), path, "resident_id", "src_row")
    assert cells(spark.read.parquet(path), "resident_id", "phone") == [("1", "5"), ("2", "6")]


def test_settings_and_reports(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.seed({"a": "1", "b": "2"}) and not ledger.seed({"c": "3"})
    ledger.put("a", "9")
    ledger.put("b", None)
    assert cells(ledger.settings(), "name", "value") == [("a", "9")]
    folder = f"file://{tmp_path}/reports"
    for n in (1, 2):
        sinks.report_with_latest({"overview": spark.range(n)}, folder)
    assert sinks.latest_report(spark, folder, "overview").count() == 2
    sinks.capture({"x": spark.range(3)}, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json/x").count() == 3
    for name in ("b", "A"):
        (tmp_path / "sheets").mkdir(exist_ok=True)
        (tmp_path / "sheets" / f"{name}.csv").write_text("h\n1\n")
    sheets = f"file://{tmp_path}/sheets"
    assert grids.choose(spark, sheets)[0] == "A" and grids.choose(spark, sheets, " b ")[0] == "b"
    with pytest.raises(ValueError):
        grids.choose(spark, sheets, "c")
    assert [(r["sheet"], r["bytes"]) for r in grids.metadata(spark, sheets).orderBy("ordinal").collect()] == [("A", 4), ("b", 4)]


def test_headers_of_zones_and_settings_of_fields():
    fields = [H.Field("Latitude", ("lat",)), H.Field("NC Name", ("Captain",)), H.Field("resident_id")]
    assert H.zone_fields(["Resident ID", "LAT", "captain", "Phone"], fields) == {"lat": "LAT", "lon": None, "zone": None, "contact_name": "captain", "contact_phone": None, "contact_email": None, "id": "Resident ID", "name": None}
    assert H.schema_names([("a", "b"), ("c", ""), ("x", "b"), ("", "")]) == ["b", "c"]
    from gridwise.operators import impact
    from gridwise.plans.config import Config

    c = Config([H.Field("b"), H.Field("A")], {"w": {"b": "x"}}, {"w": {"b": "never"}}, ["b"])
    c.put(H.Field("b", ("bee",)))
    assert [f.name for f in c.alphabetical()] == ["A", "b"] and c.fields[0].aliases == ("bee",)
    assert c.remove("b") and not c.remove("b") and c.mappings == {"w": {}} and c.sensitive == []
    assert impact.sentence({"filled": 1200, "conflicts": 1, "skipped": 0}, {"filled": "cell", "conflicts": "conflict", "skipped": "skip"}) == "1,200 cells and 1 conflict"
    assert impact.listed([]) == "nothing" and impact.listed(["a", "b", "c"]) == "a, b and c"


def test_readiness_reads_headers(spark):
    m = spark.createDataFrame([("1", "z")], "resident_id string, zone string")
    assert [c.message for c in workflows.readiness("push_missing", {"master": m, "sheets": m.drop("zone")})] == ["sheets lacks zone"]
    got = workflows.readiness("import_feed", {"target": m, "source": m, "columns": {"zone": "new", "gone": "zone"}, "source_key": "resident_id", "target_key": "nothing"})
    assert [(c.state, c.message) for c in got] == [("error", "target lacks nothing"), ("error", "source lacks mapped columns: gone"), ("warning", "target gets new columns: new")]
    assert workflows.readiness("pull_to_master", {"master": m, "sheets": m, "columns": {"zone": "zone"}})[0].state == "ok"


def test_a_grid_cell_follows_the_zones(spark):
    z = spark.createDataFrame([(0, "A", [[ring((0, 0), (1e6, 0), (1e6, 1e6), (0, 1e6))]]), (1, "B", [[ring((1e6, 0), (2e6, 0), (2e6, 1e6), (1e6, 1e6))]])], f"ordinal int, zone string, geometry {zones.GEOMETRY}")
    assert zones.cell_of(zones.with_box(z)) == 5e5
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.5e6, 10.0), (3, 3e6, 1.0)], "k int, lon double, lat double")
    assert cells(zones.first_hit(p, z, "k").select("k", "z.zone"), "k", "zone") == [(1, "A"), (2, "B")]
