"""What has to hold over many parts, zones of all sizes, polygons of many vertices, and folders with broken files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridwise.operators import export, live, pull, zones
from gridwise.sources import grids, json_grids, sinks, working
from gridwise.operators.ledger import Ledger


@pytest.fixture(params=["64m", "1m"])
def small_parts(spark, request):
    """Many shuffle partitions, which adaptive execution joins to parts of the given size."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def gapless(df, column, first, n):
    got = df.agg(F.count("*"), F.countDistinct(column), F.min(column), F.max(column)).first()
    assert tuple(got) == (n, n, first, first + n - 1)


def test_numbers_over_many_parts_are_gapless_and_in_order(spark, small_parts):
    n = 1_200_000
    new = spark.range(n).select(F.concat(F.lit("s"), F.col("id") % 7).alias("sheet"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("sheet_row"), "id", F.repeat(F.lit("x"), 20).alias("text"))
    target = spark.createDataFrame([(41,)], "src_row int")
    got = pull.numbered(new, target, "src_row")
    path = f"{working.root(spark)}/numbered-test-{small_parts}"
    got.write.mode("overwrite").parquet(path)
    read = spark.read.parquet(path)
    gapless(read, "src_row", 42, n)
    assert read.select("id").distinct().count() == n
    both = read.select("sheet", "sheet_row", "src_row")
    out_of_order = both.groupBy("sheet").agg(F.min("src_row").alias("a"), F.max("src_row").alias("b"), F.count("*").alias("n")).filter("b - a + 1 <> n").count()
    assert out_of_order == 0  # a sheet's rows follow one another
    halves = both.withColumn("late", F.col("sheet_row") >= 1 << 39).groupBy("sheet", "late").agg(F.min("src_row").alias("a"), F.max("src_row").alias("b")).groupBy("sheet").pivot("late", [False, True]).agg(F.min("a"), F.max("b"))
    assert all(r["false_max(b)"] < r["true_min(a)"] for r in halves.collect())
    if small_parts == "1m":
        assert pull.numbered(new, target, "src_row").select(F.spark_partition_id()).distinct().count() > 1


def test_rows_appended_and_undone_over_many_parts(spark, small_parts):
    n = 200_000
    target = spark.range(10).select((F.col("id") + 2).cast("int").alias("src_row"), F.concat(F.lit("T"), "id").alias("resident_id"), F.lit("old").alias("phone"))
    plan = spark.range(n).select(F.col("id").alias("proposal_id"), F.concat(F.lit("R"), "id").alias("identity"), F.create_map(F.lit("resident_id"), F.concat(F.lit("R"), "id"), F.lit("phone"), F.lit("new")).alias("cells"), F.lit("append").alias("action"))
    got = live.appended(target, plan)
    gapless(got, "src_row", 2, n + 10)
    # Deleted rows come back by an undo.
    path = f"{working.root(spark)}/undone-{small_parts}"
    whole = working.table(got, "whole")
    sinks.swap(whole, path)
    ledger = Ledger(spark, f"{working.root(spark)}/ledger-{small_parts}")
    gone = plan.select(F.lit("delete").alias("action"), "identity")
    sinks.apply_rows(ledger, "gone", whole, live.deletes(whole, plan.select("proposal_id", "identity")), path, "resident_id", "src_row")
    left = spark.read.parquet(path)
    assert left.count() == 10 and gone.count() == n
    sinks.undo(ledger, "gone", left, path, "resident_id", "src_row")
    gapless(spark.read.parquet(path), "src_row", 2, n + 10)
    assert spark.read.parquet(path).filter("phone = 'new'").select("resident_id").distinct().count() == n


def box(x0, y0, x1, y1):
    return [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]


def test_a_box_lies_in_four_cells_at_most(spark):
    r = random.Random(1)
    shapes = [(k, x := r.uniform(-9, 9), y := r.uniform(-9, 9), x + 10 ** r.uniform(-4, 4), y + 10 ** r.uniform(-4, 4)) for k in range(300)] + [(300, 2.0, 2.0, 2.0, 2.0), (301, -1e6, -1e6, 1e6, 1e6)]
    z = spark.createDataFrame([(k, [box(*b)]) for k, *b in shapes], f"ordinal int, geometry {zones.GEOMETRY}")
    per = zones.cells(zones.with_level(zones.with_box(z))).groupBy("ordinal").count()
    assert per.count() == 302 and per.agg(F.max("count")).first()[0] <= 4
    points = [(k, r.uniform(-12, 12), r.uniform(-12, 12)) for k in range(400)] + [(400, 2.0, 2.0), (401, None, 1.0)]
    p = spark.createDataFrame(points, "k int, lon double, lat double")
    expected = {(k, o) for k, x, y in points if x is not None for o, x0, y0, x1, y1 in shapes if x0 <= x < x1 and y0 <= y < y1}
    for cell in (None, 0.5):
        got = zones.hits(p, z, cell=cell).select("k", "z.ordinal").collect()
        assert {tuple(x) for x in got} == expected and len(got) == len(expected)


def test_no_zones_no_hits(spark):
    z = spark.createDataFrame([], f"ordinal int, geometry {zones.GEOMETRY}")
    p = spark.createDataFrame([(1, 1.0, 1.0)], "k int, lon double, lat double")
    assert zones.hits(p, z).collect() == [] and zones.hits(p, zones.prepared(z)).collect() == []


def test_indexed_edges_say_what_the_plain_ray_cast_says(spark):
    r = random.Random(2)

    def star(n, x, y, size):
        out = [[x + size * r.uniform(0.3, 1) * (1 if k % 4 in (0, 3) else -1), y + size * r.uniform(0.3, 1) * (1 if k % 4 < 2 else -1)] for k in range(n)]
        return [*out, out[0]] if n % 2 else out

    shapes = [[[star(r.choice([3, 4, 9, 40, 200]), r.uniform(0, 10), r.uniform(0, 10), 3), *[star(5, 5, 5, 1) for _ in range(r.randint(0, 2))]] for _ in range(r.randint(1, 3))] for _ in range(25)]
    shapes += [[box(1.0, 1.0, 4.0, 4.0)], [[*box(0.0, 0.0, 8.0, 8.0), *box(2.0, 2.0, 4.0, 4.0)]], [[[[3.0, 3.0], [5.0, 3.0]]]], [], [[]]]
    z = spark.createDataFrame([(k, s) for k, s in enumerate(shapes)], f"ordinal int, geometry {zones.GEOMETRY}")
    p = spark.createDataFrame([(k, r.choice([r.uniform(-1, 12), float(r.randint(0, 8))]), r.choice([r.uniform(-1, 12), float(r.randint(0, 8))])) for k in range(500)], "k int, lon double, lat double")
    plain, indexed = ({tuple(x) for x in zones.hits(p, q).select("k", "z.ordinal").collect()} for q in (z, zones.prepared(z)))
    assert plain == indexed and len(plain) > 500
    sizes = zones.prepared(z).select(F.size(F.flatten("strips")).alias("held"), F.size(F.flatten(F.flatten("geometry"))).alias("edges")).filter("held > 0").collect()
    assert all(x["held"] <= 2 * x["edges"] for x in sizes)


def test_json_grids(spark, tmp_path):
    good = {"tab": "b", "values": [["Id", " Name ", "", "Id"], [7, "x", None, "again"], ["007"], [], [1.50, True, {"a": 1}, "é\n"]]}
    files = {"1.json": good, "2.json": {"values": [["Id"], ["z"]]}, "3.json": {"tab": "b", "values": [["Id"], ["late"]]}, "4.json": {"tab": "e", "values": []}, "5.json": {"tab": "f", "values": [[" ", None]]}, "6.json": {"tab": "A", "values": [["Other"]]}}
    for name, x in files.items():
        (tmp_path / name).write_text(json.dumps(x))
    (tmp_path / "7.json").write_text('{"tab": "g", "values": [["Id"')
    (tmp_path / "8.json").write_text("")
    (tmp_path / "9.json").write_text('{"tab": "h", "values": 5}')
    found, states, heads = json_grids.read_folder(spark, f"file://{tmp_path}")
    assert heads == {"2": ["Id"], "A": ["Other"], "b": ["Id", "Name", "c2", "c3"]} and list(heads) == ["2", "A", "b"]
    got = {(r["sheet"], r["sheet_row"]): (r["Id"], r["Name"], r["c2"], r["c3"], r["Other"]) for r in found.collect()}
    assert got == {("2", 2): ("z", None, None, None, None), ("b", 2): ("7", "x", "", "again", None), ("b", 3): ("007", "", "", "", None), ("b", 4): ("", "", "", "", None), ("b", 5): ("1.5", "true", '{"a":1}', "é\n", None)}
    errors = {r["path"].rsplit("/", 1)[1]: (r["error"], r["data_rows"]) for r in states.collect()}
    assert errors["1.json"] == ("", 4) and errors["6.json"] == ("", 0) and errors["3.json"] == (json_grids.REPEATED, None)
    assert [errors[f"{k}.json"][0] for k in (4, 5, 7)] == [json_grids.NO_VALUES, json_grids.NO_HEADER, json_grids.NOT_JSON]
    assert len(errors) == 9 and all(errors[f"{k}.json"][0] for k in (8, 9))
    plan = json_grids.rows(json_grids.parsed(spark, f"file://{tmp_path}"), ["Name"]).select("sheet", "Name")._jdf.queryExecution().executedPlan().toString()
    assert "value#" not in plan  # texts are parsed once, into the working table


def test_grids_written_and_read(spark, tmp_path):
    rows = [("s1", 2, "a", 'q"1"'), ("s1", 3, None, "x\ny"), ("s 2", 2, "é", "")]
    json_grids.write_folder(spark.createDataFrame(rows, "sheet string, sheet_row int, id string, text string"), f"file://{tmp_path}/out", ["id", "text"])
    back = json_grids.read_folder(spark, f"file://{tmp_path}/out")[0]
    assert sorted(tuple(r) for r in back.select("sheet", "sheet_row", "id", "text").collect()) == sorted((s, k, i or "", t) for s, k, i, t in rows)


def test_an_append_evaluates_its_plan_once_and_counts_what_arrived(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            calls.add(batch.num_rows)
            yield batch

    df = spark.range(1000).mapInArrow(count, "id bigint")
    path = f"file://{tmp_path}/t"
    assert sinks.append(df, path) == 1000 and calls.value == 1000
    assert sinks.append(df.filter("id < 10"), path) == 10 and spark.read.parquet(path).count() == 1010
    assert sinks.append(df.filter("id < 0"), path) == 0


def test_a_run_is_claimed_by_one_caller(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    ledger.claim("r/1 ä")
    with pytest.raises(ValueError, match="applied already"):
        Ledger(spark, f"file://{tmp_path}/ledger").claim("r/1 ä")
    ledger.claim("r2")


def test_a_large_zone_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(300_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("z"), F.col("id") % 7)).otherwise("hot").alias("zone"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        export.write(rows, "zone", f"file://{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    got = {r["zone"]: (r["n_rows"], r["n_files"]) for r in export.written(spark, "zone", f"file://{tmp_path}/out").collect()}
    assert got["hot"][0] == 270_000 and got["hot"][1] > 3 and sum(n for n, _ in got.values()) == 300_000


def test_rows_of_a_table_are_numbered_by_file(spark, tmp_path):
    spark.range(5000).repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(f"file://{tmp_path}/grid")
    got = grids.read(spark, f"file://{tmp_path}/grid", "parquet", "s").collect()
    assert [r["sheet_row"] for r in sorted(got, key=lambda r: int(r["id"]))] == list(range(2, 5002)) and got[0].asDict().keys() == {"sheet", "sheet_row", "id"}


def test_a_multiset_fingerprint_tells_what_changed(spark):
    rows = [("a", "c", "1", True), ("b", "c", "2", True), ("b", "d", None, True), ("x", "y", "z", False)]
    schema = "identity string, column string, incoming string, will_write boolean"

    def of(rows, n=2):
        return tuple(pull.multiset_fingerprint(spark.createDataFrame(rows, schema).repartition(n)).first())

    whole = of(rows)
    assert whole == of(rows[::-1], 3) == of(rows[:3], 1) and whole[0] == 3
    changed = [[("a", "c", "3", True), *rows[1:]], [*rows, ("a", "c", "1", True)], rows[1:], [*rows, ("n", "c", "1", True)]]
    assert len({whole, *map(of, changed)}) == 5 and of([])[0] == 0


def test_moves_between_all_sheets_of_a_folder(spark):
    z = spark.createDataFrame([(i, name, f"c{name}", float(i)) for i, name in enumerate("ABC")], "ordinal int, zone string, contact_name string, x0 double")
    z = z.select("ordinal", "zone", "contact_name", F.array(F.array(zones.box(F.col("x0"), F.lit(0.0), F.col("x0") + 1, F.lit(1.0)))).alias("geometry"))
    master = spark.createDataFrame([(2, "1", 0.5, 0.5), (3, "2", 1.5, 0.5), (4, "3", 2.5, 0.5), (5, "4", 9.0, 9.0), (6, "2", 0.5, 0.5), (7, "6", None, 0.5)], "src_row int, resident_id string, lon double, lat double")
    rows = [("s1", 2, "1", "A", 1.5), ("s1", 3, "2", "A", None), ("s1", 4, "3", "A", None), ("s1", 5, "4", "", None), ("s2", 2, "5", "B", 0.5), ("s2", 3, "6", "B", 0.5), ("s0", 2, "1", "B", None), ("s9", 2, "2", "", None), ("s2", 4, " ", "B", 0.5)]
    sheets = spark.createDataFrame(rows, "sheet string, sheet_row int, resident_id string, zone string, lon double").withColumn("lat", F.lit(0.5))
    out = zones.folder_moves(sheets, master, z)
    got = {(r.sheet, r.sheet_row): (r.action, r.reason, r.from_zone, r.destination, r.contact_name) for r in out.collect()}
    assert got == {
        ("s1", 3): ("move", "", "A", "s0", "cB"),  # the first of the two sheets of B; the id's first row on the master counts
        ("s1", 4): ("skip", "no sheet of this zone", "A", "", ""),
        ("s1", 5): ("skip", "in no zone", "A", "", ""),
        ("s2", 2): ("move", "", "B", "s1", "cA"),  # by its own coordinates
        ("s2", 3): ("skip", "no coordinates", "B", "", ""),  # the master's count where it has the id
        ("s0", 2): ("move", "", "B", "s1", "cA"),
        ("s9", 2): ("skip", "sheet without a zone", "", "", ""),
    }
    assert {(r.sheet, r.destination, r.reason): r.n for r in zones.move_totals(out).collect()}["s0", "s1", ""] == 1
    assert zones.folder_moves(sheets.limit(0), master, z).count() == 0


def test_places_and_shapes_are_looked_up_once(spark, monkeypatch):
    shapes = [(k, [box(0.0, 0.0, 1.0 + k % 2, 2.0)], f"Z{k}") for k in range(9, 49)] + [(3, [box(5.0, 5.0, 6.0, 6.0)], "far")]
    z = spark.createDataFrame([(k, [s], name) for k, (s,), name in shapes], f"ordinal int, geometry {zones.GEOMETRY}, zone string")
    p = spark.range(3000).select("id", (F.col("id") % 4 * 0.5).alias("lon"), F.when(F.col("id") % 5 > 0, 1.0).alias("lat"))
    asked, hits = [], zones.hits
    monkeypatch.setattr(zones, "hits", lambda points, shapes, *more: asked.append((points.count(), shapes.count())) or hits(points, shapes, *more))
    found = zones.first_hit(p, z, "id")
    assert asked == [(8, 3)]  # not 3,000 points and 41 zones
    got = {(r["id"], r["n_zones"], r["z"]["ordinal"], r["z"]["zone"]) for r in found.collect()}
    assert got == {(k, 40 if k % 4 < 2 else 20, 9, "Z9") for k in range(3000) if k % 5}


def test_edges_as_rows_say_what_the_plain_ray_cast_says(spark):
    r = random.Random(4)
    ring = lambda n, x, y, size: [[x + size * r.uniform(0.3, 1) * (1 if k % 4 in (0, 3) else -1), y + size * r.uniform(0.3, 1) * (1 if k % 4 < 2 else -1)] for k in range(n)]
    shapes = [[[ring(r.choice([3, 4, 40, 200]), r.uniform(0, 10), r.uniform(0, 10), 3), *[ring(5, 5, 5, 1) for _ in range(r.randint(0, 2))]] for _ in range(r.randint(1, 3))] for _ in range(15)]
    shapes += [[box(1.0, 1.0, 4.0, 4.0)], [[*box(0.0, 0.0, 8.0, 8.0), *box(2.0, 2.0, 4.0, 4.0)]], [[[[3.0, 3.0], [5.0, 3.0]]]], [], [[]]]
    z = spark.createDataFrame(list(enumerate(shapes)), f"ordinal int, geometry {zones.GEOMETRY}")
    at = [(k, *(r.choice([r.uniform(-1, 12), float(r.randint(0, 8))]) for _ in "xy")) for k in range(400)]
    p = spark.createDataFrame([*at, (7, 1.0, 1.0), (7, 1.0, 1.0), (8, None, 1.0)], "k int, lon double, lat double")
    plain, by_rows = (sorted(tuple(x) for x in df.collect()) for df in (zones.hits(p, z).select("k", "z.ordinal"), zones.edge_hits(p, zones.edges(z)).select("k", "ordinal")))
    assert plain == by_rows and len(plain) > 400


def test_state_is_grouped_as_rows_not_as_maps_of_texts(spark):
    """What is sorted and grouped by identity is the rows themselves; texts are made of the one row that is left."""
    target = spark.createDataFrame([("R1", 3, 1.5), ("R1", 2, None), ("R2", 4, 2.5)], "resident_id string, src_row int, price double")
    plan = live.deletes(target, spark.createDataFrame([(1, "R1"), (2, "R2"), (3, "R3")], "proposal_id int, identity string"))
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in shown[shown.index("min_by") :] and "map(" in shown
    got = {r["identity"]: (r["action"], r["row"]) for r in plan.collect()}
    assert got == {"R1": ("skip", {"resident_id": "R1", "src_row": "2", "price": None}), "R2": ("delete", {"resident_id": "R2", "src_row": "4", "price": "2.5"}), "R3": ("skip", None)}
