"""Queries of what is kept over time: pulls in batches, typed cells and rows taken back, ledgers after a restart, ids for addresses; with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalogue import _FOLDER, _WINS, COLUMNS, CTE, PLANNED, RULES, captain, cells, master, of_orders, query, sql_changes, sql_trim
from .catalogue_runs import _DATES, _ISO, _US, _rolled
from .functions import addresses as A
from .functions import values as V
from .operators import address_ids, fill, live
from .operators.ledger import Ledger, latest
from .sources import working
from .streaming import changes, folders


def _streamed(spark, sf_dir) -> str:
    """A folder of copies pulled in two batches, the second of them by a query that goes on from the first one's checkpoint."""
    at = f"{working.root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    rows = captain(spark, sf_dir).select("sheet", "sheet_row", "resident_id", *COLUMNS)
    master(spark, sf_dir).select("src_row", "resident_id", *COLUMNS).write.parquet(f"{at}/master")
    for when in (F.col("sheet") < "Captain 2", F.col("sheet") >= "Captain 2"):
        rows.filter(when).write.mode("append").parquet(f"{at}/in")
        stream = changes.edits(spark, f"{at}/in", rows.schema.simpleString()[7:-1].replace(":", " "))
        folders.pull_folder_stream(stream, f"{at}/master", COLUMNS, f"{at}/out", f"{at}/checkpoint", RULES).awaitTermination()
    return f"{at}/out"


@query(f"{_FOLDER} {sql_changes('j', COLUMNS, RULES, 'conflict', PLANNED)}")
def streamed_pull_changes(spark, sf_dir):
    return spark.read.parquet(f"{_streamed(spark, sf_dir)}/changes").drop("batch")


@query(CTE("fx_captain") + f", {_WINS}, n as (select * from fx_wins where resident_id not in (select resident_id from fx_master)) select sheet, sheet_row, resident_id, (select max(src_row) from fx_master) + row_number() over (order by sheet, sheet_row) as src_row from n")
def streamed_pull_appends(spark, sf_dir):
    return spark.read.parquet(f"{_streamed(spark, sf_dir)}/new").select("sheet", "sheet_row", "resident_id", "src_row")


# Orders as a table of typed cells: numbers, days, truths, lists, nulls beside empty texts.
_TYPED = """select cast(o_orderkey as varchar(40)) as resident_id, cast(o_orderkey + 2 as int) as src_row, case when o_orderkey % 7 = 0 then null else o_totalprice end as price, cast(o_orderdate as date) as day,
  o_totalprice > 150000 as big, array(o_orderstatus, o_orderpriority) as tags, case o_orderkey % 3 when 0 then null when 1 then '' else o_orderpriority end as note from orders"""
_LISTED = f"typed as ({_TYPED.replace('array(o_orderstatus, o_orderpriority)', '[o_orderstatus, o_orderpriority]')})"
_SHOWN = "resident_id, src_row, price, cast(day as varchar) as day, big, array_to_string(tags, '|') as tags, note"


def _typed(spark, sf_dir):
    return of_orders(spark, sf_dir, _TYPED)


@query(f"with {_LISTED}, kept as (select * from typed where src_row % 5 <> 0), back as (select * replace (cast((select max(src_row) from kept) + row_number() over (order by resident_id) as int) as src_row) from typed where src_row % 5 = 0) select {_SHOWN} from (select * from kept union all select * from back) t")
def typed_rows_deleted_and_restored(spark, sf_dir):
    rows = _typed(spark, sf_dir)
    # What later steps read more than once is written, so no step's tasks hold the sorts of those before it.
    plan = working.table(live.deletes(rows, rows.filter("src_row % 5 = 0").select(F.col("src_row").alias("proposal_id"), F.col("resident_id").alias("identity"))), "plan")
    left = working.table(live.deleted(rows, plan), "left")
    snaps = plan.filter("action = 'delete'").select(F.col("proposal_id").alias("snapshot_id"), "identity", F.col("row").alias("cells"))
    restored = working.table(live.restore_rows(left, snaps).filter("action = 'append'").select("snapshot_id", "identity", "action"), "restored")
    back = working.table(restored.join(snaps.drop("identity"), "snapshot_id"), "back")
    return live.appended(left, back, by="identity").select("resident_id", "src_row", "price", F.col("day").cast("string").alias("day"), "big", F.array_join("tags", "|").alias("tags"), "note")


@query(f"""with {_LISTED} select resident_id, price, case src_row % 4 when 0 then 1.5 else price end as price_written, array_to_string(tags, '|') as tags, case src_row % 4 when 1 then 'a|"b"' else array_to_string(tags, '|') end as tags_written,
  cast(day as varchar) as day, case src_row % 4 when 2 then '2020-02-29' else cast(day as varchar) end as day_written from typed""")
def typed_cells_written_and_reverted(spark, sf_dir):
    rows = _typed(spark, sf_dir)
    k = F.col("src_row") % 4
    named = F.struct(F.when(k == 0, "price").when(k == 1, "tags").when(k == 2, "day").alias("column"), F.when(k == 0, "1.5").when(k == 1, '["a","\\"b\\""]').otherwise("2020-02-29").alias("incoming"))
    asked = rows.select(F.col("src_row").alias("proposal_id"), F.col("resident_id").alias("identity"), named.alias("c"), F.lit("overwrite").alias("policy")).filter("c.column is not null").select("proposal_id", "identity", "c.*", "policy")
    plan = working.table(live.writes(rows, asked).filter(F.col("action").isin("fill", "overwrite")).withColumn("will_write", F.lit(True)), "plan")
    after = working.table(fill.apply(rows, plan, "resident_id"), "after")
    snaps = plan.select(F.col("proposal_id").alias("snapshot_id"), "identity", "column", F.col("existing").alias("before"), F.col("incoming").alias("after"))
    undone = working.table(live.revert_cells(after, snaps).filter("action = 'restore'").select("identity", "column", F.col("before").alias("incoming"), F.lit(True).alias("will_write")), "undone")
    back = working.table(fill.apply(after, undone, "resident_id"), "back")
    shown = lambda df, end: df.select("resident_id", F.col("price").alias(f"price{end}"), F.array_join("tags", "|").alias(f"tags{end}"), F.col("day").cast("string").alias(f"day{end}"))
    return shown(back, "").join(shown(after, "_written"), "resident_id")


# Ledgers.
_RUNS = "select cast(user_id as varchar(40)) as run_id, event_id as seq, 'audit' as workflow, case event_type when 'error' then 'failed' when 'purchase' then 'succeeded' when 'click' then 'running' when 'view' then 'queued' else 'interrupted' end as status from {events}"


@query(f"with r as ({_RUNS.format(events='events')}), l as (select run_id, max(seq) as seq, arg_max(status, seq) as status from r group by run_id) select run_id, case when status in ('running', 'queued') then seq + 1 else seq end as seq, case when status in ('running', 'queued') then 'interrupted' else status end as status from l")
def runs_after_restart(spark, sf_dir):
    ledger = Ledger(spark, f"{working.root(spark)}/ledger-{uuid.uuid4().hex[:12]}", clock=lambda: F.lit("2024-01-01 00:00:00").cast("timestamp"))
    ledger.append("runs", spark.sql(_RUNS.format(events=f"parquet.`{sf_dir}/events.parquet`")))
    ledger.interrupt()
    return latest(ledger.read("runs"), "run_id").select("run_id", "seq", "status")


_CONFLICTS = "select cast(user_id as varchar(40)) as run_id, 'A' as sheet, cast(event_id % 100 as varchar(40)) as identity, event_type as \"column\", '' as existing, cast(event_id as varchar(40)) as incoming, 'open' as status, event_id as seq, value from {events}"


@query(f"""with c as ({_CONFLICTS.format(events='events')}), l as (select run_id, sheet, identity, "column", arg_max(incoming, seq) as incoming from c group by all) select * from l where not exists (select 1 from c where c.run_id = l.run_id and c.identity = l.identity and c."column" = l."column" and c.value > 30)""")
def conflicts_left_open(spark, sf_dir):
    ledger = Ledger(spark, f"{working.root(spark)}/ledger-{uuid.uuid4().hex[:12]}", clock=lambda: F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = spark.sql(_CONFLICTS.replace('"column"', "column").format(events=f"parquet.`{sf_dir}/events.parquet`"))
    ledger.append("conflicts", rows.drop("value"))
    ledger.resolve(rows.filter("value > 30"))
    return ledger.open_conflicts().select("run_id", "sheet", "identity", "column", "incoming")


# Addresses.
_KEYED = "select src_row, lower(concat(house, ' ', street)) as key, case when c_custkey % 6 = 0 then concat('A-', house, street) else '' end as address_id from fx_master"
_MADE = "concat(substr(sha256(key), 1, 8), '-', substr(sha256(key), 9, 4), '-4', substr(sha256(key), 14, 3), '-8', substr(sha256(key), 18, 3), '-', substr(sha256(key), 21, 12))"


@query(CTE("fx_master") + f", k as ({_KEYED}) select src_row, coalesce(max(nullif(address_id, '')) over (partition by key), {_MADE}) as address_id from k")
def address_backfill(spark, sf_dir):
    m = master(spark, sf_dir)
    key, existing = F.lower(F.concat_ws(" ", "house", "street")), F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("A-"), "house", "street")).otherwise("")
    return address_ids.backfill(m.select("src_row", key.alias("key"), existing.alias("address_id")), "key", "address_id", "src_row").select("src_row", "address_id")


@query(CTE("fx_master") + ", k as (select lower(concat(house, ' ', street)) as key, apn from fx_master where apn <> '') select 'address with several ids' as kind, key as name, count(distinct apn) as n from k group by key having count(distinct apn) > 1 union all select 'id of several addresses', apn, count(distinct key) from k group by apn having count(distinct key) > 1")
def address_backfill_blocks(spark, sf_dir):
    return address_ids.blocks(master(spark, sf_dir).withColumn("key", F.lower(F.concat_ws(" ", "house", "street"))), "key", "apn", "src_row")


_DAMAGED = ["Jan-5", "5-mar", "Feb 7", "7 Sept", "1/2", "12/31/99", "2024-01-02T05:00", "December 12", "12", "Mar-123", None, ""]
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


@query(f"""select k, concat_ws(', ', case when regexp_full_match(t, '\\d{{1,2}}/\\d{{1,2}}(/\\d{{2,4}})?') then 'slash date' end, case when regexp_full_match(lower(t), '{_MONTH}[- ]\\d{{1,2}}') then 'month and day' end, case when regexp_full_match(lower(t), '\\d{{1,2}}[- ]{_MONTH}') then 'day and month' end,
  case when regexp_full_match(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ].*)?') then 'date' end) as warnings from (select k, coalesce({sql_trim('x')}, '') as t from ({cells(_DAMAGED)}) c) q""")
def address_warnings(spark, sf_dir):
    return of_orders(spark, sf_dir, cells(_DAMAGED)).select("k", F.array_join(A.warnings(F.col("x")), ", ").alias("warnings"))


_SOLD = [x for x in _DATES if x and x.strip()]
_DAY = f"""case when regexp_full_match(t, '\\d+(\\.\\d+)?') then case when cast(t as double) >= 1 and cast(t as double) <= {V.MOST_SERIAL} then cast(date '{V.EPOCH}' + to_days(cast(floor(cast(t as double)) as int)) as date) end {_rolled(_US, 3, 1, 2)} {_rolled(_ISO, 1, 2, 3)} end"""
_SALES = f"select o.o_custkey, o.o_orderkey, c.x from orders o join ({cells(_SOLD)}) c on c.k = o.o_orderkey"


@query(f"""{CTE('fx_captain')}, s as (select concat('R', cast(o_custkey as varchar)) as resident_id, arg_min(x, o_orderkey) as x from ({_SALES}) q group by o_custkey), d as (select resident_id, coalesce(cast({_DAY} as varchar), x) as sold from (select *, {sql_trim('x')} as t from s) q),
  j as (select c.sheet, c.sheet_row, c.resident_id as identity, '' as t_sale_date, d.sold as s_sale_date from fx_captain c join d on d.resident_id = c.resident_id) {sql_changes('j', {'sale_date': 'sale_date'}, {}, 'fill_blank', PLANNED)}""")
def cell_fill_dates(spark, sf_dir):
    sold = of_orders(spark, sf_dir, cells(_SOLD).replace("select o_orderkey as k", "select o_custkey, o_orderkey as src_row"))
    source = sold.select(F.concat(F.lit("R"), F.col("o_custkey").cast("string")).alias("resident_id"), "src_row", F.col("x").alias("sale_date"))
    return fill.plan(captain(spark, sf_dir), source, "resident_id", "resident_id", {"sale_date": "sale_date"}, "src_row", dates=True)
