"""Queries of applied and undone plans, impacts, full reports, rows to write and small rules, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import (
    _DOUBLED, _FILL, _FOLDER, _HITS, _IDS, _OVERVIEW, _OWN, _PULL, _PULLED, _PUSH, _RECONCILED, _SUMMARY, _WINS, COLUMNS, CTE, MASTER_HEADERS, NAMES, PLANNED, RULES, _doubled, _edited, _ids, _reconciled,
    captain, cell_fill_plan, fx, literal, cells, master, of_orders, picked, polygons, pull_folder_changes, query, sql_changes, sql_key, sql_trim, table,
)
from .functions import values as V
from .operators import address_ids, audit, fill, impact, ledger, live, pull, schema_ops, zones
from .operators import headers as H
from .sources import grids



def _cells_after(target: str, keys: str, names: tuple[str, ...], changes: str, on: str) -> str:
    """SQL of a target with a plan's writes in place."""
    joins = " ".join(f"left join ({changes}) w_{c} on {on.replace('w.', f'w_{c}.')} and w_{c}.\"column\" = '{c}'" for c in names)
    cells = ", ".join(f"case when w_{c}.identity is not null then w_{c}.incoming else t.{c} end as {c}" for c in names)
    return f"select {keys}, {cells} from {target} t {joins}"


# Applied, and taken back.
_WRITES = f"(select sheet, identity, \"column\", arg_min(incoming, sheet_row) as incoming from ({sql_changes('j', COLUMNS, RULES, 'fill_blank', PLANNED)}) p where will_write group by all)"


@query(f"{_FILL} {_cells_after('fx_captain', 't.sheet, t.sheet_row, t.resident_id', tuple(COLUMNS), 'select * from ' + _WRITES + ' x', 'w.sheet = t.sheet and w.identity = t.resident_id')}")
def applied_fill(spark, sf_dir):
    return fill.apply(captain(spark, sf_dir), cell_fill_plan(spark, sf_dir), "resident_id").select("sheet", "sheet_row", "resident_id", *COLUMNS)


_MASTER_WRITES = f"(select identity, \"column\", arg_min(incoming, sheet) as incoming from ({sql_changes('j', COLUMNS, RULES, 'conflict', PLANNED)}) p where will_write group by all)"


@query(f"{_FOLDER} {_cells_after('fx_master', 't.src_row, t.resident_id', tuple(COLUMNS), 'select * from ' + _MASTER_WRITES + ' x', 'w.identity = t.resident_id')}")
def applied_pull(spark, sf_dir):
    return fill.apply(master(spark, sf_dir), pull_folder_changes(spark, sf_dir), "resident_id").select("src_row", "resident_id", *COLUMNS)


@query(CTE("fx_cell_snapshots") + f""", q as (select *, {sql_key('current_value')} kc, {sql_key('before_value')} kb, {sql_key('after_value')} ka from fx_cell_snapshots)
  select m.resident_id, case when q.resident_id is null then m.phone when kc <> kb and kc = ka then case when q.snapshot_id % 2 = 0 then null else before_value end else current_value end as phone from fx_master m left join q on q.resident_id = m.resident_id""")
def undone_fill(spark, sf_dir):
    snaps = fx(spark, sf_dir, "fx_cell_snapshots").select("snapshot_id", F.concat(F.lit(" "), "resident_id").alias("identity"), F.col("column_name").alias("column"), F.col("before_value").alias("before"), F.col("after_value").alias("after"))
    now = _edited(spark, sf_dir)
    back = live.revert_cells(now, snaps).filter("action = 'restore'")
    # Every other cell was null before.
    back = back.select("identity", "column", F.when(F.col("snapshot_id") % 2 == 1, F.col("before")).alias("incoming"), F.lit(True).alias("will_write"))
    return fill.apply(now, back, "resident_id").select("resident_id", "phone")


_APPENDED = f"""{CTE("fx_master")}, {_IDS}, a as (select i.* from (select *, row_number() over (partition by identity order by proposal_id) n from ids) i left join fx_master m on m.resident_id = i.identity where i.identity <> '' and n = 1 and m.resident_id is null)"""


@query(_APPENDED + " select src_row, resident_id, phone, apn from fx_master union all select cast((select max(src_row) from fx_master) + row_number() over (order by proposal_id) as int), identity, phone, '' from a")
def applied_appends(spark, sf_dir):
    m = master(spark, sf_dir).select("src_row", "resident_id", "phone", "apn")
    rows = _ids(spark, sf_dir).withColumn("resident_id", F.col("identity")).drop("identity")
    return live.appended(m, live.appends(m, rows))


@query(CTE("fx_master") + f", {_DOUBLED}, tn as (select resident_id, count(*) n from fx_double group by resident_id), {_IDS} select d.src_row, d.resident_id from fx_double d join tn on tn.resident_id = d.resident_id where n > 1 or d.resident_id not in (select identity from ids)")
def applied_deletes(spark, sf_dir):
    target = _doubled(spark, sf_dir)
    return live.deleted(target, live.deletes(target, _ids(spark, sf_dir).select("proposal_id", "identity"))).select("src_row", "resident_id")


_MOVED = CTE("fx_captain") + f""", {_IDS}, f as (select * from fx_captain where sheet = 'Captain 5'), t as (select * from fx_captain where sheet = 'Captain 6'), fn as (select resident_id, count(*) n, arg_min(phone, sheet_row) phone from f group by resident_id),
  moving as (select i.identity, min(i.proposal_id) as proposal_id, min(fn.phone) as phone from ids i join fn on fn.resident_id = i.identity and fn.n = 1 where i.identity not in (select resident_id from t) group by i.identity)"""


@query(_MOVED + """ select 'Captain 5' as side, sheet_row, resident_id, zone, phone from f where resident_id not in (select identity from moving) union all select 'Captain 6', sheet_row, resident_id, zone, phone from t
  union all select 'Captain 6', cast((select max(sheet_row) from t) + row_number() over (order by proposal_id) as int), identity, 'Zone 6', phone from moving""")
def applied_moves(spark, sf_dir):
    c = captain(spark, sf_dir)
    source, destination = c.filter("sheet = 'Captain 5'"), c.filter("sheet = 'Captain 6'")
    plan = live.moves(source, destination, _ids(spark, sf_dir).select("proposal_id", "identity"), {"zone": "Zone 6", "sheet": "Captain 6"})
    left, right = live.deleted(source, plan), live.appended(destination, plan, "sheet_row")
    return left.unionByName(right).select(F.col("sheet").alias("side"), "sheet_row", "resident_id", "zone", "phone")


@query(CTE("fx_master") + """ select src_row, resident_id, phone from fx_master where c_custkey % 4 <> 0 union all
  select cast((select max(src_row) from fx_master where c_custkey % 4 <> 0) + row_number() over (order by c_custkey) as int), resident_id, phone from fx_master where c_custkey % 4 = 0""")
def restored_rows(spark, sf_dir):
    m = master(spark, sf_dir).select("src_row", "resident_id", "phone", "c_custkey")
    left = m.filter("c_custkey % 4 <> 0").drop("c_custkey")
    cells = F.create_map(F.lit("resident_id"), F.col("resident_id"), F.lit("phone"), F.col("phone"))
    snaps = m.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("snapshot_id"), F.col("resident_id").alias("identity"), cells.alias("cells"))
    plan = live.restore_rows(left, snaps).join(snaps.select("snapshot_id", "cells"), "snapshot_id")
    return live.appended(left, plan, by="snapshot_id")


_LOGGED = f"""{_PULL}, conf as (select identity, "column", min(sheet) as sheet, arg_min(case when sheet_row % 3 = 0 then 'shown before' else existing end, sheet) as existing, arg_min(incoming, sheet) as incoming from ({_PULLED}) p where action = 'conflict' group by identity, "column")"""


@query(f"""{_LOGGED}, q as (select c.*, case c."column" {' '.join(f"when '{c}' then m.{c}" for c in COLUMNS)} end as now from conf c join fx_master m on m.resident_id = c.identity)
  select identity, "column", now as existing, incoming, case when {sql_key('now')} <> {sql_key('existing')} then 'conflict' when now is null or now = '' then 'fill' else 'overwrite' end as action, {sql_key('now')} = {sql_key('existing')} as will_write from q""")
def conflicts_applied(spark, sf_dir):
    conf = pull.pull_changes(master(spark, sf_dir), captain(spark, sf_dir), COLUMNS, RULES).filter("action = 'conflict'")
    conf = conf.withColumn("existing", F.when(F.col("sheet_row") % 3 == 0, "shown before").otherwise(F.col("existing")))
    first = conf.groupBy("identity", "column").agg(F.min(F.struct("sheet", "existing", "incoming")).alias("c")).select("c.sheet", "identity", "column", "c.existing", "c.incoming")
    return live.conflicts(master(spark, sf_dir), first).select("identity", "column", "existing", "incoming", "action", "will_write")


# Impacts.
_IMPACT = "cast(coalesce(sum(filled), 0) as bigint) as filled, cast(coalesce(sum(overwritten), 0) as bigint) as overwritten, cast(coalesce(sum(conflicts), 0) as bigint) as conflicts, cast(coalesce(sum(skipped), 0) as bigint) as skipped"


@query(f"{_FILL} select {_IMPACT}, count(*) filter (filled + overwritten > 0) as sheets_affected, cast(1 as bigint) as columns_to_add, cast(0 as bigint) as errors from (select sheet, {_SUMMARY} from ({sql_changes('j', COLUMNS, RULES, 'fill_blank', PLANNED)}) p group by sheet) s")
def cell_fill_impact(spark, sf_dir):
    to_add = captain(spark, sf_dir).select("sheet", F.lit("sale_price").alias("column")).distinct()
    return impact.cell_fill(cell_fill_plan(spark, sf_dir), to_add)


@query(_PUSH + " select count(*) filter (not here) as appended, count(*) filter (not here and (phone <> '' or email <> '')) as flagged, count(distinct case when not here then sheet end) as sheets_affected, cast(0 as bigint) as errors from w")
def push_missing_impact(spark, sf_dir):
    return impact.push_missing(pull.push_missing(master(spark, sf_dir), captain(spark, sf_dir), sensitive=("phone", "email")))


@query(CTE("fx_captain") + """, s as (select * from (select *, row_number() over (partition by sheet, resident_id order by sheet_row) r from fx_captain where resident_id not in (select resident_id from fx_master)) q where r = 1)
  select sheet, count(*) as candidates, cast(0 as bigint) as clean, count(*) filter (risk = 'likely') as likely, count(*) filter (risk <> 'likely') as possible from
  (select s.sheet, case when apn <> 'APN-NEW' and apn <> '' or email <> '' then 'likely' else 'possible' end as risk from s) x group by sheet""")
def new_resident_impact(spark, sf_dir):
    return impact.new_residents(pull.new_residents(master(spark, sf_dir), captain(spark, sf_dir)), "sheet")


@query(f"{_FILL} select cast(26 as bigint) as sheets_processed, cast(1 as bigint) as errors, cast(25 as bigint) as columns_added, {_IMPACT} from (select sheet, {_SUMMARY} from ({sql_changes('j', COLUMNS, RULES, 'fill_blank', PLANNED)}) p group by sheet) s")
def folder_totals(spark, sf_dir):
    summaries = fill.summary(cell_fill_plan(spark, sf_dir)).withColumn("columns_added", F.lit(1))
    statuses = captain(spark, sf_dir).select("sheet").distinct().withColumn("error", F.lit("")).unionByName(spark.createDataFrame([("Captain X", "not a grid")], "sheet string, error string"))
    return impact.folder(summaries, statuses)


# Rows that a plan would write, and what is shown about them.
@query(_PUSH + " select w.sheet, m.resident_id, m.resident_name, m.phone, '' as notes from w join fx_master m on m.src_row = w.master_row where not here")
def push_missing_rows(spark, sf_dir):
    m = master(spark, sf_dir)
    return pull.push_rows(m, pull.push_missing(m, captain(spark, sf_dir)), ["resident_id", "resident_name", "phone", "notes"])


@query(CTE("fx_captain") + """, s as (select * from (select *, row_number() over (partition by sheet, resident_id order by sheet_row) r from fx_captain where resident_id not in (select resident_id from fx_master)) q where r = 1)
  select sheet, sheet_row, resident_id, case when apn = '' then concat(house, ' ', street) else concat(house, ' ', street, ' · APN ', apn) end as property,
  cast((zone <> '')::int + (resident_id <> '')::int + (resident_name <> '')::int + (apn <> '')::int + (house <> '')::int + (street <> '')::int + (phone <> '')::int + (damage <> '')::int + (email <> '')::int as int) as filled_columns from s""")
def new_resident_details(spark, sf_dir):
    return pull.new_residents(master(spark, sf_dir), captain(spark, sf_dir)).select("sheet", "sheet_row", "resident_id", "property", "filled_columns")


@query(CTE("fx_captain") + f""", {_WINS}, n as (select * from fx_wins where resident_id not in (select resident_id from fx_master)) select src_row, resident_id, phone, '' as badge from fx_master
  union all select cast((select max(src_row) from fx_master) + row_number() over (order by sheet, sheet_row) as int), resident_id, phone, concat('B', sheet_row) from n""")
def append_with_new_columns(spark, sf_dir):
    sheets = captain(spark, sf_dir).withColumn("badge", F.concat(F.lit("B"), F.col("sheet_row").cast("string")))
    return pull.append_missing(master(spark, sf_dir), sheets).select("src_row", "resident_id", "phone", "badge")


@query(CTE("fx_master", "fx_sales") + " select apn, latest_sale_price from fx_sales s where not exists (select 1 from fx_master m where m.apn = s.apn and m.c_custkey % 15 < 9)")
def unmatched_feed(spark, sf_dir):
    return fill.unmatched(fx(spark, sf_dir, "fx_sales"), master(spark, sf_dir).filter("c_custkey % 15 < 9"), "apn", "apn").select("apn", "latest_sale_price")


@query(CTE("fx_master") + " select 's' as sheet, c_custkey as sheet_row, resident_id as identity, verdict, matched_id from (select m.c_custkey, case when c_custkey % 3 = 0 then concat('r-', c_custkey) else concat('Q', c_custkey) end as resident_id, case when c_custkey % 3 = 0 then 'id in another spelling' when c_custkey % 3 = 1 then 'name under another id' else 'not on the master' end as verdict, case when c_custkey % 3 = 2 then '' else m.resident_id end as matched_id from fx_master m) q")
def verdicts_of_all_kinds(spark, sf_dir):
    m = master(spark, sf_dir)
    k = F.col("c_custkey")
    sheet = m.select(F.lit("s").alias("sheet"), k.alias("sheet_row"), F.when(k % 3 == 0, F.concat(F.lit("r-"), k.cast("string"))).otherwise(F.concat(F.lit("Q"), k.cast("string"))).alias("resident_id"), F.when(k % 3 == 1, F.col("resident_name")).otherwise(F.concat(F.lit("someone "), k.cast("string"))).alias("resident_name"))
    return pull.verdicts(m, sheet)


# Full reports.
def _headers(k: int) -> list[str]:
    return [MASTER_HEADERS, _OWN, [*_OWN, "notes"]][k % 3]


def _statuses(spark, sf_dir) -> tuple[DataFrame, audit.Names]:
    found = [(f"Captain {k}", f"/sheets/{k}", "") for k in range(25)] + [("Captain E", "/sheets/E", ""), ("Captain X", "/sheets/X", "not a grid")]
    names = audit.Names(master_headers=MASTER_HEADERS, sheet_headers={f"Captain {k}": _headers(k) for k in range(25)})
    return spark.createDataFrame(found, "sheet string, url string, error string"), names


_KIND = "cast(replace(o.sheet, 'Captain ', '') as int) % 3"
_FULL = _OVERVIEW + f""", full_ as (select o.sheet, concat('/sheets/', replace(o.sheet, 'Captain ', '')) as url, '' as error, cast(case {_KIND} when 0 then 11 when 1 then 9 else 10 end as int) as total_columns, o.data_rows, o.apn_values, o.damage_values, o.addresses_missing_apn, o.zone, o.apn_inconsistent, o.missing_rows, o.extra_not_in_master, o.extra_wrong_zone,
  case {_KIND} when 0 then '' else 'lat, lon' end as missing_columns, case {_KIND} when 2 then 'notes' else '' end as extra_columns, case {_KIND} when 0 then 'Match' when 1 then 'Missing Columns' else 'Missing + Extra' end as status from overview o
  union all select 'Captain E', '/sheets/E', '', 0, 0, null, null, null, '', 0, null, null, null, '', '', 'Empty' union all select 'Captain X', '/sheets/X', 'not a grid', 0, 0, null, null, null, '', 0, null, null, null, '', '', 'ERROR')"""


@query(_FULL + " select * from full_")
def audit_full_overview(spark, sf_dir):
    statuses, names = _statuses(spark, sf_dir)
    return audit.full_overview(master(spark, sf_dir), captain(spark, sf_dir), names, statuses)


_TOTALS = ", ".join(f"cast(coalesce(sum({c}), 0) as bigint) as {a}" for c, a in (("data_rows", "total_data_rows"), ("addresses_missing_apn", "addresses_missing_apn"), ("apn_inconsistent", "apn_inconsistencies"), ("missing_rows", "missing_rows"), ("extra_not_in_master", "extra_not_in_master"), ("extra_wrong_zone", "extra_wrong_zone")))


@query(_FULL + f""" select count(*) as sheets_scanned, count(*) filter (status = 'ERROR') as sheets_with_errors, count(*) filter (status = 'Empty') as sheets_empty, count(*) filter (status = 'Match') as sheets_matching, count(*) filter (status in ('Missing Columns', 'Extra Columns', 'Missing + Extra')) as sheets_with_drift, {_TOTALS},
  (select count(*) from (select resident_id from fx_captain group by resident_id having count(*) > 1) q) as duplicate_ids, (select count(*) from fx_captain where house = '' or street = '') as missing_situs, '' as skipped_because from full_""")
def audit_full_summary(spark, sf_dir):
    statuses, names = _statuses(spark, sf_dir)
    full = audit.full_overview(master(spark, sf_dir), captain(spark, sf_dir), names, statuses)
    return audit.full_summary(full, captain(spark, sf_dir), names)


@query(" union all ".join(f"select cast({k + 1} as int) as position, '{chr(65 + k)}' as letter, '{h}' as \"column\"" for k, h in enumerate(MASTER_HEADERS)))
def audit_master_columns(spark, sf_dir):
    return audit.master_columns(master(spark, sf_dir), MASTER_HEADERS)


@query(CTE("fx_captain") + " select sheet, count(*) filter (sheet_row % 3 = 0) as n from fx_captain group by sheet")
def strictly_true_cells(spark, sf_dir):
    return audit.count_true(captain(spark, sf_dir).withColumn("sold", F.col("sheet_row") % 3 == 0), "sold")


@query(CTE("fx_captain") + """, c as (select sheet, zone, resident_id from fx_captain where sheet <> 'Captain 4' union all select 'Captain 4', zone, resident_id from fx_master where zone = 'Zone 4'), z as (select sheet, min(zone) zone from c group by sheet),
  a as (select distinct sheet, resident_id from c), b as (select z.sheet, m.resident_id from z join fx_master m on m.zone = z.zone) select coalesce(a.sheet, b.sheet) as sheet, count(*) filter (a.sheet is null or b.sheet is null) = 0 as same from a full join b on a.sheet = b.sheet and a.resident_id = b.resident_id group by 1""")
def same_ids_as_roster(spark, sf_dir):
    c, m = captain(spark, sf_dir), master(spark, sf_dir)
    whole = m.filter("zone = 'Zone 4'").select(F.lit("Captain 4").alias("sheet"), F.col("src_row").alias("sheet_row"), "zone", "resident_id")
    sheets = c.filter("sheet <> 'Captain 4'").select("sheet", "sheet_row", "zone", "resident_id").unionByName(whole)
    return audit.same_ids(sheets, m)


_FIRSTS = "firsts as (select src_row, min(ordinal) as ordinal from fx_zone_hits group by src_row)"


@query(_HITS + f", {_FIRSTS} select m.src_row, m.resident_id, m.phone, coalesce(z.zone, '') as \"ZoneName\", coalesce(z.contact_name, '') as \"NC Name\" from fx_master m left join firsts f on f.src_row = m.src_row left join fx_zones z on z.ordinal = f.ordinal")
def zone_join_output(spark, sf_dir):
    out = zones.joined(master(spark, sf_dir), polygons(spark, sf_dir), "src_row", {"ZoneName": "zone", "NC Name": "contact_name"})
    return out.select("src_row", "resident_id", "phone", "ZoneName", "NC Name")


@query(_RECONCILED + """ select count(*) as total_rows, count(*) filter (outcome <> 'missing_coords') as with_coordinates, count(*) filter (outcome = 'missing_coords') as missing_coords, count(*) filter (outcome = 'unassigned') as unassigned, count(*) filter (outcome = 'match') as matched, count(*) filter (outcome = 'fill') as would_fill,
  count(*) filter (outcome = 'conflict') as would_change, count(*) filter (contact_updates > 0) as contact_updates, count(*) filter (multi_zone) as multi_zone, count(distinct nullif(current_zone, '')) as zones_in_master, count(distinct nullif(computed_zone, '')) as zones_computed, cast(3 as int) as columns_to_add, (select count(*) from fx_zones) as features_loaded from rec""")
def zone_full_summary(spark, sf_dir):
    return zones.full_summary(_reconciled(spark, sf_dir), polygons(spark, sf_dir), {"zone": "zone"})


# Ledger.
@query(CTE("fx_log") + " select cast(entry_type as varchar) as name, cast(arg_max(metric, entry_id) as varchar) as value from fx_log group by entry_type")
def settings_upsert(spark, sf_dir):
    events = fx(spark, sf_dir, "fx_log").select(F.col("entry_type").alias("name"), F.col("metric").cast("string").alias("value"), F.col("entry_id").alias("seq"))
    return ledger.latest(events, "name").select("name", "value")


@query(CTE("fx_log") + " select entry_id, run_id from fx_log where run_id % 7 <> 0")
def deleted_runs(spark, sf_dir):
    log = fx(spark, sf_dir, "fx_log").select("entry_id", "run_id")
    return ledger.without_runs(log, log.filter("run_id % 7 = 0"))


@query(CTE("fx_log") + " select entry_id, case when run_id % 7 = 0 then null else run_id end as run_id from fx_log")
def detached_runs(spark, sf_dir):
    log = fx(spark, sf_dir, "fx_log").select("entry_id", "run_id")
    return ledger.without_runs(log, log.filter("run_id % 7 = 0"), detach=True)


@query("select n.n_nationkey as id, count(s.s_suppkey) as n, coalesce(string_agg(s.s_name, ', ' order by s.s_name), '') as names from nation n left join supplier s on s.s_nationkey = n.n_nationkey group by 1")
def parents_with_children(spark, sf_dir):
    parents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    out = ledger.with_children(parents, table(spark, sf_dir, "supplier"), "id", "s_nationkey", ["s_name"])
    return out.select("id", F.size("children").cast("long").alias("n"), F.array_join(F.col("children.s_name"), ", ").alias("names"))


@query("select max(n_nationkey) + 1 as next from nation")
def next_position(spark, sf_dir):
    return ledger.next_position(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("next"))


@query(CTE("fx_master") + " select street, src_row from (select street, src_row, row_number() over (partition by street order by src_row) n from fx_master) q where n <= 10")
def samples_of_groups(spark, sf_dir):
    return ledger.first_of_each(master(spark, sf_dir).select("street", "src_row"), ["street"], ["src_row"], 10)


@query(f"{_FILL} select action, sheet, sheet_row, \"column\" from (select *, row_number() over (partition by action order by sheet, sheet_row, \"column\") n from ({sql_changes('j', COLUMNS, RULES, 'fill_blank', PLANNED)}) p) q where n <= 25")
def preview_samples(spark, sf_dir):
    return ledger.first_of_each(cell_fill_plan(spark, sf_dir).select("action", "sheet", "sheet_row", "column"), ["action"], ["sheet", "sheet_row", "column"], 25)


# Small rules.
_DATES = [None, "", "45000", "45000.75", "0", "3/4/2021", "13/45/2024", "2024-2-30", "x", " 1/2/2020 "]
_NUMBERS = [None, "", "7", "-1.5", "+.5", "1e3", "1,000", "abc", " 12 "]
_MESSAGES = [("No rows found.", ""), ("no duplicate ids found", ""), ("", ""), ("Row membership skipped: no zone", ""), ("R1", ""), ("", "x"), ("No rows found.", "but more"), ("Nobody found it", "")]
_DASHES = ["Größe – Hof", "For  Sale", "Address—For Sale", " A -- B ", "Notes*"]
_SWITCHES = ["", "yes", "No", " Y ", "TRUE", "off", "Enabled", "1"]
_IDS_SHOWN = ["123e4567-e89b-12d3-a456-426614174000", "123E4567-E89B-12D3-A456-426614174000", "123e4567e89b12d3a456426614174000", "", "R1"]


_US, _ISO = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"


def _rolled(pattern: str, y: int, m: int, d: int) -> str:
    part = {k: f"cast(regexp_extract(t, '{pattern}', {n}) as int)" for k, n in (("y", y), ("m", m), ("d", d))}
    return f"when regexp_matches(t, '{pattern}') then cast(make_date({part['y']}, 1, 1) + to_months({part['m']} - 1) + to_days({part['d']} - 1) as date)"


@query(f"""select k, cast(case when regexp_full_match(t, '\\d+(\\.\\d+)?') then case when cast(t as double) >= 1 and cast(t as double) <= {V.MOST_SERIAL} then cast(date '{V.EPOCH}' + to_days(cast(floor(cast(t as double)) as int)) as date) end
  {_rolled(_US, 3, 1, 2)} {_rolled(_ISO, 1, 2, 3)} end as varchar) as d from (select k, {sql_trim('x')} as t from ({cells(_DATES)}) c) q""")
def dates_of_cells(spark, sf_dir):
    return of_orders(spark, sf_dir, cells(_DATES)).select("k", V.to_date(F.col("x")).cast("string").alias("d"))


@query(f"select k, case when regexp_full_match({sql_trim('x')}, '[-+]?(\\d+\\.?\\d*|\\.\\d+)([eE][-+]?\\d+)?') then cast({sql_trim('x')} as double) end as n from ({cells(_NUMBERS)}) t")
def numbers_of_cells(spark, sf_dir):
    return of_orders(spark, sf_dir, cells(_NUMBERS)).select("k", V.to_number(F.col("x")).alias("n"))


@query(f"select k, regexp_replace(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from ({cells(_DASHES)}) t")
def slugs(spark, sf_dir):
    return of_orders(spark, sf_dir, cells(_DASHES)).select("k", V.slug(F.col("x")).alias("slug"))


@query(f"select k, regexp_full_match(lower(coalesce(x, '')), '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') as is_id from ({cells(_IDS_SHOWN)}) t")
def uuid_shapes(spark, sf_dir):
    return of_orders(spark, sf_dir, cells(_IDS_SHOWN)).select("k", V.is_uuid(F.col("x")).alias("is_id"))


@query(f"select k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(x, '')), '[‐-―]', '-', 'g'), '\\s+', ' ', 'g'), '\\s*-\\s*', '-', 'g'), '[^a-z0-9 -]', '', 'g')) as header from ({cells(_DASHES)}) t")
def header_with_dashes(spark, sf_dir):
    return of_orders(spark, sf_dir, cells(_DASHES)).select("k", V.with_dashes(F.col("x")).alias("header"))


@query(f"select k, lower(trim(coalesce(x, ''))) in ('', 'yes', 'y', 'true', 'enabled') as is_on from ({cells(_SWITCHES)}) t")
def switches(spark, sf_dir):
    return of_orders(spark, sf_dir, cells(_SWITCHES)).select("k", V.is_on(F.col("x")).alias("is_on"))


_TABS = "select o_orderkey as k, case o_orderkey % 3 when 0 then '' when 1 then concat(chr(39), o_orderstatus) else concat(o_orderpriority, chr(39), chr(39), 's') end as x from orders"


@query(f"select k, concat(chr(39), replace(x, chr(39), concat(chr(39), chr(39))), chr(39), '!A1:B2') as a1 from ({_TABS}) t")
def ranges_with_tabs(spark, sf_dir):
    return of_orders(spark, sf_dir, _TABS).select("k", V.in_tab(F.col("x"), "A1:B2").alias("a1"))


_REPORT = f"select o_orderkey as k, {picked([a for a, _ in _MESSAGES], name='a')}, {picked([b for _, b in _MESSAGES], 'o_custkey', 'b', ['o_orderstatus'])} from orders"


@query(f"select k from ({_REPORT}) t where not ((a <> '')::int + (b <> '')::int <= 1 and (trim(a) = '' or regexp_matches(trim(a), '(?i)^no .*found\\.?$') or regexp_matches(trim(a), '(?i)skipped')))")
def report_rows(spark, sf_dir):
    return grids.report_rows(of_orders(spark, sf_dir, _REPORT).select("a", "b", "k"), ["a", "b"]).select("k")


@query(CTE("fx_captain") + " select sheet, sheet_row, case when phone <> '' then phone when email <> '' then email else '' end as contact from fx_captain where phone <> '' or email <> ''")
def first_filled_column(spark, sf_dir):
    c = captain(spark, sf_dir).filter(V.any_filled(F.col("phone"), F.col("email")))
    return c.select("sheet", "sheet_row", V.first_filled(F.col("phone"), F.col("email")).alias("contact"))




@query(CTE("fx_captain") + " select sheet, 'phone' as \"column\", cast(case cast(replace(sheet, 'Captain ', '') as int) % 3 when 0 then null else 7 end as int) as position, case cast(replace(sheet, 'Captain ', '') as int) % 3 when 0 then 'missing' when 1 then 'renamed' else 'exists' end as status from (select distinct sheet from fx_captain) q")
def schema_rename_mixed(spark, sf_dir):
    sheets = [r["sheet"] for r in captain(spark, sf_dir).select("sheet").distinct().collect()]  # a row for each sheet of a folder
    kinds = {0: [c for c in _OWN if c != "phone"], 1: _OWN, 2: [*_OWN, "telephone"]}
    return schema_ops.rename_all(spark, {s: kinds[int(s.split()[1]) % 3] for s in sheets}, "phone", "telephone")


@query(CTE("fx_master") + " select src_row, case when apn = '' then concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-4', substr(h, 14, 3), '-8', substr(h, 18, 3), '-', substr(h, 21, 12)) else apn end as apn from (select *, sha256(concat(house, chr(1), street)) h from fx_master) q")
def backfilled_ids(spark, sf_dir):
    return address_ids.backfill_residents(master(spark, sf_dir), "apn", "house", "street").select("src_row", "apn")


@query(CTE("fx_master") + " select src_row, resident_id, '' as notes, phone from fx_master")
def added_columns(spark, sf_dir):
    return schema_ops.add_columns(master(spark, sf_dir), ["notes", "phone"])[0].select("src_row", "resident_id", "notes", "phone")
