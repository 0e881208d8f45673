"""All queries of the reconciliation engine, and SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import addresses as A
from .functions import values as V
from .operators import address_ids, audit, export, fill, guard, keyed, ledger, live, pull, schema_ops, zones

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TEXTS = [None, "", " ", "TRUE", "false", "007", "1.50", "-0", "1e5", "13/45/2024", "2024-13-45", "3/4/2021", " x ", "Abc", "+5", ".5", "12345678", "0.1", "-2.750", "100000"]
LABELS = [None, "", "Fill Blank", "fill-blank-only", " REPLACE ", "overwrite", "log only", "Conflict", "ignore", "never", "whatever"]
HEADERS = [None, "", "Resident ID", "resident_id", "NC  Name*", "_SitusHouseNo", "Größe", "Phone #2"]
COLUMNS = {"phone": "phone", "damage": "damage", "email": "email", "apn": "apn"}
RULES = {"phone": "fill_blank", "damage": "overwrite", "email": "conflict", "apn": "never"}
MASTER_HEADERS = ["zone", "resident_id", "resident_name", "apn", "house", "street", "phone", "damage", "email", "lat", "lon"]
NAMES = audit.Names(master_headers=MASTER_HEADERS)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def literal(x: str | None) -> str:
    return "cast(null as varchar(40))" if x is None else "'" + x.replace("'", "''") + "'"


def rows_of(values: list, name: str = "x") -> str:
    return " union all ".join(f"select {k} as k, {literal(v)} as {name}" for k, v in enumerate(values))


# What people type into cells, from an order's own values.
_DAY = [f"cast({part}(o_orderdate) as varchar(40))" for part in ("month", "day", "year")]
_LATE = ["cast(month(o_orderdate) + 5 as varchar(40))", "cast(day(o_orderdate) + 20 as varchar(40))", _DAY[2]]
TYPED = [
    *(f"concat({m}, '/', {d}, '/', {y})" for m, d, y in (_DAY, _LATE)), *(f"concat({y}, '-', {m}, '-', {d})" for m, d, y in (_DAY, _LATE)),
    "cast(30000 + o_custkey as varchar(40))", "concat(cast(30000 + o_custkey as varchar(40)), '.75')", "cast(cast(floor(o_totalprice) as bigint) as varchar(40))", "concat('-', cast(o_custkey as varchar(40)), '.50')",
    "concat('  ', o_orderstatus, ' ')", "o_orderpriority", "concat(o_orderstatus, '  — ', o_orderpriority)", "concat('1,', cast(o_custkey as varchar(40)))",
]


def picked(values: list, by: str = "o_orderkey", name: str = "x", typed: list[str] = TYPED) -> str:
    """One of some texts, or of the typed ones, for each order."""
    every = [*map(literal, values), *typed]
    return f"case {by} % {len(every)} " + " ".join(f"when {k} then {e}" for k, e in enumerate(every)) + f" end as {name}"


def cells(values: list, typed: list[str] = TYPED) -> str:
    """A cell for each order: one of some texts, or one made from the order's values."""
    return f"select o_orderkey as k, {picked(values, typed=typed)} from orders"


def of_orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("from orders", f"from parquet.`{sf_dir}/orders.parquet`"))


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fixtures.view(spark, sf_dir, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, "fx_master")


def captain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, "fx_captain")


# What the SQL is put together from.
def sql_trim(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def sql_key(e: str) -> str:
    t = sql_trim(e)
    us, iso = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"

    def pad(pattern: str, k: int) -> str:
        return f"lpad(regexp_extract({t}, '{pattern}', {k}), 2, '0')"

    return f"""(case when {e} is null or {t} = '' then 'blank:' when lower({t}) in ('true', 'false') then concat('boolean:', lower({t}))
      when regexp_full_match({t}, '-?\\d+(\\.\\d+)?') then concat('number:', case when cast({t} as double) = 0 then '0' else regexp_replace(cast(cast({t} as double) as varchar), '\\.0$', '') end)
      when regexp_matches({t}, '{us}') then concat('date:', regexp_extract({t}, '{us}', 3), '-', {pad(us, 1)}, '-', {pad(us, 2)})
      when regexp_matches({t}, '{iso}') then concat('date:', regexp_extract({t}, '{iso}', 1), '-', {pad(iso, 2)}, '-', {pad(iso, 3)})
      else concat('string:', {t}) end)"""


def sql_decide(t: str, s: str, policy: str, what: str = "action") -> str:
    def pick(action: str, reason: str) -> str:
        return literal(action if what == "action" else reason)

    blank = f"({t} is null or {t} = '')"
    return f"""(case when {s} is null or {s} = '' then {pick('skip', 'nothing to write')} when {policy} = 'never' then {pick('skip', 'policy never')}
      when {sql_key(t)} = {sql_key(s)} then {pick('equal', 'cells are equal')}
      when {blank} and {policy} not in ('fill_blank', 'overwrite') then {pick('conflict', 'policy conflict')}
      when {blank} then {pick('fill', 'blank cell')} when {policy} = 'overwrite' then {pick('overwrite', 'policy overwrite')}
      else {pick('conflict', 'cells differ')} end)"""


def sql_written(s: str) -> str:
    return f"case when lower({sql_trim(s)}) in ('true', 'false') then lower({sql_trim(s)}) else {s} end"


def sql_changes(joined: str, columns: dict[str, str], rules: dict[str, str], default: str, where: str) -> str:
    """SQL of a plan over ``joined`` (sheet, sheet_row, identity, t_<column>, s_<column>)."""
    parts = []
    for s, t in columns.items():
        rule = literal(rules.get(t, default))
        parts.append(f"select sheet, sheet_row, identity, '{t}' as \"column\", t_{t} as existing, {sql_written(f's_{s}')} as incoming, {rule} as policy, {sql_decide(f't_{t}', f's_{s}', rule)} as action, {sql_decide(f't_{t}', f's_{s}', rule, 'reason')} as reason from {joined}")
    return f"select *, action in ('fill', 'overwrite') as will_write from ({' union all '.join(parts)}) q where {where}"


PLANNED = "action in ('fill', 'overwrite', 'conflict') or (action = 'skip' and policy = 'never')"
CTE = fixtures.ctes


# Values, guard, headers.
@query(f"select k, {sql_key('x')} as cmp_key from ({cells(TEXTS)}) t")
def values_cmp_key(spark, sf_dir):
    return of_orders(spark, sf_dir, cells(TEXTS)).select("k", V.key(F.col("x")).alias("cmp_key"))


@query(f"select k, x is null or x = '' as target_blank, x is null or x = '' as source_blank, coalesce({sql_trim('x')}, '') = '' as audit_blank from ({cells(TEXTS)}) t")
def blank_rules(spark, sf_dir):
    x = F.col("x")
    return of_orders(spark, sf_dir, cells(TEXTS)).select("k", V.target_blank(x).alias("target_blank"), V.source_blank(x).alias("source_blank"), V.audit_blank(x).alias("audit_blank"))


_RULES = ["fill_blank", "overwrite", "conflict", "never", "other"]
_GUARD = f"select o_orderkey as k, {picked(TEXTS, name='target')}, {picked(TEXTS, 'o_custkey', 'source')}, {picked(_RULES, '(o_orderkey + o_custkey)', 'policy', [])} from orders"


@query(f"select k, {sql_decide('target', 'source', 'policy')} as action, {sql_decide('target', 'source', 'policy', 'reason')} as reason from ({_GUARD}) q")
def guard_truth_table(spark, sf_dir):
    cases = of_orders(spark, sf_dir, _GUARD)
    v = guard.decide(F.col("target"), F.col("source"), F.col("policy"))
    return cases.withColumn("v", v).select("k", "v.action", "v.reason")


@query(f"""select k, case when p in ('fill', 'fill_blank', 'fill_blanks', 'fill_blank_only') then 'fill_blank' when p in ('overwrite', 'replace') then 'overwrite'
  when p in ('conflict', 'log_conflict', 'log_only') then 'conflict' when p in ('never', 'skip', 'ignore') then 'never' else '' end as policy
  from (select k, regexp_replace(lower({sql_trim("coalesce(x, '')")}), '[\\s-]+', '_', 'g') as p from ({cells(LABELS)}) t) q""")
def policy_normalize(spark, sf_dir):
    return of_orders(spark, sf_dir, cells(LABELS)).select("k", guard.policy(F.col("x")).alias("policy"))


@query(f"select k, regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]', '', 'g') as header from ({cells(HEADERS)}) t")
def header_normalize(spark, sf_dir):
    return of_orders(spark, sf_dir, cells(HEADERS)).select("k", V.normal_key(F.col("x")).alias("header"))


@query("""select k, concat(case when i >= 702 then chr(cast(65 + ((i // 26 - 1) // 26 - 1) % 26 as int)) else '' end, case when i >= 26 then chr(cast(65 + (i // 26 - 1) % 26 as int)) else '' end, chr(cast(65 + i % 26 as int))) as letter
  from (select o_orderkey as k, o_orderkey % 18000 as i from orders) t""")
def column_letter(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), V.column_letter(F.col("o_orderkey") % 18000).alias("letter"))


# Lookups and cell fill.
def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderkey) n from orders) q where n = 1")
def source_lookup_first(spark, sf_dir):
    return keyed.one_per_key(_orders(spark, sf_dir), "o_custkey", "o_orderkey")


@query("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) n from orders) q where n = 1")
def source_lookup_last(spark, sf_dir):
    return keyed.one_per_key(_orders(spark, sf_dir), "o_custkey", "o_orderkey", "last")


_FILL = CTE("fx_captain") + ", j as (select c.sheet, c.sheet_row, c.resident_id as identity, " + ", ".join(f"c.{c} as t_{c}, m.{c} as s_{c}" for c in COLUMNS) + " from fx_captain c join fx_master m on c.resident_id = m.resident_id)"
_SUMMARY = "count(*) filter (action = 'fill') as filled, count(*) filter (action = 'overwrite') as overwritten, count(*) filter (action = 'conflict') as conflicts, count(*) filter (action = 'skip') as skipped, count(distinct case when will_write then identity end) as identities"


@query(_FILL + " " + sql_changes("j", COLUMNS, RULES, "fill_blank", PLANNED))
def cell_fill_plan(spark, sf_dir):
    return fill.plan(captain(spark, sf_dir), master(spark, sf_dir), "resident_id", "resident_id", COLUMNS, "src_row", RULES)


@query(f"{_FILL} select sheet, {_SUMMARY} from ({sql_changes('j', COLUMNS, RULES, 'fill_blank', PLANNED)}) p group by sheet")
def cell_fill_summary(spark, sf_dir):
    return fill.summary(cell_fill_plan(spark, sf_dir))


_SALES = {"latest_sale_date": "sale_date", "latest_sale_price": "sale_price"}
_LEGACY = CTE("fx_master", "fx_sales") + ", j as (select 'master' as sheet, m.src_row as sheet_row, m.resident_id as identity, '' as t_sale_date, cast(s.latest_sale_date as varchar) as s_latest_sale_date, case when m.c_custkey % 2 = 0 then s.latest_sale_price else '' end as t_sale_price, s.latest_sale_price as s_latest_sale_price from fx_master m join fx_sales s on m.apn = s.apn where m.apn <> '')"


@query(f"{_LEGACY} select sheet, sheet_row, identity, \"column\", existing, incoming, policy, case when action = 'conflict' and existing = '' then 'fill' else action end as action from ({sql_changes('j', _SALES, {'sale_date': 'conflict'}, 'fill_blank', 'true')}) p")
def cell_fill_legacy(spark, sf_dir):
    sales = fx(spark, sf_dir, "fx_sales").withColumn("latest_sale_date", F.col("latest_sale_date").cast("string")).withColumn("n", F.col("apn"))
    target = master(spark, sf_dir).withColumns({"sheet": F.lit("master"), "sheet_row": F.col("src_row")})
    prices = sales.select(F.col("apn").alias("_apn"), F.col("latest_sale_price").alias("_price"))
    target = target.join(prices, F.col("apn") == F.col("_apn"), "left").withColumn("sale_price", F.when(F.col("c_custkey") % 2 == 0, F.coalesce("_price", F.lit(""))).otherwise(""))
    plan = fill.plan(target, sales, "apn", "apn", _SALES, "n", {"sale_date": "conflict"}, all_cells=True)
    ids = target.select("sheet_row", F.col("resident_id").alias("id"))
    return fill.plan_with_policies_of_old(plan).join(ids, "sheet_row").select("sheet", "sheet_row", F.col("id").alias("identity"), "column", "existing", "incoming", "policy", "action")


@query(CTE("fx_master", "fx_sales") + " select apn, latest_sale_price from fx_sales s where not exists (select 1 from fx_master m where m.apn = s.apn)")
def unmatched_source(spark, sf_dir):
    return fill.unmatched(fx(spark, sf_dir, "fx_sales"), master(spark, sf_dir), "apn", "apn").select("apn", "latest_sale_price")


_MODE = "modes as (select sheet, zone, n from (select sheet, zone, count(*) n, row_number() over (partition by sheet order by count(*) desc, min(sheet_row)) r from fx_captain where zone <> '' group by sheet, zone) q where r = 1)"


@query(CTE("fx_captain") + f", {_MODE} select sheet, zone, n from modes")
def zone_detect(spark, sf_dir):
    return keyed.mode(captain(spark, sf_dir), "zone", "sheet_row")


# Rosters: push, pull, screening.
_PUSH = CTE("fx_captain") + f""", {_MODE}, w as (select d.sheet, m.resident_id, m.zone, m.src_row as master_row, m.phone, m.email, c.resident_id is not null as here
  from modes d join fx_master m on m.zone = d.zone left join (select distinct sheet, resident_id from fx_captain) c on c.sheet = d.sheet and c.resident_id = m.resident_id)"""


@query(_PUSH + " select sheet, resident_id, zone, master_row, case when here then 'skip' else 'append' end as action, case when here then 'on the sheet already' else '' end as reason from w")
def push_missing(spark, sf_dir):
    return pull.push_missing(master(spark, sf_dir), captain(spark, sf_dir)).drop("flags")


@query(_PUSH + " select sheet, resident_id, concat_ws(', ', case when phone <> '' then 'phone' end, case when email <> '' then 'email' end) as flags from w where not here and (phone <> '' or email <> '')")
def push_missing_flagged(spark, sf_dir):
    out = pull.push_missing(master(spark, sf_dir), captain(spark, sf_dir), sensitive=("phone", "email"))
    return out.filter("flags <> ''").select("sheet", "resident_id", "flags")


_PULL_FROM = "(select *, row_number() over (partition by sheet, resident_id order by sheet_row) r from fx_captain)"
_PULL = CTE("fx_captain") + ", j as (select c.sheet, c.sheet_row, c.resident_id as identity, " + ", ".join(f"m.{c} as t_{c}, c.{c} as s_{c}" for c in COLUMNS) + f" from {_PULL_FROM} c join fx_master m on c.resident_id = m.resident_id where r = 1)"
_PULLED = sql_changes("j", COLUMNS, RULES, "conflict", PLANNED)


@query(f"{_PULL} {_PULLED}")
def pull_plan(spark, sf_dir):
    return pull.pull_changes(master(spark, sf_dir), captain(spark, sf_dir), COLUMNS, RULES)


@query(f"{_PULL} select sheet, {_SUMMARY} from ({_PULLED}) p group by sheet")
def pull_summary(spark, sf_dir):
    return fill.summary(pull_plan(spark, sf_dir))


_DOUBLED = "fx_double as (select resident_id, src_row from fx_master union all select resident_id, src_row + 1000000 from fx_master where c_custkey % 37 = 0)"


@query(CTE("fx_captain") + f""", {_DOUBLED}, n as (select resident_id, count(*) n from fx_double group by resident_id), q as (select c.sheet, c.sheet_row, c.resident_id as identity,
  case when c.r > 1 then 'later row of its id' when n.n is null then 'not on the master' when n.n > 1 then 'on several rows of the master' end as reason
  from {_PULL_FROM} c left join n on n.resident_id = c.resident_id) select * from q where reason is not null""")
def pull_ambiguous(spark, sf_dir):
    m = master(spark, sf_dir)
    doubled = m.unionByName(m.filter("c_custkey % 37 = 0").withColumn("src_row", F.col("src_row") + 1000000))
    return pull.pull_skips(doubled, captain(spark, sf_dir))


@query(f"""{_PULL}, l as (select sheet, line, substr(sha256(line), 1, 3) as part from (select sheet, concat(identity, chr(9), "column", chr(9), incoming) as line from ({_PULLED}) p where will_write) q),
  d as (select sheet, part, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as digest from l group by sheet, part)
  select sheet, cast(sum(n) as bigint) as n, sha256(string_agg(digest, chr(10) order by part)) as fingerprint from d group by sheet""")
def pull_fingerprint(spark, sf_dir):
    return pull.fingerprint(pull_plan(spark, sf_dir), "sheet")


def _plain(e: str) -> str:
    return f"regexp_replace(lower({e}), '[^a-z0-9]', '', 'g')"


_KEYS = f"nullif({_plain('resident_name')}, '') nk1, nullif({_plain('email')}, '') ek1, case when {_plain('resident_name')} <> '' and {_plain('apn')} <> '' then concat({_plain('resident_name')}, '|', {_plain('apn')}) end np1"


@query(CTE("fx_captain") + f""", m as (select resident_id, src_row, {_KEYS} from fx_master), s as (select * from (select *, row_number() over (partition by sheet, resident_id order by sheet_row) r, {_KEYS} from fx_captain where resident_id not in (select resident_id from fx_master)) q where r = 1),
  a as (select np1, arg_min(resident_id, src_row) id from m where np1 is not null group by np1), b as (select ek1, arg_min(resident_id, src_row) id from m where ek1 is not null group by ek1), c as (select nk1, arg_min(resident_id, src_row) id from m where nk1 is not null group by nk1),
  j as (select s.*, a.id mnp, b.id me, c.id mn, case when s.np1 is not null and row_number() over (partition by s.sheet, s.np1 order by s.sheet_row) > 1 then first_value(s.resident_id) over (partition by s.sheet, s.np1 order by s.sheet_row) end bnp,
    case when s.ek1 is not null and row_number() over (partition by s.sheet, s.ek1 order by s.sheet_row) > 1 then first_value(s.resident_id) over (partition by s.sheet, s.ek1 order by s.sheet_row) end be
    from s left join a on a.np1 = s.np1 left join b on b.ek1 = s.ek1 left join c on c.nk1 = s.nk1)
  select sheet, sheet_row, resident_id, case when mnp is not null or me is not null or bnp is not null or be is not null then 'likely' when mn is not null then 'possible' else 'none' end as risk, coalesce(mnp, me, bnp, be, mn, '') as matched_id from j""")
def new_residents(spark, sf_dir):
    return pull.new_residents(master(spark, sf_dir), captain(spark, sf_dir)).select("sheet", "sheet_row", "resident_id", "risk", "matched_id")


@query(CTE("fx_captain") + " select sheet, sheet_row, resident_id, phone from (select *, row_number() over (partition by resident_id order by sheet, sheet_row) r from fx_captain) q where r = 1")
def pull_folder_first_wins(spark, sf_dir):
    return pull.first_wins(captain(spark, sf_dir)).select("sheet", "sheet_row", "resident_id", "phone")


_WINS = "fx_wins as (select * from (select *, row_number() over (partition by resident_id order by sheet, sheet_row) r from fx_captain) q where r = 1)"
_FOLDER = CTE("fx_captain") + f", {_WINS}, j as (select c.sheet, c.sheet_row, c.resident_id as identity, " + ", ".join(f"m.{c} as t_{c}, c.{c} as s_{c}" for c in COLUMNS) + " from fx_wins c join fx_master m on c.resident_id = m.resident_id)"


@query(f"{_FOLDER} {sql_changes('j', COLUMNS, RULES, 'conflict', PLANNED)}")
def pull_folder_changes(spark, sf_dir):
    return pull.pull_folder(master(spark, sf_dir), captain(spark, sf_dir), COLUMNS, RULES)[0]


@query(CTE("fx_captain") + f", {_WINS}, n as (select * from fx_wins where resident_id not in (select resident_id from fx_master)) select sheet, sheet_row, resident_id, (select max(src_row) from fx_master) + row_number() over (order by sheet, sheet_row) as src_row from n")
def pull_folder_appends(spark, sf_dir):
    return pull.pull_folder(master(spark, sf_dir), captain(spark, sf_dir), COLUMNS, RULES)[1].select("sheet", "sheet_row", "resident_id", "src_row")


@query(CTE("fx_captain") + f""", m as (select min(resident_id) id, {_plain('resident_name')} nm from fx_master group by {_plain('resident_name')}) select c.sheet, c.sheet_row, c.resident_id as identity, case when m.id is null then 'not on the master' else 'name under another id' end as verdict, coalesce(m.id, '') as matched_id
  from fx_captain c left join m on m.nm = {_plain('c.resident_name')} where c.resident_id not in (select resident_id from fx_master)""")
def unmatched_verdicts(spark, sf_dir):
    return pull.verdicts(master(spark, sf_dir), captain(spark, sf_dir))


@query(f"{_FILL} select * from (select sheet, filled + overwritten + conflicts as weight from (select sheet, {_SUMMARY} from ({sql_changes('j', COLUMNS, RULES, 'fill_blank', PLANNED)}) p group by sheet) s) w where weight > 0")
def sheets_by_weight(spark, sf_dir):
    return fill.busiest(cell_fill_summary(spark, sf_dir)).select("sheet", "weight")


# Audit.
_MISSING = f"""{_MODE}, missing as (select d.sheet, d.zone, m.resident_id, m.resident_name, trim(concat(m.house, ' ', m.street)) as address, m.src_row as master_row from modes d join fx_master m on m.zone = d.zone where not exists (select 1 from fx_captain c where c.sheet = d.sheet and c.resident_id = m.resident_id))"""
_EXTRA = """extra as (select c.sheet, c.sheet_row, d.zone, c.resident_id, c.resident_name, c.address, case when m.resident_id is null then 'Not in master' else 'Wrong zone' end as reason, case when m.resident_id is null then '' when m.zone = '' then '(unassigned)' else m.zone end as other_zone
  from (select sheet, resident_id, max(sheet_row) sheet_row, arg_max(resident_name, sheet_row) resident_name, arg_max(trim(concat(house, ' ', street)), sheet_row) address from fx_captain group by sheet, resident_id) c join modes d on d.sheet = c.sheet left join fx_master m on m.resident_id = c.resident_id where m.zone is null or m.zone <> d.zone)"""
_APN = """grouped as (select sheet, lower(concat(house, ' ', street)) k, arg_min(concat(house, ' ', street), sheet_row) as address, count(*) as data_rows, count(*) filter (apn <> '') as with_apn, count(*) filter (apn = '') as without_apn,
  coalesce(string_agg(distinct apn, ', ' order by apn) filter (apn <> ''), '') as apns, string_agg(cast(sheet_row as varchar), ', ' order by sheet_row) as sheet_rows, count(distinct apn) filter (apn <> '') as n_apns from fx_captain where house <> '' and street <> '' group by sheet, lower(concat(house, ' ', street))),
  inconsistent as (select sheet, address, data_rows, with_apn, without_apn, apns, sheet_rows, concat_ws(' + ', case when with_apn > 0 and without_apn > 0 then 'Mixed completeness' end, case when n_apns > 1 then 'Multiple APNs' end) as reason from grouped where data_rows >= 2 and ((with_apn > 0 and without_apn > 0) or n_apns > 1))"""
_OVERVIEW = f"""{CTE("fx_captain")}, {_MISSING}, {_EXTRA}, {_APN}, overview as (select s.sheet, s.data_rows, s.apn_values, s.damage_values, coalesce(a.n, 0) as addresses_missing_apn, coalesce(d.zone, '') as zone, coalesce(i.n, 0) as apn_inconsistent, coalesce(m.n, 0) as missing_rows,
  coalesce(e.a, 0) as extra_not_in_master, coalesce(e.b, 0) as extra_wrong_zone, 'Missing Columns' as status
  from (select sheet, count(*) as data_rows, count(*) filter (apn <> '') as apn_values, count(*) filter (damage <> '') as damage_values from fx_captain group by sheet) s left join modes d on d.sheet = s.sheet
  left join (select sheet, count(*) n from grouped where without_apn > 0 group by sheet) a on a.sheet = s.sheet left join (select sheet, count(*) n from inconsistent group by sheet) i on i.sheet = s.sheet left join (select sheet, count(*) n from missing group by sheet) m on m.sheet = s.sheet
  left join (select sheet, count(*) filter (reason = 'Not in master') a, count(*) filter (reason = 'Wrong zone') b from extra group by sheet) e on e.sheet = s.sheet)"""


@query(_OVERVIEW + " select * from overview")
def audit_overview(spark, sf_dir):
    return audit.overview(master(spark, sf_dir), captain(spark, sf_dir), NAMES)


_OWN = ["zone", "resident_id", "resident_name", "apn", "house", "street", "phone", "damage", "email"]


@query(CTE("fx_captain") + " " + " union all ".join(f"select sheet, '{c}' as \"column\", '{chr(65 + k)}' as letter, true as in_master, count(*) filter ({c} <> '') as non_blank, count(*) as data_rows from fx_captain group by sheet" for k, c in enumerate(_OWN)))
def audit_column_detail(spark, sf_dir):
    return audit.column_detail(captain(spark, sf_dir), _OWN, MASTER_HEADERS)


@query(CTE("fx_captain") + " select c.resident_id, case when n.lo = n.hi then 'Within sheet' else 'Across sheets' end as scope, n.n as occurrences, c.sheet, c.sheet_row from fx_captain c join (select resident_id, count(*) n, min(sheet) lo, max(sheet) hi from fx_captain group by resident_id having count(*) > 1) n on n.resident_id = c.resident_id")
def audit_duplicates(spark, sf_dir):
    return audit.duplicates(captain(spark, sf_dir))


@query(CTE("fx_captain") + f", {_MISSING} select * from missing")
def audit_missing(spark, sf_dir):
    return audit.missing_rows(master(spark, sf_dir), captain(spark, sf_dir))


@query(CTE("fx_captain") + f", {_MODE}, {_EXTRA} select * from extra")
def audit_extra(spark, sf_dir):
    return audit.extra_rows(master(spark, sf_dir), captain(spark, sf_dir))


@query(CTE("fx_captain") + " select sheet, sheet_row, resident_id, phone as house, email as street, concat_ws(', ', case when phone = '' then 'house' end, case when email = '' then 'street' end) as missing from fx_captain where phone = '' or email = ''")
def audit_missing_situs(spark, sf_dir):
    return audit.missing_situs(captain(spark, sf_dir), audit.Names(situs_house="phone", situs_street="email"))


@query(CTE("fx_captain") + f", {_APN} select * from inconsistent")
def audit_apn(spark, sf_dir):
    return audit.apn_inconsistencies(captain(spark, sf_dir))


@query(_OVERVIEW + """ select count(*) as sheets_scanned, cast(0 as bigint) as sheets_matching, count(*) as sheets_with_drift, cast(sum(data_rows) as bigint) as total_data_rows, cast(sum(addresses_missing_apn) as bigint) as addresses_missing_apn, cast(sum(apn_inconsistent) as bigint) as apn_inconsistencies,
  cast(sum(missing_rows) as bigint) as missing_rows, cast(sum(extra_not_in_master) as bigint) as extra_not_in_master, cast(sum(extra_wrong_zone) as bigint) as extra_wrong_zone,
  (select count(*) from (select resident_id from fx_captain group by resident_id having count(*) > 1) q) as duplicate_ids, (select count(*) from fx_captain where house = '' or street = '') as missing_situs from overview""")
def audit_summary(spark, sf_dir):
    return audit.summary(master(spark, sf_dir), captain(spark, sf_dir), NAMES)


# Zones.
def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = fx(spark, sf_dir, "fx_zones")
    c = F.col
    rings = F.array_compact(F.array(zones.box(c("x0"), c("y0"), c("x1"), c("y1")), F.when(c("hx0").isNotNull(), zones.box(c("hx0"), c("hy0"), c("hx1"), c("hy1")))))
    return z.select("ordinal", "zone", "contact_name", F.array(rings).alias("geometry"))


_HITS = CTE("fx_master", "fx_zone_hits")
_FIRST = "firsts as (select src_row, min(ordinal) as ordinal, count(*) as n_zones from fx_zone_hits group by src_row)"
_RECONCILED = f"""{_HITS}, {_FIRST}, rec as (select m.src_row as master_row, m.resident_id, case when m.lat is null or m.lon is null then 'missing_coords' when f.ordinal is null then 'unassigned' when m.zone = '' then 'fill' when m.zone = z.zone then 'match' else 'conflict' end as outcome,
  m.zone as current_zone, coalesce(z.zone, '') as computed_zone, coalesce(f.n_zones, 0) > 1 as multi_zone, cast(case when z.zone is null then 0 else 1 end as int) as contact_updates, z.contact_name from fx_master m left join firsts f on f.src_row = m.src_row left join fx_zones z on z.ordinal = f.ordinal)"""


@query(_HITS + " select resident_id, ordinal, computed_zone from fx_zone_hits")
def zone_join_all(spark, sf_dir):
    return zones.hits(master(spark, sf_dir), polygons(spark, sf_dir)).select("resident_id", "z.ordinal", F.col("z.zone").alias("computed_zone"))


@query(_HITS + f", {_FIRST} select m.resident_id, f.ordinal, f.n_zones from fx_master m left join firsts f on f.src_row = m.src_row")
def zone_join_first(spark, sf_dir):
    m = master(spark, sf_dir)
    return m.select("src_row", "resident_id").join(zones.first_hit(m, polygons(spark, sf_dir), "src_row"), "src_row", "left").select("resident_id", "z.ordinal", "n_zones")


def _reconciled(spark, sf_dir):
    return zones.reconcile(master(spark, sf_dir), polygons(spark, sf_dir), {"zone": "zone"})


@query(_RECONCILED + " select master_row, resident_id, outcome, current_zone, computed_zone, multi_zone, contact_updates from rec")
def zone_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir).drop("now", "new")


@query(_RECONCILED + """ select master_row, resident_id, outcome from (select *, row_number() over (order by case outcome when 'conflict' then 1 when 'fill' then 2 when 'unassigned' then 3 when 'missing_coords' then 4 else 5 end, case when multi_zone then 0 else 1 end, master_row) r
  from rec where not (outcome = 'match' and contact_updates = 0 and not multi_zone)) q where r <= 250""")
def zone_detail(spark, sf_dir):
    return zones.detail(_reconciled(spark, sf_dir)).select("master_row", "resident_id", "outcome")


@query(_RECONCILED + """ select count(*) as total_rows, count(*) filter (outcome <> 'missing_coords') as with_coordinates, count(*) filter (outcome = 'missing_coords') as missing_coords, count(*) filter (outcome = 'unassigned') as unassigned, count(*) filter (outcome = 'match') as matched, count(*) filter (outcome = 'fill') as would_fill,
  count(*) filter (outcome = 'conflict') as would_change, count(*) filter (contact_updates > 0) as contact_updates, count(*) filter (multi_zone) as multi_zone, count(distinct nullif(current_zone, '')) as zones_in_master, count(distinct nullif(computed_zone, '')) as zones_computed from rec""")
def zone_summary(spark, sf_dir):
    return zones.summary(_reconciled(spark, sf_dir))


@query(_RECONCILED + " select master_row as sheet_row, resident_id as identity, 'zone' as \"column\", computed_zone as incoming from rec where computed_zone <> '' and current_zone = '' union all select master_row, resident_id, 'contact_name', contact_name from rec where computed_zone <> ''")
def zone_enrichment(spark, sf_dir):
    return zones.enrichment(_reconciled(spark, sf_dir)).select("sheet_row", "identity", "column", "incoming")


@query(_RECONCILED.replace(_HITS, CTE("fx_captain", "fx_zone_hits"), 1) + """, s as (select c.sheet_row, c.resident_id, r.outcome, r.multi_zone, r.computed_zone from fx_captain c left join rec r on r.resident_id = c.resident_id where c.sheet = 'Captain 7'),
  q as (select resident_id, sheet_row, case when outcome is null or outcome = 'missing_coords' then 'no coordinates' when outcome = 'unassigned' then 'in no zone' when multi_zone then 'in several zones' else '' end as reason, coalesce(computed_zone, '') as computed_zone from s)
  select resident_id, sheet_row, case when reason = '' then 'move' else 'skip' end as action, reason, computed_zone from q where reason <> '' or computed_zone = 'Zone 8'""")
def zone_moves(spark, sf_dir):
    sheet = captain(spark, sf_dir).filter("sheet = 'Captain 7'")
    return zones.moves(sheet, master(spark, sf_dir), polygons(spark, sf_dir), "Zone 8")


# Guarded plans and undo.
_TARGET = f"{_DOUBLED}, tn as (select resident_id, count(*) n from fx_double group by resident_id)"
_PROPOSALS = """props as (select c_custkey as proposal_id, case when c_custkey % 41 = 0 then '' when c_custkey % 43 = 0 then concat('X', cast(c_custkey as varchar(40))) when c_custkey % 47 = 0 then concat('R', cast(c_custkey - 1 as varchar(40))) else resident_id end as identity,
  case when c_custkey % 19 = 0 then 'nothing' when c_custkey % 23 = 0 then 'resident_id' else 'phone' end as "column", case when c_custkey % 7 = 0 then phone else concat('777-', cast(c_custkey as varchar(40))) end as incoming, case c_custkey % 4 when 0 then 'fill_blank' when 1 then 'overwrite' when 2 then 'conflict' else 'never' end as policy from fx_master)"""


def _doubled(spark, sf_dir):
    m = master(spark, sf_dir)
    return m.unionByName(m.filter("c_custkey % 37 = 0").withColumn("src_row", F.col("src_row") + 1000000))


def _spark_ctes(sql: str) -> str:
    return sql.replace('"column"', "column")


def _proposals(spark, sf_dir):
    paths = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in fixtures.TABLES}
    return spark.sql(f"{fixtures.ctes('fx_master', tables=paths)}, {_spark_ctes(_PROPOSALS)} select * from props")


@query(CTE("fx_master") + f""", {_TARGET}, {_PROPOSALS}, q as (select p.*, tn.n, case p."column" when 'phone' then m.phone when 'resident_id' then m.resident_id end as existing, p.identity <> '' and row_number() over (partition by p.identity, p."column" order by proposal_id) > 1 as again
  from props p left join tn on tn.resident_id = p.identity left join fx_master m on m.resident_id = p.identity),
  r as (select *, case when identity = '' then 'no resident_id' when n is null then 'resident_id not in the target' when n > 1 then 'resident_id on several rows of the target' when "column" = 'nothing' then 'no such column in the target'
    when again then 'cell proposed before' end as bad, case when "column" = 'resident_id' then 'never' else policy end as rule from q)
  select proposal_id, identity, "column", existing, incoming, case when bad is not null then 'skip' else {sql_decide('existing', 'incoming', 'rule')} end as action, coalesce(bad, {sql_decide('existing', 'incoming', 'rule', 'reason')}) as reason from r""")
def guarded_writes(spark, sf_dir):
    return live.writes(_doubled(spark, sf_dir), _proposals(spark, sf_dir))


_IDS = """ids as (select c_custkey as proposal_id, case when c_custkey % 41 = 0 then '' when c_custkey % 2 = 0 then concat('N', cast(c_custkey - c_custkey % 10 as varchar(40))) else resident_id end as identity, phone, email from fx_master)"""


def _ids(spark, sf_dir):
    paths = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in fixtures.TABLES}
    return spark.sql(f"{fixtures.ctes('fx_master', tables=paths)}, {_IDS} select * from ids")


@query(CTE("fx_master") + f""", {_IDS}, q as (select i.*, m.resident_id is not null as here, i.identity <> '' and row_number() over (partition by i.identity order by proposal_id) > 1 as again from ids i left join fx_master m on m.resident_id = i.identity)
  select proposal_id, identity, case when identity = '' or here or again then 'skip' else 'append' end as action, case when identity = '' then 'no resident_id' when here or again then 'resident_id in the target already' else '' end as reason,
  case when phone = '' then 0 else 1 end + case when email = '' then 0 else 1 end + case when identity = '' then 0 else 1 end as n_cells from q""")
def guarded_appends(spark, sf_dir):
    rows = _ids(spark, sf_dir).withColumn("resident_id", F.col("identity")).drop("identity")
    return live.appends(master(spark, sf_dir), rows).select("proposal_id", "identity", "action", "reason", F.size("cells").alias("n_cells"))


@query(CTE("fx_master") + f""", {_TARGET}, {_IDS}, q as (select i.*, tn.n, i.identity <> '' and row_number() over (partition by i.identity order by proposal_id) > 1 as again from ids i left join tn on tn.resident_id = i.identity),
  r as (select *, case when identity = '' then 'no resident_id' when again then 'delete proposed before' when n is null then 'resident_id not in the target' when n > 1 then 'resident_id on several rows of the target' else '' end as reason from q)
  select proposal_id, identity, case when reason = '' then 'delete' else 'skip' end as action, reason from r""")
def guarded_deletes(spark, sf_dir):
    return live.deletes(_doubled(spark, sf_dir), _ids(spark, sf_dir).select("proposal_id", "identity")).drop("row")


@query(CTE("fx_captain") + f""", {_IDS}, f as (select * from fx_captain where sheet = 'Captain 5'), t as (select distinct resident_id from fx_captain where sheet = 'Captain 6'), fn as (select resident_id, count(*) n, arg_min(phone, sheet_row) phone from f group by resident_id),
  q as (select i.proposal_id, i.identity, fn.n, fn.phone as own, t.resident_id is not null as there, i.identity <> '' and row_number() over (partition by i.identity order by proposal_id) > 1 as again from ids i left join fn on fn.resident_id = i.identity left join t on t.resident_id = i.identity),
  r as (select *, case when identity = '' then 'no resident_id' when again then 'move proposed before' when n is null then 'resident_id not on the source sheet' when n > 1 then 'resident_id on several rows of the source sheet' when there then 'resident_id on the destination sheet already' else '' end as reason from q)
  select proposal_id, identity, case when reason = '' then 'move' else 'skip' end as action, reason, 'Zone 6' as zone, coalesce(own, '') as phone from r""")
def guarded_moves(spark, sf_dir):
    c = captain(spark, sf_dir)
    out = live.moves(c.filter("sheet = 'Captain 5'"), c.filter("sheet = 'Captain 6'"), _ids(spark, sf_dir).select("proposal_id", "identity"), {"zone": "Zone 6"})
    return out.select("proposal_id", "identity", "action", "reason", F.try_element_at("cells", F.lit("zone")).alias("zone"), F.try_element_at("cells", F.lit("phone")).alias("phone"))


def _edited(spark, sf_dir):
    """The master as it stands after the run that the snapshots are of."""
    now = fx(spark, sf_dir, "fx_cell_snapshots").select(F.col("resident_id").alias("_id"), "current_value")
    m = master(spark, sf_dir)
    return m.join(now, F.col("resident_id") == F.col("_id"), "left").withColumn("phone", F.coalesce("current_value", "phone")).select(*m.columns)


@query(CTE("fx_cell_snapshots") + f""", q as (select *, {sql_key('current_value')} kc, {sql_key('before_value')} kb, {sql_key('after_value')} ka from fx_cell_snapshots)
  select snapshot_id, resident_id as identity, column_name as "column", before_value as before, case when kc = kb then 'skip' when kc <> ka then 'conflict' else 'restore' end as action,
  case when kc = kb then 'cell is as before the run' when kc <> ka then 'cell was edited after the run' else '' end as reason from q""")
def cell_revert(spark, sf_dir):
    snaps = fx(spark, sf_dir, "fx_cell_snapshots").select("snapshot_id", F.col("resident_id").alias("identity"), F.col("column_name").alias("column"), F.col("before_value").alias("before"), F.col("after_value").alias("after"))
    return live.revert_cells(_edited(spark, sf_dir), snaps)


_ROWS = "rows_ as (select c_custkey as snapshot_id, case when c_custkey % 10 = 0 then concat('G', cast(c_custkey as varchar(40))) else resident_id end as identity, case when c_custkey % 9 = 0 then 'changed' else phone end as phone from fx_master where c_custkey % 3 = 0)"


def _row_snapshots(spark, sf_dir):
    m = master(spark, sf_dir).filter("c_custkey % 3 = 0")
    ident = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("G"), F.col("c_custkey").cast("string"))).otherwise(F.col("resident_id"))
    cells = F.create_map(*[x for c in ("resident_id", "phone") for x in (F.lit(c), F.when((F.col("c_custkey") % 9 == 0) & F.lit(c == "phone"), "changed").otherwise(F.col(c)))])
    return m.select(F.col("c_custkey").alias("snapshot_id"), ident.alias("identity"), cells.alias("cells"))


_STATE = "left join tn on tn.resident_id = r.identity left join fx_master m on m.resident_id = r.identity"


@query(CTE("fx_master") + f""", {_TARGET}, {_ROWS}, q as (select r.*, tn.n, {sql_key('m.phone')} = {sql_key('r.phone')} as same from rows_ r {_STATE}) select snapshot_id, identity, case when n is null then 'skip' when n > 1 or not same then 'conflict' else 'delete' end as action,
  case when n is null then 'appended row is gone' when n > 1 then 'resident_id on several rows' when not same then 'row was edited after the run' else '' end as reason from q""")
def append_revert(spark, sf_dir):
    return live.revert_appends(_doubled(spark, sf_dir).select("resident_id", "phone", "src_row"), _row_snapshots(spark, sf_dir))


@query(CTE("fx_master") + f""", {_TARGET}, {_ROWS}, q as (select r.*, tn.n, {sql_key('m.phone')} = {sql_key('r.phone')} as same from rows_ r {_STATE}) select snapshot_id, identity, case when n is null then 'append' when n > 1 or not same then 'conflict' else 'skip' end as action,
  case when n is null then '' when n > 1 then 'resident_id on several rows; not restored' when not same then 'row is back with other values' else 'row is back as it was' end as reason from q""")
def row_restore(spark, sf_dir):
    return live.restore_rows(_doubled(spark, sf_dir).select("resident_id", "phone", "src_row"), _row_snapshots(spark, sf_dir))


# Ledger.
@query(CTE("fx_log") + " select run_id, entry_type, count(*) as n from fx_log group by run_id, entry_type")
def log_type_counts(spark, sf_dir):
    return ledger.type_counts(fx(spark, sf_dir, "fx_log"))


@query(CTE("fx_log") + " select cast(run_id as varchar) as run_id, count(*) as n, count(*) filter (entry_id % 3 <> 0) as cells, count(*) filter (entry_id % 3 = 0) as rows, count(*) filter (entry_id % 5 <> 0) as remaining from fx_log group by run_id")
def snapshot_counts(spark, sf_dir):
    snaps = fx(spark, sf_dir, "fx_log").select(F.col("run_id").cast("string").alias("run_id"), F.col("entry_id").alias("snapshot_id"), F.when(F.col("entry_id") % 3 == 0, "row_append").otherwise("cell_update").alias("operation"))
    return ledger.snapshot_counts(snaps, snaps.filter("snapshot_id % 5 = 0"))


@query(CTE("fx_log") + " select entry_id, run_id, entry_type from fx_log order by entry_id desc limit 500 offset 1000")
def log_page(spark, sf_dir):
    return ledger.page(fx(spark, sf_dir, "fx_log").select("entry_id", "run_id", "entry_type"), [F.col("entry_id").desc()], 500, 1000)


@query(CTE("fx_log") + """ select c.c_custkey as run_id, count(l.entry_id) filter (l.entry_type = 'click') as n_click, count(l.entry_id) filter (l.entry_type = 'purchase') as n_purchase, count(l.entry_id) as n_entries from customer c left join fx_log l on l.run_id = c.c_custkey group by c.c_custkey""")
def runs_with_counts(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"))
    return ledger.runs_with_counts(runs, fx(spark, sf_dir, "fx_log"), kinds=("click", "purchase"))


@query(CTE("fx_log") + " select l.entry_id, l.run_id, c.c_name as workflow from fx_log l join customer c on c.c_custkey = l.run_id where l.entry_id % 11 = 0")
def conflicts_join(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("workflow"))
    log = fx(spark, sf_dir, "fx_log").filter("entry_id % 11 = 0").select("entry_id", "run_id")
    return ledger.conflicts_of(log, runs, ["workflow"]).select("entry_id", "run_id", "workflow")


@query(f"{_PULL}, conf as (select * from ({_PULLED}) p where action = 'conflict'), " + """o as (select sheet, identity, "column", existing, incoming, case when sheet_row % 2 = 0 then 'open' else 'resolved' end as status from conf where sheet_row % 3 <> 0),
  n as (select sheet, identity, "column", existing, concat(incoming, '!') as incoming from conf where sheet_row % 5 <> 0)
  select coalesce(o.sheet, n.sheet) as sheet, coalesce(o.identity, n.identity) as identity, coalesce(o."column", n."column") as "column", coalesce(n.existing, o.existing) as existing, coalesce(n.incoming, o.incoming) as incoming,
  case when n.sheet is not null then 'open' else o.status end as status, case when o.sheet is null then 'added' when n.sheet is not null then 'updated' else 'kept' end as change from o full join n on o.sheet = n.sheet and o.identity = n.identity and o."column" = n."column" """)
def conflict_upsert(spark, sf_dir):
    conf = pull_plan(spark, sf_dir).filter("action = 'conflict'")
    old = conf.filter("sheet_row % 3 <> 0").select("sheet", "identity", "column", "existing", "incoming", F.when(F.col("sheet_row") % 2 == 0, "open").otherwise("resolved").alias("status"))
    new = conf.filter("sheet_row % 5 <> 0").select("sheet", "identity", "column", "existing", F.concat("incoming", F.lit("!")).alias("incoming"))
    return ledger.upsert_conflicts(old, new)


# Roll-up, addresses, export, schema.
@query(CTE("fx_sales") + " select apn, cast(latest_sale_date as varchar) as sale_date, latest_sale_price as sale_price from fx_sales")
def sales_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("APN"), (F.col("o_custkey") - F.col("o_custkey") % 3).cast("string")).alias("apn"), F.struct("o_orderdate", "o_orderkey", "o_totalprice").alias("r"))
    best = o.groupBy("apn").agg(F.max("r").alias("r"))
    return best.select("apn", F.col("r.o_orderdate").cast("date").cast("string").alias("sale_date"), F.floor("r.o_totalprice").cast("long").cast("string").alias("sale_price"))


def _loose(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace(upper(trim({e})), '\\s+', ' ', 'g'), '[.,#]', '', 'g'))"


_PARTS = ("house", "pre", "street", "unit", "city", "state", "zip")
# Each order has a place: spellings of one house, direction, street, unit, city, state and code.
_SPELLED = {
    "house": ["12", "7-Feb", " 12.", "", "0012"], "pre": ["n", "NORTH", "sw", "", "South West", "east"], "street": ["Main st.", "main  STREET", "Oak Park Ave", "Elm Blvd", "", "Broadway", "n. 5th ln"],
    "unit": ["", "#2", "1/2"], "city": ["town", "Town ", "x", ""], "state": ["ca", "CA", ""], "zip": ["90001-1234", "90001", "9", "", "90001-12"],
}
_ADDRESS = "select o_orderkey as k, " + ", ".join(picked(v, f"(o_orderkey + {k} * o_custkey)", n, []) for k, (n, v) in enumerate(_SPELLED.items())) + " from orders"


def _case(e: str, values: dict[str, str]) -> str:
    return f"case {e} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + f" else {e} end"


_STREET = f"case when contains({_loose('street')}, ' ') then concat(regexp_replace({_loose('street')}, '\\S+$', ''), {_case(f'regexp_extract({_loose('street')}, ' + chr(39) + '[^ ]+$' + chr(39) + ')', A.SUFFIXES)}) else {_loose('street')} end"
_ZIP = f"case when regexp_full_match(trim(zip), '\\d{{5}}(-\\d{{4}})?') then left(trim(zip), 5) else {_loose('zip')} end"


@query(f"select k, case when concat(house, pre, street, unit, city, state, zip) = '' then '' else concat_ws('|', {_loose('house')}, {_case(_loose('pre'), A.DIRECTIONS)}, {_STREET}, {_loose('unit')}, {_loose('city')}, {_loose('state')}, {_ZIP}) end as address_key from ({_ADDRESS}) t")
def address_key(spark, sf_dir):
    return of_orders(spark, sf_dir, _ADDRESS).select("k", A.composite(*[F.col(c) for c in _PARTS]).alias("address_key"))


@query(CTE("fx_master") + """, g as (select lower(concat(house, ' ', street)) as "key", count(*) as n_rows, min(src_row) as first_row, coalesce(string_agg(distinct apn, ', ' order by apn) filter (apn <> ''), '') as ids, count(distinct apn) filter (apn <> '') as n from fx_master group by lower(concat(house, ' ', street)))
  select "key", n_rows, first_row, ids, case n when 0 then 'new' when 1 then 'reuse' else 'conflict' end as status, case n when 0 then concat(substr(sha256("key"), 1, 8), '-', substr(sha256("key"), 9, 4), '-4', substr(sha256("key"), 14, 3), '-8', substr(sha256("key"), 18, 3), '-', substr(sha256("key"), 21, 12)) when 1 then ids else '' end as proposed_id from g""")
def address_groups(spark, sf_dir):
    rows = master(spark, sf_dir).withColumn("key", F.lower(F.concat_ws(" ", "house", "street")))
    return address_ids.groups(rows, "key", "apn", "src_row")


@query(CTE("fx_master") + """, c as (select zone, n_rows, contacts from (select zone, count(*) n_rows from fx_master where zone <> '' group by zone) s join (select zone, string_agg(name, ', ' order by o) contacts from (select zone, street as name, min(src_row) o from fx_master where zone <> '' group by zone, street) q group by zone) n using (zone))
  select zone, n_rows, contacts, left(concat(zone, ' - ', contacts), 180) as file_name, 'ok' as status from c""")
def zone_export_manifest(spark, sf_dir):
    rows = master(spark, sf_dir).withColumn("contact", F.concat("street", F.lit("; "), F.lower("street"), F.lit(" ;")))
    return export.manifest(rows, "zone", "contact", "src_row")


@query(CTE("fx_captain") + " " + " union all ".join(f"select sheet, '{c}' as \"column\", count(*) filter ({c} <> '') as non_blank from fx_captain group by sheet" for c in ("phone", "email")))
def schema_delete_impact(spark, sf_dir):
    return schema_ops.delete_impact(captain(spark, sf_dir), ["phone", "email"])


@query(CTE("fx_captain") + " select distinct sheet, 'phone' as \"column\", 'renamed' as status, cast(7 as int) as position from fx_captain")
def schema_rename(spark, sf_dir):
    sheets = [r["sheet"] for r in captain(spark, sf_dir).select("sheet").distinct().collect()]  # a row for each sheet of a folder
    return schema_ops.rename_all(spark, dict.fromkeys(sheets, _OWN), "phone", "telephone")


def queries() -> dict[str, Query]:
    from . import catalogue_runs, catalogue_scale, catalogue_state  # noqa: F401  (registers the queries of applied plans, undo, impacts and full reports, and of scale)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalogue_runs, catalogue_scale, catalogue_state  # noqa: F401

    return dict(SQL)
