"""The fixture views of FIXTURES.md over the driver's tables, in SQL that Spark and DuckDB both read.

A roster (``fx_master``), drifted copies of it (``fx_captain``), an outside feed rolled up (``fx_sales``), polygon stand-ins
(``fx_zones``, ``fx_zone_hits``), undo material (``fx_cell_snapshots``) and a log (``fx_log``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "supplier", "orders", "nation", "events")

VIEWS = {
    "fx_master": """
select cast(c_custkey + 2 as int) src_row, c_custkey, c_nationkey nk,
  concat('R', cast(c_custkey as varchar(40))) resident_id,
  case when c_custkey % 97 = 0 then '' else concat('Zone ', cast(c_nationkey as varchar(40))) end zone,
  c_name resident_name,
  case when c_custkey % 11 = 0 then '' when c_custkey % 31 = 0 then concat('APNX', cast(c_custkey as varchar(40)))
       else concat('APN', cast(c_custkey - c_custkey % 3 as varchar(40))) end apn,
  cast(c_custkey - c_custkey % 3 as varchar(40)) house, c_mktsegment street,
  case when c_custkey % 4 = 0 then '' else concat('555-', cast(c_custkey as varchar(40))) end phone,
  case c_custkey % 5 when 0 then 'Minor' when 1 then 'Major' when 2 then '' when 3 then 'TRUE' else '1.50' end damage,
  case when c_custkey % 2 = 0 then concat('u', cast(c_custkey as varchar(40)), '@example.org') else '' end email,
  case when c_custkey % 53 = 0 then null else cast((c_custkey * 37) % 1000 as double) / 100.0 end lat,
  case when c_custkey % 53 = 0 then null else cast((c_custkey * 53) % 1000 as double) / 100.0 end lon
from {customer}""",
    "fx_captain_raw": """
select case when c_custkey % 17 = 0 then (nk + 1) % 25 else nk end sk, src_row ord, 0 dup,
  resident_id, resident_name, apn, house, street,
  case when c_custkey % 6 = 0 then '' when c_custkey % 10 = 1 then concat('999-', cast(c_custkey as varchar(40)))
       else concat('555-', cast(c_custkey as varchar(40))) end phone,
  case c_custkey % 5 when 0 then 'Minor' when 1 then 'Total' when 2 then 'Minor' when 3 then 'true' else '1.5' end damage,
  email
from fx_master where c_custkey % 13 <> 0
union all
select nk, src_row, 1, resident_id, resident_name, apn, house, street, phone, damage, email
from fx_master where c_custkey % 29 = 0 and c_custkey % 13 <> 0
union all
select s.s_nationkey, cast(1000000 + s.s_suppkey as int), 0, concat('S', cast(s.s_suppkey as varchar(40))), m.resident_name,
  case when s.s_suppkey % 2 = 0 then m.apn else 'APN-NEW' end, m.house, m.street, '', '',
  case when s.s_suppkey % 3 = 0 then m.email else '' end
from {supplier} s join fx_master m on m.c_custkey = s.s_suppkey""",
    "fx_captain": """
select concat('Captain ', cast(sk as varchar(40))) sheet,
  cast(row_number() over (partition by sk order by ord, dup, resident_id) + 1 as int) sheet_row,
  concat('Zone ', cast(sk as varchar(40))) zone, resident_id, resident_name, apn, house, street, phone, damage, email
from fx_captain_raw""",
    "fx_sales": """
select apn, cast(sale_date as date) latest_sale_date, cast(cast(floor(sale_price) as bigint) as varchar(40)) latest_sale_price
from (select concat('APN', cast(o_custkey - o_custkey % 3 as varchar(40))) apn, o_orderdate sale_date, o_totalprice sale_price,
        row_number() over (partition by o_custkey - o_custkey % 3 order by o_orderdate desc, o_orderkey desc) rn
      from {orders}) q where rn = 1""",
    "fx_zones": """
select n_nationkey ordinal, concat('Zone ', cast(n_nationkey as varchar(40))) zone, concat('Contact ', cast(n_nationkey as varchar(40))) contact_name,
  cast(n_nationkey % 5 as double) * 2.0 x0, cast((n_nationkey - n_nationkey % 5) / 5 as double) * 2.0 y0,
  cast(n_nationkey % 5 as double) * 2.0 + 2.0 x1, cast((n_nationkey - n_nationkey % 5) / 5 as double) * 2.0 + 2.0 y1,
  case when n_nationkey = 12 then 4.5 end hx0, case when n_nationkey = 12 then 4.5 end hy0,
  case when n_nationkey = 12 then 5.5 end hx1, case when n_nationkey = 12 then 5.5 end hy1
from {nation}
union all
select 25, 'Zone 24', 'Contact 24', 0.0, 0.0, 1.5, 1.5, null, null, null, null""",
    "fx_zone_hits": """
select m.resident_id, m.src_row, z.ordinal, z.zone computed_zone
from fx_master m join fx_zones z
  on m.lon >= z.x0 and m.lon < z.x1 and m.lat >= z.y0 and m.lat < z.y1
where not (z.hx0 is not null and m.lon >= z.hx0 and m.lon < z.hx1 and m.lat >= z.hy0 and m.lat < z.hy1)""",
    "fx_cell_snapshots": """
select c_custkey snapshot_id, resident_id, 'phone' column_name, phone before_value,
  concat('777-', cast(c_custkey as varchar(40))) after_value,
  case when c_custkey % 7 = 0 then 'edited later' when c_custkey % 5 = 0 then phone
       else concat('777-', cast(c_custkey as varchar(40))) end current_value
from fx_master where c_custkey % 3 = 0""",
    "fx_log": """
select event_id entry_id, user_id run_id, event_type entry_type, ts created_at, value metric from {events}""",
}


def ctes(*names: str, tables: dict[str, str] | None = None) -> str:
    """A WITH clause that defines ``names`` and what they need. ``tables``: how to name the driver's tables."""
    known = {t: t for t in TABLES} | (tables or {})
    wanted = set(names)
    for name in reversed(VIEWS):
        if name in wanted:
            wanted |= {other for other in VIEWS if re.search(rf"\b{other}\b", VIEWS[name])}
    return "with " + ",\n".join(f"{n} as ({q.format(**known)})" for n, q in VIEWS.items() if n in wanted)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    paths = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(f"{ctes(name, tables=paths)}\nselect * from {name}")
