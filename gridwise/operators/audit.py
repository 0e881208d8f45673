"""Audit of many sheets against the master: drift of headers, completeness, duplicates, membership, inconsistent addresses.

Inputs are long: one DataFrame of all sheets with ``sheet`` and ``sheet_row``. A sheet's headers are a driver-side dict; a
column that a sheet lacks gives null (not 0) counts for it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import values as V
from ..sources import working
from . import headers as H
from . import keyed


@dataclass
class Names:
    """The audited columns' names in the long DataFrames."""

    id: str = "resident_id"
    zone: str = "zone"
    name: str = "resident_name"
    house: str = "house"
    street: str = "street"
    apn: str = "apn"
    damage: str = "damage"
    situs_house: str | None = None
    situs_street: str | None = None
    address: str | None = None
    master_headers: list[str] = field(default_factory=list)
    sheet_headers: Mapping[str, list[str]] = field(default_factory=dict)


def roster(master: DataFrame, n: Names = Names()) -> DataFrame:
    """zone, id: every pair that the master has; an id may be in two zones."""
    return master.select(V.text(F.col(n.zone)).alias("zone"), V.identity(F.col(n.id)).alias("id")).filter("zone <> '' and id <> ''").distinct()


def _shown(df: DataFrame, n: Names) -> Column:
    """A row's address as an audit shows it: house and street, as far as the table has them."""
    return F.trim(F.concat_ws(" ", *[V.text(F.col(c)) for c in (n.house, n.street) if c in df.columns]))


def _named(df: DataFrame, n: Names) -> Column:
    return V.text(F.col(n.name)) if n.name in df.columns else F.lit("")


def residents(master: DataFrame, n: Names = Names(), order: str = "src_row") -> DataFrame:
    """id, zone, name, address, row: the last row of each id."""
    rows = master.select(V.identity(F.col(n.id)).alias("id"), V.text(F.col(n.zone)).alias("zone"), _named(master, n).alias("name"), _shown(master, n).alias("address"), F.col(order).alias("row")).filter("id <> ''")
    return rows.groupBy("id").agg(F.max(F.struct("row", "zone", "name", "address")).alias("r")).select("id", "r.zone", "r.name", "r.address", "r.row")


def zones(sheets: DataFrame, n: Names = Names()) -> DataFrame:
    """sheet, zone: the most frequent zone of each sheet."""
    return keyed.mode(sheets, n.zone, "sheet_row").select("sheet", F.col(n.zone).alias("zone"))


def _ids(sheets: DataFrame, n: Names) -> DataFrame:
    """sheet, id, sheet_row, name, address: the last row of each id of a sheet."""
    rows = sheets.select("sheet", V.identity(F.col(n.id)).alias("id"), "sheet_row", _named(sheets, n).alias("name"), _shown(sheets, n).alias("address")).filter("id <> ''")
    return rows.groupBy("sheet", "id").agg(F.max(F.struct("sheet_row", "name", "address")).alias("r")).select("sheet", "id", "r.*")


def missing_rows(master: DataFrame, sheets: DataFrame, n: Names = Names()) -> DataFrame:
    """sheet, zone, resident_id, resident_name, address, master_row: on the zone's roster, not on its sheet; as the master has them."""
    expected = zones(sheets, n).join(roster(master, n), "zone")
    absent = expected.join(_ids(sheets, n).select("sheet", "id"), ["sheet", "id"], "left_anti")
    return absent.join(residents(master, n).drop("zone"), "id").select("sheet", "zone", F.col("id").alias("resident_id"), F.col("name").alias("resident_name"), "address", F.col("row").alias("master_row"))


def extra_rows(master: DataFrame, sheets: DataFrame, n: Names = Names()) -> DataFrame:
    """sheet, sheet_row, zone, resident_id, resident_name, address, reason, other_zone: on the sheet, not on its zone's roster; as the sheet has them."""
    placed = _ids(sheets, n).join(zones(sheets, n), "sheet")
    strangers = placed.join(roster(master, n), ["zone", "id"], "left_anti")
    known = strangers.join(residents(master, n).select("id", F.col("zone").alias("home")), "id", "left")
    reason = F.when(F.col("home").isNull(), "Not in master").otherwise("Wrong zone")
    other = F.when(F.col("home").isNull(), "").when(F.col("home") == "", "(unassigned)").otherwise(F.col("home"))
    return known.select("sheet", "sheet_row", "zone", F.col("id").alias("resident_id"), F.col("name").alias("resident_name"), "address", reason.alias("reason"), other.alias("other_zone"))


def duplicates(sheets: DataFrame, n: Names = Names()) -> DataFrame:
    """resident_id, scope, occurrences, sheet, sheet_row: every row of an id that occurs twice or more."""
    rows = sheets.select("sheet", "sheet_row", F.col(n.id).alias("raw")).filter(F.col("raw").isNotNull() & (F.col("raw") != "")).withColumn("resident_id", V.trim(F.col("raw").cast("string")))
    many = rows.groupBy("resident_id").agg(F.count("*").alias("occurrences"), (F.min("sheet") == F.max("sheet")).alias("one")).filter("occurrences > 1")
    scope = F.when(F.col("one"), "Within sheet").otherwise("Across sheets")
    return rows.join(many, "resident_id").select("resident_id", scope.alias("scope"), "occurrences", "sheet", "sheet_row")


def column_detail(sheets: DataFrame, columns: list[str], in_master: list[str]) -> DataFrame:
    """sheet, column, letter, in_master, non_blank, data_rows: strict blanks; one pass over the sheets."""
    counts = sheets.groupBy("sheet").agg(F.count("*").alias("data_rows"), *[F.count_if(~V.source_blank(F.col(c), V.kind_of(sheets.schema[c].dataType))).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("column"), F.lit(H.column_letter(k)).alias("letter"), F.lit(c in in_master).alias("in_master"), F.col(c).alias("non_blank")) for k, c in enumerate(columns)]
    return counts.select("sheet", "data_rows", F.inline(F.array(*cells))).select("sheet", "column", "letter", "in_master", "non_blank", "data_rows")


def missing_situs(sheets: DataFrame, n: Names = Names()) -> DataFrame:
    """sheet, sheet_row, resident_id, house, street, missing: rows where either is blank; an absent column is named."""

    def shown(name: str | None) -> Column:
        return V.text(F.col(name)) if name else F.lit("(column missing)")

    fields = [("house", n.situs_house or n.house), ("street", n.situs_street or n.street)]
    lacking = F.array_compact(F.array(*[F.when(shown(c) == "", F.lit(label)) for label, c in fields]))
    rows = sheets.select("sheet", "sheet_row", V.text(F.col(n.id)).alias("resident_id"), *[shown(c).alias(label) for label, c in fields], F.array_join(lacking, ", ").alias("missing"))
    return rows.filter("missing <> ''")


def _address(n: Names) -> Column:
    def cell(name: str | None) -> Column:
        return F.col(name) if name else F.lit("")

    return A.situs(cell(n.house), cell(n.street), cell(n.situs_house), cell(n.situs_street), cell(n.address))


def _addressed(sheets: DataFrame, n: Names) -> DataFrame:
    return sheets.select("sheet", "sheet_row", V.text(F.col(n.apn)).alias("apn"), _address(n).alias("a")).filter("a is not null")


def _mixed(n: Column, with_apn: Column) -> Column:
    return (with_apn > 0) & (with_apn < n)


def apn_inconsistencies(sheets: DataFrame, n: Names = Names()) -> DataFrame:
    """sheet, address, data_rows, with_apn, without_apn, apns, sheet_rows, reason: addresses of two rows or more that don't agree.

    Whether an address agrees is seen from numbers and from its least and greatest parcel number; rows are only listed of
    addresses that don't. ``apn_rows`` has these rows one by one, for addresses that very many rows share.
    """
    rows = apn_rows(sheets, n)
    mixed, several = _mixed(F.col("data_rows"), F.col("with_apn")), F.col("lo") != F.col("hi")
    reason = F.array_join(F.array_compact(F.array(F.when(mixed, "Mixed completeness"), F.when(several, "Multiple APNs"))), " + ")
    lists = rows.groupBy("sheet", "key", "address", "data_rows", "with_apn", "lo", "hi").agg(F.array_sort(F.collect_set(F.when(F.col("apn") != "", F.col("apn")))).alias("apns"), F.array_sort(F.collect_list("sheet_row")).alias("rows"))
    return lists.select("sheet", "address", "data_rows", "with_apn", (F.col("data_rows") - F.col("with_apn")).alias("without_apn"), F.array_join("apns", ", ").alias("apns"), F.array_join(F.col("rows").cast("array<string>"), ", ").alias("sheet_rows"), reason.alias("reason"))


def apn_rows(sheets: DataFrame, n: Names = Names()) -> DataFrame:
    """sheet, key, address, data_rows, with_apn, lo, hi, sheet_row, apn: every row of an address whose rows don't agree."""
    rows = _addressed(sheets, n).select("sheet", "sheet_row", "apn", "a.key", "a.display")
    given = F.when(F.col("apn") != "", F.col("apn"))
    counted = rows.groupBy("sheet", "key").agg(F.min_by("display", "sheet_row").alias("address"), F.count("*").alias("data_rows"), F.count(given).alias("with_apn"), F.min(given).alias("lo"), F.max(given).alias("hi"))
    odd = counted.filter((F.col("data_rows") >= 2) & (_mixed(F.col("data_rows"), F.col("with_apn")) | (F.col("lo") != F.col("hi"))))
    return rows.drop("display").join(odd, ["sheet", "key"]).select(*odd.columns, "sheet_row", "apn")


def status(lacking: list[str], extra: list[str], rows: int = 1) -> str:
    """A sheet's verdict from its headers."""
    if not rows:
        return "Empty"
    return "Missing + Extra" if lacking and extra else "Missing Columns" if lacking else "Extra Columns" if extra else "Match"


def facts(sheets: DataFrame, n: Names = Names()) -> DataFrame:
    """sheet, kind, key, n, first, a, b, lo, hi: what an audit counts, in one pass over the sheets.

    Each row stands for itself (kind ``row``), its zone, its id and its address; equal ones are counted in each task before they
    meet. a: rows with a parcel number; b: rows with damage; lo and hi: the least and the greatest parcel number.
    """
    apn, address = V.text(F.col(n.apn)), _address(n)
    given = F.when(apn != "", apn)

    def fact(kind: str, key: Column, a: Column, b: Column = F.lit(False)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), a.alias("a"), b.alias("b"))

    every = [
        fact("row", F.lit(""), ~V.source_blank(F.col(n.apn)), ~V.source_blank(F.col(n.damage))),
        F.when(V.text(F.col(n.zone)) != "", fact("zone", V.text(F.col(n.zone)), F.lit(False))),
        F.when(V.identity(F.col(n.id)) != "", fact("id", V.identity(F.col(n.id)), F.lit(False))),
        F.when(address.isNotNull(), fact("address", address["key"], given.isNotNull())),
    ]
    rows = sheets.select("sheet", "sheet_row", given.alias("_apn"), F.inline(F.array_compact(F.array(*every))))
    mine = F.when(F.col("kind") == "address", F.col("_apn"))
    return rows.groupBy("sheet", "kind", "key").agg(F.count("*").alias("n"), F.min("sheet_row").alias("first"), F.count_if("a").alias("a"), F.count_if("b").alias("b"), F.min(mine).alias("lo"), F.max(mine).alias("hi"))


def _counts(master: DataFrame, sheets: DataFrame, n: Names, order: str = "src_row") -> DataFrame:
    """The numbers of :func:`overview`: the sheets and the master are read once each, and their facts are written once.

    A sheet lacks the roster of its zone but for the ids that it shares with it, so no roster is laid out for each sheet.
    """
    seen = working.table(facts(sheets, n), "facts")
    zoned = V.text(F.col(n.zone))
    rows = master.select(V.identity(F.col(n.id)).alias("key"), zoned.alias("zone"), F.col(order).alias("row")).filter("key <> ''")
    known = working.table(rows.groupBy("key").agg(F.collect_set(F.when(F.col("zone") != "", F.col("zone"))).alias("zones"), F.max_by("zone", "row").alias("home")), "known")  # an id's zones
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    c = F.col
    disagree = (c("n") >= 2) & (_mixed(c("n"), c("a")) | F.coalesce(c("lo") != c("hi"), F.lit(False)))
    out = seen.groupBy("sheet").agg(
        F.sum(of("row", c("n"))).alias("data_rows"), F.sum(of("row", c("a"))).alias("apn_values"), F.sum(of("row", c("b"))).alias("damage_values"), F.count_if(of("address", c("a") < c("n"))).alias("addresses_missing_apn"),
        F.min(of("zone", keyed.mode_rank(c("key"), c("n"), c("first")))).alias("r"), F.count_if(of("address", disagree)).alias("apn_inconsistent"),
    ).select("*", c("r.v").alias("zone")).drop("r")
    sizes = known.select(F.explode("zones").alias("zone")).groupBy("zone").agg(F.count("*").alias("_size"))
    placed = seen.filter("kind = 'id'").select("sheet", "key").join(out.select("sheet", "zone").filter("zone is not null"), "sheet").join(known, "key", "left")
    on = F.coalesce(F.array_contains("zones", c("zone")), F.lit(False))
    members = placed.groupBy("sheet").agg(F.count_if(on).alias("_on"), F.count_if(c("home").isNull()).alias("extra_not_in_master"), F.count_if(~on & c("home").isNotNull()).alias("extra_wrong_zone"))
    out = out.join(members, "sheet", "left").join(sizes, "zone", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long")
    return out.select("sheet", "data_rows", "apn_values", "damage_values", "addresses_missing_apn", F.coalesce("zone", F.lit("")).alias("zone"), "apn_inconsistent", (zero("_size") - zero("_on")).alias("missing_rows"), zero("extra_not_in_master").alias("extra_not_in_master"), zero("extra_wrong_zone").alias("extra_wrong_zone"))


def overview(master: DataFrame, sheets: DataFrame, n: Names = Names()) -> DataFrame:
    """A row for each sheet: rows, completeness, zone, membership and drift."""
    out = _counts(master, sheets, n)
    own = [c for c in sheets.columns if c not in ("sheet", "sheet_row")]
    verdicts = {s: status(H.missing(h, n.master_headers), H.missing(n.master_headers, h)) for s, h in n.sheet_headers.items()}
    common = status(H.missing(own, n.master_headers), H.missing(n.master_headers, own))
    known = F.create_map(*[F.lit(x) for pair in verdicts.items() for x in pair]) if verdicts else None  # an entry a sheet
    return out.withColumn("status", F.coalesce(F.try_element_at(known, F.col("sheet")), F.lit(common)) if verdicts else F.lit(common))


def summary(master: DataFrame, sheets: DataFrame, n: Names = Names()) -> DataFrame:
    """One row of totals."""
    totals = overview(master, sheets, n).agg(
        F.count("*").alias("sheets_scanned"),
        F.count_if(F.col("status") == "Match").alias("sheets_matching"),
        F.count_if(F.col("status").isin("Missing Columns", "Extra Columns", "Missing + Extra")).alias("sheets_with_drift"),
        F.sum("data_rows").alias("total_data_rows"),
        F.sum("addresses_missing_apn").alias("addresses_missing_apn"),
        F.sum("apn_inconsistent").alias("apn_inconsistencies"),
        F.sum("missing_rows").alias("missing_rows"),
        F.sum("extra_not_in_master").alias("extra_not_in_master"),
        F.sum("extra_wrong_zone").alias("extra_wrong_zone"),
    )
    twice = duplicates(sheets, n).agg(F.countDistinct("resident_id").alias("duplicate_ids"))
    situs = missing_situs(sheets, n).agg(F.count("*").alias("missing_situs"))
    parts = totals.unionByName(twice, allowMissingColumns=True).unionByName(situs, allowMissingColumns=True)  # a row each
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def full_overview(master: DataFrame, sheets: DataFrame, n: Names, statuses: DataFrame) -> DataFrame:
    """A row for each sheet of a folder with all sixteen fields; sheets that can't be read (ERROR) or are empty have null counts.

    ``statuses``: sheet, url, error. Null is what a shown report calls N/A.
    """
    spark = master.sparkSession
    rows = [(s, len([x for x in h if x]), H.missing(h, n.master_headers), [x for x in H.missing(n.master_headers, h)]) for s, h in n.sheet_headers.items()]
    heads = spark.createDataFrame(rows, "sheet string, total_columns int, missing_columns array<string>, extra_columns array<string>")  # a row a sheet
    counts = _counts(master, sheets, n)
    out = statuses.select("sheet", "url", "error").join(heads, "sheet", "left").join(counts, "sheet", "left")
    lacking, extra, bad, empty = F.size("missing_columns") > 0, F.size("extra_columns") > 0, F.col("error") != "", F.col("data_rows").isNull()
    verdict = F.when(bad, "ERROR").when(empty, "Empty").when(lacking & extra, "Missing + Extra").when(lacking, "Missing Columns").when(extra, "Extra Columns").otherwise("Match")
    none = bad | empty
    zero = {"data_rows": F.coalesce("data_rows", F.lit(0)), "apn_inconsistent": F.coalesce("apn_inconsistent", F.lit(0)), "zone": F.coalesce("zone", F.lit("")), "total_columns": F.when(none, 0).otherwise(F.col("total_columns"))}
    lists = {c: F.when(none, "").otherwise(F.array_join(c, ", ")) for c in ("missing_columns", "extra_columns")}
    return out.withColumn("status", verdict).withColumns(zero | lists)


def full_summary(full: DataFrame, sheets: DataFrame, n: Names = Names(), skipped: str = "") -> DataFrame:
    """One row of fourteen totals over :func:`full_overview`; ``skipped``: why row membership wasn't looked at, if it wasn't."""
    s = F.col("status")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("data_rows", "total_data_rows"), ("addresses_missing_apn", "addresses_missing_apn"), ("apn_inconsistent", "apn_inconsistencies"), ("missing_rows", "missing_rows"), ("extra_not_in_master", "extra_not_in_master"), ("extra_wrong_zone", "extra_wrong_zone"))]
    totals = full.agg(
        F.count("*").alias("sheets_scanned"), F.count_if(s == "ERROR").alias("sheets_with_errors"), F.count_if(s == "Empty").alias("sheets_empty"), F.count_if(s == "Match").alias("sheets_matching"),
        F.count_if(s.isin("Missing Columns", "Extra Columns", "Missing + Extra")).alias("sheets_with_drift"), *sums,
    )
    twice = duplicates(sheets, n).agg(F.countDistinct("resident_id").alias("duplicate_ids"))
    situs = missing_situs(sheets, n).agg(F.count("*").alias("missing_situs"))
    parts = totals.unionByName(twice, allowMissingColumns=True).unionByName(situs, allowMissingColumns=True)  # a row each
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns]).withColumn("skipped_because", F.lit(skipped))


def master_columns(master: DataFrame, headers: list[str]) -> DataFrame:
    """position (from 1), letter, column of the master's headers."""
    return master.sparkSession.createDataFrame([(k + 1, H.column_letter(k), h) for k, h in enumerate(headers)], "position int, letter string, column string")


def count_true(sheets: DataFrame, column: str) -> DataFrame:
    """sheet, n: cells that are a boolean true."""
    return sheets.groupBy("sheet").agg(F.count_if(V.strictly_true(F.col(column), V.kind_of(sheets.schema[column].dataType))).alias("n"))


def same_ids(sheets: DataFrame, master: DataFrame, n: Names = Names()) -> DataFrame:
    """sheet, same: whether a sheet has exactly the ids of its zone's roster."""
    theirs = _ids(sheets, n).select("sheet", "id", F.lit(1).alias("here"))
    ours = zones(sheets, n).join(roster(master, n), "zone").select("sheet", "id", F.lit(1).alias("there"))
    both = theirs.join(ours, ["sheet", "id"], "full")
    return both.groupBy("sheet").agg(F.count_if(F.col("here").isNull() | F.col("there").isNull()).alias("odd")).select("sheet", (F.col("odd") == 0).alias("same"))


def report(master: DataFrame, sheets: DataFrame, n: Names = Names()) -> dict[str, DataFrame]:
    """The eight tables of an audit by name."""
    columns = [c for c in sheets.columns if c not in ("sheet", "sheet_row")]
    return {
        "overview": overview(master, sheets, n),
        "column_detail": column_detail(sheets, columns, n.master_headers),
        "duplicates": duplicates(sheets, n),
        "missing_rows": missing_rows(master, sheets, n),
        "extra_rows": extra_rows(master, sheets, n),
        "missing_situs": missing_situs(sheets, n),
        "apn_inconsistencies": apn_inconsistencies(sheets, n),
        "summary": summary(master, sheets, n),
    }
